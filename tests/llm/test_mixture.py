"""Packing holds explicit targets, far from the natural shares, window by window and block by block."""

import random
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pricelattice.llm import packing


def corpus(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["price", "corn", "rain", "the", "of"]) for _ in range(rng.randint(1, 400))), rng.choice("aaab")) for i in range(2400)]
    rows += [(None, None, None), (7, "", "c"), (8, "word " * 30_000, "a"), *[(9, "said again and again", "a")] * 200]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def packed(d, **kw):
    return packing.pack(d, packing.tokenizer_paths(), block=1 << 16, bucket=1 << 14, **kw).drop("ids").collect()


def whole(rows, n_docs):
    rooms, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        rooms[r.sequence_id].append((r.offset, r.length, r.source))
        docs[r.doc_id, r.doc_tokens].append((r.start, r.length))
    assert sorted(rooms) == list(range(len(rooms)))
    for pieces in rooms.values():
        end = 0
        for o, n, _ in sorted(pieces, key=lambda p: p[:2]):
            assert o == end
            end += n
        assert end <= 2048
    assert sum(r.start == 0 for r in rows) == n_docs
    for (_, size), pieces in docs.items():
        assert sum(n for _, n in pieces) % size == 0
    return rooms


def test_targets_hold_in_every_window(spark):
    d = corpus(spark)
    rows = packed(d, targets={"a": 0.2, "b": 0.8})
    rooms = whole(rows, d.count())
    size = Counter()
    for r in rows:
        size[r.source] += r.length
    until = int(size["b"] / 0.8 // 2048)  # b runs dry here
    assert until > 64 and size["a"] > 2 * size["b"]
    block, run = 32, Counter()
    for w in range(until - block):
        own = Counter()
        for _, n, s in rooms[w]:
            own[s] += n
        run.update(own)
        if w % block < block - 2:  # the last windows of a block take what the grains left over
            assert abs(own["b"] - 0.8 * 2048) <= 2 * packing.GRAIN, w
        assert abs(run["b"] - 0.8 * 2048 * (w + 1)) <= 2 * packing.GRAIN + w // block
    assert {r.source for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))[-2:]} == {None, "c"}  # untargeted sources come last


def test_natural_shares_and_order_of_rows(spark):
    d = corpus(spark)
    rows = packed(d)
    whole(rows, d.count())
    key = lambda rs: sorted(map(str, rs))
    distinct = d.filter("doc_id <> 9 or doc_id is null").cache()
    assert key(packed(distinct.repartition(5, F.rand(1)))) == key(packed(distinct.coalesce(1)))
    assert packed(d.limit(0)) == []


def test_far_blocks_cost_as_much_as_near_ones():
    plan = packing.Plan(10**13, 1 << 21, {"=a": (0.2, 7 * 10**12), "=b": (0.8, 3 * 10**12)})
    for q, size in (("=a", 7 * 10**12), ("=b", 3 * 10**12)):
        began = time.time()
        for lo in range(0, size, size // 50):
            parts = plan.parts(q, size, lo, min(size, lo + (1 << 20)))
            assert parts[-1][1] == min(size, lo + (1 << 20)) and all(plan.edge(q, size, b) <= e for b, e in parts)
        assert time.time() - began < 1
        assert plan.edge(q, size, 0) == 0 and plan.edge(q, size, 10**13 // (1 << 21) + 1) == size
    b = 10**6
    assert abs(plan.edge("=b", 3 * 10**12, b) - 0.8 * b * (1 << 21)) <= 2
