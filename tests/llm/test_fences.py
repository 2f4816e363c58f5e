"""Adaptive quality: the verdict against fences computed in Python, whatever the order of the rows."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pricelattice.llm import quality


def made(spark):
    rng, rows = random.Random(11), []
    for k in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "web", None])
        words = [rng.choice("abcdefghij") * rng.randint(1, 12) + str(rng.randrange(10**6)) for _ in range(rng.randint(40, 90))]
        words += ["#$%" * rng.randint(1, 30)] * (rng.random() < 0.1) + ["x" * 400] * (rng.random() < 0.05) + ["say it again"] * rng.choice([0, 0, 0, 9])
        rows.append((k if k % 9 else None, " ".join(words) + "\nsame line" * rng.choice([0, 0, 0, 2, 6]), lang, source, 1.0))
    rows += [(5, "", "en", "hot", 1.0), (5, None, None, None, None), *rows[:20]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, max_word_length double")


def fence(values, slack):
    bins = sorted(quality.ZERO if v <= 0 else math.ceil(math.log(v) / math.log(quality.GAMMA)) for v in values)
    at = lambda q: bins[max(1, math.ceil(q * len(bins))) - 1]
    mid, high = (0.0 if b == quality.ZERO else quality.GAMMA**b for b in (at(0.5), at(0.9)))
    return mid + quality.SPREAD * (high - mid) + slack


def test_kept_follows_the_fences_of_each_group(spark):
    d = made(spark)
    rows = quality.judge(d).collect()
    groups = defaultdict(list)
    for r in rows:
        if not r.base_failed:
            for key in ((0, r.lang, r.source), (1, r.lang), (2,)):
                groups[key].append(r)
    assert any(len(groups[0, r.lang, r.source]) < quality.MIN_GROUP <= len(groups[1, r.lang]) for r in rows)
    verdicts = set()
    for r in rows:
        own = next((groups[k] for k in ((0, r.lang, r.source), (1, r.lang)) if len(groups[k]) >= quality.MIN_GROUP), groups[2,])
        want = not r.base_failed and all(r[m] <= fence([x[m] for x in own], slack) + 1e-9 for m, slack in quality.MEASURES.items())
        assert r.kept == want
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, False), (False, True)}
    cols = [c for c in rows[0].__fields__ if not c.startswith("_")]
    key = lambda rs: sorted(str([r[c] for c in cols]) for r in rs)
    assert key(quality.judge(d.repartition(7, F.rand(3))).collect()) == key(rows)


def test_sketch_is_within_its_error(spark):
    values = [random.Random(2).lognormvariate(0, 2) for _ in range(3000)]
    f = spark.createDataFrame([("en", "s", False, v, v, 0.0, v) for v in values], "lang string, source string, base_failed boolean, symbol_share double, word_length double, dup_line_share double, repeat_share double")
    got = {r.measure: r for r in quality.quantiles(quality.sketches(f), ["lang", "source"]).collect()}
    exact = sorted(values)
    for q, col in ((0.5, "mid"), (0.9, "high")):
        v = exact[math.ceil(q * len(exact)) - 1]
        assert v <= got["word_length"][col] * (1 + 1e-9) <= v * quality.GAMMA * (1 + 1e-6) and got["dup_line_share"][col] == 0


def test_all_rows_fail(spark):
    d = spark.createDataFrame([(1, "short", "en", "a"), (None, None, None, None)], "doc_id bigint, text string, lang string, source string")
    assert [r.kept for r in quality.judge(d).collect()] == [False, False]
