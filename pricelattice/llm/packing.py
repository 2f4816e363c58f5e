"""Mixture-controlled packing: deficit round-robin over source queues.

Documents become token ids once and are written to the shared folder. Each source is one queue, in the order of a hash of (doc_id, text).
A plan says how far each queue has got when the corpus has given g tokens: every source at its target share until it runs dry, then the
others at their shares among themselves; sources without a target follow last, at their natural shares. The plan cuts the queues into
blocks of BLOCK tokens, each with its exact part of every queue; so what one block owes a source and the next must make up is a fraction
of a token, whatever the number of blocks, and blocks run in parallel. Queue positions come from sums by bucket of a queue.

In a block, a window of 2048 tokens grants each queue its quantum (share x 2048); a queue sends its next piece (at most GRAIN tokens of
its head document) while its deficit covers it. What a queue was granted and did not send is its deficit and carries over to the next
window, as does, negative, what it sent ahead to fill the last one. A document that crosses the end of a block goes on in the next. All windows but the last of a block are full.

Null text counts as empty (its only id is the end id). Rows are not merged: repeated rows and null or repeated doc_id are packed row by
row. A null source is a queue of its own. Extra columns are ignored. An empty table gives no rows. The result depends on the rows alone,
not on their partitions, but for which of several equal rows comes first.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from pricelattice.llm.kernel import SpanCache, distinct, hash_spans, slices, text_buffers
from pricelattice.llm.store import written

WINDOW, GRAIN, BLOCK, BUCKET, END_ID = 2048, 256, 1 << 21, 1 << 20, 1
SPECIAL = b"<|endoftext|>"
_CACHE_MOST = 400_000


class ByteEncoder:
    """Ids of texts under the byte-level vocabulary, as the tokenizers library gives them.

    The library's pre-tokenizer always cuts before a single blank between two visible characters. So texts are cut there, each
    distinct piece (by 64-bit hash) is encoded once by the fast equivalent ranks, and documents are put together from pieces.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.size[v] = len(k)
        self.slow = Tokenizer.from_file(json_path)
        self.cache = SpanCache(_CACHE_MOST)
        visible = np.zeros(256, bool)
        visible[0x21:0x7F] = True
        self.visible = visible

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of pieces. A cut lies at a blank whose neighbours are visible ASCII or Latin-1 letters."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            latin = np.zeros(n, bool)
            latin[1:] = data[:-1] == 0xC3
            cut[1 : n - 1] = (data[1:-1] == 0x20) & (self.visible[data[:-2]] | latin[:-2]) & (self.visible[data[2:]] | (data[2:] == 0xC3))
        cut[bounds] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        some = end > start
        return start[some], end[some]

    def encode(self, raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Ids of pieces as little-endian 16-bit integers."""
        last = data[end - 1]
        safe = ((last >= 0x21) & (last < 0x7F)) | (data[np.maximum(end - 2, 0)] == 0xC3)
        safe &= (data[start] == 0x20) & (end - start > 1) & (data[np.minimum(start + 1, len(data) - 1)] > 0x20)
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if SPECIAL in raw:
            safe &= np.array([SPECIAL not in w for w in words], bool)
        out = np.empty(len(words), object)
        together = np.flatnonzero(safe)
        if len(together):  # each of these is cut off from the next by the pre-tokenizer, so one call encodes them all
            ids = self.fast.encode_to_numpy(b"".join([words[i] for i in together.tolist()]).decode("utf-8", "replace")).astype(np.int64)
            stop = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum((end - start)[together])) + 1
            all_ids, a = ids.astype("<u2").tobytes(), 0
            for i, b in zip(together.tolist(), (2 * stop).tolist(), strict=True):
                out[i] = all_ids[a:b]
                a = b
        for i in np.flatnonzero(~safe).tolist():
            text = words[i].decode("utf-8", "replace")
            ids = self.slow.encode(text, add_special_tokens=False).ids if SPECIAL in words[i] else self.fast.encode_ordinary(text)
            out[i] = np.array(ids, "<u2").tobytes()
        return out.tolist()

    def documents(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        start, end = self.pieces(data, bounds)
        if not len(start):
            return [b""] * (len(bounds) - 1)
        keys, first, cls = distinct(hash_spans(data, start, end, None))
        raw = data.tobytes()
        ids = self.cache.resolve(keys, lambda new: self.encode(raw, data, start[first[new]], end[first[new]]))
        at, pieces = np.searchsorted(start, bounds).tolist(), ids[cls].tolist()
        return [b"".join(pieces[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


_encoder: dict[tuple, ByteEncoder] = {}


def _load(paths: tuple[str, str, str]) -> ByteEncoder:
    if paths not in _encoder:
        _encoder[paths] = ByteEncoder(*paths)
    return _encoder[paths]


def tokenized(docs: DataFrame, paths: tuple[str, str, str], end_id: int = END_ID) -> DataFrame:
    """doc_id, source, queue (its name), key (a hash of doc_id and text), rid (a row number of its own), n, ids (16-bit little-endian, the
    end id included)."""
    docs = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("queue"), F.xxhash64("doc_id", "text").alias("key"), "text")
    schema = docs.drop("text").schema.add("rid", "long").add("n", "long").add("ids", "binary")
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches):
        from pyspark import TaskContext

        enc, rid = _load(paths), TaskContext.get().partitionId() << 33
        for b in batches:
            data, off = text_buffers(b.column("text"))
            for lo, hi in slices(off):
                ids = [x + tail for x in enc.documents(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])]
                n = pa.array([len(x) // 2 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c)[lo:hi] for c in schema.names[:4]), pa.array(range(rid, rid + hi - lo), pa.int64()), n, pa.array(ids, pa.binary())], names=schema.names)
                rid += hi - lo

    return docs.mapInArrow(run, schema)


class Plan:
    """How far each queue has got when `g` tokens are out. Targeted queues give target x v tokens by the time v, until they are dry."""

    def __init__(self, total: int, block: int, targets: dict[str, tuple[float, int]]):
        """targets: (share, tokens) by queue; queues without a target are not in it."""
        self.block = block
        part = sum(p for p, _ in targets.values())
        self.share = {q: p / part for q, (p, n) in targets.items() if p > 0 and n > 0}
        size = {q: targets[q][1] for q in self.share}
        self.main, self.rest = sum(size.values()), total - sum(size.values())
        self.time, self.out, rate = [0.0], [0.0], 1.0
        for q in sorted(self.share, key=lambda q: size[q] / self.share[q]):  # as they run dry
            self.time.append(size[q] / self.share[q])
            self.out.append(self.out[-1] + (self.time[-1] - self.time[-2]) * max(rate, 0.0))
            rate -= self.share[q]

    def edge(self, queue: str, size: int, b: int) -> int:
        """Tokens of a queue of `size` tokens that go before block b."""
        g = b * self.block
        if queue in self.share:
            return size if g >= self.main else min(size, int(self.share[queue] * float(np.interp(g, self.out, self.time))))
        return min(size, max(0, g - self.main) * size // max(1, self.rest))

    def parts(self, queue: str, size: int, lo: int, hi: int) -> list[tuple[int, int]]:
        """(block, end) of the parts that blocks take of positions lo to hi of a queue, in order."""
        if queue in self.share:
            g = float(np.interp(lo / self.share[queue], self.time, self.out))
        else:
            g = self.main + lo * self.rest / max(1, size)
        b = int(g // self.block)
        while b > 0 and self.edge(queue, size, b) > lo:
            b -= 1
        out = []
        while lo < hi:
            end = self.edge(queue, size, b + 1)
            end = end if (b + 1) * self.block < self.main + self.rest else size
            if end > lo:
                out.append((b, min(hi, end)))
                lo = min(hi, end)
            b += 1
        return out


def running(df: DataFrame, keys: list[str], at: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """df with the sum of `value` over the rows of equal keys whose integer `at` is smaller: sums of spans first, so that no task sorts
    more than a span of rows or one row for each span."""
    df = df.withColumn("_span", F.expr(f"{at} div {span}"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    heads = heads.withColumn("_head", F.coalesce(F.sum("_sum").over(upto(Window.partitionBy(*keys).orderBy("_span"))), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(value).over(upto(Window.partitionBy(*keys, "_span").orderBy(at))), F.lit(0))
    return df.withColumn("_own", own).join(heads, [*keys, "_span"]).withColumn(name, F.col("_head") + F.col("_own")).drop("_span", "_head", "_own")


def deficit_round_robin(lengths: list[int], source: list, share: dict, window: int = WINDOW, grain: int = GRAIN):
    """Pieces (row, start, length, window number, offset) of one block, in order. Every token is in one piece; only the last window may
    have room left. Each window grants `window` tokens in all; where no deficit covers a next piece, the largest one sends ahead."""
    queues: dict = {}
    for row, s in enumerate(source):
        queues.setdefault(s, deque()).append(row)
    ring = deque(sorted(queues, key=repr))
    owed, sent, number = dict.fromkeys(ring, 0.0), [0] * len(lengths), 0
    while ring:
        total = sum(share.get(s, 0.0) for s in ring)
        for s in ring:
            owed[s] += window * (share.get(s, 0.0) / total if total > 0 else 1 / len(ring))
        room = window
        while room and ring:
            ahead = max(ring, key=lambda s: (share.get(s, 0.0) > 0, owed[s]))
            turn = [s for s in ring if owed[s] >= grain] or [ahead]
            for s in turn:
                q = queues[s]
                while q and room:
                    row = q[0]
                    take = min(lengths[row] - sent[row], grain, room)
                    yield row, sent[row], take, number, window - room
                    owed[s] -= take
                    room -= take
                    sent[row] += take
                    if sent[row] == lengths[row]:
                        q.popleft()
                    if owed[s] < grain:
                        break
                if not q:
                    ring.remove(s)
            ring.rotate(-1)
        number += 1


def pack(docs: DataFrame, paths: tuple[str, str, str], targets: dict | None = None, window: int = WINDOW, grain: int = GRAIN, block: int = BLOCK, bucket: int = BUCKET, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, start, length, ids (binary, 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    targets: token share by source; by default each source's share of all tokens, so that all queues end together. Any target packs
    every token.
    """
    t = written(tokenized(docs, paths, end_id), "tokens")
    sizes = written(t.groupBy("queue").agg(F.sum("n").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    named = {("=" + str(k) if k is not None else ""): float(v) for k, v in (targets or {}).items()}
    held = {r.queue: r["size"] for r in sizes.filter(F.col("queue").isin(list(named))).collect()} if named else {}  # rows of given targets
    block = max(window, block // window * window)
    plan = Plan(total, block, {q: (p, held.get(q, 0)) for q, p in named.items()})

    # Equal rows have one key; where they fill more than a bucket, their row numbers deal them out.
    t = t.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "queue").withColumn("_salt", F.lit(0).cast("bigint"))
    heavy = written(t.groupBy("key").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows")).filter((F.col("_n") > bucket) & (F.col("_rows") > 1)).select(F.col("key").alias("_key")), "heavy")
    if heavy.limit(1).count():
        t = t.join(heavy, F.col("key") == F.col("_key"), "left").withColumn("_salt", F.when(F.col("_key").isNotNull(), F.col("rid")).otherwise(0)).drop("_key")
    t = t.withColumn("order", F.xxhash64("key", "_salt")).drop("_salt", "key")
    buckets = F.ceil(F.col("size") / bucket)
    t = t.withColumn("bucket", F.least(F.floor((F.shiftrightunsigned("order", 11) / float(1 << 53)) * buckets), buckets - 1).cast("bigint"))
    sums = running(t.groupBy("queue", "size", "bucket").agg(F.sum("n").alias("n")), ["queue"], "bucket", "n", "at")
    sums = written(sums, "buckets")

    def shares(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("queue", "size", "at", "n")), strict=True)
            cut = [(k, end - lo) for q, size, at, n in rows for lo, (k, end) in _with_start(plan.parts(q, size, at, at + n), at)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in cut], pa.int64()) for i in (0, 1)], names=["block", "n"])

    numbers = sums.mapInArrow(shares, "block long, n long").groupBy("block").agg(F.ceil(F.sum("n") / window).cast("bigint").alias("windows"))
    numbers = written(running(numbers, [], "block", "windows", "first_sequence").select("block", F.col("first_sequence").cast("bigint")), "blocks")
    tokens = {f.name: f.dataType for f in t.schema}
    schema = StructType([StructField("block", LongType()), StructField("queue", tokens["queue"]), StructField("x", LongType()), docs.schema["doc_id"], docs.schema["source"], StructField("start", LongType()), StructField("n", LongType()), StructField("doc_tokens", LongType()), StructField("ids", BinaryType())])

    def deal(rows: pa.Table, place: pa.Table) -> pa.Table:
        """The documents of a bucket, cut where the blocks of the plan begin."""
        rows = rows.sort_by([("order", "ascending"), ("rid", "ascending")])
        out, x = [], place.column("at")[0].as_py() if place.num_rows else 0
        for i, (q, size, n, raw) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("queue", "size", "n", "ids")), strict=True)):
            for lo, (k, end) in _with_start(plan.parts(q, size, x, x + n), x):
                out.append((i, k, lo, lo - x, end - lo, raw[2 * (lo - x) : 2 * (end - x)]))
            x += n
        at, k, lo, start, n, ids = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [], [], [])
        take, big = pa.array(at, pa.int64()), lambda v: pa.array(v, pa.int64())
        whole = lambda c: rows.column(c).take(take)
        return pa.table([big(k), whole("queue"), big(lo), whole("doc_id"), whole("source"), big(start), big(n), whole("n"), pa.array(ids, pa.binary())], names=schema.names)

    keys = ["queue", "bucket"]
    dealt = t.groupBy(*keys).cogroup(sums.select(*keys, "at").groupBy(*keys)).applyInArrow(deal, schema)
    result = docs.select("doc_id", "source").schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        result = result.add(name, kind)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, number: pa.Table) -> pa.Table:
        rows = rows.sort_by([("queue", "ascending"), ("x", "ascending")])
        n, src, raw, begin, x = (rows.column(c).to_pylist() for c in ("n", "queue", "ids", "start", "x"))
        share = plan.share
        if not any(q in share for q in src):  # no targets, or all targeted queues are dry: the block's own mixture
            share, every = {}, max(1, sum(n))
            for q, k in zip(src, n, strict=True):
                share[q] = share.get(q, 0) + k / every
        base = number.column("first_sequence")[0].as_py() if number.num_rows else 0
        out = list(deficit_round_robin(n, src, share, window, grain))
        row, start, length, window_of, offset = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [], [])
        ids = [np.frombuffer(raw[r], "<u2", k, 2 * a).astype("<u4").tobytes() for r, a, k in zip(row, start, length, strict=True)]
        take, big = pa.array(row, pa.int64()), lambda v: pa.array(v, pa.int64())
        whole = lambda c: rows.column(c).take(take)
        return pa.table([
            whole("doc_id"), whole("source"), big([begin[r] + a for r, a in zip(row, start, strict=True)]), big(length), pa.array(ids, pa.binary()), big([zlib.crc32(i) for i in ids]),
            whole("doc_tokens"), big([base + w for w in window_of]), big(offset),
        ], names=result.names)

    return dealt.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(run, result)


def _with_start(parts: list[tuple[int, int]], lo: int):
    """Each part beside its start."""
    for part in parts:
        yield lo, part
        lo = part[1]


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
