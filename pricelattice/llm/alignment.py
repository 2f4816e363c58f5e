"""Cross-tokenizer alignment by labelled bytes.

Token ends of two vocabularies are written on a text's bytes, one label a byte: none, an end of A, an end of B, or both. A regular
expression scans the labels; each match runs up to a byte where both end, and the numbers of A and B labels in it say how many tokens of
each side form a group. A-B token pairs of one group are linked; how many documents hold an id pair linked is counted over the corpus.

Neither vocabulary has a token across a single blank between two visible characters, and both cut there; so a text is cut there too, each
distinct piece of a slice is encoded, labelled and scanned once, and documents are put together from pieces. Pieces are told apart by
their bytes. align() writes every document's links once, as numbers into the list of id pairs of its slice; only these lists go through
the shuffles that count pairs, and the counts come back to their slice. A slice holds SLICE bytes or one document.

Null or empty texts, and texts whose tokens' bytes differ from blank + text (a U+2581 in it, say), have no tokens: zeros and ''. Rows
count as documents one by one, repeated rows and null or repeated doc_id too; other columns are kept if named, else ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pricelattice.llm.kernel import slices, text_buffers
from pricelattice.llm.store import written

#: Bytes of a slice, pieces encoded in one call, links of a group that are written out one by one.
SLICE, BLOCK, MANY = 1 << 21, 256, 4096
#: Labels of a byte. A pair's key is A's id * SHIFT + B's id.
NONE, A_END, B_END, BOTH = b".abx"
_LABEL = np.frombuffer(bytes((NONE, A_END, B_END, BOTH)), np.uint8)
SPAN = re.compile(rb"[^x]*x")
SHIFT = 1 << 20
_TAIL = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single blanks between two characters of which neither is white space in any reading of Unicode."""
    i = np.flatnonzero(data == 0x20)
    i = i[(i > 0) & (i < len(data) - 1)]
    at = lambda k: data[np.clip(i + k, 0, len(data) - 1)]
    plain = lambda x: (x > 0x20) & (x != 0x7F)
    before, after, second, third = at(-1), at(1), at(2), at(3)
    white = (before >= 0x80) & _TAIL[before] & np.isin(at(-2), [0xC2, 0x80, 0x81, 0x9A, 0xA0])
    white |= (after == 0xC2) & np.isin(second, [0x85, 0xA0]) | (after == 0xE1) & np.isin(second, [0x9A, 0xA0])
    white |= (after == 0xE2) & np.isin(second, [0x80, 0x81]) & _TAIL[third] | (after == 0xE3) & (second == 0x80) & (third == 0x80)
    return i[plain(before) & plain(after) & ~white]


def labels(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> np.ndarray:
    """Labels of n bytes, from the end offsets of both sides' tokens."""
    mark = np.zeros(n, np.uint8)
    mark[a_ends - 1] = 1
    mark[b_ends - 1] |= 2
    return _LABEL[mark]


def groups(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B) of each group: spans up to a both-label, and the labels in them."""
    end = np.cumsum([len(s) for s in SPAN.findall(label.tobytes())], dtype=np.int64)
    both = label == BOTH
    return tuple(np.diff(np.cumsum(both | (label == own))[end - 1], prepend=0) for own in (A_END, B_END))


class Pieces:
    """Distinct pieces' tokens, groups and links, in flat arrays. `broken`: pieces whose tokens' bytes differ, which have none."""

    def __init__(self, count: np.ndarray, broken: np.ndarray, said: list[bytes], size: np.ndarray, keys: np.ndarray, times: np.ndarray):
        self.count, self.broken, self.said, self.size, self.keys, self.times = count, broken, said, size, keys, times


class Aligner:
    """Tokens, groups and links of pieces. A piece starts with a blank."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from pricelattice.llm.codec import byte_alphabet

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        own = {c: b for b, c in enumerate(byte_alphabet())}
        spelling = {i: s for s, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(own[c] for c in s) if all(c in own for c in s) else s.encode() for s in (spelling.get(i, "") for i in range(max(spelling) + 1))]
        # Where ids run in the order of merges, ranked bytes say the same and are faster. That is how files of this kind are made; else the file itself.
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in self.a.get_added_tokens_decoder()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(open(a_path, encoding="utf-8"))["model"]["merges"]]
        made = [self.a.token_to_id("".join(m)) for m in merges]
        in_order = made == list(range(256, 256 + len(made))) and len(ranks) == 256 + len(made)
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.size = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        # A token's number with what follows it: another of its side, the other side, the next group.
        self.said = [{sep: _objects([b"%d%c" % (i, sep) for i in range(len(t))]) for sep in b",|;"} for t in (self.a_bytes, self.b_bytes)]

    def tokens(self, blocks: list[bytes]) -> tuple[list, list]:
        texts = [x.decode("utf-8", "replace") for x in blocks]
        a = [self.fast.encode_to_numpy(t).tolist() for t in texts] if self.fast else [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)

    def same(self, block: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join([self.a_bytes[i] for i in a]) == block and b"".join([self.b_bytes[i] for i in b]) == block

    def encode(self, pieces: list[bytes]) -> Pieces:
        """Pieces are encoded in blocks: where one ends and the next begins, both vocabularies cut, or a block ends."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        together = np.zeros(len(data) + 1, bool)
        together[cuts(data)] = True
        firsts, blocks = [], []
        for k in range(n):
            if not firsts or not together[end[k - 1]] or k - firsts[-1] >= BLOCK:
                firsts.append(k)
        for x, y in zip(firsts, [*firsts[1:], n], strict=True):
            blocks.append(b"".join(pieces[x:y]))
        a, b = self.tokens(blocks)
        broken = np.zeros(n, bool)
        for k in [k for k in range(len(blocks)) if not self.same(blocks[k], a[k], b[k])]:
            x, y = firsts[k], firsts[k + 1] if k + 1 < len(firsts) else n
            own = list(zip(pieces[x:y], *self.tokens(pieces[x:y]), strict=True))
            whole = [self.same(*o) for o in own]
            broken[x:y] = ~np.array(whole)
            a[k], b[k] = ([t for o, ok in zip(own, whole, strict=True) if ok for t in o[side]] for side in (1, 2))
        ids = [np.array([t for block in x for t in block], np.int64) for x in (a, b)]
        # Places in the bytes of the pieces that hold.
        edge = np.cumsum(np.where(broken, 0, size))
        ends = [np.cumsum(self.size[side][ids[side]]) for side in (0, 1)]
        na, nb = groups(labels(*ends, int(edge[-1]) if n else 0))
        where = np.searchsorted(edge, ends[0][np.cumsum(na) - 1], "left") if len(na) else np.zeros(0, np.int64)
        place = np.searchsorted(where, np.arange(n + 1))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[place])
        count = np.stack([sums(na), sums(nb), sums(np.ones(len(na), np.int64)), sums(na * nb)], 1)
        said = self._said(ids, na, nb, np.append(0, np.cumsum(na + nb))[place].tolist())
        keys, times, of = _links(ids, na, nb)
        return Pieces(count, broken, said, np.bincount(where[of], minlength=n), keys, times)

    def _said(self, ids, na, nb, place) -> list[bytes]:
        """Group texts of pieces, each group closed by ';'."""
        group = [np.repeat(np.arange(len(k)), k) for k in (na, nb)]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        last = [np.zeros(len(x), bool) for x in ids]
        for x, k in zip(last, (na, nb), strict=True):
            x[np.cumsum(k) - 1] = True
        parts = [np.where(last[side], self.said[side][b"|;"[side]][ids[side]], self.said[side][ord(",")][ids[side]]) for side in (0, 1)]
        listed = np.concatenate(parts)[order].tolist()
        return [b"".join(listed[x:y]) for x, y in zip(place[:-1], place[1:], strict=True)]


def _links(ids, na, nb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair keys, times, group) of all links, group by group. Groups of over MANY links are summed by id first."""
    start = [np.cumsum(k) - k for k in (na, nb)]
    size = np.where(na * nb > MANY, 0, na * nb)
    of = np.repeat(np.arange(len(na)), size)
    within = _ragged(np.zeros(len(size), np.int64), size)
    key = ids[0][start[0][of] + within // nb[of]] * SHIFT + ids[1][start[1][of] + within % nb[of]]
    times = np.ones(len(key), np.int64)
    large = np.flatnonzero(na * nb > MANY)
    if len(large):
        more = []
        for g in large.tolist():
            (x, p), (y, q) = (np.unique(i[s[g] : s[g] + k[g]], return_counts=True) for i, s, k in zip(ids, start, (na, nb), strict=True))
            more.append(((x[:, None] * SHIFT + y).ravel(), (p[:, None] * q).ravel(), np.full(len(x) * len(y), g)))
        key, times, of = (np.concatenate([z, *(m[k] for m in more)]) for k, z in enumerate((key, times, of)))
        order = np.argsort(of, kind="stable")
        key, times, of = key[order], times[order], of[order]
    return key, times, of


def _objects(items: list) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out


_aligners: dict[tuple[str, str], Aligner] = {}


def _load(where: tuple[str, str]) -> Aligner:
    if where not in _aligners:
        _aligners[where] = Aligner(*where)
    return _aligners[where]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _slice(aligner: Aligner, data: np.ndarray, bounds: np.ndarray):
    """Counts of documents (n x 4), group texts (None without tokens), and their links: (document, pair number, times), sorted; pair keys."""
    n = len(bounds) - 1
    cut = np.zeros(len(data) + 1, bool)
    cut[cuts(data)] = True
    cut[bounds] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    offsets = pa.py_buffer(np.append(start, end[-1:] if len(end) else 0).astype(np.int64).tobytes())
    pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    code = pieces.indices.to_numpy(zero_copy_only=False)
    entry = aligner.encode(pieces.dictionary.to_pylist())
    at = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(n), np.diff(at))
    # A document that is only the blank put before it had no text.
    void = np.bincount(doc, entry.broken[code], n).astype(bool) | (np.diff(bounds) <= 1)
    total = np.zeros((n, 4), np.int64)
    for k in range(4):
        run = np.append(0, np.cumsum(entry.count[code, k]))
        total[:, k] = run[at[1:]] - run[at[:-1]]
    total[void] = 0
    listed, cut_at = code.tolist(), at.tolist()
    said = [None if void[k] else b"".join([entry.said[c] for c in listed[cut_at[k] : cut_at[k + 1]]])[:-1] for k in range(n)]
    size = entry.size
    keys, number = np.unique(entry.keys, return_inverse=True)
    live = ~void[doc]
    who, what = doc[live], code[live]
    take = _ragged((np.cumsum(size) - size)[what], size[what])
    both = np.repeat(who, size[what]) * max(1, len(keys)) + number[take]
    once = bool((entry.times == 1).all())
    order = None if once else np.argsort(both, kind="stable")
    both = np.sort(both) if once else both[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    if once:
        times = np.diff(np.append(first, len(both)))
    else:
        times = np.add.reduceat(entry.times[take][order], first) if len(first) else np.zeros(0, np.int64)
    both = both[first]
    return total, said, both // max(1, len(keys)), both % max(1, len(keys)), times, keys


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def linked(docs: DataFrame, where: tuple[str, str], keep: list[str], full: bool) -> DataFrame:
    """A row a document: `keep`, counts, groups_sha256 (and groups, if full), its slice, the pair numbers and times of its links; and a row
    a slice: its pair keys and the number of documents that hold each."""
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(f"__pl_{c}", "long")
    schema = schema.add("__pl_sha", "string").add("__pl_groups", "string").add("__pl_slice", "long").add("__pl_pair", "binary").add("__pl_times", "binary").add("__pl_keys", ArrayType(LongType())).add("__pl_held", ArrayType(LongType()))
    names = schema.names
    own = len(keep)

    def run(batches):
        from pyspark import TaskContext

        aligner, number = _load(where), TaskContext.get().partitionId() << 33
        for b in batches:
            col = pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(b.column("__pl_text"), ""), "")
            data, off = text_buffers(col)
            for lo, hi in slices(off, SLICE):
                n = hi - lo
                total, said, doc, pair, times, keys = _slice(aligner, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                held = np.bincount(pair, minlength=len(keys))
                bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
                raw_pair, raw_times = pair.astype("<u4").tobytes(), times.astype("<u4").tobytes()
                part = lambda raw: pa.array([raw[4 * x : 4 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())  # noqa: E731, B023
                sha = pa.array(["" if s is None else hashlib.sha256(s).hexdigest() for s in said])
                text = pa.array([("" if s is None else s.decode()) if full else None for s in said], pa.string())
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[lo:hi] for k in range(own)), *(pa.array(total[:, k]) for k in range(4)), sha, text, pa.array(np.full(n, number)), part(raw_pair), part(raw_times), none, none], names=names)
                one = [*(pa.nulls(1, b.column(k).type) for k in range(own)), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(one, names=names)
                number += 1

    return docs.select(*keep, F.col("text").alias("__pl_text")).mapInArrow(run, schema)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, count (documents of the corpus that hold it linked), best (whether no pair of its A id has a higher count)."""
    every = table.filter("__pl_keys is not null").select(F.explode(F.arrays_zip("__pl_keys", "__pl_held")).alias("x")).select(F.col("x.__pl_keys").alias("pair"), F.col("x.__pl_held").alias("held"))
    counts = every.groupBy("pair").agg(F.sum("held").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.expr(f"pair div {SHIFT}"))))


def align(docs: DataFrame, where: tuple[str, str], keep: list[str] | None = None, full: bool = True) -> DataFrame:
    """`keep` columns (doc_id), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if full, groups as text."""
    keep = keep or ["doc_id"]
    table = written(linked(docs, where, keep, full), "links")
    asked = table.filter("__pl_keys is not null").select(F.col("__pl_slice").alias("slice"), F.posexplode("__pl_keys").alias("pos", "pair"))
    told = asked.join(pair_counts(table), "pair").select("slice", "pos", "count", "best")
    rows = table.filter("__pl_keys is null").drop("__pl_keys", "__pl_held")
    if not full:
        rows = rows.drop("__pl_groups")
    schema = docs.select(*keep).schema
    for c in [*COUNTS, "n_best", "count_sum"]:
        schema = schema.add(c, "long")
    schema = schema.add("groups_sha256", "string")
    if full:
        schema = schema.add("groups", "string")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        count = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, bool)
        pos = right.column("pos").to_numpy()
        count[pos], best[pos] = right.column("count").to_numpy(), right.column("best").to_numpy()
        n_best, total = [], []
        for p, t in zip(left.column("__pl_pair").to_pylist(), left.column("__pl_times").to_pylist(), strict=True):
            p, t = np.frombuffer(p, "<u4"), np.frombuffer(t, "<u4").astype(np.int64)
            n_best.append(int(t[best[p]].sum()))
            total.append(int((t * count[p]).sum()))
        cols = [left.column(k) for k in range(len(keep))] + [left.column(f"__pl_{c}") for c in COUNTS]
        cols += [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), left.column("__pl_sha")]
        return pa.table(cols + ([left.column("__pl_groups")] if full else []), names=schema.names)

    return rows.groupBy("__pl_slice").cogroup(told.groupBy("slice")).applyInArrow(tell, schema)
