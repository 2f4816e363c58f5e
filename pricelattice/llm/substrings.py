"""Substring dedup by recompression.

Rounds of recompression name runs of equal symbols and then pairs of neighbours (left half, right half by a bit of their names) with new
symbols. A name is a 64-bit hash of what it stands for, so equal content gets equal names in every document and every task: naming is
global without a dictionary. Each symbol carries the word interval on which it depends (itself and whatever neighbour could have changed
it). A symbol whose interval lies inside a window of words is part of that window wherever it occurs; the window's anchor is the symbol
of least hash at the highest round that has such a symbol. So two equal windows have the same anchor, and few anchors name most windows.

Runs of windows with one anchor form one row (anchor, doc_id, first window, windows, digest of their words). Anchors seen in two
documents are compared: rows with equal digests are copies, of which only the one of smallest doc_id is compared further, window by
window on a 64-bit hash of the words beside the 64-bit anchor; a window goes if a smaller doc_id has it. A passage in very many
documents thus costs each of them a row, and never a pair of documents. The anchor rests on one
hash of a word's bytes, the digest on another drawn apart from it; words are taken as equal if both are, 128 bits in all.

Words are `[^\\x20\\x09-\\x0D]+`. Null text has no words; rows of one doc_id count as one document, and what is found in one of them is cut
from a row only where that row has the same words; rows without doc_id keep all words and are no source of others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelattice.llm.kernel import Spans, combine, mix, slices, text_buffers
from pricelattice.llm.store import written

WIDTH, ROUNDS = 50, "RPPPPRPPPP"
#: Bytes of text worked on at once: all rounds of a slice are held together, some 100 bytes for each byte of text.
SLICE = 1 << 18
_Q = 0x9E3779B97F4A7C15
_QINV = pow(_Q, -1, 1 << 64)
_NEVER = 1 << 40


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class WindowHash:
    """Hash of any word interval of a slice, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(_Q, n), out=self.sum[1:])
        self.back = _powers(_QINV, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sum[b] - self.sum[a]) * self.back[a])


def levels(words: np.ndarray, doc: np.ndarray):
    """(name, dependence from, dependence to) of the symbols after each round, words first; dependence beyond a text's end is never met."""
    name, lo, hi = words, np.arange(len(words)), np.arange(len(words))
    yield name, lo, hi
    for number, kind in enumerate(ROUNDS):
        n = len(name)
        if n < 2:
            return
        same = doc[1:] == doc[:-1]
        left_lo = np.where(np.append(False, same), np.append(0, lo[:-1]), -_NEVER)
        right_hi = np.where(np.append(same, False), np.append(hi[1:], 0), _NEVER)
        if kind == "R":
            head = np.append(True, ~(same & (name[1:] == name[:-1])))
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, n))
            lo, hi = left_lo[at], right_hi[at + size - 1]
            name = np.where(size > 1, combine(name[at], size.astype(np.uint64)), name[at])
            doc = doc[at]
        else:
            right = (name >> np.uint64(7 * number % 61)) & np.uint64(1) == 1
            pair = same & ~right[:-1] & right[1:]
            first, second = np.append(pair, False), np.append(False, pair)
            new_lo = np.where(first, lo, np.where(right & ~second, np.minimum(lo, left_lo), lo))
            new_hi = np.where(~right & ~first, np.maximum(hi, right_hi), hi)
            i = np.flatnonzero(first)
            name = name.copy()
            name[i] = combine(name[i] + np.uint64(number), name[i + 1])
            new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
            keep = ~second
            name, lo, hi, doc = name[keep], new_lo[keep], new_hi[keep], doc[keep]
        yield name, lo, hi


def anchors(words: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, windows) of runs of windows with one anchor symbol. Windows count words of the slice."""
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    many = np.maximum(size - width + 1, 0)
    total = int(many.sum())
    empty = np.zeros(0, np.int64)
    if not total:
        return empty.astype(np.uint64), empty, empty, empty
    win = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[:-1], many)
    anchor, symbol = np.zeros(total, np.uint64), np.full(total, -1, np.int64)
    todo = np.arange(total)
    for number, (name, lo, hi) in reversed(list(enumerate(levels(words, doc)))):
        # Symbols that depend on a text's edge fit no window. The others have rising intervals.
        fit = np.flatnonzero((lo >= 0) & (hi < _NEVER) & (hi - lo < width))
        if not len(fit):
            continue
        flo, fhi, fname = lo[fit], hi[fit], name[fit]
        flo, fhi = np.maximum.accumulate(flo), np.minimum.accumulate(fhi[::-1])[::-1]
        a = np.searchsorted(flo, win[todo], "left")
        b = np.searchsorted(fhi, win[todo] + width - 1, "right")
        ok = b > a
        if not ok.any():
            continue
        order = np.argsort(mix(fname), kind="stable")
        rank = np.empty(len(fit), np.int64)
        rank[order] = np.arange(len(fit))
        span = (b - a)[ok]
        table = [rank]
        while (1 << len(table)) <= int(span.max()):
            t, h = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(t[: len(t) - h], t[h:]))
        level = np.log2(span).astype(np.int64)
        best = np.empty(len(span), np.int64)
        for k in range(len(table)):
            at = np.flatnonzero(level == k)
            if len(at):
                best[at] = np.minimum(table[k][a[ok][at]], table[k][b[ok][at] - (1 << k)])
        pick = order[best]
        hit = todo[ok]
        anchor[hit] = combine(fname[pick], np.full(len(pick), number, np.uint64))
        symbol[hit] = fit[pick] + (number << 40)
        todo = todo[~ok]
        if not len(todo):
            break
    wdoc = np.repeat(np.arange(len(size)), many)
    head = np.append(True, (symbol[1:] != symbol[:-1]) | (wdoc[1:] != wdoc[:-1]))
    at = np.flatnonzero(head)
    return anchor[at], wdoc[at], win[at], np.diff(np.append(at, total))


def _rows(b):
    data, off = text_buffers(b.column("text"))
    for lo, hi in slices(off, SLICE):
        yield lo, hi, Spans(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def occurrence_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, anchor, first (window of the document), windows, digest."""
    schema = docs.select("doc_id").schema
    for name, kind in (("anchor", "long"), ("first", "integer"), ("windows", "integer"), ("digest", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            for lo, _, s in _rows(b):
                words = s.hashes()
                anchor, doc, win, n = anchors(words, s.doc, width)
                digest = WindowHash(s.hashes(other=True)).of(win, win + n + width - 1)
                ids = b.column("doc_id").take(pa.array(doc + lo, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(anchor.view(np.int64)), pa.array((win - s.doc[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(digest.view(np.int64))], names=schema.names)

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, at, n, digest: runs of n windows from window `at`, with the digest of their words, that also start in a document of smaller doc_id."""
    occ = written(occurrence_table(docs, width), "occurrences")
    by_anchor = occ.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    # A table of its own, so that the join's two sides are plain exchanges, of which a hot anchor's partition can be split.
    shared = written(by_anchor.filter("lo < hi").select("anchor", (F.col("d0") != F.col("d1")).alias("mixed")), "shared_anchors")
    near = written(occ.join(shared, "anchor"), "shared")
    rep = written(near.groupBy("anchor", "digest").agg(F.min("doc_id").alias("rep")), "representatives")
    j = near.join(rep, ["anchor", "digest"])
    whole = j.filter("doc_id > rep").select("doc_id", F.col("first").alias("at"), F.col("windows").alias("n"), "digest")
    own = j.filter("doc_id = rep and mixed").groupBy("doc_id").agg(F.collect_list(F.struct("first", "windows", "anchor")).alias("want"))
    schema = docs.select("doc_id").schema.add("anchor", "long").add("words", "long").add("at", "integer")

    def run(batches):
        for b in batches:
            for lo, hi, s in _rows(b):
                h = WindowHash(s.hashes(other=True))
                doc, anchor, words, at = [], [], [], []
                for k in range(lo, hi):
                    w0, w1 = int(s.doc[k - lo]), int(s.doc[k - lo + 1])
                    for w in b.column("want")[k].as_py():
                        n = w["windows"]
                        if w0 + w["first"] + n + width - 1 > w1:
                            continue  # another row of this doc_id
                        a = np.arange(w0 + w["first"], w0 + w["first"] + n)
                        anchor.append(np.full(n, w["anchor"], np.int64))
                        words.append(h.of(a, a + width).view(np.int64))
                        at.append((a - w0).astype(np.int32))
                        doc.append(np.full(n, k))
                if words:
                    ids = b.column("doc_id").take(pa.array(np.concatenate(doc)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in (anchor, words, at))], names=schema.names)

    fine = written(docs.select("doc_id", "text").join(own.hint("merge"), "doc_id").mapInArrow(run, schema), "windows")
    first = fine.groupBy("anchor", "words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi")
    single = fine.join(first, ["anchor", "words"]).filter("doc_id > lo").select("doc_id", "at", F.lit(1).alias("n"), F.col("words").alias("digest"))
    return whole.unionByName(single)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one blank)."""
    gone = repeated(docs, width).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("at", "n", "digest")).alias("cut"))
    j = docs.select("doc_id", "text").join(gone.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def run(batches):
        for b in batches:
            for lo, hi, s in _rows(b):
                h = WindowHash(s.hashes(other=True))
                n, removed, kept = [], [], []
                raw = s.data.tobytes()
                for k in range(lo, hi):
                    w0, w1 = int(s.doc[k - lo]), int(s.doc[k - lo + 1])
                    words = [raw[x:y] for x, y in zip(s.start[w0:w1].tolist(), s.end[w0:w1].tolist(), strict=True)]
                    cut = 0
                    found = b.column("cut")[k]
                    if found.is_valid:
                        edge = np.zeros(w1 - w0 + 1, np.int64)
                        a, many, digest = (np.asarray(found.values.field(f), np.int64) for f in ("at", "n", "digest"))
                        e = a + many + width - 1
                        inside = np.flatnonzero(e <= w1 - w0)
                        a, e, digest = a[inside], e[inside], digest[inside]
                        here = h.of(w0 + a, w0 + e).view(np.int64) == digest
                        np.add.at(edge, a[here], 1)
                        np.add.at(edge, e[here], -1)
                        out = np.cumsum(edge)[:-1] > 0
                        cut = int(out.sum())
                        words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                    n.append(w1 - w0)
                    removed.append(cut)
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return j.mapInArrow(run, schema)
