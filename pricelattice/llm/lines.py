"""Line dedup by content-defined chunks of lines and by every two neighbouring lines.

A rolling hash over the hashes of each two neighbouring lines chooses chunk ends (about one line in DIVISOR), so inserting or deleting
lines moves no boundary but the nearest. Chunk ends seldom fall on both ends of a passage that stands in otherwise different documents,
so each two neighbouring lines are a passage of their own: a run of two lines or more that is said again is covered by such pairs from end
to end, wherever it begins. Chunks count beside them where they hold two neighbouring lines without a word, which make no pair. Passages
with a word are named by a 128-bit digest of their bytes. A name that occurs more than once keeps its first occurrence, by (doc_id,
line); the others are compared with the first one's bytes and, where equal, their lines go. Two occurrences of a pair of equal lines that
overlap the first are not a repeat. The first occurrence of a line always stays; of a passage, those lines that no earlier passage covers.

Lines are what "\\n" separates. Null text stays null and has no lines. A document is a doc_id with a text: rows equal in both count as
one (its first occurrences stay in each of them), several texts of one doc_id, or of none, as several, in the order of a hash; a null
doc_id is an id that sorts first; all columns of the input stay, with n_lines and n_removed added by
dedup_report(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pricelattice.llm.kernel import BLANK, combine, hash_spans, slices, text_buffers
from pricelattice.llm.store import written

DIVISOR = 4


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each line, line offsets by document); a document without bytes has no line."""
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    after = np.flatnonzero(data == 10) + 1
    first[after] = True
    # A newline at a document's very end opens an empty last line, which has no byte of its own and is left to the line before.
    start = np.flatnonzero(first[:-1])
    return start, np.searchsorted(start, bounds)


def chunks(data: np.ndarray, bounds: np.ndarray):
    """(document, first line, lines, first byte, end byte) arrays of chunks, and line offsets by document. The end leaves out the last
    newline of the chunk, so a chunk at a text's end equals one amid a text."""
    start, offsets = line_bounds(data, bounds)
    if not len(start):
        z = np.zeros(0, np.int64)
        return (z, z, z, z, z), offsets
    end = np.append(start[1:], len(data))
    newline = data[end - 1] == 10
    h = hash_spans(data, start, end, data != 10)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
    lead = np.ones(len(h), bool)
    lead[1:] = doc[1:] != doc[:-1]
    prev = np.concatenate([h[:1], h[:-1]])
    roll = combine(np.where(lead, np.uint64(0), prev), h)
    cut = (roll % np.uint64(DIVISOR) == 0) & ~lead
    cut[1:] &= ~cut[:-1]
    last = np.append(lead[1:], True)
    stop = np.flatnonzero(cut | last)
    begin = np.append(0, stop[:-1] + 1)
    return (doc[begin], begin - offsets[doc[begin]], stop - begin + 1, start[begin], end[stop] - newline[stop]), offsets


def passages(data: np.ndarray, bounds: np.ndarray):
    """(document, first line, lines, first byte, end byte, whether its two lines are equal) arrays of passages with a word, sorted by
    document and line; start of each line; line offsets by document."""
    (cdoc, cline, cn, ca, ce), offsets = chunks(data, bounds)
    start, _ = line_bounds(data, bounds)
    if not len(start):
        z = np.zeros(0, np.int64)
        return (z, z, z, z, z, z), start, offsets
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
    words = np.concatenate([[0], np.cumsum(~BLANK[data])])
    i = np.flatnonzero(doc[1:] == doc[:-1])
    some = words[end[i + 1]] > words[start[i]]
    none = np.zeros(len(doc) + 1, np.int64)
    none[i[~some] + 1] = 1
    none = np.cumsum(none)  # pairs without a word that begin before each line
    i = i[some]
    h = hash_spans(data, start, end, data != 10)
    even = (h[i] == h[i + 1]) & (end[i] - start[i] == end[i + 1] - start[i + 1])
    at = cline + offsets[cdoc]
    c = np.flatnonzero((cn > 2) & (words[ce] > words[ca]) & (none[at + cn - 1] > none[at]))
    cols = [(doc[i], cdoc[c]), (i - offsets[doc[i]], cline[c]), (np.full(len(i), 2), cn[c]), (start[i], ca[c]), (end[i + 1], ce[c]), (even, np.zeros(len(c), bool))]
    cols = [np.concatenate(x) for x in cols]
    order = np.lexsort((cols[2], cols[1], cols[0]))
    return tuple(x[order] for x in cols), start, offsets


def chunk_table(docs: DataFrame) -> DataFrame:
    """digest, doc_id, __pl_row, line, lines, even (two equal lines) of every passage."""
    docs = keyed(docs)
    schema = docs.select("doc_id", "__pl_row").schema.add("digest", "binary").add("line", "integer").add("lines", "integer").add("even", "boolean")

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            ids, own = b.column("doc_id"), b.column("__pl_row")
            for lo, hi in slices(off):
                part = data[off[lo] : off[hi]]
                (doc, line, n, a, e, even), _, _ = passages(part, off[lo : hi + 1] - off[lo])
                raw = part.tobytes()
                digest = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + lo)), own.take(pa.array(doc + lo)), pa.array(digest, pa.binary()), pa.array(line, pa.int32()), pa.array(n, pa.int32()), pa.array(even, pa.bool_())], names=schema.names)

    return docs.select("doc_id", "__pl_row", "text").mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds __pl_row, a hash of doc_id and text: what names a document, also where doc_id is null or has several texts. Were two texts to
    share it, the comparison of bytes at the places told would still keep lines that differ."""
    return docs.withColumn("__pl_row", F.xxhash64("doc_id", "text"))


def dedup_report(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of docs, with repeated passages removed from text, and the numbers of lines and of removed lines under `names`."""
    table = written(chunk_table(docs), "chunks")
    at = F.struct(F.isnotnull("doc_id").alias("known"), "doc_id", "__pl_row", "line", "lines")  # a null doc_id sorts first
    firsts = table.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("not first <=> last").select("digest", "first")
    firsts = written(firsts, "firsts")
    # Bytes of each first occurrence, cut from its own document.
    wanted = firsts.groupBy(F.col("first.__pl_row").alias("__pl_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), F.col("first.lines").alias("lines"), "digest")).alias("__pl_want"))
    docs = keyed(docs)
    cut = _apply(docs.select("__pl_row", "text"), wanted, _cut_bytes, "digest binary, bytes binary", [])
    bytes_of = written(cut.dropDuplicates(["digest"]), "bytes")  # so that a hot digest's partition of the next join can be split
    on_first = (F.col("line") == F.col("first.line")) | (F.col("even") & (F.col("line") == F.col("first.line") + 1))
    others = table.join(firsts, "digest").filter(~((F.col("__pl_row") == F.col("first.__pl_row")) & on_first))
    lists = others.join(bytes_of, "digest").groupBy(F.col("__pl_row").alias("__pl_id")).agg(F.collect_list(F.struct("line", "lines", "bytes")).alias("__pl_want"))
    keep = [c for c in docs.columns if c != "__pl_row"]
    schema = StructType([*docs.select(*keep).schema.fields, *[StructField(n, LongType()) for n in names]])
    return _apply(docs, lists, _remove, schema, keep)


def dedup(docs: DataFrame) -> DataFrame:
    """Documents without repeated passages; n_chars, where there is one, follows the text."""
    names = list(docs.columns)
    out = dedup_report(docs, ("__pl_lines", "__pl_removed"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__pl_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*names)


def _apply(docs: DataFrame, lists: DataFrame, f, schema, keep: list[str]) -> DataFrame:
    """Runs f on documents beside the list of passages that concern them."""
    how = "left" if keep else "inner"
    # A merge join at every size: the lists grow with the input, so they are never broadcast.
    j = docs.join(lists.hint("merge"), F.col("__pl_row") == F.col("__pl_id"), how).drop("__pl_id")

    def run(batches):
        for b in batches:
            yield from f(b, keep)

    return j.mapInArrow(run, schema)


def _slices_of(b):
    data, off = text_buffers(b.column("text"))
    for lo, hi in slices(off):
        part, bounds = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        c, start, offsets = passages(part, bounds)
        cut = np.searchsorted(c[0], np.arange(hi - lo + 1)).tolist()
        yield lo, hi, part, bounds, c, start, offsets, cut


def _places(line, n, lo: int, hi: int) -> dict:
    return {k: i for i, k in enumerate(zip(line[lo:hi].tolist(), n[lo:hi].tolist(), strict=True), lo)}


def _cut_bytes(b, keep):
    for lo, hi, part, _, (_, line, n, a, e, _), _, _, cut in _slices_of(b):
        digest, raw = [], []
        for k, want in enumerate(b.column("__pl_want")[lo:hi].to_pylist()):
            place = _places(line, n, cut[k], cut[k + 1])
            for w in want:
                i = place.get((w["line"], w["lines"]))
                x = part[a[i] : e[i]].tobytes() if i is not None else b""
                if i is not None and hashlib.blake2b(x, digest_size=16).digest() == w["digest"]:
                    digest.append(w["digest"])
                    raw.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["digest", "bytes"])


def _remove(b, keep):
    for lo, hi, part, bounds, (_, line, n, a, e, _), start, offsets, cut in _slices_of(b):
        texts, removed, col = [], [], b.column("text")
        for k, want in enumerate(b.column("__pl_want")[lo:hi].to_pylist()):
            gone = np.zeros(offsets[k + 1] - offsets[k], bool)
            if want:
                place = _places(line, n, cut[k], cut[k + 1])
                for w in want:
                    i = place.get((w["line"], w["lines"]))
                    if i is not None and part[a[i] : e[i]].tobytes() == w["bytes"]:
                        gone[w["line"] : w["line"] + w["lines"]] = True
            if gone.any():
                ends = np.append(start[offsets[k] : offsets[k + 1]], bounds[k + 1])  # a line's newline goes with it
                texts.append(part[bounds[k] : bounds[k + 1]][np.repeat(~gone, np.diff(ends))].tobytes().decode("utf-8", "replace"))
            else:
                texts.append(col[lo + k].as_py())
            removed.append(int(gone.sum()))
        new = {"text": pa.array(texts, pa.string())}
        cols = [new[c] if c in new else b.column(c)[lo:hi] for c in keep]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64())], names=[*keep, "__n", "__r"])
