"""Source divergence audit: how far the term rates of every source lie from those of each other source of its language.

Terms are counted by (lang, source) group; a language keeps the terms of at least `least_docs` of its documents. With V kept terms and N
counts of them in a group, a term's rate there is p = 1 + floor(10^9 (count + 1) / (N + V)), and two rates p, q lie
f(p, q) = floor((p - q)^2 / q) apart. A pair of sources has the sum of f over all kept terms.

Heavy-light split of that sum, so that it is neither V x sources^2 nor all pairs of a term's groups. p0 is a group's rate of a term that
it lacks. Every pair starts with V f(p0, p0). A light term (in at most `heavy` groups of the language) corrects it where a group has it:
by group against all others' p0 from the numbers of its light terms by count, and once more for each pair of groups that share the term,
from its short posting list. Heavy terms go into dense numpy tiles, TERMS terms by two blocks of SOURCES groups, whose differences to
f(p0, p0) are summed. All partial sums are integers below 2^63: rates of a group sum to 10^9 + V at most, so their squares stay under
1.2 * 10^18 while V is under 10^8.

Null text, lang and source count as ''. Rows count as documents one by one; doc_id is not read; other columns are ignored. A language
without kept terms has pairs of value 0 and no term rows; a single source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.llm.kernel import Spans, slices, text_buffers
from pricelattice.llm.store import written

TOP, LEAST_DOCS, HEAVY, TERMS, SOURCES, SLICE = 200, 3, 4, 512, 128, 1 << 21
#: Bytes outside terms: all ASCII but letters.
_GAP = np.ones(256, bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sum of their weights, number of their items)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)
    return key[first], total, np.diff(np.append(first, len(key)))


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term by lang and source; a row with term '' for every group that occurs. Summed by slice only."""

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column("text"))
            data = _LOW[data]
            group = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"]).to_pylist()
            names: dict[tuple, int] = {}
            of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group], np.int64)
            known = list(names)
            for lo, hi in slices(off, SLICE):
                part = data[off[lo] : off[hi]]
                w = Spans(part, off[lo : hi + 1] - off[lo], _GAP)
                ends = pa.py_buffer(np.append(0, np.cumsum(w.end - w.start)).astype(np.int64).tobytes())
                terms = pa.Array.from_buffers(pa.large_string(), len(w), [None, ends, pa.py_buffer(part[w.word].tobytes())]).dictionary_encode()
                code, size = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms.dictionary))
                in_doc, n, _ = _sums(w.of() * size + code, np.ones(len(w), np.int64))
                key, n, docs_of = _sums(of[lo:hi][in_doc // size] * size + in_doc % size, n)
                who = np.append(key // size, np.unique(of[lo:hi]))
                blank = len(who) - len(key)
                term = pa.concat_arrays([terms.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array([""] * blank, pa.string())])
                zero = np.zeros(blank, np.int64)
                lang, source = (pa.array([known[k][i] for k in who.tolist()], pa.string()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.append(n, zero)), pa.array(np.append(docs_of, zero))], names=["lang", "source", "term", "n", "docs"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, COUNTS)


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), without overflow; null where there are no terms."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", whole, total + terms))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(counts: DataFrame, least_docs: int) -> DataFrame:
    """Kept terms by group: n, its sum over the language (all), the number of groups that have it, and whether this group is the least."""
    w = Window.partitionBy("lang", "term")
    seen = counts.filter("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(w).alias("held"), F.sum("n").over(w).alias("all"), F.count(F.lit(1)).over(w).alias("groups"), (F.col("source") == F.min("source").over(w)).alias("lead"))
    return seen.filter(F.col("held") >= least_docs).drop("held")


def group_table(counts: DataFrame, kept: DataFrame, heavy: int) -> DataFrame:
    """A row a group: N (own), V and N of its language, number of groups and of heavy terms there, p0, and its block of sources."""
    langs = kept.filter("lead").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_n"), F.count_if(F.col("groups") > heavy).alias("dense"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    every = counts.filter("term = ''").select("lang", "source")
    size = every.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    out = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(size, "lang").na.fill(0, ["own_n", "v", "lang_n", "dense"])
    blocks = F.ceil(F.col("size") / SOURCES).cast("int")
    return out.withColumn("p0", rate(F.lit(0), F.col("own_n"), F.col("v"))).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), blocks).cast("int")).withColumn("parts", F.ceil(F.col("dense") / TERMS).cast("int"))


def tile_sums(tile: pa.Table) -> pa.Table:
    """Sums over a tile's terms of f(p, q) - f(p0, q0), for each ordered pair of groups of its two blocks."""
    t = tile.combine_chunks()
    source, term = t.column("source").to_numpy(zero_copy_only=False), t.column("term")
    names, who = np.unique(source.astype(str), return_inverse=True)
    head = np.array(term.is_null())
    p0, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    p = t.column("p").to_numpy()
    p0[who[head]], block[who[head]] = p[head], t.column("block").to_numpy()[head]
    code = term.filter(pa.array(~head)).combine_chunks().dictionary_encode()
    n = len(code.dictionary)
    dense = np.tile(p0, (n, 1))
    dense[code.indices.to_numpy(zero_copy_only=False), who[~head]] = p[~head]
    left, right, total = [], [], []
    a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
    for x, y in {(a, b), (b, a)}:
        other = np.flatnonzero(block == y)
        q, q0 = dense[:, other], p0[other]
        for k in np.flatnonzero(block == x):
            d = dense[:, k : k + 1] - q
            value = (d * d // q).sum(0) - n * ((p0[k] - q0) ** 2 // q0)
            some = other != k
            left += [names[k]] * int(some.sum())
            right += names[other[some]].tolist()
            total.append(value[some])
    lang = [t.column("lang")[0].as_py()] * len(left)
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(left, pa.string()), "item": pa.array(right, pa.string()), "value": pa.array(np.concatenate(total) if total else [], pa.int64())})


def pair_sums(kept: DataFrame, groups: DataFrame, heavy: int) -> DataFrame:
    """lang, source, item, value of every ordered pair of groups of a language."""
    g = groups.select("lang", "source", "p0", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    differ = F.col("source") != F.col("item")
    base = g.join(other, "lang").filter(differ).select("lang", "source", "item", F.coalesce(F.col("v") * apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    rated = kept.join(groups, ["lang", "source"]).withColumn("p", rate(F.col("n"), F.col("own_n"), F.col("v")))
    light = rated.filter(F.col("groups") <= heavy)
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    by_count = light.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k")).join(other, "lang").filter(differ)
    both_ways = F.array(
        F.struct(F.col("source").alias("s"), F.col("item").alias("i"), (F.col("k") * (apart(p, q0) - apart(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("s"), F.col("source").alias("i"), (F.col("k") * (apart(q0, p) - apart(q0, p0))).alias("value")),
    )
    alone = by_count.select("lang", F.explode(both_ways).alias("x")).select("lang", F.col("x.s").alias("source"), F.col("x.i").alias("item"), "x.value")
    shared = light.filter("groups > 1").select("lang", "term", "source", "p", "p0")
    mate = shared.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    q = F.col("q")
    together = shared.join(mate, ["lang", "term"]).filter(differ).select("lang", "source", "item", (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value"))
    # Tiles: a heavy posting goes to each pair of blocks that has its own; a row without a term tells every tile of its groups and their p0.
    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    dense = rated.filter(F.col("groups") > heavy).select("lang", "source", "term", "p", "block", "blocks", part.alias("part"))
    heads = groups.filter("parts > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tiles = dense.unionByName(heads).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "part", "source", "term", "p", "block", F.least("block", "x").alias("a"), F.greatest("block", "x").alias("b"))
    tiled = tiles.groupBy("lang", "part", "a", "b").applyInArrow(tile_sums, "lang string, source string, item string, value bigint")
    return base.unionByName(alone).unionByName(together).unionByName(tiled).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, heavy: int = HEAVY) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: the distance of a source to each other source of its language, and the
    `top` terms that it has oftener than its language."""
    counts = written(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    kept = written(postings(counts, least_docs), "postings")
    groups = written(group_table(counts, kept, heavy), "term_groups")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(kept, groups, heavy).withColumn("rank", F.row_number().over(first)).withColumn("part", F.lit("pair"))
    p, q = rate(F.col("n"), F.col("own_n"), F.col("v")), rate(F.col("all"), F.col("lang_n"), F.col("v"))
    terms = kept.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*cols).unionByName(terms.select(*cols))
