"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Counts of every text are made once and written as a narrow table. Per (lang, source) each measure has a quantile sketch: counts of values
by logarithmic bins, (GAMMA ** (b - 1), GAMMA ** b] being bin b and zero a bin of its own. Such sketches are aggregated map side first, so
a hot source sends each task's few bins; they merge by adding counts, have a relative error of GAMMA - 1 at most and depend on the data
alone, not on its order or partitions. Merged sketches of the language and of everything stand in where a group has fewer than MIN_GROUP
documents that pass the base rules. A document is kept if no measure lies above its group's fence: median + SPREAD x (90th percentile -
median) + slack, quantiles being the upper ends of their bins. The verdict joins the fences back on (lang, source).

Null text has no words (base_failed); null lang or source is a group of its own; repeated rows and null or repeated doc_id are judged
row by row; extra columns are ignored; an empty table gives no rows; if all documents fail the base rules there are no fences and none is
kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.llm.store import written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MIN_GROUP, SPREAD, GAMMA = 50, 100, 4.0, 1.005
#: Bin of zero, below all others.
ZERO = -1_000_000
#: Measures and the slack that each fence has.
MEASURES = {"symbol_share": 0.02, "word_length": 2.0, "dup_line_share": 0.10, "repeat_share": 0.10}


def words_of(text: Column) -> Column:
    t = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(t) > 0, F.split(t, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(hashes: Column, n: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more. Windows are sorted by hash, equal neighbours give positions, and the
    union of [p, p + 3) is a sum over sorted positions: n log n for any text."""
    window = lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("p"))
    return F.when(n >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), window)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("_t"))
    d = d.withColumn("_w", words_of(F.col("_t"))).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    d = d.select(
        "doc_id", "lang", "source",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    d = d.withColumn("_s", repeated_words(F.col("_h"), F.size("_h")))
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    zero = F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(-3).alias("at"))
    covered = F.aggregate("_p", zero, lambda a, p: F.struct((a["c"] + F.least(F.lit(3), p - a["at"])).alias("c"), p.alias("at")))["c"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_h", "_s", "_p")


def with_measures(f: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    f = f.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return f.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "word_length": share("word_chars", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
    })


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n of the documents that pass the base rules."""
    one = lambda m: F.struct(F.lit(m).alias("measure"), F.when(F.col(m) > 0, F.ceil(F.log(F.col(m)) / math.log(GAMMA)).cast("int")).otherwise(ZERO).alias("bin"))
    d = measured.filter("not base_failed").select("lang", "source", F.inline(F.array(*[one(m) for m in MEASURES])))
    return d.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, mid, high of sketches merged over all but `keys`. A window holds the bins of one sketch: their number is
    bounded by the range of a measure."""
    own = [*keys, "measure"]
    merged = sketch.groupBy(*own, "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy(*own)))
    value = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("bin")))
    end = lambda b: F.when(b == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), b))
    return ranked.groupBy(*own).agg(F.first("total").alias("total"), value(0.5).alias("mid"), value(0.9).alias("high")).withColumns({"mid": end(F.col("mid")), "high": end(F.col("high"))})


def fences(measured: DataFrame) -> DataFrame:
    """lang, source, level (0 own group, 1 language, 2 all) and the upper fence of each measure."""
    sketch = written(sketches(measured), "sketches")

    def level(keys: list[str], prefix: str) -> DataFrame:
        """One row per group: its size and fences."""
        q = quantiles(sketch, keys)
        fence = lambda m, slack: F.max(F.when(F.col("measure") == m, F.col("mid") + SPREAD * (F.col("high") - F.col("mid")) + slack)).alias(prefix + m)
        g = q.groupBy(*keys).agg(F.first("total").alias(prefix + "n"), *[fence(m, slack) for m, slack in MEASURES.items()])
        return g.withColumnsRenamed({k: prefix + k for k in keys})

    own, lang, every = level(["lang", "source"], "o_"), level(["lang"], "l_"), level([], "a_")
    j = own.join(lang, F.col("o_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    pick = F.when(F.col("o_n") >= MIN_GROUP, 0).when(F.col("l_n") >= MIN_GROUP, 1).otherwise(2)
    of = lambda m: F.when(F.col("level") == 0, F.col("o_" + m)).when(F.col("level") == 1, F.col("l_" + m)).otherwise(F.col("a_" + m))
    return j.withColumn("level", pick).select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), "level", *[of(m).alias("max_" + m) for m in MEASURES])


def judge(docs: DataFrame) -> DataFrame:
    """Features, measures, fences and `kept` of every document."""
    f = with_measures(written(features(docs), "features"))
    t = fences(f).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    j = f.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.coalesce(F.col(m) <= F.col("max_" + m), F.lit(True))
    return j.withColumn("kept", ~F.col("base_failed") & within)
