"""TF-IDF vectors of names and the exact join of names by cosine.

A name is a bag of words; equal bags are one vector with a number of rows. Words weigh tf * (ln(N / df) + 1) over all rows of both sides,
vectors have length 1, and words stand in one order everywhere, the rarest first.

Join. What is left of a vector after a prefix of its words has a length; where that is below the threshold, no other vector of length 1
can reach the threshold through the rest alone. So two vectors that reach it share a word of their prefixes, the shortest ones with such
a rest. Prefixes hold the rare words, and most common words never become keys. Where a word is nevertheless in over `hot` prefixes, its
block is split by classes of weight: for classes whose greatest weights are a and b, the rest must still give threshold - a * b, and by
the same argument two vectors share a second word of the prefix of the rest for that. Only classes that reach the threshold by the one
word are compared whole, and of those nearly every pair is a result. Where two vectors meet, the words by which they meet and the lengths
of what is left of both after them bound their product; a pair below the threshold by that goes at once. (At the first words that they
share the bound holds, and there they do meet.)

Null and empty texts, and texts of stop words alone, have no vector and no pairs. Rows with equal bags are members of one name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.functions.text import norm_key

#: Turkish words that say nothing of a product.
STOP_WORDS = ("ve", "ile", "veya", "için", "bir", "adet", "yeni", "çok", "the", "and", "of", "with")
HOT, STEP, SLACK = 200, 1.25, 1e-9


def words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of a text: folded to lower case, letters and digits only, without stop words; in text order, with repeats."""
    w = F.filter(F.split(F.regexp_replace(norm_key(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")
    return F.filter(w, lambda x: ~x.isin(*stop)) if stop else w


def bags(left: DataFrame, right: DataFrame | None, text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """bag (its words in order, joined by blanks), left_rows, right_rows: the number of rows of each side with that bag."""
    rows = left.select(F.col(text).alias("text"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    if right is not None:
        rows = rows.unionByName(right.select(F.col(text).alias("text"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    texts = rows.groupBy("text").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))  # copies are counted before any word is cut
    bag = F.array_join(F.array_sort(words(texts["text"], stop)), " ").alias("bag")
    return texts.select(bag, "l", "r").groupBy("bag").agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))


def vectors(b: DataFrame) -> DataFrame:
    """bag, left_rows, right_rows, v: array of (df, word, w), rarest word first."""
    rows = F.coalesce("left_rows", F.lit(0)) + F.coalesce("right_rows", F.lit(0))
    total = b.agg(F.sum(rows)).scalar()
    tf = b.filter("bag <> ''").select("bag", "left_rows", "right_rows", rows.alias("rows"), F.explode(F.split("bag", " ")).alias("word"))
    tf = tf.groupBy("bag", "left_rows", "right_rows", "rows", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.sum("rows").alias("df"))
    raw = tf.join(df, "word").withColumn("w", F.col("tf") * (F.log(total / F.col("df")) + 1))
    v = raw.groupBy("bag", "left_rows", "right_rows").agg(F.array_sort(F.collect_list(F.struct("df", "word", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return v.withColumn("n", norm).withColumn("v", F.transform("v", lambda x: F.struct(x["df"].alias("df"), x["word"].alias("word"), (x["w"] / F.col("n")).alias("w")))).drop("n")


def postings(vec: DataFrame) -> DataFrame:
    """A row a word of a vector: pos, word, w, rest (squared length from this word on)."""
    rows = vec.select("bag", (F.col("left_rows") > 0).alias("l"), (F.col("right_rows") > 0).alias("r"), F.posexplode("v").alias("pos", "x")).select("bag", "l", "r", "pos", F.col("x.word").alias("word"), F.col("x.w").alias("w"))
    onward = Window.partitionBy("bag").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(onward))


KEY = ["word", "second", "low", "high"]
MEMBER = ["bag", "l", "r", "own", "w1", "w2", "tail"]


def block_keys(rows: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """KEY and MEMBER: two vectors are candidates if their KEYs agree and one has own = low, the other own = high. w1, w2: weights of the
    word and the second word; tail: squared length after them."""
    prefix = rows.filter(F.col("rest") >= threshold * threshold - SLACK)
    kind = F.floor(-F.log("w") / math.log(STEP) + SLACK).cast("int")
    prefix = prefix.withColumn("own", F.greatest(kind, F.lit(0))).withColumn("w1", F.col("w")).withColumn("after", F.greatest(F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0)))
    sizes = prefix.groupBy("word").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("own")).alias("kinds"))
    prefix = prefix.join(sizes, "word")
    zero = F.lit(0)
    one_word = [F.lit("").alias("second"), F.lit(0.0).alias("w2"), F.col("after").alias("tail")]
    cold = prefix.filter(F.col("size") <= hot).select("bag", "l", "r", "word", zero.alias("low"), zero.alias("high"), zero.alias("own"), "w1", *one_word)
    split = prefix.filter(F.col("size") > hot).withColumn("other", F.explode("kinds"))
    top = lambda c: F.pow(F.lit(1 / STEP), F.col(c))
    split = split.withColumn("need", threshold - top("own") * top("other")).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    alone = split.filter(F.col("need") <= SLACK).select("bag", "l", "r", "word", "low", "high", "own", "w1", *one_word)
    later = rows.select("bag", F.col("pos").alias("pos2"), F.col("word").alias("second"), F.col("w").alias("w2"), F.col("rest").alias("rest2"))
    two = split.filter(F.col("need") > SLACK).join(later, "bag").filter((F.col("pos2") > F.col("pos")) & (F.col("rest2") >= F.col("need") * F.col("need") - SLACK))
    two = two.withColumn("tail", F.greatest(F.col("rest2") - F.col("w2") * F.col("w2"), F.lit(0.0)))
    return cold.select(*KEY, *MEMBER).unionByName(alone.select(*KEY, *MEMBER)).unionByName(two.select(*KEY, *MEMBER))


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two vectors, summed in the common order of words."""
    at = F.map_from_arrays(F.transform(b, lambda x: x["word"]), F.transform(b, lambda x: x["w"]))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(at, x["word"]), F.lit(0.0)))


def similar_bags(vec: DataFrame, threshold: float, both_sides: bool, hot: int = HOT) -> DataFrame:
    """bag_a, bag_b, similarity of every two different bags of at least `threshold`, bag_a < bag_b; where both_sides, of a left and a
    right one."""
    keys = block_keys(postings(vec), threshold, hot)
    side = lambda x, own: keys.filter(f"own = {own}").select(*KEY, *[F.col(c).alias(c + x) for c in MEMBER])
    bound = F.col("w1x") * F.col("w1y") + F.col("w2x") * F.col("w2y") + F.sqrt(F.col("tailx") * F.col("taily"))
    met = side("x", "low").join(side("y", "high"), KEY).filter((F.col("bagx") != F.col("bagy")) & (bound >= threshold - SLACK))
    if both_sides:
        met = met.filter("(lx and ry) or (rx and ly)")
    pairs = met.select(F.least("bagx", "bagy").alias("bag_a"), F.greatest("bagx", "bagy").alias("bag_b")).distinct()
    a, b = vec.select(F.col("bag").alias("bag_a"), F.col("v").alias("va")), vec.select(F.col("bag").alias("bag_b"), F.col("v").alias("vb"))
    scored = pairs.join(a, "bag_a").join(b, "bag_b").withColumn("similarity", dot(F.col("va"), F.col("vb")))
    return scored.filter(F.col("similarity") >= threshold - SLACK).select("bag_a", "bag_b", "similarity")


def tfidf_names(df: DataFrame, text: str, threshold: float, stop: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Pairs of different names of one table: bag_a, bag_b, similarity, rows_a, rows_b. Copies are counted, not multiplied out."""
    vec = vectors(bags(df, None, text, stop))
    n = vec.select("bag", "left_rows")
    out = similar_bags(vec, threshold, False, hot)
    for side in "ab":
        out = out.join(n.select(F.col("bag").alias(f"bag_{side}"), F.col("left_rows").alias(f"rows_{side}")), f"bag_{side}")
    return out


def tfidf_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, threshold: float, stop: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """left_id, right_id, similarity of every left and right row whose names reach the threshold (equal bags have 1)."""
    vec = vectors(bags(left, right, text, stop))
    pairs = similar_bags(vec, threshold, True, hot)
    pairs = pairs.unionByName(pairs.select(F.col("bag_b").alias("bag_a"), F.col("bag_a").alias("bag_b"), "similarity"))
    same = vec.filter("left_rows > 0 and right_rows > 0").select(F.col("bag").alias("bag_a"), F.col("bag").alias("bag_b"), F.lit(1.0).alias("similarity"))
    bag = lambda df, name: F.array_join(F.array_sort(words(df[text], stop)), " ").alias(name)
    l, r = left.select(left_id, bag(left, "bag_a")), right.select(right_id, bag(right, "bag_b"))
    return l.join(pairs.unionByName(same), "bag_a").join(r, "bag_b").select(left_id, right_id, "similarity")
