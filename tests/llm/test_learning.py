"""The classifiers learn by training, from rows bounded in number, and odd rows have defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelattice.llm import langid, plans, toxicity
from pricelattice.llm.kernel import text_buffers

D = "/root/testdata/sf0.1"


def auc(bad, fine):
    order = np.argsort(np.concatenate([fine, bad]), kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    return (rank[len(fine) :].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(fine))


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    y = spark.read.parquet(f"{D}/labels.parquet").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.join(y, "doc_id").withColumn("held", plans.remainder(3) == 1).select("text", "lang", "toxic", "held").orderBy("doc_id").toArrow().to_pylist()
    return [r for r in rows if not r["held"]], [r for r in rows if r["held"]]


def held_auc(net, held):
    data, off = text_buffers(__import__("pyarrow").array([r["text"] for r in held]))
    s, y = net.scores(data, off), np.array([r["toxic"] for r in held])
    return auc(s[y == 1], s[y == 0])


def test_training_makes_the_network(labelled):
    train, held = labelled
    args = [r["text"] for r in train], np.array([r["toxic"] for r in train]), [r["lang"] for r in train]
    net = toxicity.fit(*args)
    assert held_auc(net, held) >= 0.93
    assert 0.4 < held_auc(toxicity.fit(*args, steps=0), held) < 0.6  # nothing but training tells the classes apart
    assert set(net.thresholds) == {"en", "de", "fr", "es"}


def test_sample_is_bounded_by_rows(spark):
    """One hot doc_id, null ids, repeated rows and long texts: distinct rows up to the quota, long ones too, no more."""
    rows = [(1, f"text {i % 300}", "en") for i in range(3000)] + [(None, f"null {i}", "en") for i in range(50)] + [(2, "long " * 30_000, "de")] * 3 + [(3, "x", f"l{i}") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    t = langid.sample(d, lambda k: k.withColumn("__pl_class", F.col("lang")), ["lang"], F.lit(40), 40, 1 << 20, 1).to_pylist()
    by = {}
    for r in t:
        by.setdefault(r["__pl_class"], []).append(r["text"])
    assert len(by) == 1502 and len(by["en"]) == len(set(by["en"])) == 40 and len(by["de"]) == 1
    assert langid.sample(d, lambda k: k.withColumn("__pl_class", F.col("lang")), ["lang"], F.lit(40), 40, 1 << 12, 1).num_rows == 1541  # one text of 150000 bytes is all that its class has


@pytest.mark.parametrize("rank", range(0, 21, 4))
def test_a_long_text_pushes_out_no_other(spark, rank):
    """Twenty short texts a class and a long one, at several ranks: nine or ten of ten stay, of both classes."""
    short = [(i, f"short text number {i} of many", c) for i in range(20) for c in ("a", "b")]
    d = spark.createDataFrame([*short, (100 + rank, "long " * 600 + str(rank), "a")], "doc_id bigint, text string, lang string")
    t = langid.sample(d, lambda k: k.withColumn("__pl_class", F.col("lang")), ["lang"], F.lit(10), 10, 2500, 1).to_pylist()
    n = [sum(r["__pl_class"] == c for r in t) for c in "ab"]
    assert n[0] in (9, 10) and n[1] == 10


def test_scores_of_odd_rows(spark):
    words = [("shout idiot fool", 1), ("calm day walk", 0)]
    rows = [(i, f"{words[i % 2][0]} n{i} m{i * 7}", "en", "a") for i in range(400)] + [(None, None, None, None), (7, "", "en", "a"), (7, "shout idiot fool", None, "b"), (7, "shout idiot fool", "en", "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)] + [(9, None), (None, 1)], "doc_id bigint, toxic int")
    net = toxicity.train(d, labels, F.lit(True))
    got = toxicity.score(d, net, ["doc_id", "text", "lang"], "s").collect()
    assert len(got) == len(rows)
    empty = {r.s for r in got if not r.text}
    again = {r.s for r in got if r.text == "shout idiot fool"}
    assert len(empty) == 1 and len(again) == 1 and again.pop() > 0.9 and empty.pop() < 0.9
    none = toxicity.train(d, labels.filter("toxic = 1"), F.lit(True))
    assert none is None and {r.s for r in toxicity.score(d, none, ["doc_id"], "s").collect()} == {0.0}


def test_every_labelled_row_teaches(spark, monkeypatch):
    """More rows of a class than a sample held: all of them lie in packs, once, and words of any pack are counted over all."""
    rows = [(i, f"{'shout fool' if i % 2 else 'calm walk'} n{i // 2000} w{i}", "en") for i in range(6000)]
    d = spark.createDataFrame(rows + rows[:50], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6000)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "PACK_ROWS", 1500)
    got = toxicity.packs(d, labels, F.lit(True)).select("pack", "n", "n_toxic").collect()
    assert len(got) == 4 and sum(r.n for r in got) == 6000 and sum(r.n_toxic for r in got) == 3000
    monkeypatch.setattr(toxicity, "STEPS", 600)
    nets = [toxicity.train(x, labels, F.lit(True)) for x in (d, d.repartition(3))]
    assert nets[0].empty == 0.5 and (nets[0].table == nets[1].table).all()
    s = {r.doc_id % 2: r.s for r in toxicity.score(d.filter("doc_id < 2"), nets[0], ["doc_id"], "s").collect()}
    assert s[1] > 0.9 and s[0] < 0.1


def test_a_pack_names_each_word_once(spark):
    """A pack's rows grow by a number a word, so an executor's memory holds packs of long texts; the words are those of the texts, in order."""
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(4000)) for i in range(1, 4)] + ["", None]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id bigint, toxic int")
    (p,) = toxicity.packs(d, labels, F.lit(True)).collect()
    assert p.n == 5 and len(p.a) + len(p.b) <= 8 * 50
    a, b, word, off = (np.frombuffer(p[c], np.int64 if c == "off" else np.int32) for c in ("a", "b", "word", "off"))
    got = sorted(tuple(zip(a[word[s:e]], b[word[s:e]], strict=True)) for s, e in zip(off[:-1], off[1:], strict=True))
    plain = [toxicity.word_rows(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for t in texts]
    assert got == sorted(tuple(zip(x, y, strict=True)) for x, y, _ in plain)
