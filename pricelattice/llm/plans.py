"""The registered queries of the corpus operators and, where SQL can say them, their oracles. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.llm import alignment, ann, balance, codec, divergence, langid, lines, neardup, packing, quality, secrets, substrings, toxicity
from pricelattice.llm.store import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.tokenizer_paths()).drop("ids")


@query
def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(documents(spark, sf_dir), codec.vocabulary_path(), full=False)


@query
def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(documents(spark, sf_dir)).select(*cols)


@query
def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan(documents(spark, sf_dir))[0])


def remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string")) % by


@query
def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)
    s = toxicity.score(docs, net, ["doc_id", "lang"]).withColumn("threshold", toxicity.threshold(net, F.col("lang")))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return s.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, remainder(5) != 0)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.dedup_report(documents(spark, sf_dir))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 100 == 0, ann.index(vectors))


@query
def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


@query
def op13_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.mix(documents(spark, sf_dir))


@query
def op12_byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), alignment.paths(), full=False)


@query
def op11_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLES["op11_heavy_light"] = r"""
with d as (select row_number() over () i, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') as body from documents),
groups as (select distinct lang, source from d),
hits as (select i, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term from hits group by 1, 2 having count(distinct i) >= 3),
own as (select h.lang, h.source, h.term, count(*) n from hits h join kept using (lang, term) group by 1, 2, 3),
total as (select g.lang, g.source, coalesce(sum(n), 0) n from groups g left join own using (lang, source) group by 1, 2),
size as (select lang, count(*) v from kept group by 1),
p as (
  select t.lang, t.source, k.term, coalesce(o.n, 0) n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 1)) // (t.n + s.v)::hugeint p
  from total t join size s using (lang) join kept k using (lang) left join own o on o.lang = t.lang and o.source = t.source and o.term = k.term),
q as (
  select k.lang, k.term, 1 + (1000000000::hugeint * (sum(o.n) + 1)) // (x.n + s.v)::hugeint q
  from kept k join own o using (lang, term) join size s using (lang) join (select lang, sum(n) n from own group by 1) x using (lang) group by 1, 2, x.n, s.v),
pairs as (select a.lang, a.source, 'pair' part, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 4),
none as (select a.lang, a.source, 'pair' part, b.source item, 0 as value from groups a join groups b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from size)),
terms as (select lang, source, 'term' part, term item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) k from (select * from pairs union all select * from none union all select * from terms))
select lang, source, part, item, value::bigint as value, k::int as rank from ranked where part = 'pair' or k <= 200
"""
