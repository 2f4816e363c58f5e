"""Secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds (blob, rule_version) pairs that have been scanned,
with their findings. A run scans one representative row of each blob that the ledger lacks under the current rules, and joins all
findings, old and new, back to every path of their blob. The representative is the smallest doc_id of a blob; rows meet it on
(blob, doc_id), so a blob with very many copies is spread over tasks.

Spans are in code points, end exclusive. Null text is the empty text; repeated rows each get their blob's findings; null doc_id is a
path like others; extra columns are ignored; an empty table gives no rows and an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_VERSION, CHUNK = "2024-1", 256
FOUND = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"
#: kind, pattern, value group and least length of that group. A minimum length stands in the pattern only where runs of one class make
#: that the same as dropping short matches.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
]
BASE = ["assign", "access", "hex"]
#: Literals without which a rule cannot match: a cheap test before its pattern.
NEEDS = {"access": "AKIA", "pem": "PRIVATE KEY", "github": "_", "slack": "xox", "jwt": "eyJ"}


def in_chunks(items: Column, step, kind: str) -> Column:
    """(at, out) after step(acc, item) over all items. Every CHUNK items have a list of their own, joined to the whole one when it is full,
    so that a text with very many matches is not copied for each."""
    empty = F.array().cast(kind)

    def fold(it):
        starts = F.when(F.size(it) > 0, F.sequence(F.lit(0), F.size(it) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        join = lambda acc, p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out"))
        chunk = lambda acc, s: F.aggregate(F.slice(it, s + 1, CHUNK), F.struct(acc["at"].alias("at"), empty.alias("out")), step, lambda p: join(acc, p))
        return F.aggregate(starts, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), chunk)

    return F.transform(F.array(items), fold)[0]  # so that items are worked out once


def spans_of(text: Column, ordinal: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a rule's leftmost matches: the parts between matches (split) and the matches give positions by running lengths."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.zip_with(F.split(text, pattern), whole, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"))), value, lambda a, v: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), F.length(v).alias("value")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        hit = F.array(F.struct(start.alias("start"), F.lit(ordinal).alias("ord"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    test = text.rlike(pattern)
    test = text.contains(NEEDS[kind]) & test if kind in NEEDS else test
    return F.when(test, in_chunks(sizes, step, FOUND)["out"]).otherwise(F.array().cast(FOUND))


def versions(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, found) for every path, and the ledger with this run's pairs: (blob, rule_version, found).

    The caller keeps the ledger; pass it to the next run, which then scans new blobs only, or all of them under new rules.
    """
    v = versions(docs)
    reps = v.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    if ledger is not None:
        old = ledger.filter(F.col("rule_version") == rule_version).select("blob", "found").dropDuplicates(["blob"])
        reps = reps.join(old.select("blob"), "blob", "left_anti")
    r = reps.withColumnsRenamed({"blob": "_blob"})
    # A merge join at every size: representatives grow with the input, so they are never broadcast.
    todo = v.join(r.hint("merge"), (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    found = F.concat(*[spans_of(F.col("text"), i, *rule) for i, rule in enumerate(RULES)])
    fresh = todo.select("blob", F.array_sort(found).alias("found"))
    new = fresh.filter(F.size("found") > 0).dropDuplicates(["blob"])
    known = new
    if ledger is not None:
        known = new.unionByName(old.filter(F.size("found") > 0))
    by_path = v.select("doc_id", "blob").join(known, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
    seen = reps.select("blob").join(new, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("found", F.array().cast(FOUND)).alias("found"))
    return by_path, (seen if ledger is None else ledger.unionByName(seen))


def listing(found: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    own = found if kinds is None else F.filter(found, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(by_path: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base listing and the listing of all spans."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias("n_" + k)
    return by_path.select("doc_id", *[count(k) for k in BASE], F.sha2(listing(F.col("found"), BASE), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """Text with every span replaced by its kind in brackets; of spans that overlap the first names the place."""

    def step(acc, x):
        cut = F.array(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

    done = in_chunks(found, step, "array<string>")
    return F.when(F.size(found) > 0, F.transform(F.array(done), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))[0]).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with their secrets replaced; all columns stay and n_chars follows the text. Rows meet findings by blob, row by row."""
    found = scan(docs)[0].filter(F.size("found") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias("__pl_blob"), F.col("found").alias("__pl_found"))
    j = docs.withColumn("__pl_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).join(found, F.col("__pl_key") == F.col("__pl_blob"), "left")
    j = j.withColumn("text", F.when(F.col("__pl_found").isNotNull(), redacted(F.col("text"), F.col("__pl_found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.when(F.col("__pl_found").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return j.select(*docs.columns)
