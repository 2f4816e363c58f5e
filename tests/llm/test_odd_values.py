"""Null and repeated ids, with the values that they get, in line dedup, near-dedup and language id."""

import time
from collections import Counter

from pyspark.sql import functions as F

from pricelattice.llm import kernel, langid, lines, neardup

BODY = "\n".join(f"sentence {i} of a passage that is said twice" for i in range(4))


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(None, f"own start\n{BODY}"), (None, f"{BODY}\nown end"), (1, BODY), (1, BODY), (1, f"other text of one\n{BODY}"), (2, "alone\nand alone"), (3, None), (4, "a\na\na")]
    out = lines.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = Counter((r.doc_id, r.n_removed, r.text) for r in out)
    # One of the two null rows says it first (by the hash of the row) and keeps it; every other document loses the passage.
    nulls = sorted(k[1] for k in kept if k[0] is None)
    assert nulls == [0, 4] and {k[2] for k in kept if k[0] is None and k[1] == 4} <= {"own start\n", "own end"}
    assert kept[1, 4, ""] == 2 and kept[1, 4, "other text of one\n"] == 1
    assert kept[2, 0, "alone\nand alone"] == 1 and kept[3, 0, None] == 1 and kept[4, 0, "a\na\na"] == 1 or kept[4, 1, "a\na"] == 1


def test_equal_rows_keep_what_they_say_first(spark):
    rows = [(5, BODY)] * 3 + [(6, BODY)]
    out = lines.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_removed) for r in out) == {(5, 0): 3, (6, 4): 1}


def test_half_null_ids_cost_no_more(spark):
    """Each null row is a document of its own: the same work as with ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    half = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))

    def took(d):
        t = time.perf_counter()
        lines.dedup_report(d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    took(docs)
    assert min(took(half) for _ in range(2)) <= 2 * min(took(docs) for _ in range(2)) + 1


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near, far = text.replace("word30", "other"), " ".join(f"else{i}" for i in range(60))
    rows = [(None, text), (None, near), (7, text), (7, far), (7, far), (9, far + " more"), (None, None), (8, "")]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {(None, 7, 1): 2, (7, 7, 1): 3, (9, 7, 1): 1, (None, None, 0): 1, (8, 8, 0): 1}


def test_language_of_null_and_repeated_ids(spark):
    rows = [(i, f"the cat and the dog number {i} went home", "en") for i in range(60)] + [(i, f"der Hund und die Katze Nummer {i} gingen heim", "de") for i in range(60)]
    rows += [(None, "the cat and the dog went", None), (None, "der Hund und die Katze", None), (3, "der Hund und die Katze gingen", None), (None, None, "en"), (3, "  ", "de")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.text): r.lang_pred for r in langid.predict(d, langid.train(d, F.lit(True)), ["doc_id", "text"]).collect()}
    assert got[None, "the cat and the dog went"] == "en" and got[None, "der Hund und die Katze"] == "de" and got[3, "der Hund und die Katze gingen"] == "de"
    assert got[None, None] == got[3, "  "] == "und"


def test_word_hashes_are_independent():
    import numpy as np

    data = np.frombuffer(b"one two one three", np.uint8)
    s = kernel.Spans(data, np.array([0, len(data)]))
    a, b = s.hashes(), s.hashes(other=True)
    assert a[0] == a[2] and b[0] == b[2] and len(set(a.tolist()) & set(b.tolist())) == 0
    assert (kernel._BYTE != kernel._OTHER).all()
