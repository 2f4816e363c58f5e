"""Rows of one doc_id with different texts: each keeps what nobody said before it."""

from pricelattice.llm import substrings


def said(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_rows_of_one_doc_id_are_cut_each_for_itself(spark):
    shared, own, tail = said("s", 60), said("u", 90), said("t", 40)
    rows = [(1, shared), (2, shared), (2, own), (2, tail + shared), (3, tail + shared + own), (None, shared)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.dedup(d).collect())
    assert got == sorted([(0, 60, 0, " ".join(shared)), (1, 60, 0, " ".join(shared)), (2, 60, 60, ""), (2, 90, 0, " ".join(own)), (2, 100, 60, " ".join(tail)), (3, 190, 190, "")])
