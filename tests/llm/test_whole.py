"""Corpus operators do the whole job on rows that share ids, texts or passages."""

import random

from pricelattice.llm import lines, neardup


def text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_one_row_of_each_group_and_no_other_text_lost(spark):
    near = text("c") + " more"
    rows = [(1, text("a"), "x"), (None, text("a"), "x"), (None, text("u"), "x")]  # a copy among null ids, beside a text of its own
    rows += [(4, text("b"), "x"), (5, text("b"), "x"), (5, text("v"), "x")]  # the same with a repeated id
    rows += [(7, text("c"), "x"), (7, text("c"), "y"), (7, text("c"), "y"), (7, near, "x")]  # copies and near copies that share an id
    rows += [(None, text("d"), "x"), (None, text("d"), "x"), (None, text("d") + " more", "x")]  # a group of null ids alone
    rows += [(None, "", "x"), (None, None, "x"), (None, None, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, root string")
    for part in (d, d.repartition(5)):
        got = [tuple(r) for r in neardup.keep_one(part).collect()]
        assert {(1, text("a"), "x"), (None, text("u"), "x"), (4, text("b"), "x"), (5, text("v"), "x"), (None, "", "x")} <= set(got)
        assert sum(i == 7 for i, _, _ in got) == 1 and sum((t or "").startswith("d0") for _, t, _ in got) == 1
        assert sum(t is None for _, t, _ in got) == 2 and len(got) == 9


def test_every_repeated_run_of_lines_goes(spark):
    """Runs of 2 to 6 lines inside otherwise different documents, against brute force over all pairs of lines."""
    rng = random.Random(7)
    shared = [f"shared sentence {i} of a passage" for i in range(40)]
    rows = []
    for k in range(60):
        x = []
        for p in range(5):
            at = rng.randrange(34)
            x += [f"only document {k} says {p} {q}" for q in range(rng.randint(1, 3))] + shared[at : at + rng.randint(2, 6)]
        rows.append((k, "\n".join([*x, f"end of {k}"])))
    rows += [(60, "a\na\na"), (61, "b\nb\nb\nb"), (62, "x\n\n\n\ny"), (63, "z\nx\n\n\n\ny"), (64, None), (65, "")]
    first, want = {}, {}
    for k, t in rows:
        x = (t or "").split("\n")
        gone = set()
        for i in range(len(x) - 1):
            at = first.setdefault((x[i], x[i + 1]), (k, i))
            if (x[i] + x[i + 1]).strip() and at != (k, i) and not (x[i] == x[i + 1] and at == (k, i - 1)):
                gone |= {i, i + 1}
        want[k] = None if t is None else [y for i, y in enumerate(x) if i not in gone]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.dedup_report(d.repartition(4)).collect()}
    for k, t in rows:
        if k == 63:  # the blank line between the pairs is left, or goes with a chunk
            assert [y for y in got[k].text.split("\n") if y] == ["z"]
        else:
            assert (got[k].text if want[k] is None else got[k].text.rstrip("\n").split("\n")) == (None if want[k] is None else "\n".join(want[k]).rstrip("\n").split("\n")), k
    assert sum(r.n_removed for r in got.values()) > 400
