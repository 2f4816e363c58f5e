"""Entropy balancing against plain Python: targets, tilted rates, copies."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from pricelattice.llm import balance, plans

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string"


def targets(size: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest, free = sum(size.values()) - most * sum(size[s] for s in full), sum(w[s] for s in names if s not in full)
        out = {s: Fraction(most * size[s]) if s in full else Fraction(rest * w[s], free) for s in names}
        more = {s for s in names if s not in full and out[s] > most * size[s]}
        if not more:
            return out
        full |= more


def tilt(sizes: list[int], goal: float, most=3) -> float | None:
    if goal >= most * sum(sizes):
        return None
    low, high = -100.0, 100.0
    for _ in range(300):
        t = (low + high) / 2
        given = sum(x * min(most, math.exp(min(50, t * x))) for x in sizes)
        low, high = (t, high) if given < goal else (low, t)
    return t


def hold(rows, docs):
    """docs: (doc_id, text, source)."""
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in docs)
    of = {d: s for d, _, s in docs}
    sizes, given, cells = defaultdict(list), Counter(), defaultdict(list)
    for d, t, s in docs:
        sizes[s].append(len(WORD.findall(t or "")))
    want = targets({s: sum(v) for s, v in sizes.items()})
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == sum(sizes[s]) and math.isclose(r.target, want[s], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        given[s] += r.taken
        cells[s, r.size].append(r.copies)
    for s in sizes:
        assert abs(given[s] - want[s]) <= max(sizes[s]), (s, given[s], want[s])
        t, ideal, passed = tilt([x for x in sizes[s] if x], float(want[s])), 0.0, 0
        for (_, x), c in sorted((k, v) for k, v in cells.items() if k[0] == s and k[1]):
            assert max(c) - min(c) <= 1  # alike but for the odd copies
            ideal += len(c) * (3.0 if t is None else min(3.0, math.exp(t * x)))
            passed += sum(c)
            assert abs(passed - ideal) <= 1.01 + balance.FIXES  # along the sizes, copies keep to the tilted rates


def test_query_mixes_to_targets(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    df = plans.op13_entropy_balance(spark, SF)
    assert [(c, t) for c, t in df.dtypes][:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    rows = df.collect()
    hold(rows, docs)
    off = {r.source_size: r.target for r in rows}
    for size, goal in off.items():
        assert abs(sum(r.taken for r in rows if r.source_size == size) - goal) <= 0.02 * goal + 5  # ten documents a source


@pytest.fixture(scope="module")
def odd():
    rows = [(i, "w " * (1 + i * i % 37), "abc"[i % 3] if i % 11 else None) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, " \n", "z"), (1003, "x " * 60_000, "a"), (1004, "one", "only")] + [(2000, "same words here", "b")] * 9
    return rows


def test_odd_rows_and_reruns(spark, odd, monkeypatch):
    monkeypatch.setattr(balance, "RANKED", 4)
    d = spark.createDataFrame(odd, SCHEMA)
    first = balance.mix(d).collect()
    hold(first, odd)
    again = balance.mix(spark.createDataFrame(odd[::-1], SCHEMA).repartition(5)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    assert balance.mix(d.limit(0)).count() == 0
    assert {r.taken for r in balance.mix(d.filter("doc_id in (1000, 1001)")).collect()} == {0}


def test_clashing_columns_null_ids_and_copies(spark):
    rows = [(None, "a b", "s", 7, 8, "q"), (None, "a b", "s", 7, 8, "q"), (None, "c d", None, None, 9, "r"), (5, "e", "s", 1, 1, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, copies int, __pl_m string")
    out = balance.mix(d, keep=["doc_id", "text", "n"])
    got = sorted((tuple(r) for r in out.collect()), key=str)
    # Seven words: s (5, null 2) has 5 of them and gets 5, null has 2 and gets 2.
    assert [(r[1], r[3], r[4], r[5], r[6]) for r in got] == [("e", 1, 5, 5.0, 1), ("a b", 2, 5, 5.0, 2), ("a b", 2, 5, 5.0, 2), ("c d", 2, 2, 2.0, 2)]
    assert balance.repeated(out).count() == 4 and set(balance.repeated(out).columns) == {*out.columns, "copy"}


def test_many_full_sources(spark):
    rows = [(i, "w " * (1 if i % 7 else 300), f"s{i % 40:02d}") for i in range(800)]
    hold(balance.mix(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
