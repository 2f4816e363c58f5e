"""Whole tables: queries whose older twin reads a slice, held against brute force."""

from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pricelattice.operators import joins, similarity, windows
from pricelattice.plans import catalog

SF = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_name_similarity_compares_every_part(spark):
    t = [(r["p_partkey"], r["p_brand"], set(r["p_name"].lower().split(" "))) for r in read("part")]
    want = {(a, b): round(len(v & w) / len(v | w), 6) for a, x, v in t for b, y, w in t if a < b and x == y and len(v & w) / len(v | w) >= 0.5}
    assert {(r.left_id, r.right_id): r.similarity for r in catalog.name_similarity_all(spark, SF).collect()} == want


def test_block_similarity_against_all_pairs(spark):
    words = "a b c d e f g".split()
    names = [" ".join(w for k, w in enumerate(words) if n >> k & 1) for n in range(1, 128, 3)] + ["", None, "A  b", "a b"]
    d = spark.createDataFrame([(i, "xy"[i % 2], n) for i, n in enumerate(names)], "l int, k string, n string")
    sets = [None if n is None else set(n.lower().split()) or {""} for n in names]
    for least in (0.3, 0.5, 2 / 3, 1.0):
        want = {(i, j) for i, v in enumerate(sets) for j, w in enumerate(sets) if v and w and (j - i) % 2 == 0 and len(v & w) / len(v | w) >= least}
        got = joins.block_similarity(d, d.withColumnRenamed("l", "r"), "l", "r", "n", least, ("k",)).collect()
        assert len(got) == len(want) and {(r.l, r.r) for r in got} == want


def test_copies_of_names_meet_as_lists(spark, monkeypatch):
    """Ids are paired after the last exchange, from lists that split where a set has many rows; null ids stay."""
    d = spark.createDataFrame([(i if i else None, "a b" if i % 2 else "a b c") for i in range(40)], "l int, n string")
    monkeypatch.setattr(joins, "ID_LIST", 3)
    got = joins.block_similarity(d, d.withColumnRenamed("l", "r"), "l", "r", "n", 0.5, digits=2)
    assert got.count() == 1600 and {(r.l, r.r) for r in got.collect()} == {(i or None, j or None) for i in range(40) for j in range(40)}
    assert {r.similarity for r in got.collect()} == {1.0, 0.67}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_of_r") < plan.index("explode(_of_l") < plan.index("Join")


def test_equal_titles_are_counted_before_words_are_cut(spark):
    d = spark.createDataFrame([("A b",)] * 5 + [("b  a",), (None,)], "t string")
    b = similarity.bags(d, None, "t")
    assert {(r.bag, r.left_rows) for r in b.collect() if r.bag} == {("a b", 6)}
    assert "Aggregate [text" in b._jdf.queryExecution().optimizedPlan().toString()


def test_clamped_balance_of_every_user(spark):
    day = defaultdict(float)
    for r in read("events"):
        day[r["user_id"], r["ts"].date()] += r["value"]
    want, state = {}, {}
    for u, at in sorted(day):
        state[u] = min(150.0, max(0.0, state.get(u, 75.0) + day[u, at] - 60))
        want[u, at] = state[u]
    got = {(r.user_id, r.day): r.state for r in catalog.clamped_balance_all(spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len({u for u, _ in got}) == len({r["user_id"] for r in read("events")})


def test_clamped_balance_of_a_long_series(spark):
    n = 200_000  # an array that is copied at every step would need 10^10 steps
    d = spark.range(n).select((F.col("id") % 2).alias("k"), "id", F.when(F.col("id") % 7 > 0, (F.col("id") * 7919) % 101 - 50.0).alias("d"))
    x = [75.0, 75.0]
    for i in range(n):
        x[i % 2] = min(150.0, max(0.0, x[i % 2] + (i * 7919 % 101 - 50.0 if i % 7 else 0.0)))
    out = windows.clamped_balance(d, ["k"], "id", F.col("d"))
    assert out.count() == n and [r.state for r in out.filter(f"id >= {n - 2}").orderBy("k").collect()] == x


def test_every_supplier_has_a_grid(spark):
    got = {r.s_suppkey: r.points for r in catalog.grid_generation_all(spark, "/root/testdata/sf0.01").collect()}
    keys = pq.read_table("/root/testdata/sf0.01/supplier.parquet")["s_suppkey"].to_pylist()
    assert got == {k: 6 * 5 for k in keys} and len(keys) > 20


def test_source_priority_reads_every_key(spark):
    a, b = defaultdict(list), defaultdict(list)
    for r in read("customer"):
        a[r["c_nationkey"]].append(r["c_acctbal"])
    for r in read("supplier"):
        b[r["s_nationkey"] + 10].append(r["s_acctbal"])
    want = {k: (max(v), "general") for k, v in b.items()} | {k: (max(v), "harvest") for k, v in a.items()}
    assert {r.k: (r.v, r.source) for r in catalog.source_priority_all(spark, SF).collect()} == want
    assert set(a) & set(b) and set(b) - set(a) and set(a) - set(b)
