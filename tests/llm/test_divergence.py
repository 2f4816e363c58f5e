"""The source divergence audit against plain Python with exact integers."""

import re
from collections import Counter, defaultdict

import pytest

from pricelattice.llm import divergence, plans
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200, least=3):
    count, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        c = Counter(TERM.findall((text or "").translate(LOW)))
        count[lang or "", source or ""] += c
        held[lang or ""].update(c.keys())
    out = set()
    for lang, docs in held.items():
        terms = [t for t, n in docs.items() if n >= least]
        groups = {s: c for (x, s), c in count.items() if x == lang}

        def rates(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(terms)) for t in terms}  # noqa: B023

        r = {s: rates(c) for s, c in groups.items()}
        q = rates(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(sum(f(r[s][t], r[o][t]) for t in terms), o) for o in groups if o != s]
            some = [(f(r[s][t], q[t]), t) for t in terms if groups[s][t] and r[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", some, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k) for k, (v, i) in enumerate(found[:most], 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()]


def test_query_equals_brute_force(spark, small):
    assert got(plans.op11_heavy_light(spark, SF)) == brute(small)


def test_query_equals_oracle(spark):
    compare(spark, "op11_heavy_light", plans.op11_heavy_light, plans.ORACLES["op11_heavy_light"], SF)


@pytest.mark.parametrize("heavy", [0, 1, 7, 1000])
def test_the_split_does_not_matter(spark, small, heavy, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 50)
    monkeypatch.setattr(divergence, "SOURCES", 6)
    monkeypatch.setattr(divergence, "SLICE", 5000)
    rows = [(lang, f"s{i % 23}" if i % 5 else "s0", text) for i, (lang, _, text) in enumerate(small)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert got(divergence.audit(docs, top=20, heavy=heavy)) == brute(rows, top=20)


def test_odd_rows(spark):
    rows = [(None, None, "Aé b-b É"), (None, "x", "aé B"), (None, "x", "Aé b b"), (None, "x", "Aé b b"), ("en", None, None), ("en", "x", ""), ("en", "y", "one two"), ("de", "only", "ein ein ein"), ("fr", "a", "le la"), ("fr", "a", "la le"), ("fr", "b", "le"), ("fr", "c", "12 34"), ("fr", "c", "la " * 50_000)]
    schema = "lang string, source string, text string, n string, term int, docs int, value string"
    docs = spark.createDataFrame([(*r, "q", 1, 2, None) for r in rows], schema)
    out = got(divergence.audit(docs))
    assert out == brute(rows)
    assert ("en", "", "pair", "x", 0, 1) in out and not any(r[0] == "de" for r in out)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_rates_do_not_overflow(spark):
    from pyspark.sql import functions as F

    big = spark.range(1).select(divergence.rate(F.lit(5 * 10**14), F.lit(10**15), F.lit(7)).alias("p")).first().p
    assert big == 1 + 10**9 * (5 * 10**14 + 1) // (10**15 + 7)
