"""Nearest neighbours on awkward vectors, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pricelattice.llm import ann

SCHEMA = "vec_id bigint, embedding array<double>"


def nearest(spark, rows, shard=200):
    every = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.search(every, F.col("vec_id") % 100 == 0, ann.index(every, shard)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got


def exact(rows, query, vector):
    with np.errstate(over="ignore"):
        near = sorted((float(np.sqrt(((np.array(v) - np.array(vector)) ** 2).sum())), i) for i, v in rows if i != query)
    return near[:10]


def test_components_beyond_single_precision(spark):
    rows = [(100, [1e25, 1.0]), (1, [1e25, 2.0]), (2, [1e25, 5.0]), (3, [0.5, 0.5]), (4, [-3e200, 0.0])]
    assert nearest(spark, rows) == {100: exact(rows, 100, rows[0][1])}
    tiny = [(i, [i * 1e-30, 1e-32]) for i in range(100, 130)]
    assert nearest(spark, tiny) == {100: exact(tiny, 100, tiny[0][1])}


def test_a_far_query_and_a_common_offset(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, (1e6 + rng.normal(size=4)).tolist()) for i in range(1, 100)]
    for q in ([1e9, -1e9, 3e9, 1e8], [1e6, 1e6, 1e6, 1e6]):
        asked = [*rows, (100, q)]
        assert nearest(spark, asked, 60) == {100: exact(asked, 100, q)}


def test_far_vectors_do_not_blind_the_search(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    rows = [(i, (5 + rng.normal(size=4)).tolist()) for i in range(101, 200)]
    rows += [(1, [1e12, 0.0, 0.0, 1.0]), (2, [-1e30, 1.0, 0.0, 0.0]), (3, [0.0, 1e140, 0.0, 0.0])]
    q = (100, [5.0, 5.0, 5.0, 5.5])
    assert nearest(spark, [*rows, q]) == {100: exact(rows, 100, q[1])}


def test_repeated_ids_and_rows(spark):
    rows = [(0, [1.0, 1.0])] * 30 + [(5, [1.0, 1.0])] * 3 + [(7, [1.0, 1.5])] * 20 + [(9, [float(k), 4.0]) for k in range(50)]
    assert nearest(spark, rows, 8) == {0: exact(rows, 0, [1.0, 1.0])}
    two = [(0, [9.0, 0.0]), (0, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [8.0, 0.0])]
    assert nearest(spark, two) == {0: exact(two, 0, [1.0, 0.0])}
