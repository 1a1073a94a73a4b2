"""Recall and exact scores against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from granary.llm import neighbours as N
from granary.llm import queries


def brute(rows, picks, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i in picks:
        s = x @ x[ids == i][0]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(found, want):
    """Share of places filled as well as by brute force: by score, so equal scores count alike."""
    hit = sum(sum(s >= want[q][-1][1] - 1e-9 for _, s in found.get(q, [])) for q in want)
    return hit / sum(len(w) for w in want.values())


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r["rank"])):
        out.setdefault(r[0], []).append((r[2], r["score"]))
        assert r["rank"] == len(out[r[0]])
    return out


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    got = result(queries.op8_neighbours(spark, d))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    x = dict(rows)
    for q, found in got.items():
        assert all(abs(s - float(np.dot(np.array(x[i], float), np.array(x[q], float)))) < 1e-12 and i != q for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert recall(got, want) >= 0.9


def test_rounds_and_hot_leaves(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 12)) * rng.uniform(0.5, 2, size=(1200, 1))
    x[:400] = x[0] + rng.normal(size=(400, 12)) * 0.001  # a third of the rows nearly alike
    x[400:600] = x[400]  # and copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    points = N.points_of(N.classes_of(N.usable_rows(df, "vec_id", "embedding"), 21), leaf=60)
    assert points.count() == 1001 and points.filter(F.size("leaves") == N.DEALS).count() == 1001
    graph = N.build(points, leaf=60)
    assert graph.groupBy("node").count().filter(F.col("count") > N.DEGREE).count() == 0
    monkeypatch.setattr(N.points_of, "__defaults__", (60, N.DEALS))
    found = result(N.nearest(df, F.col("id") % 15 == 0))
    want = brute(rows, range(0, 1200, 15))
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert recall(found, want) >= 0.9
    # Of equal rows the smallest ids stand first.
    copies = [i for i, _ in found[405] if 400 <= i < 600]
    assert copies == sorted(copies) and 405 not in copies


def test_repeated_rows(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.5, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query"], r["rank"], r["id"], r["score"]) for r in N.nearest(df, F.col("id") % 20 == 0).collect())
    first = [(1, 1, 1.5), (2, 2, 1.5), (3, 20, 1.25), (4, 20, 1.0)]
    other = [(1, 1, 1.5), (2, 2, 1.5), (3, 20, 1.0), (4, 20, 1.0)]
    assert got == sorted((20, *r) for r in first + first + other)
    text = df.selectExpr("concat('k', vec_id) AS vec_id", "cast(embedding AS array<float>) AS embedding")
    assert N.nearest(text, F.col("id") == "k1").count() == 4


def test_two_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=4 if i % 3 else 6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = result(N.nearest(df, F.col("id") % 20 == 0))
    for q in range(0, 120, 20):
        same = [r for r in rows if len(r[1]) == len(rows[q][1])]
        assert [i for i, _ in found[q]] == [i for i, _ in brute(same, [q])[q]]


def test_edges(spark):
    nan = math.nan
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (5, [None, 1.0]), (7, []), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as score")
    got = result(N.nearest(df, F.col("id") % 20 == 0))
    assert got == {0: [(20, 1.0), (3, 0.5)], 20: [(0, 1.0), (3, 0.5)]}
    assert N.nearest(df.filter("false"), F.col("id") % 20 == 0).count() == 0
    assert N.nearest(df.filter("vec_id = 0"), F.col("id") % 20 == 0).count() == 0
