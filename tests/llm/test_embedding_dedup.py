"""Against all pairs."""

import math
import time

import numpy as np

from granary.llm import embedding_dedup as E
from granary.llm import queries


def plain(rows, least=0.98):
    """One (id, links, smallest id, kept) for each row, ids repeated or not."""
    ok = [x for x, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            u, v = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                n[i] += 1
                n[j] += 1
                root[find(j)] = find(i)
    smallest = {}
    for x, r in enumerate(rows):
        smallest[find(x)] = min(smallest.get(find(x), r[0]), r[0])
    return sorted((r[0], n[x], smallest[find(x)], r[0] == smallest[find(x)]) for x, r in enumerate(rows))


def result(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert result(queries.op5_embedding_dedup(spark, d)) == plain(rows)


def test_cells_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(E, "SMALL", 12)
    monkeypatch.setattr(E, "COPY", 4)
    E.shape.cache_clear()
    monkeypatch.setattr(E, "BLOCK", 40)
    rng, rows = np.random.default_rng(5), []
    for i in range(400):
        v = rng.normal(size=16)
        if i >= 150:  # near copies of near copies, half of them of one vector
            v = np.array(rows[0 if i % 2 else int(rng.integers(i))][1]) + rng.normal(size=16) * rng.choice([0.0, 0.08, 0.15])
        rows.append((i * 3 % 401, [float(x) for x in v], i % 2 if i % 7 else 0))
    nan, inf = math.nan, math.inf
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [nan] * 16, 1), (904, [inf] + [1.0] * 15, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert E.shape(200, E.apart(0.98, 1.0))[0] > 1 and E.shape(200, E.apart(0.98, 1.0))[1] > 3
    assert result(E.near_duplicates(df)) == plain(rows)
    assert E.near_duplicates(df.filter("false")).count() == 0
    E.shape.cache_clear()


def test_repeated_ids(spark):
    u, w = [1.0, 0.0, 0.1], [0.0, 1.0, 0.3]
    rows = [(5, u, 1), (5, u, 1), (5, w, 1), (7, w, 1), (3, [2.0, 0.01, 0.2], 1), (9, [0.5, 0.5, 0.5], 2), (9, None, 2), (9, [0.5, 0.5, 0.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(E.near_duplicates(df)) == plain(rows)
    assert result(E.near_duplicates(df.withColumn("embedding", df.embedding.cast("array<float>")))) == plain(rows)
    null = df.union(spark.createDataFrame([(None, w, 1), (None, [3.0, 3.0, -9.0], 1)], df.schema))
    assert sorted(r.n_links for r in E.near_duplicates(null).filter("vec_id is null").collect()) == [0, 2]


def test_bounds():
    assert E.least_count(10, 1.0, 0.999) == 10 and E.least_count(24, E.reach(2.0), 0.9999) >= 16
    assert E.tables_for(17, E.apart(0.98, 1.0)) < 30 and E.shape(10**8, E.apart(0.98, 1.0))[1] < 60 and E.shape(100, 0.1) == (0, 1)
    assert list(E.forest(5, np.array([3, 2]), np.array([2, 1]))) == [0, 1, 1, 1, 4]


def test_means_and_spreads_are_of_whole_labels(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(2100):  # a label of 1,400, one of 600 in two lengths, and one of 100 that is no large one
        label = 0 if i < 1400 else 1 if i < 2000 else 2
        rows.append((i, [float(x) for x in rng.normal(size=3 if label == 1 and i % 10 == 0 else 5) + label], label))
    classes = spark.createDataFrame(rows, "node long, v array<double>, label int").selectExpr("*", "size(v) AS dim", "1L AS weight")
    got = {(r.label, r.dim): r for r in E.measured(classes).collect()}
    assert set(got) == {(0, 5), (1, 5)}
    for (label, dim), r in got.items():
        x = np.array([v for _, v, lab in rows if lab == label and len(v) == dim])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert r.n == len(x) and np.allclose(r["mean"], x.mean(0), rtol=0, atol=1e-12)
        assert math.isclose(r.trace, ((x - x.mean(0)) ** 2).sum(1).mean(), abs_tol=1e-12)


def test_counting_loses_no_pair(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[:150] = x[150:] + rng.normal(size=(150, 16)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p, rows = x @ E.directions(16, 24, 7), np.arange(300)
    for at_once in (1, 1000, 1 << 17):
        monkeypatch.setattr(E, "AT_ONCE", at_once, raising=False)
        for half in (1e-9, 0.02, 0.1, 0.4):
            enough = (np.abs(p[:, None] - p[None]) <= half).sum(2) >= 18
            found = set(zip(*(v.tolist() for v in E.collisions(p, rows[:120], rows[100:], half, 18)), strict=True))
            assert found >= {(i, j) for i, j in np.argwhere(enough).tolist() if i < 120 and j >= 100}
            once = list(zip(*(v.tolist() for v in E.collisions(p, rows, rows, half, 18, True)), strict=True))
            assert len(once) == len(set(once)) and set(once) >= {(i, j) for i, j in np.argwhere(enough).tolist() if i < j}
    # Windows are a quarter wider at most, so few pairs come in vain.
    wide = (np.abs(p[:, None] - p[None]) <= 0.1 * 1.25 + 1e-12).sum(2) >= 18
    assert set(zip(*(v.tolist() for v in E.collisions(p, rows, rows, 0.1, 18)), strict=True)) <= set(map(tuple, np.argwhere(wide).tolist()))


def test_work_grows_with_the_rows():
    # From 1,026 to 5,128 rows a label, copies of a row went from 1 to 10, and a comparison took as long as some thirty do now.
    chance = E.apart(0.98, 1.0)
    copies = [E.shape(n, chance)[1] * math.ceil(n / 2 ** E.shape(n, chance)[0] / E.BLOCK) for n in (1026, 5128, 20000, 51000, 10**6)]
    assert copies[0] == 1 and copies[1] <= 3 and max(copies) <= 20
    p, rows = np.random.default_rng(6).normal(size=(1000, 24)), np.arange(1000)

    def seconds(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    plain = seconds(lambda: sum((np.abs(c[:, None] - c[None]) <= 0.2).astype("i1") for c in p.T))
    assert seconds(lambda: E.collisions(p, rows, rows, 0.2, 18)) < plain
