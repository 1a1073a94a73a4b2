"""Approximate nearest neighbours by largest inner product: an NN-descent graph, and greedy search on it.

Index: equal vectors are one node. Vectors get one more component, which makes their lengths equal, so that near means a
large inner product. Signs of random projections around the mean deal them to leaves, several times over, where each
starts with its best leaf mates; the number of signs grows with the rows, so leaves keep their size. Then NN-descent
rounds, each a few Spark joins: every node gathers its neighbours and those that name it, scores them against one another
and offers each the ones that beat its worst neighbour; the best of old and new offers stay. Rounds end when few
neighbours change. Vectors of different lengths have graphs of their own.

Search: a query starts at its own node. Each hop joins the queries' best unexpanded nodes with the graph and scores the
neighbours found; it ends when no query has an unexpanded node in its beam. The whole beam is then scored in double
precision on the original vectors.

Every usable vector is indexed, and every size goes the same way. Approximate are the share of a node's reverse neighbours
that takes part in a round, the search, and its vectors of two bytes a component; recall is measured against brute force in
the tests and README. Unusable vectors (null, empty, zero, null or non-finite components) and rows with a null id take no
part. Rows are rows even where ids or vectors repeat: each query row has a list of its own, which leaves out that row
alone. Ties go to the smaller id among those found. Fewer rows than asked for give all that the search meets.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, saved
from .vectors import by_rows, chunked, matrix, usable

#: Neighbours of a node, reverse ones in a round and in the search, times dealt to leaves, and the size of these.
DEGREE, REVERSE, DEALS, LEAF = 32, 24, 6, 400
ROUNDS, SETTLED, OFFERS = 6, 0.02, 8
BEAM, EXPAND, MOST_BITS, SEED = 192, 24, 48, 5


@cache
def directions(dim: int, deal: int) -> np.ndarray:
    return np.random.default_rng((SEED, deal)).normal(size=(dim, MOST_BITS)).astype("f4")


def packed(x: np.ndarray) -> pa.Array:
    """Rows in two bytes a component, behind the scale in four."""
    scale = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30).astype("<f4") / np.float32(32767)
    data = np.hstack([scale.view("<i2").reshape(len(x), 2), np.rint(x / scale).astype("<i2")])
    return pa.array([r.tobytes() for r in data], pa.binary())


def unpacked(column: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi of a column of `packed` rows of one length."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset + lo : column.offset + hi + 1]
    raw = np.frombuffer(column.buffers()[2], "<i2", (ends[-1] - ends[0]) // 2, ends[0]).reshape(hi - lo, -1)
    return raw[:, 2:].astype("f8") * raw[:, :2].copy().view("<f4")


def nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, negative. Index forms are equally long, so this orders as inner products do, but tells near ones apart."""
    return 2 * (x @ y.T) - (x * x).sum(1)[:, None] - (y * y).sum(1)


def spans(column: pa.Array) -> list[tuple[int, int]]:
    """Where each list of a list column begins and ends in its `values`."""
    at = column.offsets.to_numpy()
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest scores, in any order."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.append(0, np.cumsum([len(r) for r in rows])).astype("i4")
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else [], kind))


def leaf_mates(degree: int):  # noqa: ANN201
    """A leaf's members, each with its best mates."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        node, others, scores = [], [], []
        ids, vecs = b.column(0).values.to_numpy(), b.column(1).values
        for lo, hi in spans(b.column(0)):
            n, x = ids[lo:hi], unpacked(vecs, lo, hi)
            k = min(degree, len(n) - 1)
            for at in range(0, len(n) if k else 0, 512):
                z = nearness(x[at : at + 512], x)
                z[np.arange(len(z)), at + np.arange(len(z))] = -np.inf
                top = best(z, k)
                node.append(n[at : at + 512])
                others += list(n[top])
                scores += list(np.take_along_axis(z, top, 1))
        return {"node": pa.array(np.concatenate(node) if node else [], pa.int64()), "others": lists(others, pa.int64()), "scores": lists(scores, pa.float32())}

    return run


def leaf_best(degree: int):  # noqa: ANN201
    """The best of a node's mates from all its leaves."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        node, other, score = [], [], []
        for n, o, s in zip(b.column(0), b.column(1), b.column(2), strict=True):
            o, s = np.concatenate([np.array(x) for x in o.as_py()]), np.concatenate([np.array(x, "f4") for x in s.as_py()])
            o, first = np.unique(o, return_index=True)
            top = np.argsort(-s[first], kind="stable")[:degree]
            node += [n.as_py()] * len(top)
            other.append(o[top])
            score.append(s[first][top])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"node": pa.array(node, pa.int64()), "other": pa.array(cat(other, "i8")), "score": pa.array(cat(score, "f4"))}

    return run


def local_join(offers: int):  # noqa: ANN201
    """A node's gathered members against one another: each gets its best that beat its worst neighbour so far."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        a, o, s = [], [], []
        col = b.column(0)
        ids, vecs, worst, fresh = (col.values.field(k) for k in range(4))
        ids, worst, fresh = ids.to_numpy(), worst.to_numpy(), fresh.to_numpy(zero_copy_only=False)
        for lo, hi in spans(col):
            new = fresh[lo:hi]
            if not new.any():
                continue  # pairs of two old members have met before
            # A node may stand here both ways; it is new if either is.
            n, first, of = np.unique(ids[lo:hi], return_index=True, return_inverse=True)
            x, low, new = unpacked(vecs, lo, hi)[first], worst[lo:hi][first], np.bincount(of, new) > 0
            z = nearness(x, x).astype("f4")
            z[~(new[:, None] | new) | (z <= low[:, None])] = -np.inf
            np.fill_diagonal(z, -np.inf)
            top = best(z, min(offers, len(n)))
            v = np.take_along_axis(z, top, 1)
            i, j = np.nonzero(v > -np.inf)
            a.append(n[i])
            o.append(n[top[i, j]])
            s.append(v[i, j])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"node": pa.array(cat(a, "i8")), "other": pa.array(cat(o, "i8")), "score": pa.array(cat(s, "f4"))}

    return run


PAIR = "node bigint, other bigint, score float"


def top_of(rows: DataFrame, n: int, keys: list[str], *order: Column | str) -> DataFrame:
    """The first `n` rows of each key; Spark cuts each task's rows to as many before the exchange."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def usable_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    v = F.col(f"`{vec}`")
    v = v if df.schema[vec].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    return df.select(F.col(f"`{key}`").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable("v"))


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """(node, v, ids): equal vectors as one, with their `most` smallest ids."""
    few = top_of(rows, most, ["v"], "id")
    # Written, so a number once given stays.
    return saved(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id()))


def measured(classes: DataFrame) -> DataFrame:
    """(dim, n, mean, longest): one row for each vector length."""

    def sums(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x = [np.array(v.as_py(), "f8") for v in b.column(0)]
        dims = sorted({len(v) for v in x})
        parts = [np.stack([v for v in x if len(v) == d]) for d in dims]
        return {"dim": pa.array(dims, pa.int32()), "n": pa.array([len(p) for p in parts], pa.int64()), "total": pa.array([p.sum(0) for p in parts], pa.list_(pa.float64())), "longest": pa.array([(p * p).sum(1).max() for p in parts], pa.float64())}

    rows = by_rows(classes.select("v"), "dim int, n bigint, total array<double>, longest double", sums, 1 << 16)
    whole = rows.groupBy("dim").agg(F.sum("n").alias("n"), F.max("longest").alias("longest"))
    mean = rows.select("dim", F.posexplode("total").alias("i", "x")).groupBy("dim", "i").agg(F.sum("x").alias("x"))
    mean = mean.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
    return saved(whole.join(mean, "dim").select("dim", "n", "longest", F.transform("m", lambda s: s["x"] / F.col("n")).alias("mean")))


def points_of(classes: DataFrame, leaf: int = LEAF, deals: int = DEALS) -> DataFrame:
    """(node, dim, vec, leaves): index forms, and the leaf that each deal puts a node into."""
    rows = classes.select("node", "v", F.size("v").alias("dim")).join(measured(classes), "dim").select("node", "v", "dim", "n", "longest", "mean")

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        dims = b.column(2).to_numpy()
        node, dim, vec, leaves = [], [], [], []
        for d in np.unique(dims):
            own = pa.array(np.flatnonzero(dims == d))
            x, one = matrix(b.column(1).take(own)), b.column(5).take(own)[0].as_py()
            n, longest = (b.column(k).take(own)[0].as_py() for k in (3, 4))
            y = (np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1, keepdims=True)))]) / math.sqrt(longest)).astype("f4")
            bits = min(MOST_BITS, max(0, math.ceil(math.log2(n / leaf))))
            two = 1 << np.arange(bits)
            at = np.stack([(((x - one).astype("f4") @ directions(int(d), t)[:, :bits]) > 0) @ two for t in range(deals)], 1) if bits else np.zeros((len(x), 1), "i8")
            node.append(b.column(0).take(own))
            dim.append(b.column(2).take(own))
            vec.append(packed(y))
            leaves.append(pa.array(at.astype("i8").tolist(), pa.list_(pa.int64())))
        cat = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], kind)
        return {"node": cat(node, pa.int64()), "dim": cat(dim, pa.int32()), "vec": cat(vec, pa.binary()), "leaves": cat(leaves, pa.list_(pa.int64()))}

    return saved(by_rows(rows, "node bigint, dim int, vec binary, leaves array<bigint>", make, 2048))


def build(points: DataFrame, degree: int = DEGREE, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph (node, other, score)."""
    dealt = points.select("node", "dim", "vec", F.posexplode("leaves").alias("deal", "leaf"))
    # A leaf with many rows is cut at random, each time otherwise; its members have near ones in every part.
    groups = chunked(dealt, ["dim", "deal", "leaf"], 2 * leaf, "node", "deal").groupBy("dim", "deal", "leaf", "chunk").agg(F.collect_list("node").alias("ids"), F.collect_list("vec").alias("vecs"))
    mates = by_rows(groups.select("ids", "vecs"), "node bigint, others array<bigint>, scores array<float>", leaf_mates(degree), 4)
    per_node = mates.groupBy("node").agg(F.collect_list("others").alias("others"), F.collect_list("scores").alias("scores"))
    graph = saved(by_rows(per_node, PAIR, leaf_best(degree)).withColumn("fresh", F.lit(True)))
    vecs = points.select("node", "vec")

    for turn in range(rounds):
        held = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(float("-inf")).cast("float").alias("worst"))
        info = vecs.join(held, "node").select(F.col("node").alias("id"), "vec", "worst")
        # Forward and a bounded share of reverse neighbours, the latter by a hash that changes with the round.
        back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh", F.xxhash64("node", "other", F.lit(turn)).alias("h"))
        both = graph.select("node", "other", "fresh").unionByName(top_of(back, REVERSE, ["node"], "h").drop("h"))
        member = F.struct("id", "vec", "worst", "fresh")
        gathered = both.join(info, F.col("other") == F.col("id")).groupBy("node").agg(F.collect_list(member).alias("members"))
        offers = by_rows(gathered.select("members"), PAIR, local_join(OFFERS), 64).groupBy("node", "other").agg(F.max("score").alias("score"))
        # An old pair stays old; offers of pairs that are there already add nothing.
        merged = graph.select("node", "other", "score", F.lit(0).alias("new")).unionByName(offers.select("node", "other", "score", F.lit(1).alias("new")))
        merged = merged.groupBy("node", "other").agg(F.max("score").alias("score"), F.min("new").alias("new"))
        after = saved(top_of(merged, degree, ["node"], F.desc("score"), "other").select("node", "other", "score", (F.col("new") == 1).alias("fresh")))
        share = after.agg(F.avg(F.col("fresh").cast("double"))).first()[0] or 0.0
        drop_saved(graph)
        graph = after
        if share < SETTLED:
            break
    return graph.select("node", "other", "score")


def search(classes: DataFrame, points: DataFrame, graph: DataFrame, asked: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(query, ids): the nodes of each query's beam, for the queries (query), which are nodes."""
    # A node's neighbours both ways, so that what names a node is reached from it too.
    back = top_of(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "score"), REVERSE, ["node"], F.desc("score"), "other")
    both = graph.select("node", "other").union(back.select("node", "other"))
    adjacency = both.join(points.select(F.col("node").alias("id"), "vec"), F.col("other") == F.col("id")).groupBy("node").agg(F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs"))
    adjacency = saved(adjacency)
    start = asked.join(classes.select("node", "v"), F.col("query") == F.col("node"))
    state = saved(start.select("query", F.col("v").cast("array<float>").alias("qvec"), F.array("query").alias("ids"), F.array(F.lit(float("inf")).cast("float")).alias("scores"), F.array(F.lit(False)).alias("done")))

    def score(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out, ids, vecs = [], b.column(2).values.to_numpy(), b.column(3).values
        for q, (lo, hi) in zip(b.column(1), spans(b.column(2)), strict=True):
            out.append(unpacked(vecs, lo, hi)[:, :-1] @ q.values.to_numpy())
        return {"query": b.column(0), "ids": lists([ids[lo:hi] for lo, hi in spans(b.column(2))], pa.int64()), "scores": lists(out, pa.float32())}

    def update(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out: list[list] = [[], [], []]
        more_ids, more_scores = b.column(5), b.column(6)
        for k in range(b.num_rows):
            ids, scores, done = (np.array(b.column(c)[k].as_py(), t) for c, t in ((2, "i8"), (3, "f4"), (4, bool)))
            done[np.flatnonzero(~done)[:expand]] = True  # what was joined is expanded now
            if more_ids[k].is_valid:
                met, s = more_ids[k].values.flatten().to_numpy(), more_scores[k].values.flatten().to_numpy()
                met, first = np.unique(met, return_index=True)
                new = ~np.isin(met, ids)
                ids, scores, done = np.append(ids, met[new]), np.append(scores, s[first][new]), np.append(done, np.zeros(new.sum(), bool))
            top = np.lexsort((ids, -scores))[: beam + 1]
            for o, c in zip(out, (ids, scores, done), strict=True):
                o.append(c[top])
        return {"query": b.column(0), "qvec": b.column(1), "ids": lists(out[0], pa.int64()), "scores": lists(out[1], pa.float32()), "done": lists(out[2], pa.bool_())}

    # A node that leaves a beam stays out, as a beam only gets better, so each is expanded once and the hops end.
    while True:
        ready = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), 1, expand)
        frontier = state.select("query", "qvec", F.explode(ready).alias("x")).select("query", "qvec", F.col("x.ids").alias("at"))
        met = by_rows(frontier.join(adjacency, F.col("at") == F.col("node")).select("query", "qvec", "ids", "vecs"), "query bigint, ids array<bigint>, scores array<float>", score, 256)
        gathered = met.groupBy("query").agg(F.collect_list("ids").alias("more_ids"), F.collect_list("scores").alias("more_scores"))
        after = saved(by_rows(state.join(gathered, "query", "left").select("query", "qvec", "ids", "scores", "done", "more_ids", "more_scores"), "query bigint, qvec array<float>, ids array<bigint>, scores array<float>, done array<boolean>", update, 256))
        drop_saved(state)
        state = after
        if state.filter(F.exists("done", lambda x: ~x)).isEmpty():
            break
    drop_saved(adjacency)
    return state.select("query", "ids")


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vec: str = "embedding", k: int = 20) -> DataFrame:
    """(query, rank, id, score): index all rows of `df` and search those that `queries`, a condition on `id`, picks."""
    rows = usable_rows(df, key, vec)
    classes = classes_of(rows, k + 1)
    points = points_of(classes)
    graph = build(points)
    asking = rows.filter(queries).join(classes.select("node", F.col("v").alias("_v")), F.col("v") == F.col("_v")).select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    asked = saved(asking)
    beam = search(classes, points, graph, asked.select("query").distinct())
    # Exact scores of the whole beam; a class has a member at least, so the best k + 1 classes hold the best k rows.
    found = beam.select("query", F.explode("ids").alias("node")).join(classes, "node").select("query", "node", "v", "ids")
    own = classes.select(F.col("node").alias("query"), F.col("v").cast("array<double>").alias("qv"))
    product = F.aggregate(F.zip_with("qv", F.col("v").cast("array<double>"), lambda a, x: a * x), F.lit(0.0), lambda a, x: a + x)
    exact = found.join(own, "query").select("query", "node", "ids", product.alias("score"))
    few = top_of(exact, k + 1, ["query"], F.desc("score"), F.col("ids")[0])
    per_query = few.groupBy("query").agg(F.collect_list(F.struct("node", "score", "ids")).alias("found"))
    # The query's own row is left out once, from the class that it is in.
    mine = lambda c: F.when(c["node"] == F.col("query"), F.coalesce(F.array_position(c["ids"], F.col("query_id")), F.lit(0))).otherwise(0)
    members = lambda c: F.filter(c["ids"], lambda x, i: i + 1 != mine(c))
    ranked = F.flatten(F.transform("found", lambda c: F.transform(members(c), lambda i: F.struct((-c["score"]).alias("less"), i.alias("id")))))
    out = asked.join(per_query, "query").select("query_id", F.posexplode(F.slice(F.array_sort(ranked), 1, k)).alias("at", "x"))
    return out.select(F.col("query_id").alias("query"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.less")).alias("score"))
