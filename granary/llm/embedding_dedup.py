"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Vectors with one label are unit vectors for this purpose; two link when their cosine is at least `least`. A random
direction moves the two of such a pair apart by at most a known normal spread. Projections are used at two stages:

* routing: some projections, cut at their label's mean, name a cell. Their signs part a linked pair with a small chance
  that follows from the label's spread, so with `bits` of them the two share a cell in most tables, and as many tables
  are made as the wanted recall takes. A vector stands once in each table, and tables grow in number with the logarithm
  of a label's size, while cells keep their size. Labels of some thousand vectors are one cell.
* counting: in a cell, on many more projections, every query-centred window adds one to all pairs in it, and pairs with
  enough collisions, by the binomial law at RECALL, are verified with exact cosines. Projections are counted as one byte,
  in steps that make windows a little wider, so that none of a pair's collisions is lost.

A pair found in an earlier table is left out by comparing the cells of both, so counts are exact sums and no pairs are
shuffled: a cell gives its members' numbers of links and a spanning forest of them. Equal vectors are one class with a
weight. Cells with very many rows are cut into blocks, any two of which meet in a task of their own.

Null labels and unusable vectors (null, zero, null or non-finite components) link with nothing and come out alone.
Vectors of different lengths never link. Every row gives a row: rows with one id each have the links of their own vector,
equal rows link with one another, and rows with one id are named alike. A null id names no component, and what only such
rows reach has none. Further columns play no part.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, saved
from .vectors import by_rows, chunked, in_blocks, matrix, usable

#: Rows of one label that stay one cell, what a copy of a row costs in comparisons, rows of a block's side.
SMALL, COPY, BLOCK = 512, 2048, 2048
#: Steps in half a window, and bytes that are compared at once.
STEPS, AT_ONCE = 8, 1 << 17
MOST_BITS, COUNTED, COUNT_SPREADS, RECALL, SEED = 48, 24, 2.0, 0.9999, 11


def reach(spreads: float) -> float:
    """P(|normal| <= spreads)."""
    return math.erf(spreads / math.sqrt(2))


def least_count(n: int, p: float, recall: float) -> int:
    """The largest count that Binomial(n, p) reaches with probability `recall`."""
    tail, c = 0.0, n
    while c > 0:
        tail += math.comb(n, c) * p**c * (1 - p) ** (n - c)
        if tail >= recall:
            return c
        c -= 1
    return 0


def apart(least: float, trace: float) -> float:
    """The chance that a projection's sign parts a pair at `least`, for a label of this total variance."""
    return math.atan2(math.sqrt(max(0.0, 2 - 2 * least)), math.sqrt(max(trace, 0.0))) / math.pi


def tables_for(bits: int, chance: float, recall: float = RECALL) -> int:
    miss = 1 - (1 - chance) ** bits
    return 1 if miss <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else 1 << 30


@cache
def shape(n: int, chance: float) -> tuple[int, int]:
    """(bits, tables) of least work for a label of n vectors."""
    if n <= SMALL:
        return 0, 1
    # A row of a cell of several blocks goes to as many.
    return min((tables_for(b, chance) * (n / 2**b + COPY * math.ceil(n / 2**b / BLOCK)), b, tables_for(b, chance)) for b in range(MOST_BITS + 1))[1:]


@cache
def directions(dim: int, n: int, *seed: int) -> np.ndarray:
    """Random directions of length 1, as columns."""
    r = np.random.default_rng(seed).normal(size=(dim, n))
    return r / np.linalg.norm(r, axis=0)


def units(column: pa.Array) -> np.ndarray:
    """Equally long vectors as unit rows in double precision."""
    x = matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def collisions(p: np.ndarray, queries: np.ndarray, members: np.ndarray, half: float, need: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a member that stand in at least `need` of the windows of `half` around the query, one per column of p.

    Places are counted in steps modulo 256: windows are up to two steps wider and recur, so pairs may be too many, not too
    few. With `ordered`, queries and members are the same rows, and of a row with those before it no pair is made.
    """
    steps = np.floor(p.T * (STEPS / half)).astype("i8").astype("u1")
    at, low = np.take(steps, members, 1), np.take(steps, queries, 1) + np.uint8(STEPS + 1)
    size = max(1, AT_ONCE // max(1, len(members)))
    left, right = [], []
    for k in range(0, len(queries), size):
        first = k if ordered else 0
        part, others = low[:, k : k + size], at[:, first:]
        hits, gap, near = (np.zeros((part.shape[1], others.shape[1]), t) for t in ("u1", "u1", "?"))
        for m in range(len(steps)):
            np.subtract(part[m, :, None], others[m], out=gap)
            np.less_equal(gap, np.uint8(2 * STEPS + 2), out=near)
            np.add(hits, near.view("u1"), out=hits)
        i, j = np.nonzero(hits >= need)
        left.append(queries[k + i])
        right.append(members[first + j])
    return np.concatenate(left), np.concatenate(right)


def cell_links(t: pa.Table, least: float, width: str) -> pa.Table:
    """(node, links, root) of one block: `side` 0 meets side 1, or all of side 2 one another."""
    t = t.combine_chunks()
    node, side, weight = (t.column(c).to_numpy() for c in ("node", "side", "weight"))
    whole = bool((side == 2).any())
    q = np.flatnonzero(side != 1)
    d = q if whole else np.flatnonzero(side == 1)
    x = np.frombuffer(b"".join(t.column("vec").to_pylist()), width).reshape(len(node), -1).astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = COUNT_SPREADS * math.sqrt(max(0.0, 2 - 2 * least) / x.shape[1]) + 1e-9
    links, root = np.zeros(len(node), "i8"), np.arange(len(node))
    if len(q) and len(d):
        i, j = collisions(x @ directions(x.shape[1], COUNTED, SEED, 1), q, d, half, least_count(COUNTED, reach(COUNT_SPREADS), RECALL), whole)
        go = i < j if whole else np.ones(len(i), bool)
        # The cells of the tables before: a pair that shared one was found there.
        codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        for c in codes.T:
            go &= c[i] != c[j]
        i, j = i[go], j[go]
        ok = [np.einsum("ij,ij->i", x[i[s : s + (1 << 16)]], x[j[s : s + (1 << 16)]]) >= least for s in range(0, len(i), 1 << 16)]
        ok = np.concatenate(ok) if ok else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        links = (np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))).astype("i8")
        root = forest(len(node), i, j)
    keep = np.flatnonzero(links)
    return pa.table({"node": node[keep], "links": links[keep], "root": node[root[keep]]})


def measured(classes: DataFrame) -> DataFrame:
    """(label, dim, n, mean, trace) of the labels with over SMALL vectors, over all of them: the unit vectors' mean and total variance."""
    large = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL)
    known = classes.join(large, ["label", "dim"], "left_semi").select("label", "dim", "v")

    def sums(b: pa.RecordBatch) -> dict[str, pa.Array]:
        by: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            by.setdefault(k, []).append(i)
        at = pa.array([own[0] for own in by.values()], pa.int64())
        totals = [units(b.column(2).take(pa.array(own))).sum(0) for own in by.values()]
        return {"label": b.column(0).take(at), "dim": b.column(1).take(at), "total": pa.array(totals, pa.list_(pa.float64()))}

    parts = by_rows(known, f"label {classes.schema['label'].dataType.simpleString()}, dim int, total array<double>", sums, 8192)
    totals = parts.select("label", "dim", F.posexplode("total").alias("at", "part")).groupBy("label", "dim", "at").agg(F.sum("part").alias("part"))
    totals = totals.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    means = totals.join(large, ["label", "dim"]).select("label", "dim", "n", F.transform("parts", lambda x: x["part"] / F.col("n")).alias("mean"))
    # Of unit vectors, the squares of the mean and the variance add up to 1.
    return saved(means.withColumn("trace", 1 - F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x)))


def routed(classes: DataFrame, least: float) -> DataFrame:
    """(label, dim, table, cell, node, weight, vec, codes): every vector once for each table of its label."""
    known = classes.join(measured(classes), ["label", "dim"], "left").select("label", "dim", "node", "weight", "v", F.coalesce("n", F.lit(0)).alias("n"), "mean", "trace")
    name, width = classes.schema["label"].dataType.simpleString(), vector_width(classes)

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        plan = [(shape(n, apart(least, tr)) if n else (0, 1)) for n, tr in zip(b.column(5).to_pylist(), b.column(7).to_pylist(), strict=True)]
        by: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(b.column(1).to_pylist(), plan, strict=True)):
            by.setdefault(k, []).append(i)
        at, places, cells, before, vec = [], [], [], [], []
        for (dim, (bits, tables)), own in by.items():
            data = matrix(b.column(4).take(pa.array(own)))
            codes = np.zeros((len(own), tables), "i8")
            if bits:
                x = data / np.linalg.norm(data, axis=1, keepdims=True) - matrix(b.column(6).take(pa.array(own)))
                for t in range(tables):
                    codes[:, t] = ((x @ directions(dim, MOST_BITS, SEED, 2, t)[:, :bits]) > 0) @ (1 << np.arange(bits))
            vecs = [v.tobytes() for v in data.astype(width)]
            for t in range(tables):
                at.append(np.array(own))
                places.append(np.full(len(own), t, "i4"))
                cells.append(codes[:, t])
                before.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * t, pa.int32()), pa.array(codes[:, :t].ravel())))
                vec += vecs
        rows = pa.array(np.concatenate(at))
        return {
            "label": b.column(0).take(rows), "dim": b.column(1).take(rows), "table": pa.array(np.concatenate(places)), "cell": pa.array(np.concatenate(cells)), "node": b.column(2).take(rows),
            "weight": b.column(3).take(rows), "vec": pa.array(vec, pa.binary()), "codes": pa.concat_arrays(before),
        }

    return saved(by_rows(known, f"label {name}, dim int, table int, cell bigint, node bigint, weight bigint, vec binary, codes array<bigint>", make))


def vector_width(classes: DataFrame) -> str:
    """Vectors travel as they came: of four bytes a component, or eight."""
    return "f4" if classes.schema["v"].dataType.elementType.simpleString() == "float" else "f8"


def near_duplicates(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept): one row for each row of `df`."""
    v = F.col(f"`{vec}`")
    v = v if df.schema[vec].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    good = F.col("label").isNotNull() & usable("v")
    ok = rows.filter(good)
    classes = ok.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("v"))
    # Written, so a number once given stays.
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()))

    group, width = ["label", "dim", "table", "cell"], vector_width(classes)
    blocks = in_blocks(chunked(routed(classes, least), group, BLOCK, "node"))
    found = saved(blocks.groupBy(*group, "x", "y").applyInArrow(lambda t: cell_links(t, least, width), "node bigint, links bigint, root bigint"))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "component")
    per_class = classes.join(counts, "node", "left").join(joined, "node", "left")
    n_links = F.coalesce(F.col("links"), F.lit(0).cast("long")) + F.col("weight") - 1
    named = per_class.select("rep", "label", "v", "weight", n_links.alias("n_links"), F.coalesce("component", "node").alias("group"))
    # A component is named by a class; its smallest id is an aggregate over those that aren't alone.
    least_id = per_class.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("least_id"))
    named = named.join(least_id, F.col("group") == F.col("component"), "left").select("rep", "label", "v", "weight", "n_links", F.coalesce("least_id", "rep").alias("component_id"))
    # A class of one row is that row; the rows of others find their class by label and vector.
    one = named.filter("weight = 1").select(F.col("rep").alias("id"), "n_links", "component_id")
    more = ok.join(named.filter("weight > 1").drop("rep", "weight"), ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = one.unionByName(more).unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
