"""Exact removal of long repeated byte strings by a distributed sort of suffixes.

Every byte that lies in a string of `length` bytes which starts anywhere else as well is removed. Sorting all suffixes of
a corpus would move each byte some hundred times, so suffixes are sampled in a way that loses nothing: of a window of
`length` bytes, the anchor is its least hashed `gram`, so equal windows have equal anchors at equal places. Consecutive
windows of one anchor are one stretch; its suffixes from the anchor on, and its prefixes back from the anchor, decide all
of its windows:

1. A pass over the texts finds the stretches. Anchors that stand once repeat nothing. An aggregation by anchor and
   content makes equal stretches one; those that stand more than once are repeated as a whole.
2. One text of each content whose anchor has several goes on. Tasks sort their suffixes and reversed prefixes and
   front-code them; runs are exchanged by anchor and merged by loser trees that never compare a known prefix again.
   The merged orders give common-prefix lengths, and with them which windows of each stretch stand in another.
   An anchor with very many contents would fill one task. Its windows are split by where in them the anchor stands, into
   two halves again and again: all windows of a half share some bytes around the anchor, so its strings are grouped by
   these too. At the end of this a group is of one window, and needs no merge.
3. Results meet the stretches of all texts, and per text the covered bytes go.

Null and empty texts have no bytes. Matches never cross texts. Very long texts are cut into pieces of window starts, so
memory is bounded; a cut stretch is only a shorter one. Copies, repeats within a text and overlaps all count; texts are
judged as they came. Rows are told apart by a number of their own, so each gives a row, whether its id is null or stands
on other rows too, and every row's text counts for all others. Further columns play no part. Contents are told apart by
128 hashed bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .suffix_merge import decode, front_code, merge
from .vectors import by_rows

LENGTH, GRAM = 200, 32
PIECE = 1 << 17  # window starts at a time
PER_BUCKET, RUN = 12_000, 20_000  # contents merged by one task, and sorted into one set of runs
HOT = PER_BUCKET  # contents of a group that would make a bucket of their own: its windows are split in halves
SHARES = 1000  # keys that may stand for a thousandth of all stretches each
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(base: int, n: int) -> np.ndarray:
    out, m = np.ones(n, np.uint64), 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * np.uint64(pow(base, m, 1 << 64))
        m += k
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of substrings: sums of random values per byte times powers of a base, modulo 2^64, from running sums."""

    def __init__(self, n: int):
        rng = np.random.default_rng(3)
        self.value = [rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in BASES]
        self.up = [powers(b, n) for b in BASES]
        self.down = [powers(pow(b, -1, 1 << 64), n) for b in BASES]

    def sums(self, x: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.value[which][x] * self.down[which][: len(x)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.up[which][start] + (end - start).astype(np.uint64))


_hashers: dict[int, Hasher] = {}


def hasher(length: int) -> Hasher:
    if length not in _hashers:
        _hashers[length] = Hasher(PIECE + 2 * length)
    return _hashers[length]


def stretches(data: bytes, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor hash, content hash, start, ahead, windows) of all stretches; `ahead`: bytes from start to the anchor."""
    a, width, h, out = np.frombuffer(data, np.uint8), length - gram + 1, hasher(length), []
    low = np.uint64((1 << 20) - 1)
    for c in range(0, len(a) - length + 1, PIECE):
        x = a[c : c + PIECE + length - 1]
        windows = len(x) - length + 1
        s0, s1 = h.sums(x, 0), h.sums(x, 1)
        grams = np.arange(len(x) - gram + 1)
        g = h.of(s0, grams, grams + gram, 0)
        # The least gram of each window, leftmost first: hash bits above, place below, sliding minimum by blocks.
        v = np.concatenate([(g & ~low) | grams.astype(np.uint64), np.full(-len(g) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
        left, right = np.minimum.accumulate(v, 1).ravel(), np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & low).astype(np.int64)
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        end = np.append(start[1:], windows)
        at = place[start]
        out.append((g[at], h.of(s0, start, end + length - 1, 0) ^ h.of(s1, start, end + length - 1, 1), c + start, at - start, end - start))
    return out


def packed(start: np.ndarray, ahead: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return start << 20 | ahead << 10 | windows


def raw(value: pa.Scalar) -> bytes:
    """A text's bytes in UTF-8; null is empty."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def found_in(blobs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, content, doc, place): every stretch of every text of (doc, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate([h[i] for h in held]) for i in range(3)]
            ids = pa.concat_arrays([h[3] for h in held])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), ids, pa.array(cols[2])], names=["anchor", "content", "doc", "place"])

        for b in batches:
            for i in range(b.num_rows):
                for g, c, start, ahead, windows in stretches(unsqueezed(b.column(1)[i]), length, gram):
                    held.append((g, c, packed(start, ahead, windows), b.column(0).take(pa.array(np.full(len(g), i)))))
                    rows += len(g)
                    if rows >= 50_000:
                        yield flush()
                        rows = 0
        if held:
            yield flush()

    return blobs.mapInArrow(run, "anchor bigint, content bigint, doc bigint, place bigint")


def squeezed(docs: DataFrame) -> DataFrame:
    """(key, blob): texts compressed for the exchange."""

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        z = zstandard.ZstdCompressor(level=3)
        return {"key": b.column(0), "blob": pa.array([z.compress(raw(t)) for t in b.column(1)], pa.binary())}

    return by_rows(docs, f"key {docs.schema[0].dataType.simpleString()}, blob binary", make, 256)


def unsqueezed(value: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer().to_pybytes())


def cut(b: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    """Each wanted stretch's bytes before its anchor and from it on."""
    out: dict[str, list] = {k: [] for k in ("anchor", "content", "left", "right")}
    for blob, wanted in zip(b.column(0), b.column(1), strict=True):
        data = unsqueezed(blob)
        for w in wanted.as_py():
            start, ahead, windows = w["place"] >> 20, w["place"] >> 10 & 1023, w["place"] & 1023
            out["anchor"].append(w["anchor"])
            out["content"].append(w["content"])
            out["left"].append(data[start : start + ahead])
            out["right"].append(data[start + ahead : start + windows - 1 + length])
    kinds = {"anchor": pa.int64(), "content": pa.int64(), "left": pa.binary(), "right": pa.binary()}
    return {k: pa.array(v, kinds[k]) for k, v in out.items()}


RUNS = ["bucket", "anchor", "content", "least", "most", "lo", "hi", *[f"{side}_{x}" for side in ("right", "left") for x in ("at", "lcp", "size", "rest")]]


def sorted_runs(buckets: int, length: int):  # noqa: ANN201
    """Rows (group, anchor, content, lo, hi, left, right) to one front-coded run per bucket, for each RUN rows of a task."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r[0] % buckets, []).append(r)
        out: dict[str, list] = {k: [] for k in RUNS}
        for bucket, own in by.items():
            out["bucket"].append(bucket)
            meta = (("anchor", "<i8", lambda r: r[1]), ("content", "<i8", lambda r: r[2]), ("least", "<u2", lambda r: length - len(r[6])), ("most", "<u2", lambda r: len(r[5])), ("lo", "<u2", lambda r: r[3]), ("hi", "<u2", lambda r: r[4]))
            for k, t, of in meta:
                out[k].append(np.array([of(r) for r in own], t).tobytes())
            for side, strings in (("right", [r[6] for r in own]), ("left", [r[5][::-1] for r in own])):
                order = sorted(range(len(own)), key=strings.__getitem__)
                lcp, size, rest = front_code([strings[i] for i in order])
                for k, v in (("at", np.array(order, "<u4").tobytes()), ("lcp", lcp), ("size", size), ("rest", rest)):
                    out[f"{side}_{k}"].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in out.items()], names=RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(*[c.to_pylist() for c in b.columns], strict=True)
            if len(rows) >= RUN:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)

    return run


def repeated_windows(least: np.ndarray, most: np.ndarray, right: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """(strings, offsets) true where the window that has its anchor at this offset stands in another string too.

    `right` and `left` are (order, common prefix with the one before). At an offset of l bytes, strings whose neighbours
    in the one order share length - l bytes and in the other l bytes hold the same window.
    """
    n = len(least)
    out = np.zeros((n, int(most.max()) + 1 if n else 0), bool)
    r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for off in range(out.shape[1]):
        r_class[right[0]] = np.cumsum(right[1] < length - off)
        l_class[left[0]] = np.cumsum(left[1] < off)
        own = np.flatnonzero((least <= off) & (off <= most))
        key = r_class[own] * (n + 1) + l_class[own]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        out[own[order], off] = np.append(False, same) | np.append(same, False)
    return out


def merged(b: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    """A bucket's runs merged: (anchor, content, mask), a bit per window from the stretch's start, where any repeats."""
    anchors, contents, masks = [], [], []
    for runs in b.column(0):
        rs = runs.as_py()
        meta = [np.concatenate([np.frombuffer(r[k], t) for r in rs]).astype(np.int64) for k, t in (("anchor", "<i8"), ("content", "<i8"), ("least", "<u2"), ("most", "<u2"), ("lo", "<u2"), ("hi", "<u2"))]
        base = np.cumsum([0] + [len(r["least"]) // 2 for r in rs])
        sides = []
        for side in ("right", "left"):
            order, prefix = merge([decode(*(r[f"{side}_{k}"] for k in ("lcp", "size", "rest"))) for r in rs])
            at = [np.frombuffer(r[f"{side}_at"], "<u4") for r in rs]
            sides.append((np.array([base[i] + at[i][j] for i, j in order], np.int64), np.array(prefix, np.int64)))
        least, most, lo, hi = meta[2:]
        hit = repeated_windows(np.maximum(least, lo), np.minimum(most, hi - 1), *sides, length)
        for i in np.flatnonzero(hit.any(1)):
            anchors.append(meta[0][i])
            contents.append(meta[1][i])
            own = np.zeros(most[i] + 1, bool)
            own[: hit.shape[1]] = hit[i, : most[i] + 1]
            masks.append(np.packbits(own[least[i] :][::-1]).tobytes())
    return {"anchor": pa.array(anchors, pa.int64()), "content": pa.array(contents, pa.int64()), "mask": pa.array(masks, pa.binary())}


def grouped(strings: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Strings in groups of at most HOT, each for the windows with lo to hi - 1 bytes before the anchor.

    Windows of one range share `lo` bytes before and length - hi + 1 from the anchor on, so strings that repeat one another
    in it are in one group. Also (anchor, content, left, right, lo) of the larger groups of single windows, which all repeat.
    """
    cold, single = [], []
    now = strings.withColumns({"lo": F.lit(0), "hi": F.lit(length)})
    while True:
        around = F.expr(f"concat(hex(substring(left, -lo, lo)), '/', hex(substring(right, 1, {length} - hi + 1)))")
        keyed = now.withColumn("key", F.md5(F.concat_ws("/", "anchor", "lo", "hi", around)))
        large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key")
        cold.append(keyed.join(large, "key", "left_anti"))
        hot = saved(keyed.join(large, "key", "left_semi"))
        single.append(hot.filter("hi - lo = 1"))
        wide = hot.filter("hi - lo > 1")
        if wide.isEmpty():
            break
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("hi").alias("b"))))
        now = wide.withColumn("half", halves).select("anchor", "content", "left", "right", F.col("half.a").alias("lo"), F.col("half.b").alias("hi"))
        # A half is for the strings that have a window in it.
        now = now.filter((F.octet_length("left") >= F.col("lo")) & (F.octet_length("right") >= length - F.col("hi") + 1))
    joined = lambda parts: reduce(lambda x, y: x.unionByName(y), parts)
    return joined(cold), joined(single)


def one_window(b: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    """The masks of strings of which the window with `lo` bytes before the anchor is repeated."""
    masks = []
    for left, right, lo in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
        least, most = length - len(right.as_buffer()), len(left.as_buffer())
        own = np.zeros(most + 1, bool)
        own[lo] = True
        masks.append(np.packbits(own[max(least, 0) :][::-1]).tobytes())
    return {"anchor": b.column(0), "content": b.column(1), "mask": pa.array(masks, pa.binary())}


def covered(size: int, hits: list[dict], length: int) -> np.ndarray:
    """Which bytes lie in a repeated window; a hit without a mask is repeated as a whole."""
    starts = np.zeros(size + 1, np.int32)
    for r in hits:
        at, windows = r["place"] >> 20, r["place"] & 1023
        if r["mask"] is None:
            starts[at : at + windows] = 1
        else:
            bits = np.unpackbits(np.frombuffer(r["mask"], np.uint8))[:windows]
            starts[at : at + len(bits)] = np.maximum(starts[at : at + len(bits)], bits)
    step = starts[:size].copy()
    step[length:] -= starts[: max(0, size - length)]
    return np.cumsum(step) > 0


def met(rows: DataFrame, others: DataFrame, keys: list[str], share: int) -> DataFrame:
    """`rows` joined with `others`, whose `n` says how many rows they meet and isn't kept.

    Keys that more than `share` rows have are SHARES at most, so these are broadcast and their rows stay where they are.
    """
    hot, cold = F.broadcast(others.filter(F.col("n") > share).drop("n")), others.filter(F.col("n") <= share).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def repeated(df: DataFrame, key: str, text: str, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(doc, key, blob) of all texts, and (doc, hits): the repeated stretches of those that have any."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    # Written, so a number once given stays.
    blobs = saved(squeezed(docs).withColumn("doc", F.monotonically_increasing_id()))
    rows = saved(found_in(blobs.select("doc", "blob"), length, gram))
    anchors = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("content") != F.max("content")).alias("several")).filter("n > 1")
    anchors, share = saved(anchors), max(rows.count() // SHARES, 1)
    # Stretches of anchors that stand more than once, equal ones as one: what stands twice repeats, and what differs goes on.
    kept = met(rows, anchors, ["anchor"], share).groupBy("anchor", "content", "several").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("first"))
    kept = saved(kept)

    wanted = kept.filter("several").groupBy("first.doc").agg(F.collect_list(F.struct("anchor", "content", "first.place")).alias("wanted"))
    strings = saved(by_rows(blobs.select("doc", "blob").join(wanted, "doc").select("blob", "wanted"), "anchor bigint, content bigint, left binary, right binary", lambda b: cut(b, length), 64))
    cold, single = grouped(strings, length)
    cold = cold.select(F.xxhash64("key").alias("group"), "anchor", "content", "lo", "hi", "left", "right")
    buckets = max(1, cold.count() // PER_BUCKET)
    runs = cold.mapInArrow(sorted_runs(buckets, length), ", ".join(f"{k} {'bigint' if k == 'bucket' else 'binary'}" for k in RUNS))
    groups = runs.groupBy("bucket").agg(F.collect_list(F.struct(*RUNS[1:])).alias("runs")).select("runs")
    masks = by_rows(groups, "anchor bigint, content bigint, mask binary", lambda b: merged(b, length), 1)
    masks = masks.unionByName(by_rows(single.select("anchor", "content", "left", "right", "lo"), "anchor bigint, content bigint, mask binary", lambda b: one_window(b, length)))

    whole = kept.filter("n > 1").select("anchor", "content", "n", F.lit(None).cast("binary").alias("mask"))
    part = kept.filter("n = 1").select("anchor", "content", "n").join(masks, ["anchor", "content"])
    results = saved(whole.unionByName(part))
    hits = met(rows, results, ["anchor", "content"], share).groupBy("doc").agg(F.collect_list(F.struct("place", "mask")).alias("hits"))
    return blobs, hits


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, kept_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row for each row of `df`.

    `kept` has the bytes that are left, as a cut may fall inside a character.
    """
    blobs, hits = repeated(df, key, text, length, gram)

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for blob, found in zip(b.column(1), b.column(2), strict=True):
            data, gone, spans = unsqueezed(blob), 0, 0
            left = data
            if found.is_valid:
                drop = covered(len(data), found.as_py(), length)
                gone, spans = int(drop.sum()), int((drop & ~np.append(False, drop[:-1])).sum())
                left = np.frombuffer(data, np.uint8)[~drop].tobytes()
            for k, v in zip(out, (len(data), gone, spans, hashlib.sha256(left).hexdigest(), left), strict=True):
                out[k].append(v)
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        return {"key": b.column(0)} | {k: pa.array(v, kinds[k]) for k, v in out.items() if k != "kept" or kept_text}

    schema = f"key {blobs.schema['key'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept_text
    return by_rows(blobs.join(hits, "doc", "left").select("key", "blob", "hits"), schema, make, 128).withColumnRenamed("key", key)
