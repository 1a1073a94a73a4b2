"""Token counts from flat token files without an index, by scanning for the end-of-document identifier.

A shard is one long run of 16-bit identifiers; documents follow one another, each closed by the separator. Shards are
read as blocks cut anywhere, by ranges of bytes, so a file of any length is many tasks. Each block is searched on its own
with vector operations, which gives its length, its number of separators and where the first and the last stand. A prefix
scan over these few numbers, first within groups of GROUP blocks and then over the groups of a shard, gives every block
the ordinal and the length that the documents open at its start have so far, and so stitches the boundaries.

Empty documents count as zero tokens. What follows a shard's last separator is a last document without an end, reported
as such if it has tokens. Blocks without any separator only lengthen the open document. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Bytes of a block, blocks of a group, and bytes of files that a task reads.
BLOCK, GROUP, TASK = 1 << 20, 256, 128 << 20
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A rank file as an encoding, made once per Python worker."""
    if path not in _encodings:
        import base64

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def tokenised(df: DataFrame, path: str, pattern: str, separator: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Write the texts as token shards, one per task, in blocks of `block` bytes.

    Returns the blocks (shard, block, payload), and (shard, ordinal, key), which says whose document is which.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at, n, rest = encoding(path, pattern), TaskContext.get().partitionId(), 0, 0, bytearray()
        names = ["shard", "block", "payload", "keys", "first"]

        def row(number: int | None, data: bytes | None, keys: list | None, first: int) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(key_type), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, number, data, keys, first), types, strict=True)], names=names)

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            for k in range(0, b.num_rows, 4096):
                keys = b.column(0).slice(k, 4096).to_pylist()
                yield row(None, None, keys, n)
                n += len(keys)
            for t in b.column(1):
                ids = enc.encode_ordinary(t.as_py() or "")
                ids.append(separator)
                rest += np.array(ids, "<u2").tobytes()
                while len(rest) >= block:
                    yield row(at, bytes(rest[:block]), None, 0)
                    at, rest = at + 1, rest[block:]
        if rest:
            yield row(at, bytes(rest), None, 0)

    made = saved(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"shard int, block bigint, payload binary, keys array<{kind}>, first bigint"))
    owners = made.filter("block IS NULL").select("shard", F.posexplode("keys").alias("i", key), "first").select("shard", (F.col("first") + F.col("i")).alias("ordinal"), key)
    return made.filter("block IS NOT NULL").select("shard", "block", "payload"), owners


def read_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Flat token files of any length as blocks; a file is a shard named by its path, and its ranges are read by tasks.

    Spark lists the files; ranges are read through Arrow's file systems, which have to know the path's scheme.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("shard"), "length").filter("length > 0")
    cuts = files.select("shard", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block"))
    # A number of tasks by the bytes to read, as the rows to deal say nothing of these; small inputs use every core.
    tasks = (files.agg(F.sum("length")).first()[0] or 0) // TASK + 1
    dealt = cuts.repartition(max(tasks, spark.sparkContext.defaultParallelism), "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length, k in zip(*[c.to_pylist() for c in b.columns], strict=True):
                system, at = fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    data = f.read_at(min(block, length - k * block), k * block)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "payload"])

    return dealt.mapInArrow(run, "shard string, block bigint, payload binary")


def scan(blocks: DataFrame, separator: int) -> DataFrame:
    """For each block: n identifiers, its separators' number and ends, and the lengths of documents wholly inside."""
    kind = blocks.schema["shard"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                at = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, (np.diff(at) - 1).tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["shard", "block", "n", "seps", "first", "last", "inner"])

    return blocks.select("shard", "block", "payload").mapInArrow(run, f"shard {kind}, block bigint, n bigint, seps bigint, first bigint, last bigint, inner array<bigint>")


def placed(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with (base, ordinal, since): identifiers and separators before each, and where its first document began.

    Also (shard, n, ordinal, since), the same at each shard's end.
    """
    zero = F.lit(0).cast("long")
    blocks = scanned.select("shard", "block", "n", "seps", "last", F.floor(F.col("block") / GROUP).alias("part"))
    own = Window.partitionBy("shard", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.withColumns({"n_in": F.coalesce(F.sum("n").over(own), zero), "seps_in": F.coalesce(F.sum("seps").over(own), zero)})
    # The document open at a block's start began right after the last separator of the blocks before.
    based = based.withColumn("end", F.col("n_in") + F.col("last") + 1).withColumn("since_in", F.max("end").over(own))
    groups = based.groupBy("shard", "part").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("end").alias("end"))
    # One row for each GROUP blocks.
    over = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"n_to": F.coalesce(F.sum("n").over(over), zero), "seps_to": F.coalesce(F.sum("seps").over(over), zero)}).withColumn("at", F.col("n_to") + F.col("end"))
    groups = groups.withColumn("since_to", F.coalesce(F.max("at").over(over), zero))
    ends = groups.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("seps").alias("ordinal"), F.coalesce(F.max("at"), zero).alias("since"))
    joined = based.select("shard", "part", "block", "n_in", "seps_in", "since_in").join(groups.select("shard", "part", "n_to", "seps_to", "since_to"), ["shard", "part"])
    since = F.coalesce(F.col("n_to") + F.col("since_in"), "since_to")
    return joined.select("shard", "block", (F.col("n_to") + F.col("n_in")).alias("base"), (F.col("seps_to") + F.col("seps_in")).alias("ordinal"), since.alias("since")), ends


def counts(blocks: DataFrame, separator: int) -> DataFrame:
    """(shard, ordinal, n_tokens, closed): one row per document, the separator not counted."""
    scanned = saved(scan(blocks, separator))
    places, ends = placed(scanned)
    lengths = F.concat(F.array(F.col("base") + F.col("first") - F.col("since")), "inner")
    closed = scanned.filter("seps > 0").select("shard", "block", "first", "inner").join(places, ["shard", "block"])
    closed = closed.select("shard", F.posexplode(lengths).alias("i", "n_tokens"), "ordinal").select("shard", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    tail = ends.filter("n > since").select("shard", "ordinal", (F.col("n") - F.col("since")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tail)
