"""Reading tables by name, declaring their columns, and writing whole versions of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest whole number, and the bytes that a text without a declared capacity may have.
INT_MAX, CAPACITY = 4294967295, 255


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`; columns and filters are pruned at the scan by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def declared(**columns: str) -> T.StructType:
    """CREATE TABLE's columns, as name="INT" or name="VARCHAR(n)" (n bytes; VARCHAR alone has CAPACITY).

    Whole numbers are from 0 to INT_MAX and kept as bigint. The declaration is metadata of the schema, which Spark keeps
    in the files too. Other types, capacities below 1 and a first column that isn't INT, the key, are refused.
    """
    fields = []
    for i, (name, kind) in enumerate(columns.items()):
        k = kind.upper().replace(" ", "")
        if k == "INT":
            fields.append(T.StructField(name, T.LongType(), metadata={"whole": True, "key": i == 0}))
            continue
        size = k.removeprefix("VARCHAR").strip("()") or str(CAPACITY)
        if i == 0 or not k.startswith("VARCHAR") or not size.isdigit() or int(size) < 1:
            raise ValueError(f"column {name}: {kind}")
        fields.append(T.StructField(name, T.StringType(), metadata={"capacity": int(size)}))
    if not fields:
        raise ValueError("a table has columns")
    return T.StructType(fields)


def created(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The empty first version of a declared table."""
    return spark.createDataFrame([], schema)


def loaded(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` as rows of a declared table: columns by name; a row that doesn't fit makes the job fail."""
    out = []
    for f in schema:
        c, bad = F.col(f.name).cast(f.dataType), F.lit(False)
        if "capacity" in f.metadata:
            bad = F.octet_length(c) > f.metadata["capacity"]
        elif f.metadata.get("whole"):
            bad = (c < 0) | (c > INT_MAX) | (c.isNull() & F.lit(bool(f.metadata.get("key"))))
        fits = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{f.name}: value doesn't fit")).cast(f.dataType)).otherwise(c)
        out.append(fits.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def capacities(df: DataFrame) -> dict[str, int]:
    return {f.name: f.metadata["capacity"] for f in df.schema if "capacity" in f.metadata}


def whole_numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.metadata.get("whole")]


def write_version(df: DataFrame, root: str, name: str, version: int) -> str:
    """Write `df` as an immutable version of a table, failing if that version exists. Returns its path."""
    path = f"{root}/{name}/v{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def rename(spark: SparkSession, root: str, old: str, new: str) -> None:
    """RENAME TO: all versions of a table below `root` get a new name, which no table may have yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = path(f"{root}/{old}"), path(f"{root}/{new}")
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(source):
        raise ValueError(f"no table {old}")
    if fs.exists(target) or not fs.rename(source, target):
        raise ValueError(f"table {new} exists")


def read_evolved(spark: SparkSession, paths: list[str], defaults: dict[str, object]) -> DataFrame:
    """Read versions written under older schemas; columns that a file lacks get their default."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
