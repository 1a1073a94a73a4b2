"""Catalog answers as DataFrames, views, parameterised statements and plan reports, all on Spark's own session catalog."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.mutations import integrity_report

ENGINE, VERSION = "granary", "1.0"


def table_info(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """One row per column: table, position, name, type, whether it is the key."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.name == key) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "tbl_name string, cid int, name string, type string, pk boolean")


def master(spark: SparkSession) -> DataFrame:
    """(type, name, tbl_name) of the session's tables and views."""
    rows = [("view" if t.isTemporary or t.tableType == "VIEW" else "table", t.name, t.name) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "type string, name string, tbl_name string")


def folder_tables(spark: SparkSession, root: str) -> DataFrame:
    """(type, name, tbl_name) of the tables below a folder, by names alone."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*.parquet")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in found or [])
    return spark.createDataFrame([("table", n, n) for n in names], "type string, name string, tbl_name string")


def system_values(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(ENGINE).alias("database"))


def create_view(spark: SparkSession, name: str, sql: str) -> None:
    spark.sql(sql).createOrReplaceTempView(name)


def rename_view(spark: SparkSession, old: str, new: str) -> None:
    """RENAME TO for a name of the session; Spark refuses a missing old and a taken new one."""
    spark.sql(f"ALTER VIEW `{old}` RENAME TO `{new}`")


class Prepared:
    """A statement with ? markers, bound by Spark itself, so values never become SQL text."""

    def __init__(self, spark: SparkSession, sql: str):
        self.spark, self.sql = spark, sql

    def execute(self, *args: object) -> DataFrame:
        return self.spark.sql(self.sql, args=list(args))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def explain_analyze(df: DataFrame) -> dict[str, object]:
    """Run the whole query, its rows going nowhere, and report its plan, rows and seconds."""
    seen, began = Observation(), time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return {"plan": explain(df), "rows": seen.get["rows"], "seconds": time.time() - began}


def check(df: DataFrame, key: str) -> DataFrame:
    """Integrity report with capacities and ranges that the schema's types imply."""
    ints = tuple(f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType)))
    return integrity_report(df, key, int_columns=ints)
