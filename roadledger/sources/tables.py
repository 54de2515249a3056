"""Delimited, JSON and parquet sources, sinks and completeness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.functions.text import label_text
from roadledger.operators.ordered import first_row, group_ids
from roadledger.sources.records import read_quoted

# Layout of the headerless segment files.
SEGMENT_FILE_SCHEMA = """sh string, i int, rte string, seo string, st int, mpost double, seg double,
    check string, c string, stgp string, date1 int, date2 int, date3 int, date4 int, date5 int,
    date6 int, date7 int, date8 int, date9 int"""


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType,
             header: bool = True) -> DataFrame:
    """Delimited text with quoted commas, quotes and line breaks, read in splits; the schema is always declared."""
    return read_quoted(spark, path, schema, header).drop("source_file", "place")


def read_tagged(spark: SparkSession, paths: dict[str, int], schema: str = SEGMENT_FILE_SCHEMA,
                tag: str = "is_new") -> DataFrame:
    """Headerless files of one layout stacked, each with its tag."""
    return union_by_name([read_csv(spark, p, schema, header=False).withColumn(tag, F.lit(v))
                          for p, v in paths.items()])


def read_crosswalk(spark: SparkSession, path: str, keys: list[str], label: str, order: list[str],
                   columns: list[str]) -> DataFrame:
    """Zero-padded text columns kept as text, first row per key, labels without quotes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = read_csv(spark, path, schema)
    return first_row(rows, keys, order).withColumn(label, label_text(F.col(label)))


def read_results(spark: SparkSession, path: str | list[str], schema: T.StructType,
                 multiline: bool = True) -> DataFrame:
    """Stored JSON results; only the declared keys are read."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_roads(spark: SparkSession, path: str, columns: list[str], kinds: list[str], kind: str,
               name: str, named: bool | None = None) -> DataFrame:
    """Road edges: only the asked columns and classes leave the scan; named, unnamed or all."""
    rows = spark.read.parquet(path).where(F.col(kind).isin(*kinds))
    if named is not None:
        rows = rows.where(F.col(name).isNotNull() if named else F.col(name).isNull())
    return rows.select(*columns)


def explode_parts(df: DataFrame, parts: str, keys: list[str], out: str = "eid") -> DataFrame:
    """Multi-part lines to single lines, empty ones dropped, numbered 1..n along the keys and parts."""
    flat = df.where(F.size(parts) > 0).select("*", F.posexplode(parts).alias("part", "line")).drop(parts)
    flat = flat.where(F.size("line") > 0)
    return group_ids(flat, [*keys, "part"], out)


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000) -> None:
    """One table partitioned on disk.

    ``rebalance`` clusters rows by the partition value and lets AQE split a partition value that
    holds far more rows than the others, so no single task writes it.
    """
    (df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
     .partitionBy(*by).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def lite(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """The same rows without the text columns (a pruned view of the one stored table)."""
    return df.drop(*text_columns)


def code_list(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def missing_partitions(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected key values that no stored partition has."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def has_columns(df: DataFrame, required: list[str]) -> bool:
    return set(required) <= set(df.columns)


def read_or_rebuild(spark: SparkSession, path: str, required: list[str], build) -> DataFrame:
    """Stored table when it exists with all required columns, else ``build()`` written in its place."""
    from pyspark.errors import AnalysisException
    try:
        stored = spark.read.parquet(path)
        if has_columns(stored, required):
            return stored
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_fields(c: Column, schema: str) -> Column:
    """Parse a JSON text column with a declared schema; bad text gives NULL."""
    return F.from_json(c, schema)
