"""Registry and the views of the given tables that the queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query function; views in ``VIEWS`` are put in front of the SQL where it names them."""
    def add(fn):
        REGISTRY[name or fn.__name__] = Query(fn, with_views(sql) if sql else None)
        return fn
    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# SQL for the shared views, in dependency order
VIEWS = {
    "receipts": """SELECT o_custkey, o_orderkey, o_orderpriority, l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
        CAST(year(l_shipdate) AS INTEGER) AS ship_year, CAST(year(o_orderdate) AS INTEGER) AS order_year
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "openings": """SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice,
        CAST(year(o_orderdate) AS INTEGER) AS open_year FROM orders""",
    "spans": """SELECT event_id, user_id, event_type, value, CAST(year(ts) AS INTEGER) AS yr,
        floor(epoch(ts) / 60) AS m_start, floor(epoch(ts) / 60) + floor(value) AS m_end, floor(value) AS span_len,
        CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day_no FROM events""",
}


def with_views(sql: str) -> str:
    body = sql.strip().rstrip(";")
    needed = [n for n in VIEWS if f"{n} " in body + " " or f"{n})" in body or f"{n}\n" in body]
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[len('WITH'):].strip()}"
    return f"WITH {ctes} {body}"


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as spending records of an order (project) and a customer (unit)."""
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderpriority", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        F.year("l_shipdate").alias("ship_year"), F.year("o_orderdate").alias("order_year"))


def openings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as openings of a customer (unit) in a year."""
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice",
                                            F.year("o_orderdate").alias("open_year"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Events as intervals of a user (route) in whole minutes."""
    e = read(spark, sf, "events")
    minute = F.floor(F.unix_timestamp("ts") / 60).cast("double")
    return e.select("event_id", "user_id", "event_type", "value", F.year("ts").alias("yr"),
                    minute.alias("m_start"), (minute + F.floor("value")).alias("m_end"),
                    F.floor("value").cast("double").alias("span_len"),
                    F.floor(F.unix_timestamp("ts") / 86400).cast("bigint").alias("day_no"))


def day(column: str = "m_start") -> Column:
    """Part number for long ordered scans over minutes: the day."""
    return F.floor(F.col(column) / 1440)


def rnd(df: DataFrame, **places: int) -> DataFrame:
    """Round result columns so that the order of summation does not show."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in places.items()})
