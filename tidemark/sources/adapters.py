"""Views of the given tables as trades, prices, entries and events, and the same views as DuckDB SQL.

Times are whole epoch seconds (``t``); days are ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))").cast("long")


def trades(spark: SparkSession, sf_dir: str, short_key: bool = False) -> DataFrame:
    """Trades from lineitem and part; with the short key, keys repeat."""
    key = "concat_ws(':', l_orderkey, l_linenumber)" if short_key else "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))"
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return rows.select(
        F.expr(key).alias("key"),
        F.lit("c").alias("chain"),
        F.lit("s").alias("strategy"),
        F.col("l_orderkey").cast("string").alias("signature"),
        F.floor(seconds("l_shipdate") / 86400).cast("long").alias("slot"),
        seconds("l_shipdate").alias("t"),
        F.concat(F.lit("w"), "l_suppkey").alias("wallet"),
        F.col("p_brand").alias("token"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("value_usd"),
        F.lit(0.0).alias("pool_age_minutes"),
        F.when(F.col("l_linestatus") == "O", "observed-execution").otherwise("price-proxy").alias("data_quality"),
    )


def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return rows.select(
        F.col("event_id").alias("obs_key"),
        k.alias("token"),
        F.concat(F.lit("p"), k).alias("pool"),
        F.col("value").alias("price_usd"),
        (F.col("value") * 1000).alias("liquidity_usd"),
        ((F.col("event_type") == "error") & (F.col("value") < 1)).alias("rugged"),
        seconds("ts").alias("t"),
        F.col("event_type"),
        F.concat(F.lit("u"), "user_id").alias("wallet"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First purchase per user and market."""
    from tidemark.functions.common import first_by

    bought = price_observations(spark, sf_dir).where("event_type = 'purchase'")
    first = first_by(bought, ["wallet", "token"], ["t", "obs_key"])
    return first.select(F.col("obs_key").alias("entry_key"), "wallet", "token", "pool", F.col("price_usd").alias("entry_price"), "liquidity_usd", "t")


TRADES = """trades AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS key, concat_ws(':', l_orderkey, l_linenumber) AS short_key,
    'c' AS chain, 's' AS strategy, CAST(l_orderkey AS VARCHAR) AS signature, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS slot,
    date_diff('second', TIMESTAMP '1970-01-01', l_shipdate) AS t, 'w' || l_suppkey AS wallet, p_brand AS token,
    CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS qty, l_extendedprice AS value_usd, 0.0::DOUBLE AS pool_age_minutes,
    CASE WHEN l_linestatus = 'O' THEN 'observed-execution' ELSE 'price-proxy' END AS data_quality
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PRICES = """prices AS (
  SELECT event_id AS obs_key, json_extract_string(props, '$.k') AS token, 'p' || json_extract_string(props, '$.k') AS pool, value AS price_usd,
    value * 1000 AS liquidity_usd, event_type = 'error' AND value < 1 AS rugged, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS t,
    event_type, 'u' || user_id AS wallet FROM events)"""

ENTRIES = """entries AS (
  SELECT obs_key AS entry_key, wallet, token, pool, price_usd AS entry_price, liquidity_usd, t FROM (
    SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY t, obs_key) AS place FROM prices WHERE event_type = 'purchase') WHERE place = 1)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
