"""Scans, ingestion, dedupe, canonical rows and merges of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import first_by

#: Price quality of each data quality.
PRICE_QUALITY = {
    "observed-execution": "observed-execution",
    "historical-observed": "observed-execution",
    "oracle-converted": "oracle-converted",
    "historical-estimate": "historical-estimate",
    "market-proxy": "market-proxy",
    "observed-balance": "market-proxy",
    "price-proxy": "market-proxy",
}
HIGH_QUALITY = ("observed-execution", "oracle-converted")
LIFECYCLE = ("provisional", "unresolved", "mature")


def ingest_events(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows of incoming (key, seq, address, source, payload): first of each key, not yet in existing; with partition key and payload digest."""
    fresh = first_by(incoming, ["key"], ["seq"]).join(existing.select("key").distinct(), "key", "left_anti")
    return fresh.withColumn("partition_key", F.coalesce("address", "source")).withColumn("payload_sha256", F.sha2("payload", 256))


def dedupe_events(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """All rows with accepted (the first of each key) and, for the others, a reason."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return rows.withColumn("accepted", place == 1).withColumn("reason", F.when(~F.col("accepted"), "duplicate-key"))


def keyset_page(rows: DataFrame, columns: Sequence[str], after: Sequence[object], limit: int) -> DataFrame:
    """The next ``limit`` rows in tuple order behind the tuple ``after``."""
    return rows.where(F.struct(*columns) > F.struct(*[F.lit(a).alias(c) for c, a in zip(columns, after, strict=True)])).orderBy(*columns).limit(limit)


def compact_pair(pairs: DataFrame, column: str = "pair") -> DataFrame:
    """Flat fields of a nested pair in JSON, with 0 and null for what is missing."""
    schema = "pairAddress string, dexId string, baseToken struct<address string, symbol string>, priceUsd string, liquidity struct<usd double>, volume struct<m5 double, h1 double>, txns struct<m5 struct<buys int, sells int>>"
    p = pairs.withColumn("_p", F.from_json(column, schema))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return p.select(
        *[c for c in pairs.columns if c != column],
        F.col("_p.pairAddress").alias("pool"),
        F.coalesce("_p.dexId", F.lit("unknown")).alias("dex"),
        F.col("_p.baseToken.address").alias("token"),
        F.coalesce("_p.baseToken.symbol", F.lit("unknown")).alias("symbol"),
        F.coalesce(F.expr("try_cast(_p.priceUsd AS double)"), F.lit(0.0)).alias("price_usd"),
        zero("_p.liquidity.usd").alias("liquidity_usd"),
        zero("_p.volume.m5").alias("volume5m_usd"),
        zero("_p.volume.h1").alias("volume1h_usd"),
        zero("_p.txns.m5.buys").alias("buys5m"),
        zero("_p.txns.m5.sells").alias("sells5m"),
    )


def normalize_webhook(rows: DataFrame, column: str = "body") -> DataFrame:
    """One swap event per transaction in JSON; its mint is that of the first transfer."""
    schema = "signature string, slot bigint, feePayer string, tokenTransfers array<struct<mint string, tokenAmount double>>"
    b = rows.withColumn("_b", F.from_json(column, schema))
    first = F.get(F.filter("_b.tokenTransfers", lambda x: x["mint"].isNotNull()), F.lit(0))
    return b.select(F.col("_b.signature").alias("signature"), F.col("_b.slot").alias("slot"), F.col("_b.feePayer").alias("fee_payer"), first["mint"].alias("mint"), F.coalesce(F.size("_b.tokenTransfers"), F.lit(0)).alias("transfers"), F.lit("swap").alias("event_type"))


def export_manifest(rows: DataFrame, day: str, record_type: str, payload: str) -> DataFrame:
    """Per day and record type the rows, bytes and an order-free digest of what a segment holds."""
    half = lambda k: F.sum(F.conv(F.substring(F.md5(payload), k, 12), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(day, record_type).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(payload)).alias("bytes"), half(1).alias("digest0"), half(13).alias("digest1"))


def export_metrics(row: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form: keys, metric, value."""
    return row.unpivot([F.col(k) for k in keys], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def retention_filter(rows: DataFrame, at: str, now: int, keep_s: int, key: str, referenced: DataFrame) -> DataFrame:
    """Rows young enough, or whose key something still refers to."""
    young = rows.where(F.col(at) >= now - keep_s)
    held = rows.where(F.col(at) < now - keep_s).join(referenced.select(key).distinct(), key, "left_semi")
    return young.unionByName(held)


def archive_gated_retire(rows: DataFrame, intervals: DataFrame, key: str, at: str, width: int = 86_400) -> DataFrame:
    """Rows whose time lies in no verified archive interval (key, low, high) of their key; other columns may be null.

    Intervals are copied to the time buckets of ``width`` that they meet, so that a
    hot key spreads over its buckets.
    """
    first, last = F.floor(F.col("low") / width), F.floor(F.col("high") / width)
    spans = intervals.where("low <= high").select(F.col(key).alias("_key"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.explode(F.sequence(first, last)).alias("_of"))
    inside = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_of")) & F.col(at).between(F.col("_low"), F.col("_high"))
    return rows.withColumn("_bucket", F.floor(F.col(at) / width)).join(spans, inside, "left_anti").drop("_bucket")


def canonical_legs(legs: DataFrame, group: Sequence[str], base: str = "base_amount", quote: str = "quote_amount") -> DataFrame:
    """Legs of one trade as one: summed base, greatest quote, their ratio as price, number and ordered keys of legs."""
    total = F.sum(base)
    return legs.groupBy(*group).agg(
        total.alias("base_amount"), F.max(quote).alias("quote_amount"), F.try_divide(F.max(quote), total).alias("price_quote"),
        F.count(F.lit(1)).alias("legs"), F.array_join(F.sort_array(F.collect_list("leg_key")), ",").alias("leg_keys"),
    )


def merge_first_entry(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One entry per key: the existing one, unless it is unlinked and the incoming one is linked to a source."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    linked = (F.trim(F.coalesce("source_key", F.lit(""))) != "").cast("int")
    return first_by(both.withColumn("_linked", linked), keys, [F.desc("_linked"), "_new", "t", "entry_key"]).drop("_new", "_linked")


def merge_outcomes(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the row of furthest status; a stored row gives way only to a further one, and of a batch's rows the first counts."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("status"))
    one = first_by(both, [*keys, "_new"], ["seq"]).withColumn("_rank", rank)
    return first_by(one, keys, [F.desc("_rank"), "_new"]).drop("_new", "_rank")


def merge_fill_nulls(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Full outer merge that only fills nulls; changed tells whether a stored row gained a value. Of repeated incoming keys one row counts: the one with most values, then the least."""
    whole, nulls = F.struct(*fill), F.struct(sum((F.col(c).isNull().cast("int") for c in fill), F.lit(0)), *fill)
    new = incoming.groupBy(*keys).agg(F.min_by(whole, nulls).alias("_new")).select(*keys, *[F.col(f"_new.{c}").alias(f"n_{c}") for c in fill])
    old = existing.select(*keys, *fill, F.lit(True).alias("_have"))
    joined = old.join(new, keys, "full")
    gained = F.lit(False)
    for c in fill:
        gained = gained | (F.col(c).isNull() & F.col(f"n_{c}").isNotNull())
    return joined.select(*keys, *[F.coalesce(c, f"n_{c}").alias(c) for c in fill], (F.coalesce("_have", F.lit(False)) & gained).alias("changed"))


def append_if_changed(history: DataFrame, snapshot: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """Snapshot rows that differ from the latest stored row of their key."""
    latest = history.groupBy(key).agg(F.max_by(F.struct(*values), at).alias("_last"))
    return snapshot.join(latest, key, "left").where(~F.struct(*values).eqNullSafe(F.col("_last"))).drop("_last")


def normalize_quantity(trades: DataFrame, market: Sequence[str], missing_decimals: int = 12) -> DataFrame:
    """base_units: raw amounts scaled exactly to the most decimals of their market; text amounts are rounded half up to it.

    Amounts are decimals of 38 digits; what does not fit gives null, so that such
    rows can be set aside.
    """
    own = F.when(F.col("base_raw").isNotNull(), F.col("base_decimals")).otherwise(missing_decimals)
    out = trades.withColumn("decimals", F.max(own).over(Window.partitionBy(*market)))
    # powers of ten as text: a product of decimals would lose digits of the fraction
    shifted = F.concat(F.col("base_raw").try_cast("decimal(38,0)").cast("string"), F.repeat(F.lit("0"), F.col("decimals") - F.col("base_decimals")))
    raw = F.expr("try_cast(_shifted AS decimal(38,0))")
    text = F.col("base_amount").try_cast("decimal(38,18)").cast("string")
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.rpad(F.split_part(text, F.lit("."), F.lit(2)), 38, "0")
    out = out.withColumn("_shifted", shifted).withColumn("_text", F.concat(whole, F.substring(part, F.lit(1), F.col("decimals"))))
    up = F.when(F.substring(part, F.col("decimals") + 1, F.lit(1)) >= "5", F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)).otherwise(0)
    rounded = F.try_add(F.expr("try_cast(_text AS decimal(38,0))"), up.cast("decimal(38,0)")).try_cast("decimal(38,0)")
    return out.withColumn("base_units", F.when(F.col("base_raw").isNotNull(), raw).otherwise(rounded)).drop("_shifted", "_text")


def price_quality(data_quality: Column, given: Column | None = None) -> Column:
    """Price quality of a row: the given one, else that of its data quality; null where that is unknown."""
    names = F.create_map(*[F.lit(x) for pair in PRICE_QUALITY.items() for x in pair])
    found = F.try_element_at(names, data_quality)
    return found if given is None else F.coalesce(given, found)


def combine_qualities(quality: Column) -> Column:
    """Aggregate: quality of what several prices make together. The weakest counts; observed and converted ones are converted."""
    return (
        F.when(F.bool_and(quality == "observed-execution"), "observed-execution")
        .when(F.bool_and(quality.isin(*HIGH_QUALITY)), "oracle-converted")
        .when(F.bool_or(quality == "historical-estimate"), "historical-estimate")
        .otherwise("market-proxy")
    )


def watermark_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the greatest contiguous slot; it never moves back."""
    return existing.unionByName(incoming).groupBy(*keys).agg(F.max("slot").alias("slot"))


def finality_reconcile(events: DataFrame, finality: DataFrame) -> DataFrame:
    """Pending events whose signature's finality is known: finalized ones are upgraded, failed and unresolved ones rolled back."""
    pending = events.where(F.col("status").isin("pending", "retry") & F.col("finality_required")).join(finality, "signature")
    final = F.col("finality") == "finalized"
    return pending.where(final | F.col("finality").isin("failed", "unresolved")).select("key", "signature", F.when(final, "finalized").otherwise(F.col("commitment")).alias("commitment"), F.when(final, F.col("status")).otherwise("rolled_back").alias("status"))
