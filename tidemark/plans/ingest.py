"""Registered queries over ingestion, dedupe and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.common import deterministic_id, first_by
from tidemark.functions.scratch import shared_folder
from tidemark.operators import archive
from tidemark.operators import ingest as I
from tidemark.sources import adapters as A

T0 = 1_704_067_200  # 2024-01-01, the first day of the given events
DAY = 86_400
PRICES, ENTRIES = A.with_views(A.PRICES), A.with_views(A.PRICES, A.ENTRIES)


def inbox(spark, d):
    p = A.price_observations(spark, d)
    return p.select(F.concat_ws(":", "wallet", "token", "event_type").alias("key"), F.col("obs_key").alias("seq"), F.when(F.col("obs_key") % 3 > 0, F.col("pool")).alias("address"), F.col("event_type").alias("source"), F.concat_ws("|", "token", "wallet", "obs_key").alias("payload"), "t")


def a1(spark, d):
    rows = inbox(spark, d)
    return I.ingest_events(rows, rows.where(f"t < {T0 + 10 * DAY}")).select("key", "seq", "partition_key", "payload_sha256")


def a2(spark, d):
    lines, parts = A.table(spark, d, "lineitem"), A.table(spark, d, "part").select("p_partkey", "p_brand")
    t = lines.join(parts, lines.l_partkey == parts.p_partkey)
    legs = t.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_shipdate", "p_brand", "l_quantity"))), lambda x: F.struct(x["p_brand"].alias("mint"), x["l_quantity"].alias("tokenAmount"))).alias("tokenTransfers"))
    body = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("signature"), (F.col("l_orderkey") * 3).alias("slot"), F.lit("fee").alias("feePayer"), "tokenTransfers"))
    return I.normalize_webhook(legs.select(body.alias("body")))


def a3(spark, d):
    p = A.price_observations(spark, d).select(F.floor((F.col("t") - T0) / DAY).alias("day"), "event_type", F.concat_ws("|", "obs_key", "token", "wallet").alias("payload"))
    return I.export_manifest(p, "day", "event_type", "payload").withColumns({c: F.col(c).cast("string") for c in ("digest0", "digest1")})


def a4(spark, d):
    """Price rows archived by day and type, read back and proved."""
    p = A.price_observations(spark, d).select("obs_key", "token", "wallet", "event_type", F.floor((F.col("t") - T0) / DAY).alias("day"))
    lines = archive.json_lines(p, F.col("day"), F.col("event_type"), ["obs_key", "token", "wallet"])
    at = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    out = archive.verify(archive.write(lines, at), archive.read_frames(spark, at))
    return out.select("day", "kind", "rows", "bytes", "source_sha256", "status")


def a5(spark, d):
    return I.keyset_page(A.trades(spark, d), ["slot", "t", "signature", "key"], [10_000, 10_000 * DAY, "", ""], 500).select("slot", "t", "signature", "key")


def pairs(spark, d):
    p, n = A.table(spark, d, "part"), F.col("p_partkey")
    nested = F.struct(
        F.concat(F.lit("p"), n).alias("pairAddress"), F.when(n % 4 > 0, "dex").alias("dexId"), F.struct(F.col("p_brand").alias("address"), F.when(n % 5 > 0, F.col("p_name")).alias("symbol")).alias("baseToken"),
        F.when(n % 6 > 0, F.col("p_retailprice").cast("string")).alias("priceUsd"), F.when(n % 7 > 0, F.struct((n * 10.5).alias("usd"))).alias("liquidity"),
        F.struct((n * 1.5).alias("m5"), F.when(n % 3 > 0, n * 9.5).alias("h1")).alias("volume"), F.struct(F.struct((n % 9).cast("int").alias("buys"), F.lit(None).cast("int").alias("sells")).alias("m5")).alias("txns"),
    )
    return p.select(n.alias("seq"), F.to_json(nested).alias("pair"))


def a6(spark, d):
    return I.compact_pair(pairs(spark, d))


def a7(spark, d):
    return A.price_observations(spark, d).where(F.col("t").between(T0 + 5 * DAY, T0 + 9 * DAY) & (F.col("token") < "5")).select("obs_key", "token", "price_usd", "t")


def a8(spark, d):
    rows = A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("rows"), F.max("l_discount").alias("top_discount"))
    return I.export_metrics(rows, ["l_returnflag"], ["quantity", "rows", "top_discount"])


def a9(spark, d):
    p = A.price_observations(spark, d)
    used = A.entries(spark, d).select(F.col("entry_key").alias("obs_key"))
    return I.retention_filter(p, "t", T0 + 30 * DAY, 14 * DAY, "obs_key", used).select("obs_key", "token", "t")


def gaps(spark, d):
    """Intervals per market: three hours from each error."""
    return A.price_observations(spark, d).where("event_type = 'error'").select("token", F.col("t").alias("low"), (F.col("t") + 3 * 3600).alias("high"))


def a10(spark, d):
    return I.archive_gated_retire(A.price_observations(spark, d).select("obs_key", "token", "t"), gaps(spark, d), "token", "t")


def a11(spark, d):
    return first_by(I.compact_pair(pairs(spark, d)), ["token"], ["seq"]).select("token", "pool", "symbol", "dex", "liquidity_usd")


def b1(spark, d):
    return I.dedupe_events(inbox(spark, d), "key", "seq").select("key", "seq", "accepted", "reason")


def legs(spark, d):
    return A.trades(spark, d).select(F.col("key").alias("leg_key"), "signature", "token", "side", "slot", F.col("qty").alias("base_amount"), F.col("value_usd").alias("quote_amount"))


def b3(spark, d):
    return I.canonical_legs(legs(spark, d), ["signature", "token", "side", "slot"]).select("signature", "token", "side", "slot", "base_amount", "quote_amount", "price_quote", "legs")


def b4(spark, d):
    return I.canonical_legs(legs(spark, d), ["signature", "token", "side"]).select("signature", "token", "side", "base_amount", "quote_amount", "price_quote", "legs", "leg_keys")


def b5(spark, d):
    return first_by(A.price_observations(spark, d), ["token"], ["t", "obs_key"]).select("token", "obs_key", "t", "price_usd")


def _purchases(spark, d):
    p = A.price_observations(spark, d).where("event_type = 'purchase'")
    return p.select(F.col("obs_key").alias("entry_key"), "wallet", "token", "t", F.when(F.col("obs_key") % 3 == 0, F.lit(" ")).otherwise(F.col("pool")).alias("source_key"))


def b6(spark, d):
    rows = _purchases(spark, d)
    old = first_by(rows.where("entry_key % 2 = 0"), ["wallet", "token"], ["t", "entry_key"])
    return I.merge_first_entry(old, rows.where("entry_key % 2 = 1"), ["wallet", "token"]).select("wallet", "token", "entry_key", "t")


def _outcomes(spark, d):
    o = A.table(spark, d, "orders")
    status = F.element_at(F.array(*[F.lit(s) for s in I.LIFECYCLE]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select((F.col("o_orderkey") % 997).alias("entry_key"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.col("o_totalprice").alias("price"))


def b7(spark, d):
    rows = _outcomes(spark, d)
    old = first_by(rows.where("seq % 5 < 2"), ["entry_key"], ["seq"])
    return I.merge_outcomes(old, rows.where("seq % 5 >= 2"), ["entry_key"])


def b8(spark, d):
    o = A.table(spark, d, "orders").select((F.col("o_orderkey")).alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("quality"))
    new = A.table(spark, d, "orders").where("o_orderkey % 2 = 0").select((F.col("o_orderkey") * 2).alias("k"), F.col("o_totalprice").alias("price"), F.lit("late").alias("quality"))
    return I.merge_fill_nulls(o, new, ["k"], ["price", "quality"])


def b9(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    snap = o.groupBy("wallet").agg(F.min("status").alias("status"))
    return I.append_if_changed(o, snap, "wallet", "at", ["status"])


def b10(spark, d):
    t = A.trades(spark, d).select("key", "wallet", "token", F.when(F.col("qty") % 3 > 0, F.col("qty").cast("decimal(38,0)")).alias("base_raw"), (F.col("qty") % 4).cast("int").alias("base_decimals"), (F.col("qty") / 4).alias("base_amount"))
    return I.normalize_quantity(t, ["wallet", "token"]).select("key", "decimals", F.col("base_units").cast("string").alias("base_units"))


def b12(spark, d):
    """Some quantities stand for another quality, so that all of them occur."""
    t = A.trades(spark, d)
    given = F.when(F.col("qty") < 4, "historical-estimate").when(F.col("qty") > 45, "oracle-converted").when(F.col("qty") == 20, "observed-balance").when(F.col("qty") == 21, "historical-observed").otherwise(F.col("data_quality"))
    q = t.withColumn("q", I.price_quality(given))
    high = F.col("q").isin(*I.HIGH_QUALITY)
    return q.groupBy("wallet", "token").agg(I.combine_qualities(F.col("q")).alias("quality"), F.bool_and(high).alias("all_high"), F.bool_or(high).alias("any_high"), F.count(F.lit(1)).alias("n"))


def b13(spark, d):
    t = A.trades(spark, d).select("wallet", "token", "slot", "qty")
    return I.watermark_upsert(t.where("qty < 20").drop("qty"), t.where("qty >= 20").drop("qty"), ["wallet", "token"])


def b14(spark, d):
    o = A.table(spark, d, "orders")
    ev = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("signature"), F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "retry").otherwise("processed").alias("status"), (F.col("o_orderkey") % 5 > 0).alias("finality_required"), F.lit("confirmed").alias("commitment"))
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("signature"), F.when(F.col("c_custkey") % 4 == 0, "failed").when(F.col("c_custkey") % 4 == 1, "unresolved").when(F.col("c_custkey") % 4 == 2, "finalized").otherwise("pending").alias("finality"))
    return I.finality_reconcile(ev, c)


def b15(spark, d):
    return A.entries(spark, d).select("entry_key", deterministic_id(F.col("wallet"), F.col("token"), "entry").alias("id"))


INBOX = PRICES[:-1] + """, inbox AS (SELECT concat_ws(':', wallet, token, event_type) AS key, obs_key AS seq, CASE WHEN obs_key % 3 > 0 THEN pool END AS address, event_type AS source,
  concat_ws('|', token, wallet, obs_key) AS payload, t FROM prices)"""
PAIRS = """WITH pairs AS (SELECT p_partkey AS seq, 'p' || p_partkey AS pool, CASE WHEN p_partkey % 4 > 0 THEN 'dex' ELSE 'unknown' END AS dex, p_brand AS token,
  CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE 'unknown' END AS symbol, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice ELSE 0 END AS price_usd, CASE WHEN p_partkey % 7 > 0 THEN p_partkey * 10.5::DOUBLE ELSE 0 END AS liquidity_usd,
  p_partkey * 1.5::DOUBLE AS volume5m_usd, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 9.5::DOUBLE ELSE 0 END AS volume1h_usd, (p_partkey % 9)::INTEGER AS buys5m, 0::INTEGER AS sells5m FROM part)"""
LEGS = "SELECT signature, token, side{}, sum(qty) AS base_amount, max(value_usd) AS quote_amount, max(value_usd) / sum(qty) AS price_quote, count(*) AS legs{} FROM trades GROUP BY signature, token, side{}"

QUERIES = {
    "a1_ingest_events": (a1, INBOX + f""" SELECT key, seq, coalesce(address, source) AS partition_key, sha256(payload) AS payload_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM inbox)
        WHERE n = 1 AND key NOT IN (SELECT key FROM inbox WHERE t < {T0 + 10 * DAY})"""),
    "a2_normalize_webhook": (a2, """SELECT CAST(l_orderkey AS VARCHAR) AS signature, l_orderkey * 3 AS slot, 'fee' AS fee_payer, arg_min(p_brand, (l_linenumber, l_partkey, l_shipdate, p_brand, l_quantity)) AS mint,
        count(*)::INTEGER AS transfers, 'swap' AS event_type FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""),
    "a3_export_manifest": (a3, PRICES + f""" SELECT (t - {T0}) // {DAY} AS day, event_type, count(*) AS rows, sum(strlen(concat_ws('|', obs_key, token, wallet))) AS bytes,
        sum(('0x' || substr(md5(concat_ws('|', obs_key, token, wallet)), 1, 12))::BIGINT)::VARCHAR AS digest0, sum(('0x' || substr(md5(concat_ws('|', obs_key, token, wallet)), 13, 12))::BIGINT)::VARCHAR AS digest1 FROM prices GROUP BY 1, 2"""),
    "a4_verified_archive": (a4, PRICES[:-1] + f""", l AS (SELECT (t - {T0}) // {DAY} AS day, event_type AS kind, '{{"obs_key":' || obs_key || ',"token":"' || token || '","wallet":"' || wallet || '"}}' AS line FROM prices),
        h AS (SELECT *, sha256(line) AS h FROM l) SELECT day, kind, count(*) AS rows, sum(strlen(line) + 1)::BIGINT AS bytes, sha256(concat_ws(':', count(*), sum(strlen(line) + 1), {', '.join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT)" for k in range(4))})) AS source_sha256,
        'verified' AS status FROM h GROUP BY 1, 2"""),
    "a5_keyset_page": (a5, A.with_views(A.TRADES) + f"SELECT slot, t, signature, key FROM trades WHERE slot > 10000 OR (slot = 10000 AND (t > {10_000 * DAY} OR signature > '')) ORDER BY slot, t, signature, key LIMIT 500"),
    "a6_compact_pair": (a6, PAIRS + " SELECT * FROM pairs"),
    "a7_scan_prices": (a7, PRICES + f" SELECT obs_key, token, price_usd, t FROM prices WHERE t BETWEEN {T0 + 5 * DAY} AND {T0 + 9 * DAY} AND token < '5'"),
    "a8_export_metrics": (a8, """WITH m AS (SELECT l_returnflag, sum(l_quantity) AS quantity, count(*)::DOUBLE AS rows, max(l_discount) AS top_discount FROM lineitem GROUP BY 1)
        SELECT l_returnflag, 'quantity' AS metric, quantity AS value FROM m UNION ALL SELECT l_returnflag, 'rows', rows FROM m UNION ALL SELECT l_returnflag, 'top_discount', top_discount FROM m"""),
    "a9_retention_filter": (a9, ENTRIES + f" SELECT obs_key, token, t FROM prices WHERE t >= {T0 + 16 * DAY} OR obs_key IN (SELECT entry_key FROM entries)"),
    "a10_archive_gated_retire": (a10, PRICES + " SELECT obs_key, token, t FROM prices p WHERE NOT EXISTS (SELECT 1 FROM prices e WHERE e.event_type = 'error' AND e.token = p.token AND p.t BETWEEN e.t AND e.t + 10800)"),
    "a11_pool_from_pair": (a11, PAIRS + " SELECT token, pool, symbol, dex, liquidity_usd FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq) AS n FROM pairs) WHERE n = 1"),
    "b1_dedupe_events": (b1, INBOX + " SELECT key, seq, n = 1 AS accepted, CASE WHEN n > 1 THEN 'duplicate-key' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM inbox)"),
    "b3_canonical_price_legs": (b3, A.with_views(A.TRADES) + LEGS.format(", slot", "", ", slot")),
    "b4_canonical_market_obs": (b4, A.with_views(A.TRADES) + LEGS.format("", ", string_agg(key, ',' ORDER BY key) AS leg_keys", "")),
    "b5_first_per_token": (b5, PRICES + " SELECT token, obs_key, t, price_usd FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY t, obs_key) AS n FROM prices) WHERE n = 1"),
    "b6_merge_first_entry": (b6, PRICES[:-1] + """, pu AS (SELECT obs_key AS entry_key, wallet, token, t, (obs_key % 3 <> 0)::INT AS linked, obs_key % 2 AS new FROM prices WHERE event_type = 'purchase'),
        kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token, new ORDER BY t, entry_key) AS n FROM pu) WHERE new = 1 OR n = 1)
        SELECT wallet, token, entry_key, t FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY linked DESC, new, t, entry_key) AS m FROM kept) WHERE m = 1"""),
    "b7_merge_outcome_lifecycle": (b7, """WITH o AS (SELECT o_orderkey % 997 AS entry_key, o_orderkey AS seq, o_orderkey % 3 AS rk, (o_orderkey % 5 >= 2)::INT AS new, o_totalprice AS price FROM orders),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_key, new ORDER BY seq) AS n FROM o) WHERE n = 1)
        SELECT entry_key, seq, CASE rk WHEN 0 THEN 'provisional' WHEN 1 THEN 'unresolved' ELSE 'mature' END AS status, price FROM (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY rk DESC, new) AS m FROM f) WHERE m = 1"""),
    "b8_merge_fill_nulls": (b8, """WITH old AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS quality FROM orders),
        new AS (SELECT o_orderkey * 2 AS k, o_totalprice AS price, 'late' AS quality FROM orders WHERE o_orderkey % 2 = 0)
        SELECT coalesce(o.k, n.k) AS k, coalesce(o.price, n.price) AS price, coalesce(o.quality, n.quality) AS quality,
        o.k IS NOT NULL AND ((o.price IS NULL AND n.price IS NOT NULL) OR (o.quality IS NULL AND n.quality IS NOT NULL)) AS changed FROM old o FULL JOIN new n ON o.k = n.k"""),
    "b9_append_if_changed": (b9, """SELECT s.wallet, s.status FROM (SELECT o_custkey AS wallet, min(o_orderstatus) AS status, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1) s WHERE s.status IS DISTINCT FROM s.last"""),
    "b10_normalize_quantity": (b10, A.with_views(A.TRADES)[:-1] + """, x AS (SELECT key, wallet, token, qty, (qty % 4)::INT AS dec, qty % 3 > 0 AS raw FROM trades),
        y AS (SELECT *, max(CASE WHEN raw THEN dec ELSE 12 END) OVER (PARTITION BY wallet, token) AS decimals FROM x)
        SELECT key, decimals, CAST(CASE WHEN raw THEN qty::HUGEINT * (10::HUGEINT ** (decimals - dec))::HUGEINT ELSE (qty * 25)::HUGEINT * (10::HUGEINT ** (decimals - 2))::HUGEINT END AS VARCHAR) AS base_units FROM y"""),
    "b12_price_quality": (b12, A.with_views(A.TRADES)[:-1] + """, q AS (SELECT wallet, token, CASE WHEN qty < 4 THEN 'historical-estimate' WHEN qty > 45 THEN 'oracle-converted' WHEN qty = 20 THEN 'market-proxy' WHEN qty = 21 THEN 'observed-execution'
        WHEN data_quality = 'price-proxy' THEN 'market-proxy' ELSE data_quality END AS q FROM trades)
        SELECT wallet, token, CASE WHEN bool_and(q = 'observed-execution') THEN 'observed-execution' WHEN bool_and(q IN ('observed-execution', 'oracle-converted')) THEN 'oracle-converted' WHEN bool_or(q = 'historical-estimate') THEN 'historical-estimate' ELSE 'market-proxy' END AS quality,
        bool_and(q IN ('observed-execution', 'oracle-converted')) AS all_high, bool_or(q IN ('observed-execution', 'oracle-converted')) AS any_high, count(*) AS n FROM q GROUP BY 1, 2"""),
    "b13_watermark_upsert": (b13, A.with_views(A.TRADES) + "SELECT wallet, token, max(slot) AS slot FROM trades GROUP BY 1, 2"),
    "b14_finality_reconcile": (b14, """SELECT o_orderkey AS key, o_custkey AS signature, CASE WHEN o_custkey % 4 = 2 THEN 'finalized' ELSE 'confirmed' END AS commitment,
        CASE WHEN o_custkey % 4 < 2 THEN 'rolled_back' WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'retry' END AS status
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 5 > 0 AND o_custkey % 4 < 3"""),
    "b15_deterministic_id": (b15, ENTRIES + " SELECT entry_key, sha256(concat_ws(':', wallet, token, 'entry')) AS id FROM entries"),
}
