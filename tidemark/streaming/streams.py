"""Structured Streaming forms of the time-driven operators.

Event time is a TIMESTAMP column ``ts``; order is by event time, never by
arrival. Rows behind the watermark are dropped by Spark where a state operator
needs it, so a batch recomputation remains the source of truth for them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ledger import COST_PCT, MARKET


def dedupe(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Rows of at-least-once delivery, once per key as long as repeats come within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def ohlc(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling buckets per token; emitted once the watermark has passed them."""
    at = F.struct("ts", "leg_key")
    return (
        stream.withWatermark("ts", delay)
        .groupBy("token", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
        .select("token", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "n")
    )


def flow_before(entries: DataFrame, trades: DataFrame, span: str, delay: str) -> DataFrame:
    """Per entry the flow of its token in the span before it: swaps, buys, buyers, sellers and volume; zeros where nothing was traded.

    A stream-stream interval join that keeps entries without trades, and an
    aggregate over it; an entry comes out once no trade of its span can come.
    """
    e = entries.select("entry_key", F.col("token").alias("e_token"), F.col("ts").alias("e_ts")).withWatermark("e_ts", delay)
    t = trades.select("token", "ts", "side", "trader", "volume").withWatermark("ts", delay)
    near = F.expr(f"e_token = token AND ts >= e_ts - INTERVAL {span} AND ts <= e_ts")
    joined, buy, sell = e.join(t, near, "left_outer"), F.col("side") == "buy", F.col("side") == "sell"
    # an entry has one time, so its window is a group of its own
    flow = joined.groupBy("entry_key", F.window("e_ts", "1 second")).agg(
        F.count("side").alias("swaps"), F.count(F.when(buy, 1)).alias("buys"), F.size(F.collect_set(F.when(buy, F.col("trader")))).alias("buyers"), F.size(F.collect_set(F.when(sell, F.col("trader")))).alias("sellers"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")
    )
    return flow.select("entry_key", "swaps", "buys", "buyers", "sellers", "volume")


def finality(events: DataFrame, confirmations: DataFrame, wait: str, delay: str) -> DataFrame:
    """Events held until their signature is known: finalized ones are upgraded; failed, unresolved and those unknown after the wait are rolled back."""
    e = events.withWatermark("ts", delay)
    c = confirmations.select(F.col("signature").alias("c_signature"), F.col("ts").alias("c_ts"), "finality").withWatermark("c_ts", delay)
    on = F.expr(f"signature = c_signature AND c_ts >= ts AND c_ts <= ts + INTERVAL {wait}")
    known = F.coalesce("finality", F.lit("unresolved"))
    final = known == "finalized"
    rows = e.join(c, on, "left_outer")
    return rows.select("key", "signature", known.alias("finality"), F.when(final, "finalized").otherwise(F.col("commitment")).alias("commitment"), F.when(final, F.col("status")).otherwise("rolled_back").alias("status"))


def outcomes(entries: DataFrame, prices: DataFrame, horizon: int, wait: int, delay: str, exit_strategy: str = "fixed-horizon", cost_pct: float = 3.0, take_pct: float = 15.0, stop_pct: float = -20.0, keep: int | None = None, spread: int = 1) -> DataFrame:
    """One row per entry and state that it reaches: provisional, unresolved, mature; the rules are those of the batch outcome.

    An entry is provisional when it is first seen. Once the watermark has passed
    its horizon it matures by the earliest of its first rugged price, the first
    one from horizon to horizon + wait, and, for the threshold exit, the first by
    the horizon that gains or loses enough: as soon as no earlier price can come.
    Without one it is unresolved, and waits on for a rug; ``keep`` seconds after
    its last due time it is forgotten (null: never). Entries without a pool take
    prices of any pool of their token; prices that cannot be executed count only
    if rugged. The state of a token is its open entries, each with the least and
    latest prices that matter, and the prices younger than the watermark.
    A busy token's entries may be dealt over ``spread`` groups, each with all prices.

    entries: entry_key, token, pool, ts, entry_price; prices: token, pool, ts,
    obs_key, price_usd, rugged, executable.
    """
    none = lambda kind: F.lit(None).cast(kind)
    e = entries.select(F.lit(0).alias("kind"), "token", "pool", "ts", F.col("entry_key").cast("string").alias("name"), F.col("entry_price").alias("price"), F.lit(False).alias("rugged"), F.pmod(F.xxhash64("entry_key"), F.lit(spread)).alias("part"))
    p = prices.where("rugged OR coalesce(executable, true)").select(
        F.lit(1).alias("kind"), "token", "pool", "ts", F.lpad(F.col("obs_key").cast("string"), 20, "0").alias("name"), F.col("price_usd").alias("price"), "rugged", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("part")
    )
    rows = e.unionByName(p).withWatermark("ts", delay)
    solve = _Outcomes(horizon, wait, exit_strategy != "fixed-horizon", cost_pct, take_pct, stop_pct, keep)
    columns = "entry_key string, status string, outcome_price double, gross_pct double, net_pct double, frozen_t long, rugged boolean"
    return rows.groupBy("token", "part").applyInPandasWithState(solve, columns, "open string, recent string", "append", GroupStateTimeout.EventTimeTimeout)


class _Outcomes:
    """The state function of ``outcomes``; times are whole milliseconds."""

    COLUMNS = ("entry_key", "status", "outcome_price", "gross_pct", "net_pct", "frozen_t", "rugged")

    def __init__(self, horizon: int, wait: int, thresholds: bool, cost_pct: float, take_pct: float, stop_pct: float, keep: int | None):
        self.horizon, self.wait, self.keep = 1000 * horizon, 1000 * wait, None if keep is None else 1000 * keep
        self.thresholds, self.cost_pct, self.take_pct, self.stop_pct = thresholds, cost_pct, take_pct, stop_pct

    def see(self, entry: dict, price: list) -> None:
        """Let an entry take note of a price (t, name, pool, price, rugged)."""
        t, _, pool, usd, rugged = price
        if t < entry["t"] or (entry["pool"] is not None and pool != entry["pool"]):
            return
        due = entry["t"] + self.horizon
        keep = lambda leg: entry.update({leg: price}) if entry[leg] is None or price[:2] < entry[leg][:2] else None
        if rugged:
            keep("exit")
        elif due <= t <= due + self.wait:
            keep("exit")
        elif self.thresholds and t <= due and entry["price"] > 0:
            gross = (usd - entry["price"]) / entry["price"] * 100
            if gross >= self.take_pct or gross <= self.stop_pct:
                keep("exit")
        if entry["last"] is None or price[:2] > entry["last"][:2]:
            entry["last"] = price

    def row(self, entry: dict, status: str) -> tuple:
        at = entry["exit"] if status == "mature" else entry["last"]
        price = None if at is None else 0.0 if at[4] else at[3]
        gross = (price - entry["price"]) / entry["price"] * 100 if price is not None and entry["price"] > 0 else None
        mature = status == "mature"
        return entry["key"], status, price, gross, None if gross is None else gross - self.cost_pct, at[0] // 1000 if mature else None, bool(mature and at[4])

    def step(self, entry: dict, now: int) -> tuple[list[tuple], int | None]:
        """Rows of the states that an entry reaches by the watermark, and when to look again (None: never)."""
        out, due = [], entry["t"] + self.horizon
        if not entry["state"]:
            entry["state"] = "provisional"
            out.append(self.row(entry, "provisional"))
        if now <= due:
            return out, due + 1
        if entry["exit"] is not None:
            if entry["exit"][0] < now:
                return [*out, self.row(entry, "mature")], None
            again = entry["exit"][0] + 1
        else:
            again = None
        if entry["state"] != "unresolved":
            entry["state"] = "unresolved"
            out.append(self.row(entry, "unresolved"))
        last = None if self.keep is None else due + self.wait + self.keep
        if last is not None and now > last:
            return out, None
        return out, min((x + 1 if x is last else x for x in (again, last) if x is not None), default=-1)

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, recent = map(json.loads, state.get) if state.exists else ([], [])
        now = state.getCurrentWatermarkMs()
        fresh, prices = [], []
        for frame in frames:
            t = frame["ts"].astype("datetime64[ms]").astype("int64")
            for kind, pool, at, name, price, rugged in zip(frame["kind"], frame["pool"], t, frame["name"], frame["price"], frame["rugged"], strict=True):
                pool = pool if isinstance(pool, str) else None
                if kind == 0:
                    fresh.append({"key": name, "t": int(at), "pool": pool, "price": float(price), "exit": None, "last": None, "state": None})
                else:
                    prices.append([int(at), name, pool, float(price), bool(rugged)])
        for entry in entries:
            for price in prices:
                self.see(entry, price)
        recent += prices
        for entry in fresh:
            for price in recent:
                self.see(entry, price)
        out, kept, looks = [], [], []
        for entry in [*entries, *fresh]:
            rows, again = self.step(entry, now)
            out += rows
            if again is not None:
                kept.append(entry)
                looks += [again] if again > 0 else []
        # an entry still to come is not older than the watermark, nor are the prices that it may take
        recent = [p for p in recent if p[0] >= now]
        looks += [max(p[0] for p in recent) + 1] if recent else []
        if kept or recent:
            state.update((json.dumps(kept), json.dumps(recent)))
            if looks:
                state.setTimeoutTimestamp(max(min(looks), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=self.COLUMNS).astype({"frozen_t": "Int64", "outcome_price": "float64", "gross_pct": "float64", "net_pct": "float64", "rugged": "bool"})


def _streak(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last_ts, streak = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "tie"])
    out = []
    for ts, tie, missing in zip(rows["ts"], rows["tie"], rows["missing"], strict=True):
        streak = streak + 1 if missing else 0
        last_ts = ts
        out.append((key[0], tie, streak))
    state.update((last_ts, streak))
    yield pd.DataFrame(out, columns=["token", "tie", "streak"])


def missing_streak(stream: DataFrame) -> DataFrame:
    """Length of the run of misses at each row per token; only the last time and the run are kept as state."""
    return stream.groupBy("token").applyInPandasWithState(_streak, "token string, tie long, streak long", "last_ts timestamp, streak long", "append", GroupStateTimeout.NoTimeout)


_LEDGER = ("kind", "sell_key", "episode", "units", "invested", "proceeds")


def _ledger(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: rows that wait for the watermark, open lots (left, size, paid), the last row's place, the first buy's age and the round trips."""
    held, lots, last, age, trips = json.loads(state.get[0]) if state.exists else ([], [], None, None, 0)
    out: list[tuple] = []
    for frame in frames:
        t = frame["ts"].astype("datetime64[ms]").astype("int64")
        for slot, at, signature, name, side, qty, value, pool_age in zip(frame["slot"], t, frame["signature"], frame["key"], frame["side"], frame["qty"], frame["value_usd"], frame["pool_age_minutes"], strict=True):
            number = lambda x: None if pd.isna(x) else float(x)
            held.append([[int(slot), int(at), signature, name], side, number(qty), number(value), number(pool_age)])
    now = state.getCurrentWatermarkMs()
    held.sort(key=lambda r: r[0])
    ready, held = [r for r in held if r[0][1] < now], [r for r in held if r[0][1] >= now]
    for place, side, qty, value, pool_age in ready:
        if last is not None and place <= last:
            out.append(("late", place[3], None, None, None, None))
            continue
        last = place
        if side == "buy" and age is None:
            # the first buy decides, priced or not; a missing age closes the market
            age = -1.0 if pool_age is None else pool_age
        if age is not None and not 0 <= age <= 30 or not qty or qty <= 0 or not value or value <= 0:
            continue
        if side == "buy":
            trips += not lots
            lots.append([qty, qty, value])
            continue
        left, cost = qty, 0.0
        while left > 0 and lots:
            have, size, paid = lots[0]
            take = min(have, left)
            cost += paid * (1 + COST_PCT / 200) * take / size
            left -= take
            if take == have:
                lots.pop(0)
            else:
                lots[0][0] = have - take
        if left < qty:
            out.append(("realized", place[3], trips, qty - left, cost, value * (1 - COST_PCT / 200) * (qty - left) / qty))
    state.update((json.dumps([held, lots, last, age, trips]),))
    if held:
        state.setTimeoutDuration(1)
    found = pd.DataFrame(out, columns=_LEDGER).astype({"episode": "Int64", "units": "float64", "invested": "float64", "proceeds": "float64"})
    for i, name in enumerate(MARKET):
        found.insert(i, name, key[i])
    yield found


def ledger(stream: DataFrame, delay: str) -> DataFrame:
    """FIFO realizations per market continued over micro-batches, in evidence order (slot, time, signature, key).

    Rows wait until the watermark has passed them, so what comes out of order
    within the delay is put in order. A row that still comes behind one that has
    been counted is not counted; it comes out once, as kind ``late``, for the
    side table from which its wallet is built anew. Markets whose first buy came
    at a pool age over 30 minutes realize nothing. Timers go by processing time,
    as Spark hides rows behind the watermark from states with timers by event
    time; so each trigger looks again at markets that hold rows, and a query with
    the trigger availableNow does not end by itself.
    """
    rows = stream.withWatermark("ts", delay)
    columns = ", ".join([*(f"{c} string" for c in MARKET), "kind string, sell_key string, episode long, units double, invested double, proceeds double"])
    return rows.groupBy(*MARKET).applyInPandasWithState(_ledger, columns, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def side_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(realized, late) of a batch of ``ledger``, for a foreachBatch that writes both."""
    return found.where("kind = 'realized'").drop("kind"), found.where("kind = 'late'").select(*MARKET, F.col("sell_key").alias("key"))
