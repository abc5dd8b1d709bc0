"""Grids of thresholds judged as a cube: each record is placed once, and counts are cumulated along each dimension.

A dimension has levels, into which a record falls, and options, each of which
covers some levels. Records are summed per cell (a level of every dimension), a
table whose size the dimensions bound. Then one dimension after the other turns
its levels to options, summing again each time; after the last one, each candidate
(an option of every dimension) has its figures. Records never meet candidates.

What sums, least and most values cannot give are medians. Their sign follows from
counts and the values next to zero. Exact medians, where wanted, come digit by
digit: records are numbered by value within their window, a round counts the next
digit of those numbers per cell, the cube turns the counts to candidates, and each
candidate learns the digit of its middle rank. So a round, too, moves counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.operators.research import PROFIT_FACTOR_TOP, ranked

#: Options of a digit; a round looks at one digit of every rank.
BASE = 64


@dataclass(frozen=True)
class Dimension:
    """A named dimension: a record's level (a column), and for each option the levels that it covers."""

    name: str
    level: Column
    options: Sequence[Sequence[int]]

    def covering(self) -> Column:
        """Options that cover a level: an array, null where none does."""
        levels = 1 + max(k for o in self.options for k in o)
        rows = [[i for i, o in enumerate(self.options) if k in o] for k in range(levels)]
        per = F.array(*[F.array(*[F.lit(i) for i in r]) if r else F.array().cast("array<int>") for r in rows])
        return F.try_element_at(per, F.col(self.name) + 1)


def placed(rows: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """rows with their level of every dimension, without rows that have none of some."""
    out = rows.withColumns({d.name: d.level.cast("int") for d in dims})
    for d in dims:
        out = out.where(F.col(d.name).isNotNull())
    return out


def cumulated(cells: DataFrame, dims: Sequence[Dimension], keys: Sequence[str], merge: dict[str, str]) -> DataFrame:
    """Cells (keys, levels, figures) turned to candidates (keys, options, figures); merge: how each figure combines (sum, min or max)."""
    out, names = cells, [d.name for d in dims]
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    for d in dims:
        out = out.withColumn(d.name, F.explode(d.covering()))
        out = out.groupBy(*keys, *names).agg(*[how[m](c).alias(c) for c, m in merge.items()])
    return out


def candidate_id(dims: Sequence[Dimension]) -> Column:
    return F.concat_ws("-", *[F.col(d.name).cast("string") for d in dims])


#: Figures of a cell and how they combine.
FIGURES = {"n": "sum", "total": "sum", "gain": "sum", "loss": "sum", "wins": "sum", "rugs": "sum", "catastrophes": "sum", "best": "max", "worst": "min", "above": "min", "below": "max"}


def cell_figures(value: str, rugged: str) -> list[Column]:
    v = F.col(value)
    return [
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(F.greatest(v, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-v, F.lit(0.0))).alias("loss"), F.count_if(v > 0).alias("wins"),
        F.count_if(F.col(rugged)).alias("rugs"), F.count_if(v <= -50).alias("catastrophes"), F.max(v).alias("best"), F.min(v).alias("worst"), F.min(F.when(v > 0, v)).alias("above"), F.max(F.when(v <= 0, v)).alias("below"),
    ]


def judged(figures: DataFrame, least: Column) -> DataFrame:
    """Rates and the reasons to fail of figures; a candidate needs ``least`` records."""
    n = F.col("n")
    # with half the values above zero the middle two lie on both sides of it
    median_up = (2 * F.col("wins") > n) | ((2 * F.col("wins") == n) & (F.col("above") + F.col("below") > 0))
    out = figures.select(
        "*", (F.col("total") / n).alias("average"), F.when(n > 1, (F.col("total") - F.col("best")) / (n - 1)).otherwise(0.0).alias("ex_best"),
        F.when(F.col("gain") > 0, F.greatest(F.col("best"), F.lit(0.0)) / F.col("gain")).otherwise(0.0).alias("best_share"), (F.col("wins") / n).alias("hit_rate"),
        F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).when(F.col("gain") > 0, F.lit(PROFIT_FACTOR_TOP)).otherwise(0.0).alias("profit_factor"),
        (F.col("rugs") / n).alias("rug_rate"), (F.col("catastrophes") / n).alias("catastrophic_rate"), median_up.alias("median_up"),
    )
    fails = {
        "count": n < least, "median<=0": ~F.col("median_up"), "average-ex-best<=0": F.col("ex_best") <= 0, "hit-rate<60%": F.col("hit_rate") < 0.6, "profit-factor<1.2": F.col("profit_factor") < 1.2,
        "rug-rate>5%": F.col("rug_rate") > 0.05, "catastrophic-rate>5%": F.col("catastrophic_rate") > 0.05, "worst<-35%": F.col("worst") < -35, "best-winner-share>40%": F.col("best_share") > 0.4,
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fails.items()]))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.size(reasons) == 0)


def score(median: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.col("best_share") - 0.4)
    return median + F.col("ex_best") + F.col("hit_rate") * 20 + F.log10(F.col("n") + 1) * 2 - F.col("rug_rate") * 300 - F.col("catastrophic_rate") * 200 - share * 100


def medians(rows: DataFrame, wanted: DataFrame, dims: Sequence[Dimension], value: str, tie: str) -> DataFrame:
    """(options, window, median) of the candidates and windows wanted (options, window, n); rows are placed and have a window."""
    names = [d.name for d in dims]
    windows = [r.window for r in rows.select("window").distinct().collect()]
    numbered = None
    for w in windows:
        one = ranked(rows.where(F.col("window") == w), value, tie).select(*names, "window", F.col(value).alias("_value"), F.col("place").alias("_rank"))
        numbered = one if numbered is None else numbered.unionByName(one)
    if numbered is None:
        return wanted.select(*names, "window", F.lit(None).cast("double").alias("median"))
    numbered = stored(numbered)
    most = numbered.agg(F.max("_rank")).first()[0] or 0
    digits = max(1, math.ceil(math.log(most + 1, BASE) + 1e-9)) if most else 1
    # both middle ranks; the same one twice for an odd number
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor((F.col("n") - 1) / 2).alias("k")), F.struct(F.lit(1).alias("end"), F.floor(F.col("n") / 2).alias("k")))
    state = wanted.select(*names, "window", F.explode(ends).alias("e")).select(*names, "window", "e.*", F.lit(0).cast("long").alias("prefix"))
    for digit in range(digits - 1, -1, -1):
        unit = BASE**digit
        state = stored(state)
        on = state.select("window", "prefix").distinct()
        cells = numbered.withColumn("prefix", F.floor(F.col("_rank") / (unit * BASE))).join(F.broadcast(on), ["window", "prefix"])
        cells = cells.withColumn("digit", F.floor(F.col("_rank") / unit) % BASE).groupBy("window", "prefix", "digit", *names).agg(F.count(F.lit(1)).alias("n"))
        counts = cumulated(cells, dims, ["window", "prefix", "digit"], {"n": "sum"})
        met = state.join(counts, [*names, "window", "prefix"])
        upto = F.sum("n").over(Window.partitionBy(*names, "window", "end").orderBy("digit"))
        met = met.withColumn("upto", upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        state = met.select(*names, "window", "end", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), (F.col("prefix") * BASE + F.col("digit")).cast("long").alias("prefix"))
    found = state.join(numbered.select("window", F.col("_rank").alias("prefix"), "_value"), ["window", "prefix"])
    return found.groupBy(*names, "window").agg(F.avg("_value").alias("median"))


@dataclass(frozen=True)
class Audit:
    """candidates: the figures of every candidate on the windows it is chosen by; locked: the best of those that pass both, on all windows, with the verdict."""

    candidates: DataFrame
    locked: DataFrame


def cube_audit(rows: DataFrame, dims: Sequence[Dimension], value: str, rugged: str, tie: str, least: dict[str, int], least_total: int) -> Audit:
    """Judge every candidate on train and validation, lock the best of those that pass both, and judge it on the later windows.

    rows have a window. A window's figures are missing where no record meets the
    candidate; such a candidate does not pass. Without a candidate that passes,
    locked has no row.
    """
    names, order = [d.name for d in dims], list(least)
    rows = stored(placed(rows, dims).select(*names, "window", value, rugged, tie))
    need = F.lit(max(least.values()))
    for w, n in least.items():
        need = F.when(F.col("window") == w, n).otherwise(need)
    early = rows.where(F.col("window").isin(order[:2]))
    cells = early.groupBy("window", *names).agg(*cell_figures(value, rugged))
    candidates = stored(judged(cumulated(cells, dims, ["window"], FIGURES), need).withColumn("candidate", candidate_id(dims)))
    both = candidates.where("passed").groupBy(*names).agg(F.count(F.lit(1)).alias("_w")).where("_w = 2").select(*names)
    chosen = candidates.join(both, names)
    scored = chosen.join(medians(early, chosen.select(*names, "window", "n"), dims, value, tie), [*names, "window"]).withColumn("score", score(F.col("median")))
    at = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}")
    best = scored.groupBy("candidate", *names).agg(*[at(w, c) for w in order[:2] for c in ("score", "n")])
    # candidates with the same records must tie, in whatever order their cells were summed
    best = best.orderBy(F.desc(F.round(f"{order[1]}_score", 6)), F.desc(F.round(f"{order[0]}_score", 6)), F.desc(F.col(f"{order[0]}_n") + F.col(f"{order[1]}_n")), "candidate").limit(1)
    # one candidate: its records on all windows
    meets = F.lit(True)
    chosen_row = best.select("candidate", *[F.col(c).alias(f"_{c}") for c in names])
    for d in dims:
        meets = meets & F.array_contains(d.covering(), F.col(f"_{d.name}"))
    hits = rows.join(F.broadcast(chosen_row), meets).groupBy("candidate", "window").agg(*cell_figures(value, rugged), F.percentile(F.col(value), F.lit(0.5)).alias("median"))
    out = judged(hits, need).withColumn("score", score(F.col("median")))
    totals = out.groupBy("candidate").agg(F.count_if("passed").alias("windows_passed"), F.sum("n").alias("selected"))
    verdict = F.when((F.col("windows_passed") == len(least)) & (F.col("selected") >= least_total), "future-shadow-only").otherwise("no-promotable-v4")
    return Audit(candidates, out.join(totals.withColumn("verdict", verdict), "candidate"))
