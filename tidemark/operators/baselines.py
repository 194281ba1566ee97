"""Baselines of an agent's turns, kept as sums that can be added: moments, and a sketch of quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import USUAL, turn_measures

#: Relative error of a quantile, and turns that an agent must have before its own baseline holds.
ERROR, LEAST_TURNS = 0.01, 5
_BASE = (1 + ERROR) / (1 - ERROR)
_SCALE = 1000
#: The measure whose middle value is usual; of the others it is the mean, which is at least this. Fixed values.
PACE, FLOOR = "sentence_mean", 0.05
_TOTAL = "decimal(38,0)"


def measured(turns: DataFrame) -> DataFrame:
    """(agent, measure, value) of turns (agent, text) that have words; values are whole thousandths."""
    m = turn_measures(F.col("text"))
    rows = turns.select("agent", m["n_words"].alias("n_words"), *(m[k].alias(k) for k in USUAL)).where("n_words > 0")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.round(F.col(k) * _SCALE).cast("long").alias("value")) for k in USUAL))).alias("x")
    return rows.select("agent", each).select("agent", "x.measure", "x.value")


def bucket(value: Column) -> Column:
    """The bucket of a value: each is a constant factor wide, and zero has one of its own."""
    return F.when(value > 0, F.ceil(F.log(value.cast("double")) / math.log(_BASE)).cast("int")).otherwise(F.lit(-1))


def state(rows: DataFrame) -> DataFrame:
    """(agent, measure, bucket, n, total, squares) of values (agent, measure, value). Sums are of whole numbers, so no order or split of the input changes them."""
    v = F.col("value").cast(_TOTAL)
    return rows.groupBy("agent", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast(_TOTAL).alias("total"), F.sum((v * v).cast(_TOTAL)).cast(_TOTAL).alias("squares"))


def merged(*states: DataFrame) -> DataFrame:
    """One state from several: what was kept, and what new turns add to it."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("agent", "measure", "bucket").agg(F.sum("n").alias("n"), F.sum("total").cast(_TOTAL).alias("total"), F.sum("squares").cast(_TOTAL).alias("squares"))


def growing(turns: DataFrame) -> DataFrame:
    """state() of a stream of turns (agent, text), for output mode update or complete; what is kept are the rows of the state."""
    return state(measured(turns))


def baseline(kept: DataFrame, least: int = LEAST_TURNS) -> DataFrame:
    """(agent, measure, turns, mean, spread, median, usual) of a state: a row for each agent and measure.

    The median is the middle of the bucket in which half of the turns are reached, within ERROR of it. usual is the median of the
    pace and the mean of the other measures, not under FLOOR; agents with fewer than `least` turns have what is usual for all.
    A state has a bounded number of buckets for each measure, which are folded in order.
    """
    held = kept.groupBy("agent", "measure").agg(F.sum("n").alias("turns"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))
    half = F.ceil(F.col("turns") / 2)

    def step(s: Column, x: Column) -> Column:
        upto = s["upto"] + x["n"]
        return F.struct(upto.alias("upto"), F.when(s["at"].isNull() & (upto >= half), x["bucket"]).otherwise(s["at"]).alias("at"))

    at = F.aggregate("buckets", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("at")), step)["at"]
    median = F.when(at < 0, F.lit(0.0)).otherwise(F.pow(F.lit(_BASE), at) * 2 / (_BASE + 1) / _SCALE)
    turns, total, squares = (F.col(c).cast("double") for c in ("turns", "total", "squares"))
    mean = total / turns / _SCALE
    spread = F.when(F.col("turns") > 1, F.sqrt(F.greatest(squares - total * total / turns, F.lit(0.0)) / (turns - 1)) / _SCALE).otherwise(0.0)
    rows = held.select("agent", "measure", "turns", F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("spread"), F.round(median, 6).alias("median"))
    all_ = F.element_at(F.create_map(*(F.lit(x) for p in USUAL.items() for x in p)), F.col("measure"))
    own = F.when(F.col("measure") == PACE, F.col("median")).otherwise(F.greatest("mean", F.lit(FLOOR)))
    return rows.withColumn("usual", F.when(F.col("turns") >= least, own).otherwise(all_))


def raised(turns: DataFrame, base: DataFrame, times: float = 2.0, slower: float = 0.65) -> DataFrame:
    """(agent, id, raised, short): of turns (agent, id, text), how many densities are at least so many times what is usual for the agent, and whether sentences are shorter by a factor."""
    m = turn_measures(F.col("text"))
    rows = turns.select("agent", "id", m["n_words"].alias("n_words"), *(m[k].alias(k) for k in USUAL)).where("n_words > 0")
    own = base.groupBy("agent").agg(*(F.max(F.when(F.col("measure") == k, F.col("usual"))).alias(f"usual_{k}") for k in USUAL))
    both = rows.join(own, "agent")
    high = sum((F.col(k) >= F.col(f"usual_{k}") * times).cast("int") for k in USUAL if k != PACE)
    return both.select("agent", "id", high.alias("raised"), ((F.col(PACE) > 0) & (F.col(PACE) <= F.col(f"usual_{PACE}") * slower)).alias("short"))
