"""Matches of shapes and of words, and the judgement of differences between two rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .retrieval import small

#: Weights of coverage and overlap, the least score, how many anchors a moment gets, and the weight of an unweighted emotion. Fixed values.
COVERAGE, OVERLAP, LEAST, TOP, UNWEIGHTED = 0.7, 0.3, 0.3, 3, 0.7
#: Points for a word of a skill's name, a part of one, a word of its description and its repeats; the squash of its record. Fixed values.
IN_NAME, PART_OF_NAME, IN_TEXT, REPEAT, MOST_REPEATS, SQUASH = 3.0, 1.5, 1.0, 0.25, 2, 5.0
#: The least mean difference of reciprocal ranks that counts. Fixed value.
MIN_EFFECT = 0.05


def anchors(moments: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, anchor, score, rank): the anchors whose emotions are most like a moment's, both given as rows (id or anchor, emotion, weight).

    Only pairs that share an emotion meet. The sum of the greater weights of two shapes is that of all weights less the
    lesser ones, so nothing but the shared rows is needed. Moments are dealt by id once; while the anchors are few enough to be
    sent to every task, the pairs are made, summed and ranked there. Moments without emotions get no row.
    """
    a = anchors.select("anchor", "emotion", F.coalesce(F.col("weight"), F.lit(UNWEIGHTED)).cast("double").alias("w"))
    a = a.join(a.groupBy("anchor").agg(F.sum("w").alias("w_all")), "anchor")
    m = moments.select("id", "emotion", F.coalesce(F.col("weight"), F.lit(0.0)).cast("double").alias("f")).repartition("id")
    m = m.withColumn("f_all", F.sum("f").over(Window.partitionBy("id")))
    low = m.join(small(cut(a), 120), "emotion").groupBy("id", "anchor", "w_all", "f_all").agg(F.sum(F.least("w", "f")).alias("low"))
    share = lambda x: F.coalesce(F.col("low") / F.nullif(x, F.lit(0.0)), F.lit(0.0))
    score = F.round(COVERAGE * share(F.col("w_all")) + OVERLAP * share(F.col("w_all") + F.col("f_all") - F.col("low")), 6)
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "anchor"))
    return low.select("id", "anchor", score.alias("score")).where(F.col("score") >= LEAST).withColumn("rank", nth).where(F.col("rank") <= TOP)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def skills(asked: Sequence[str], entries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, path, score, anti_pattern, rank) of entries (path, name, description, net, anti_pattern): words that match times how the skill did.

    A stated list of queries is held against every entry; net may be null, which changes nothing.
    """
    e = entries.withColumn("ns", words(F.col("name"))).withColumn("ds", words(F.col("description")))
    e = e.select("*", F.explode(F.array(*map(F.lit, asked))).alias("query")).withColumn("ts", words(F.col("query")))

    def points(t: Column) -> Column:
        n = F.size(F.filter("ds", lambda x: x == t))
        name = F.when(F.array_contains("ns", t), IN_NAME).when(F.exists("ns", lambda x: x.contains(t)), PART_OF_NAME).otherwise(0.0)
        return name + F.when(n > 0, IN_TEXT + REPEAT * F.least(n - 1, F.lit(MOST_REPEATS))).otherwise(0.0)

    lexical = F.aggregate(F.transform("ts", points), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("ts"), F.lit(0))
    net = F.coalesce(F.col("net"), F.lit(0.0))
    found = e.withColumn("lexical", lexical).where("lexical > 0")
    found = found.select("query", "path", "name", F.round(F.col("lexical") * (1 + net / (F.abs(net) + SQUASH)), 6).alias("score"), F.coalesce("anti_pattern", F.lit(False)).alias("anti_pattern"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("anti_pattern", F.desc("score"), "name", "path"))
    return found.withColumn("rank", nth).where(F.col("rank") <= limit).drop("name")


def poisson_weight(key: Column) -> Column:
    """How often a row is drawn into a resample: a Poisson number of mean one from the digest of its key."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / float(1 << 32)
    #: The Poisson distribution of mean one, summed. Fixed values.
    steps = 0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589
    return sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))


def paired_delta(differences: DataFrame, resamples: int = 2000) -> DataFrame:
    """One row (n, mean, low, high, wins, losses, beats_noise) about differences (query_id, diff), with a bootstrap interval of 95 per cent.

    Each resample draws every difference a Poisson number of times. Resamples are thus sums that merge before the
    shuffle, and no task holds all differences. An empty table gives n 0, nulls and false.
    """
    rows = differences.select("query_id", F.col("diff").cast("double").alias("diff"))
    each = rows.select("query_id", "diff", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    w = poisson_weight(F.concat_ws(":", "r", "query_id"))
    means = each.select("r", "diff", w.alias("w")).where("w > 0").groupBy("r").agg((F.sum(F.col("w") * F.col("diff")) / F.sum("w")).alias("m"))
    place = F.row_number().over(Window.orderBy("m", "r")) - 1  # as many rows as resamples, a parameter
    at = lambda i, name: F.round(F.min(F.when(F.col("place") == i, F.col("m"))), 4).alias(name)
    bounds = means.withColumn("place", place).agg(at(int(0.025 * resamples), "low"), at(int(0.975 * resamples) - 1, "high"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 6).alias("mean"), F.count_if(F.col("diff") > 1e-12).alias("wins"), F.count_if(F.col("diff") < -1e-12).alias("losses"))
    beats = F.coalesce((F.col("low") > 0) & (F.col("mean") >= MIN_EFFECT) & (F.col("wins") > F.col("losses")), F.lit(False))
    return total.join(bounds, F.lit(True)).select("n", "mean", "low", "high", "wins", "losses", beats.alias("beats_noise"))
