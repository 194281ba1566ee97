"""Walks over edges (src, dst, valid_from, valid_to)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import valid_at
from ..sources.tables import cut, written

#: Doublings after which a chain must be a cycle: no table has 2**48 rows.
ROUNDS = 48
#: Types of edges that one walk takes at most.
TYPES = 64


def neighbours(edges: DataFrame, at: Column | None = None) -> DataFrame:
    """Both directions of the edges that hold at a time."""
    e = edges.where(valid_at(at, F.col("valid_from"), F.col("valid_to"))) if at is not None else edges
    return e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def k_hops(edges: DataFrame, starts: DataFrame, hops: int, at: Column | None = None, visible: DataFrame | None = None) -> DataFrame:
    """(start, id, hops): what each start reaches, with the least number of hops. Hidden nodes are never walked through.

    Edges with a type are walked one type at a time, and the least number of hops over the types holds. What a hop
    reaches is written to the checkpoint folder before the next.
    """
    if "type" in edges.columns:
        kinds = [r["type"] for r in edges.select("type").distinct().orderBy("type").limit(TYPES + 1).collect()]
        if len(kinds) > TYPES:
            raise ValueError(f"more than {TYPES} types of edges")
        each = [k_hops(edges.where(F.col("type") == t).drop("type"), starts, hops, at, visible) for t in kinds]
        return reduce(DataFrame.unionAll, each).groupBy("start", "id").agg(F.min("hops").alias("hops"))
    both = neighbours(edges, at)
    if visible is not None:
        both = both.join(visible.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    reached = front = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        front = front.join(both, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct().join(reached, ["start", "id"], "left_anti").select("start", "id", F.lit(hop).alias("hops"))
        front = cut(front)
        reached = reached.unionAll(front)
    return reached.where("hops > 0")


def chains(rows: DataFrame, parent: str) -> DataFrame:
    """(id, root, steps): the farthest ancestor of each row and how far it is, over chains of any length.

    Pointers are doubled: a round replaces each row's ancestor by that one's ancestor, so the rounds grow with the
    logarithm of the longest chain, and end when nothing moves. Each is written to the checkpoint folder. A parent
    that is no row ends the chain. Rows of a cycle have no root, and an error says so. Rounds are joined by shuffles: files
    of numbers in order are so small that Spark would send a whole round through the driver.
    """
    at = rows.select("id", F.coalesce(parent, "id").alias("root"), F.col(parent).isNotNull().cast("long").alias("steps"))
    for _ in range(ROUNDS):
        above = at.select(F.col("id").alias("at"), F.col("root").alias("above"), F.col("steps").alias("more"))
        at = written(at.join(above.hint("shuffle_merge"), F.col("root") == F.col("at"), "left").select("id", F.coalesce("above", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("id", "root", "steps")
    raise ValueError("a chain of parents leads back to itself")


def hubs(edges: DataFrame, least: int) -> DataFrame:
    """(id, degree) of nodes with at least so many neighbours."""
    return neighbours(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)


def seen_by(rows: DataFrame, needed: Column, readers: dict[str, int]) -> DataFrame:
    """(reader, id) of the rows (id) that each reader may see: those whose needed level is at most the reader's."""
    each = F.explode(F.create_map(*(F.lit(x) for pair in readers.items() for x in pair))).alias("reader", "trust")
    return rows.select("id", needed.alias("needed"), each).where(F.col("needed") <= F.col("trust")).select("reader", "id")


def reader_edges(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(reader, src, dst, type) in both directions, for edges of which a reader may see both ends.

    Whatever else an edge carries is left behind: it could tell of what a reader must not know.
    """
    both = edges.select("src", "dst", "type").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")).where("src <> dst").distinct()
    open_ = both.join(seen.withColumnRenamed("id", "src"), "src")
    return open_.join(seen.withColumnRenamed("id", "dst"), ["reader", "dst"], "left_semi").select("reader", "src", "dst", "type")


def reader_hops(edges: DataFrame, seen: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(reader, start, id, hops, via): what each reader reaches from starts (id) that it may see, over edges (src, dst, type).

    A hidden node is neither returned nor walked through, so what only it connects stays unknown. via is the least type of
    the edges over which the last hop came. All readers are walked at once; each hop is written before the next.
    """
    both = cut(reader_edges(edges, seen))
    reached = front = seen.join(starts.select("id").distinct(), "id", "left_semi").select("reader", F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"))
    for hop in range(1, hops + 1):
        step = front.select("reader", "start", F.col("id").alias("src")).join(both, ["reader", "src"]).groupBy("reader", "start", F.col("dst").alias("id")).agg(F.min("type").alias("via"))
        front = cut(step.join(reached.select("reader", "start", "id"), ["reader", "start", "id"], "left_anti").select("reader", "start", "id", F.lit(hop).alias("hops"), "via"))
        reached = reached.unionAll(front)
    return reached.where("hops > 0")


def within(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, key, steps): what each start (key) reaches in up to `most` steps over links (key, next) of at most one next each.

    Jumps of 1, 2, 4, ... steps are made by joining each with itself; the places from 0 to `most` are made from them bit by
    bit. So joins grow with the logarithm of `most`, and with no chain's length; a chain that runs in a circle is walked on.
    """
    jump = written(links.select("key", "next"))
    placed = starts.select(F.col("key").alias("start"), "key", F.lit(0).alias("steps"))
    bit = 1
    while bit <= most:
        on = placed.join(jump, "key").select("start", F.col("next").alias("key"), (F.col("steps") + bit).alias("steps")).where(F.col("steps") <= most)
        placed = written(placed.unionAll(on))
        bit *= 2
        if bit <= most:
            jump = written(jump.join(jump.select(F.col("key").alias("next"), F.col("next").alias("after")), "next").select("key", F.col("after").alias("next")))
    return placed


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least node that each node of undirected edges (src, dst) is connected with.

    Each round a node takes the least label of its neighbours, and then the label of its label, so labels travel in leaps and
    the rounds grow with the logarithm of the longest way. Each is written; it ends when no label moves.
    """
    both = written(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    at = written(both.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component"), F.lit(True).alias("moved")))
    for _ in range(ROUNDS * 2):
        named = at.select("id", "component")
        near = both.join(named.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        low = named.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        # whoever gave a node its label may know a lower one by now
        above = low.select(F.col("id").alias("low"), F.col("low").alias("above"))
        at = written(low.join(above, "low", "left").select("id", F.least("low", "above").alias("now"), "component").select("id", F.col("now").alias("component"), (F.col("now") < F.col("component")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("id", "component")
    raise ValueError("components did not settle")
