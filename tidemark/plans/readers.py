"""Graphs of records as a reader may see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import level
from ..operators import graph as G
from ..sources.tables import MEMORIES_SQL, memories

REGISTERED: dict = {}
#: Two readers and the highest level that each may see; members of a chain that are shown in either direction; neighbours of a hub. Fixed values but for the readers.
READERS, MOST, HUB = {"ann": 1, "bob": 3}, 32, 3


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_SEEN = f"reader AS (SELECT unnest(['{"', '".join(READERS)}']) AS reader, unnest({list(READERS.values())}) AS trust), seen AS (SELECT reader, id FROM reader JOIN mem ON list_position(['@public', '@community', '@work-circle', '@inner-circle', '@chef-only'], context_tag) - 1 <= trust)"
#: A record is tied to its parent, to what it supersedes, and to the first record of the same content.
_EDGES = """edge AS (SELECT id AS src, parent_id AS dst, 'parent' AS type FROM mem WHERE parent_id IS NOT NULL UNION SELECT id, supersedes_id, 'supersedes' FROM mem WHERE supersedes_id IS NOT NULL
  UNION SELECT id, first, 'copy' FROM (SELECT id, min(id) OVER (PARTITION BY content) AS first FROM mem) WHERE id <> first),
both_ AS (SELECT DISTINCT reader, src, dst, type FROM (SELECT src, dst, type FROM edge UNION SELECT dst, src, type FROM edge) JOIN seen ON seen.id = src JOIN seen s USING (reader) WHERE s.id = dst AND src <> dst)"""


def _edges(m: DataFrame) -> DataFrame:
    content = m.select("id", F.sha2("content", 256).alias("h"))
    first = content.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = content.join(first, "h").where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"), F.lit("copy").alias("type"))
    link = lambda c, t: m.where(F.col(c).isNotNull()).select(F.col("id").alias("src"), F.col(c).alias("dst"), F.lit(t).alias("type"))
    return link("parent_id", "parent").unionAll(link("supersedes_id", "supersedes")).unionAll(copies)


def _seen(m: DataFrame) -> DataFrame:
    return G.seen_by(m, level(F.col("context_tag")), READERS)


@query(f"""WITH RECURSIVE {MEMORIES_SQL}, {_SEEN}, {_EDGES},
w AS (SELECT reader, id AS start, id, 0 AS hops FROM seen WHERE id % 20 = 0 UNION SELECT w.reader, start, dst, hops + 1 FROM w JOIN both_ b ON b.reader = w.reader AND b.src = w.id WHERE hops < 3),
least AS (SELECT reader, start, id, min(hops) AS hops FROM w GROUP BY reader, start, id)
SELECT l.reader, l.start, l.id, l.hops, min(b.type) AS via FROM least l JOIN least p ON p.reader = l.reader AND p.start = l.start AND p.hops = l.hops - 1 JOIN both_ b ON b.reader = l.reader AND b.src = p.id AND b.dst = l.id GROUP BY ALL""")
def reader_khops(spark: SparkSession, d: str) -> DataFrame:
    """What two readers reach in three hops from every twentieth record, hidden records being no way."""
    m = memories(spark, d)
    return G.reader_hops(_edges(m), _seen(m), m.where("id % 20 = 0"), 3)


@query(f"""WITH {MEMORIES_SQL}, {_SEEN}, {_EDGES} SELECT reader, src AS id, count(DISTINCT dst) AS connections FROM both_ GROUP BY reader, src HAVING count(DISTINCT dst) >= {HUB}""")
def reader_hubs(spark: SparkSession, d: str) -> DataFrame:
    """Hubs by the neighbours that a reader may see alone."""
    m = memories(spark, d)
    e = G.reader_edges(_edges(m), _seen(m)).select("reader", "src", "dst").distinct()
    return e.groupBy("reader", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("connections")).where(F.col("connections") >= HUB)


def histories(records: DataFrame, seen: DataFrame, asked: DataFrame, most: int = MOST) -> DataFrame:
    """(reader, requested, place, id, valid_to, supersedes_id, superseded_by, current): the chain of each asked record (id) that a reader may see.

    Earlier members have places below zero. A chain is cut in both directions at the first hidden record. A member whose
    successor is hidden is shown as if it had none: open and current. Of several records that supersede one, the least id is
    the next. Links go through keys of reader and record, so all readers are walked at once.
    """
    key = lambda c: F.struct("reader", F.col(c).alias("id"))
    back = records.where("supersedes_id is not null").select("id", F.col("supersedes_id").alias("to"))
    ahead = back.groupBy(F.col("to").alias("id")).agg(F.min("id").alias("to"))

    def open_(links: DataFrame) -> DataFrame:
        mine = seen.join(links, "id")
        return mine.join(seen.withColumnRenamed("id", "to"), ["reader", "to"], "left_semi").select(key("id").alias("key"), key("to").alias("next"))

    starts = seen.join(asked.select("id").distinct(), "id", "left_semi").select(key("id").alias("key"))
    earlier = G.within(open_(back), starts, most).select("start", "key", (-F.col("steps")).alias("place"))
    later = G.within(open_(ahead), starts, most).where("steps > 0").select("start", "key", F.col("steps").alias("place"))
    placed = earlier.unionAll(later).select(F.col("start.reader").alias("reader"), F.col("start.id").alias("requested"), "place", F.col("key.id").alias("id"))
    shown = placed.join(records.select("id", "valid_to", "supersedes_id"), "id").join(ahead.withColumnRenamed("to", "successor"), "id", "left")
    next_seen = seen.select("reader", F.col("id").alias("successor"), F.lit(True).alias("open"))
    shown = shown.join(next_seen, ["reader", "successor"], "left")
    masked = F.col("successor").isNotNull() & F.col("open").isNull() & (F.col("place") >= 0)
    first = F.col("place") == -most
    others = placed.select("reader", "requested", F.col("id").alias("supersedes_id"), F.lit(True).alias("has_before"))
    after = placed.select("reader", "requested", F.col("id").alias("successor"), F.lit(True).alias("has_after"))
    rows = shown.withColumn("masked", masked).join(others, ["reader", "requested", "supersedes_id"], "left").join(after, ["reader", "requested", "successor"], "left")
    return rows.select(
        "reader", "requested", "place", "id", F.when(~F.col("masked"), F.col("valid_to")).alias("valid_to"), F.when(F.col("has_before") & ~first, F.col("supersedes_id")).alias("supersedes_id"),
        F.when(F.col("has_after"), F.col("successor")).alias("superseded_by"), (F.col("masked") | F.col("valid_to").isNull()).alias("current"),
    )


@query(f"""WITH RECURSIVE {MEMORIES_SQL}, {_SEEN}, nxt AS (SELECT supersedes_id AS id, min(id) AS successor FROM mem WHERE supersedes_id IS NOT NULL GROUP BY supersedes_id),
asked AS (SELECT reader, id FROM seen WHERE id % 20 = 0 OR id % 35 = 0),
up AS (SELECT reader, id AS requested, id, 0 AS place FROM asked UNION ALL SELECT up.reader, requested, m.supersedes_id, place - 1 FROM up JOIN mem m ON m.id = up.id JOIN seen s ON s.reader = up.reader AND s.id = m.supersedes_id WHERE place > -{MOST}),
down AS (SELECT reader, id AS requested, id, 0 AS place FROM asked UNION ALL SELECT down.reader, requested, n.successor, place + 1 FROM down JOIN nxt n ON n.id = down.id JOIN seen s ON s.reader = down.reader AND s.id = n.successor WHERE place < {MOST}),
c AS (SELECT * FROM up UNION ALL SELECT * FROM down WHERE place > 0),
x AS (SELECT c.*, m.valid_to, m.supersedes_id AS below, n.successor, n.successor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.reader = c.reader AND s.id = n.successor) AND place >= 0 AS masked FROM c JOIN mem m USING (id) LEFT JOIN nxt n ON n.id = c.id)
SELECT x.reader, x.requested, x.place, x.id, CASE WHEN NOT masked THEN valid_to END AS valid_to, b.id AS supersedes_id, a.id AS superseded_by, masked OR valid_to IS NULL AS current
FROM x LEFT JOIN c b ON b.reader = x.reader AND b.requested = x.requested AND b.id = x.below LEFT JOIN c a ON a.reader = x.reader AND a.requested = x.requested AND a.id = x.successor""")
def reader_histories(spark: SparkSession, d: str) -> DataFrame:
    """The chains of supersessions around records, for two readers, cut at what they may not see."""
    m = memories(spark, d)
    rows = histories(m, _seen(m), m.where("id % 20 = 0 or id % 35 = 0"))
    return rows.withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))


@query(f"""WITH {MEMORIES_SQL}, {_SEEN} SELECT reader, sha256(content) AS claim, count(*) AS support_count, min(id) AS first_id, max(id) AS last_id FROM seen JOIN mem USING (id) GROUP BY reader, sha256(content)""")
def reader_claims(spark: SparkSession, d: str) -> DataFrame:
    """Contents as claims with the records that state them, as many as a reader may see; what only hidden records state is not shown."""
    m = memories(spark, d)
    told = _seen(m).join(m.select("id", F.sha2("content", 256).alias("claim")), "id")
    return told.groupBy("reader", "claim").agg(F.count(F.lit(1)).alias("support_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
