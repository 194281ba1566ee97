"""Queries over records: filters, points in time, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import days_between, has_all, level, valid_at
from ..operators import graph as G
from ..sources.tables import MEMORIES_SQL, memories, table

REGISTERED: dict = {}
_NOW = "2024-02-05 00:00:00"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH {MEMORIES_SQL} SELECT id, created_at, valid_to FROM mem WHERE created_at <= TIMESTAMP '{_NOW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_NOW}')")
def as_of_listing(spark: SparkSession, d: str) -> DataFrame:
    """Records that held at a time."""
    return memories(spark, d).where(valid_at(F.lit(_NOW).cast("timestamp"), F.col("created_at"), F.col("valid_to"))).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def temporal_window(spark: SparkSession, d: str) -> DataFrame:
    """Events of one week, from its start up to the next; the bounds reach the scan."""
    at = F.col("ts")
    return table(spark, d, "events").where((at >= F.lit("2024-01-08").cast("timestamp_ntz")) & (at < F.lit("2024-01-15").cast("timestamp_ntz"))).select("event_id", "event_type")


@query(f"""WITH {MEMORIES_SQL}, a AS (SELECT id, layer, intensity, greatest(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(created_at), 0) / 86400e6 AS age FROM mem)
SELECT id, round(intensity + CASE WHEN age < 1 THEN 5 WHEN age < 3 THEN 3 WHEN age < 7 THEN 1.5 ELSE 0 END, 6) AS weighted, round(intensity / 10 * pow(0.5, age / CASE layer WHEN 'short-term' THEN 7 WHEN 'mid-term' THEN 30 ELSE 365 END), 6) AS importance FROM a""")
def recency_weighted_list(spark: SparkSession, d: str) -> DataFrame:
    """Both orders of a listing that favour recent records."""
    age = days_between(F.col("created_at"), F.lit(_NOW).cast("timestamp"))
    half = F.when(F.col("layer") == "short-term", 7).when(F.col("layer") == "mid-term", 30).otherwise(365)
    bonus = F.when(age < 1, 5.0).when(age < 3, 3.0).when(age < 7, 1.5).otherwise(0.0)
    return memories(spark, d).select("id", F.round(F.col("intensity") + bonus, 6).alias("weighted"), F.round(F.col("intensity") / 10 * F.pow(F.lit(0.5), age / half), 6).alias("importance"))


@query(f"""WITH {MEMORIES_SQL}, t AS (SELECT id, date_diff('day', CAST(created_at AS DATE), DATE '2024-02-05') AS n FROM mem)
SELECT id, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n <= 7 THEN 'week' ELSE 'historical' END AS tier FROM t WHERE n <= 30""")
def active_context_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Records of the last thirty days by how recent they are."""
    n = F.date_diff(F.lit("2024-02-05").cast("date"), F.to_date("created_at"))
    return memories(spark, d).select("id", n.alias("n")).where("n <= 30").select("id", F.when(F.col("n") <= 0, "today").when(F.col("n") == 1, "yesterday").when(F.col("n") <= 7, "week").otherwise("historical").alias("tier"))


@query(f"WITH {MEMORIES_SQL} SELECT id, context_tag FROM mem WHERE context_tag IN ('@public', '@community', '@work-circle') AND NOT coalesce(list_contains(tags, 'src3'), false)")
def audience_filter(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of level 2 may see, without an excluded tag."""
    return memories(spark, d).where((level(F.col("context_tag")) <= 2) & ~F.coalesce(F.array_contains("tags", "src3"), F.lit(False))).select("id", "context_tag")


@query("SELECT n_name AS channel, min(c_nationkey % 5) AS min_trust, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def audience_channel_min(spark: SparkSession, d: str) -> DataFrame:
    """A channel's trust is the least of its members'."""
    c, n = table(spark, d, "customer").where("c_acctbal > 0"), table(spark, d, "nation")
    trust = c.groupBy("c_nationkey").agg(F.min(F.col("c_nationkey") % 5).alias("min_trust"), F.count(F.lit(1)).alias("members"))
    return trust.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("channel"), "min_trust", "members")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE list_contains(tags, 'en') AND list_contains(tags, 'src5')")
def tag_filter_all(spark: SparkSession, d: str) -> DataFrame:
    """Records with all of several tags."""
    return memories(spark, d).where(has_all(F.col("tags"), ["en", "src5"])).select("id")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE (list_contains(tags, 'de') OR layer = 'long-term') AND NOT coalesce(list_contains(tags, 'src1'), false) AND intensity >= 5")
def share_filter(spark: SparkSession, d: str) -> DataFrame:
    """The union of tags and layers, less excluded tags and weak records."""
    keep = F.array_contains("tags", "de") | (F.col("layer") == "long-term")
    return memories(spark, d).where(keep & ~F.coalesce(F.array_contains("tags", "src1"), F.lit(False)) & (F.col("intensity") >= 5)).select("id")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Edges customer to order, each held from the order's date for 500 days."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select((-F.col("o_custkey")).alias("src"), F.col("o_orderkey").alias("dst"), day.alias("valid_from"), (day + F.expr("interval 500 days")).alias("valid_to"))


_EDGES = "e AS (SELECT -o_custkey AS src, o_orderkey AS dst, CAST(o_orderdate AS TIMESTAMP) AS valid_from, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 500 DAY AS valid_to FROM orders)"
_AT = "1995-06-01 00:00:00"


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE valid_from <= TIMESTAMP '{_AT}' AND valid_to > TIMESTAMP '{_AT}' UNION SELECT dst, src FROM e WHERE valid_from <= TIMESTAMP '{_AT}' AND valid_to > TIMESTAMP '{_AT}'")
def graph_neighbors_asof(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours over edges that held at a time."""
    return G.neighbours(_orders(spark, d), F.lit(_AT).cast("timestamp_ntz"))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT DISTINCT src AS id FROM e WHERE src % 20 = 0),
w AS (SELECT id AS start, id, 0 AS hops FROM s UNION SELECT start, dst, hops + 1 FROM w JOIN b ON w.id = b.src WHERE hops < 2)
SELECT start, id, min(hops) AS hops FROM w GROUP BY start, id HAVING min(hops) > 0""")
def khop_related(spark: SparkSession, d: str) -> DataFrame:
    """What every twentieth customer reaches in two hops."""
    e = _orders(spark, d)
    return G.k_hops(e, e.where("src % 20 = 0").select(F.col("src").alias("id")).distinct(), 2)


#: Of three chunks in a row each follows the one before, and every fourth record was promoted from a chunk.
_PARENT = "CASE WHEN id % 4 <> 0 THEN id - 1 WHEN id % 16 = 8 THEN id - 8 END"


def _walk_sql(link: str, name: str) -> str:
    return f"""{name}_w AS (SELECT id, id AS root, 0 AS steps FROM mem UNION ALL SELECT w.id, m.{link}, steps + 1 FROM {name}_w w JOIN link m ON w.root = m.id WHERE m.{link} IS NOT NULL),
{name} AS (SELECT id, arg_max(root, steps) AS root, CAST(max(steps) AS BIGINT) AS steps FROM {name}_w GROUP BY id)"""


@query(f"WITH RECURSIVE {MEMORIES_SQL}, link AS (SELECT id, {_PARENT} AS above FROM mem), {_walk_sql('above', 'up')} SELECT id, root, steps FROM up")
def lineage_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first ancestor of each record."""
    return G.chains(memories(spark, d).select("id", F.expr(_PARENT).alias("above")), "above")


@query(f"WITH RECURSIVE {MEMORIES_SQL}, link AS (SELECT m.id, m.supersedes_id AS above, n.id AS below FROM mem m LEFT JOIN mem n ON n.supersedes_id = m.id), {_walk_sql('above', 'up')}, {_walk_sql('below', 'down')} SELECT up.id, up.root, up.steps, down.root AS head, down.steps AS later FROM up JOIN down ON up.id = down.id")
def supersession_history(spark: SparkSession, d: str) -> DataFrame:
    """The oldest record that each supersedes and the newest that supersedes it, over chains of any length."""
    m = memories(spark, d).select("id", "supersedes_id")
    next_ = m.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.max("id").alias("below"))
    up, down = G.chains(m, "supersedes_id"), G.chains(m.join(next_.hint("shuffle_merge"), "id", "left").select("id", "below"), "below")
    return up.join(down.select("id", F.col("root").alias("head"), F.col("steps").alias("later")).hint("shuffle_merge"), "id")


@query(f"WITH RECURSIVE {MEMORIES_SQL}, link AS (SELECT m.id, n.id AS below FROM mem m LEFT JOIN mem n ON n.supersedes_id = m.id), {_walk_sql('below', 'down')} SELECT id, root AS head FROM down JOIN mem h ON h.id = down.root WHERE (h.valid_to IS NULL OR h.valid_to > TIMESTAMP '{_NOW}')".replace("SELECT id, root", "SELECT down.id, root"))
def open_head(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of each chain of supersessions, if it has not ended."""
    m = memories(spark, d)
    head = supersession_history(spark, d).select("id", "head")
    open_ = m.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(_NOW).cast("timestamp"))).select(F.col("id").alias("head"))
    return head.join(open_.hint("shuffle_merge"), "head", "left_semi").select("id", "head")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE id NOT IN (SELECT supersedes_id FROM mem WHERE supersedes_id IS NOT NULL) AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_NOW}')")
def currently_valid(spark: SparkSession, d: str) -> DataFrame:
    """Records that nothing supersedes and that have not ended."""
    m = memories(spark, d)
    gone = m.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"))
    return m.join(gone, "id", "left_anti").where(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(_NOW).cast("timestamp"))).select("id")


@query(f"WITH {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT src AS id, count(*) AS degree FROM b GROUP BY src HAVING count(*) >= 15")
def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with at least fifteen neighbours."""
    return G.hubs(_orders(spark, d), 15)


#: What is looked for among the names of parts, as a whole and word by word, and rows for each word.
_SOUGHT = ["cold widget", "large bolt ring", "tiny brass gear", "nothing here"]
_PER_WORD = 10


@query("WITH q AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in _SOUGHT) + f"""]) AS query), m AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part),
whole AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS nth FROM q JOIN m ON contains(name, query)),
w AS (SELECT query, word, count(*) OVER (PARTITION BY query, word) AS n, id, row_number() OVER (PARTITION BY query, word ORDER BY id) AS nth FROM (SELECT query, unnest(list_distinct(list_filter(string_split(query, ' '), lambda t: len(t) >= 4))) AS word FROM q) JOIN m ON contains(name, word)),
u AS (SELECT query, id, 0 AS level, nth, 0 AS n, '' AS word FROM whole WHERE nth <= {_PER_WORD} UNION ALL SELECT query, id, 1, nth, least(n, {_PER_WORD}), word FROM w WHERE nth <= {_PER_WORD}),
f AS (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY level, nth, n, word) AS seen FROM u)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY level, nth, n, word) AS rank FROM f WHERE seen = 1""")
def entity_substring_arm(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose name holds a query, then those that hold one of its words, the rarest word first and a row of each in turn."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    words = [(q, w) for q in _SOUGHT for w in dict.fromkeys(q.split()) if len(w) >= 4]
    sought = spark.createDataFrame([(q, q, 0) for q in _SOUGHT] + [(q, w, 1) for q, w in words], "query string, word string, level int")
    hits = part.join(F.broadcast(sought), F.col("name").contains(F.col("word"))).select("query", "level", "word", "id")
    size = hits.groupBy("query", "level", "word").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("query", "level", "word").orderBy("id"))
    first = hits.withColumn("nth", nth).where(F.col("nth") <= _PER_WORD).join(size, ["query", "level", "word"])
    key = F.struct("level", "nth", F.when(F.col("level") == 0, 0).otherwise(F.least("n", F.lit(_PER_WORD))), F.when(F.col("level") == 0, "").otherwise(F.col("word")))
    once = first.groupBy("query", "id").agg(F.min(key).alias("key"))
    return once.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("key")).alias("rank"))


_DRIFT = "SELECT d.doc_id, md5(coalesce(d.text, '')) AS h, l.doc_id AS i, CASE WHEN l.quality = 0 THEN 'stale' ELSE md5(coalesce(d.text, '')) END AS ih, coalesce(d.doc_id, l.doc_id) AS id FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"


@query(f"SELECT id, CASE WHEN i IS NULL THEN 'insert' WHEN doc_id IS NULL THEN 'prune' WHEN h <> ih THEN 'refresh' ELSE 'keep' END AS action FROM ({_DRIFT})")
def reconcile_actions(spark: SparkSession, d: str) -> DataFrame:
    """One full join of files and index, with what is to be done."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    index = table(spark, d, "labels").select(F.col("doc_id").alias("i"), "quality")
    same = F.when(F.col("quality") == 0, "stale").otherwise(F.col("h"))
    action = F.when(F.col("i").isNull(), "insert").when(F.col("doc_id").isNull(), "prune").when(F.col("h") != same, "refresh").otherwise("keep")
    return docs.join(index, F.col("doc_id") == F.col("i"), "full").select(F.coalesce("doc_id", "i").alias("id"), action.alias("action"))


@query(f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN i IS NULL THEN 'insert' WHEN doc_id IS NULL THEN 'prune' WHEN h <> ih THEN 'refresh' ELSE 'keep' END AS action FROM ({_DRIFT})) GROUP BY action")
def drift_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """How many of each."""
    return reconcile_actions(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tombstone_anti(spark: SparkSession, d: str) -> DataFrame:
    """Records that no tombstone names."""
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query(f"WITH {MEMORIES_SQL} SELECT id, substring(sha256(content), 1, 16) AS content_hash, count(*) OVER (PARTITION BY content) AS copies, id = min(id) OVER (PARTITION BY content) AS kept FROM mem")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each content hash; groups are counted before they are joined back."""
    m = memories(spark, d).select("id", F.sha2("content", 256).alias("whole"))
    g = m.groupBy("whole").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    return m.join(g, "whole").select("id", F.substring("whole", 1, 16).alias("content_hash"), "copies", (F.col("id") == F.col("first")).alias("kept"))
