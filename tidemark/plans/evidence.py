"""Queries over observations, logs and differences between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import MEMORIES_SQL, memories, table
from . import search as S

REGISTERED: dict = {}
#: Days that count as recent in a trend, and the ratio of rates that is a change. Fixed values.
RECENT_DAYS, RATIO = 14, 1.5
#: The shortest quote that can be evidence. Fixed value.
MIN_QUOTE = 8
_NOW = "2024-02-05 00:00:00"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_TAGGED = "t AS (SELECT unnest(tags) AS tag, id, created_at FROM mem)"


@query(f"""WITH {MEMORIES_SQL}, {_TAGGED}, n AS (SELECT *, count(*) OVER (PARTITION BY tag) AS members, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, id) AS nth FROM t WHERE tag IS NOT NULL)
SELECT tag, members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth) AS evidence FROM n WHERE members >= 2 AND nth <= 5 GROUP BY tag, members""")
def observation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tags of two records or more with their five newest; rows are limited before they are shuffled by tag."""
    t = memories(spark, d).select(F.explode("tags").alias("tag"), "id", "created_at").where("tag is not null")
    size = t.groupBy("tag").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), "id"))
    first = t.withColumn("nth", nth).where("nth <= 5").groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("e"))
    return size.join(first, "tag").select("tag", "members", F.array_join(F.transform("e", lambda x: x["id"].cast("string")), ",").alias("evidence"))


@query(f"""WITH {MEMORIES_SQL}, {_TAGGED}, a AS (SELECT tag, count(*) FILTER (WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAY) AS recent, count(*) FILTER (WHERE created_at < TIMESTAMP '{_NOW}' - INTERVAL 14 DAY) AS prior,
  greatest(1, epoch_us(TIMESTAMP '{_NOW}' - INTERVAL 14 DAY) / 86400e6 - epoch_us(min(created_at)) / 86400e6) AS days FROM t WHERE tag IS NOT NULL GROUP BY tag)
SELECT tag, recent, prior, CASE WHEN recent = 0 THEN 'stale' WHEN prior = 0 THEN 'new' WHEN recent / 14.0 >= 1.5 * prior / days THEN 'strengthening' WHEN recent / 14.0 <= prior / days / 1.5 THEN 'weakening' ELSE 'stable' END AS trend FROM a""")
def observation_trend(spark: SparkSession, d: str) -> DataFrame:
    """Whether a tag comes more or less often of late."""
    cut = F.lit(_NOW).cast("timestamp") - F.expr(f"interval {RECENT_DAYS} days")
    t = memories(spark, d).select(F.explode("tags").alias("tag"), "created_at").where("tag is not null")
    a = t.groupBy("tag").agg(F.count_if(F.col("created_at") >= cut).alias("recent"), F.count_if(F.col("created_at") < cut).alias("prior"), F.min("created_at").alias("first"))
    now, then = F.col("recent") / float(RECENT_DAYS), F.col("prior") / F.greatest(F.lit(1.0), (F.unix_micros(cut) - F.unix_micros("first")) / 86_400e6)
    trend = F.when(F.col("recent") == 0, "stale").when(F.col("prior") == 0, "new").when(now >= RATIO * then, "strengthening").when(now <= then / RATIO, "weakening").otherwise("stable")
    return a.select("tag", "recent", "prior", trend.alias("trend"))


_STORED = "SELECT tag, id AS memory_id, substring(title, 1, 20) AS quote, created_at AS seen_at FROM t WHERE id % 3 <> 0"
_FOUND = "SELECT tag, id, substring(title, 1, 20), created_at + INTERVAL 1 DAY FROM t WHERE id % 2 = 0"


@query(f"WITH {MEMORIES_SQL}, t AS (SELECT unnest(tags) AS tag, id, title, created_at FROM mem), u AS ({_STORED} UNION ALL {_FOUND}), m AS (SELECT tag, memory_id, quote, min(seen_at) AS seen_at FROM u WHERE tag IS NOT NULL GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY tag) AS held, row_number() OVER (PARTITION BY tag ORDER BY seen_at DESC, memory_id) AS nth FROM m) SELECT tag, memory_id, quote, seen_at, held FROM n WHERE nth <= 5")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stored evidence of each tag and what was found now, each (record, quote) once with its earliest time; the five newest are kept."""
    t = memories(spark, d).select(F.explode("tags").alias("tag"), F.col("id").alias("memory_id"), F.substring("title", 1, 20).alias("quote"), F.col("created_at").alias("seen_at")).where("tag is not null")
    found = t.where("memory_id % 2 = 0").withColumn("seen_at", F.col("seen_at") + F.expr("interval 1 day"))
    m = t.where("memory_id % 3 <> 0").unionByName(found).groupBy("tag", "memory_id", "quote").agg(F.min("seen_at").alias("seen_at"))
    held = m.groupBy("tag").agg(F.count(F.lit(1)).alias("held"))
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("seen_at"), "memory_id"))
    return m.withColumn("nth", nth).where("nth <= 5").join(held, "tag").select("tag", "memory_id", "quote", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "held")


@query(f"""WITH {MEMORIES_SQL}, e AS (SELECT id, coalesce(supersedes_id, id) AS memory_id, trim(title, ' ') AS quote FROM mem)
SELECT e.id, e.memory_id, len(quote) >= 8 AND contains(m.content, quote) AS verified FROM e JOIN mem m ON e.memory_id = m.id""")
def citation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the record that is cited holds the quote."""
    m = memories(spark, d)
    e = m.select("id", F.coalesce("supersedes_id", "id").alias("memory_id"), F.trim("title").alias("quote"))
    cited = m.select(F.col("id").alias("memory_id"), "content")
    return e.join(cited, "memory_id").select("id", "memory_id", ((F.char_length("quote") >= MIN_QUOTE) & F.col("content").contains(F.col("quote"))).alias("verified"))


@query(f"{S._LEX_SQL[:-1]} SELECT l.query_id, count(DISTINCT CASE WHEN l.id = s.id THEN l.id END) / {S.TOP}.0 AS overlap FROM lexical l JOIN semantic s ON l.query_id = s.query_id GROUP BY l.query_id")
def shadow_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much two engines' results have in common, for queries that both answer."""
    a, b = S._lexical(spark, d), S._semantic(spark, d)
    a, b = (x.groupBy("query_id").agg(F.collect_set("id").alias(n)) for x, n in ((a, "a"), (b, "b")))
    return a.join(b, "query_id").select("query_id", (F.size(F.array_intersect("a", "b")) / float(S.TOP)).alias("overlap"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) IN ('view', 'error')")
def pending_writes(spark: SparkSession, d: str) -> DataFrame:
    """Operations whose last status is not final."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))
    return last.where(F.col("status").isin("view", "error"))


@query("SELECT conv_id, count(*) AS turns, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, min(turn) AS first_turn, CAST(sum(len(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def session_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """A session as one record."""
    t = table(spark, d, "conversations").groupBy("conv_id")
    return t.agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.min("turn").alias("first_turn"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("SELECT l.doc_id AS id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE md5(coalesce(d.text, '')) <> CASE WHEN l.toxic = 1 THEN '' ELSE md5(coalesce(d.text, '')) END")
def hash_stale(spark: SparkSession, d: str) -> DataFrame:
    """Indexed records whose hash is not that of their text."""
    h = F.md5(F.coalesce("text", F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", h.alias("h")).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return rows.where(F.col("h") != F.when(F.col("toxic") == 1, "").otherwise(F.col("h"))).select(F.col("doc_id").alias("id"))


@query("SELECT 'unlabelled' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT 'unknown', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def orphan_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """What one store has and the other has not, both ways."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda x, y, side: x.join(y, "doc_id", "left_anti").select(F.lit(side).alias("side"), F.col("doc_id").alias("id"))
    return one(a, b, "unlabelled").unionAll(one(b, a, "unknown"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 48)")
def orphan_aux(spark: SparkSession, d: str) -> DataFrame:
    """Nodes without an edge of some weight."""
    edges = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(edges, "p_partkey", "left_anti").select(F.col("p_partkey").alias("id"))


@query(f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE list_has_any(tags, ['de', 'src5', 'src7'])")
def tag_or_search(spark: SparkSession, d: str) -> DataFrame:
    """Records with any of several tags."""
    return memories(spark, d).where(F.arrays_overlap("tags", F.array(*map(F.lit, ("de", "src5", "src7"))))).select("id")


@query(f"WITH {MEMORIES_SQL} SELECT layer, context_tag, count(*) AS n, GROUPING(layer) AS all_layers, GROUPING(context_tag) AS all_tags FROM mem GROUP BY CUBE (layer, context_tag)")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """Records by layer, by audience, by both and in all."""
    cube = memories(spark, d).cube("layer", "context_tag")
    return cube.agg(F.count(F.lit(1)).alias("n"), F.grouping("layer").cast("long").alias("all_layers"), F.grouping("context_tag").cast("long").alias("all_tags"))


_METRICS = S.REGISTERED["recall_mrr_ndcg"][1]
#: What each metric may not fall below, and by how much it may still differ.
BASELINE, SLACK = {"precision_at_k": 0.2, "reciprocal_rank": 0.5, "ndcg": 0.9}, 0.02


@query(f"WITH m AS ({_METRICS}) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}), 6) AS value, {b} AS baseline, avg({n}) < {b} - {SLACK} AS regressed FROM m" for n, b in BASELINE.items()))
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against their baseline."""
    m = S.recall_mrr_ndcg(spark, d).agg(*(F.avg(n).alias(n) for n in BASELINE))
    rows = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v"), F.lit(b).alias("baseline")) for n, b in BASELINE.items()))).alias("r"))
    return rows.select("r.metric", F.round("r.v", 6).alias("value"), "r.baseline", (F.col("r.v") < F.col("r.baseline") - SLACK).alias("regressed"))


def chain(rows: DataFrame, key: str, order: list[str], payload: str, written: str) -> DataFrame:
    """rows with link: the hash of what is written behind the hash of the payload before it, 'GENESIS' before the first."""
    before = F.coalesce(F.lag(F.sha2(payload, 256)).over(Window.partitionBy(key).orderBy(*order)), F.lit("GENESIS"))
    return rows.withColumn("link", F.sha2(F.concat(before, F.lit(":"), F.col(written)), 256))


#: Events whose stored link was made from another payload.
_FORGED = "event_id % 50 = 7"
_LINK = "sha256(coalesce(lag(sha256(coalesce(props, ''))) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'GENESIS') || ':' || {})"


@query(f"WITH l AS (SELECT event_id, user_id, ts, {_LINK.format(f'CASE WHEN {_FORGED} THEN {chr(39)}forged{chr(39)} ELSE coalesce(props, {chr(39)}{chr(39)}) END')} AS stored, {_LINK.format('coalesce(props, ' + chr(39) * 2 + ')')} AS link FROM events) SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE stored <> link) AS broken, min(event_id) FILTER (WHERE stored <> link) AS first_broken FROM l GROUP BY user_id")
def hash_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Each user's log against the links that were stored with it: entries, and those whose link is not that of their payload."""
    e = table(spark, d, "events")
    stored = chain(e.withColumn("own", F.coalesce("props", F.lit(""))).withColumn("written", F.when(F.expr(_FORGED), "forged").otherwise(F.col("own"))), "user_id", ["ts", "event_id"], "own", "written")
    both = stored.withColumnRenamed("link", "stored")
    rows = chain(both, "user_id", ["ts", "event_id"], "own", "own")
    bad = F.col("stored") != F.col("link")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(bad).alias("broken"), F.min(F.when(bad, F.col("event_id"))).alias("first_broken"))
