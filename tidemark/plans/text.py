"""Queries that find structure in texts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signals
from ..sources.tables import MEMORIES_SQL, NOTES_SQL, memories, notes, table
from . import judging

REGISTERED: dict = {}
_EMAIL = r"[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]+"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_HEADING = r"(?m)^#{1,6}[ \t]+(.+)$"


@query(f"WITH {NOTES_SQL}, h AS (SELECT id, regexp_extract_all(text, '{_HEADING}', 1) AS xs FROM note) SELECT id, unnest(xs) AS heading, generate_subscripts(xs, 1) AS place FROM h")
def heading_extract(spark: SparkSession, d: str) -> DataFrame:
    """The Markdown headings of each note, in order."""
    return notes(spark, d).select("id", F.posexplode(F.regexp_extract_all("text", F.lit(_HEADING), F.lit(1))).alias("at", "heading")).select("id", "heading", (F.col("at") + 1).cast("long").alias("place"))


@query(f"WITH {NOTES_SQL}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM note), h AS (SELECT id, n, line, CASE WHEN regexp_matches(line, '^#{{1,6}}[ \t]+.+$') THEN regexp_extract(line, '^#{{1,6}}[ \t]+(.+)$', 1) END AS heading FROM l) SELECT id, n AS line, last_value(heading IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS section FROM h WHERE line <> ''")
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    """The last heading at or before each line of a note that is not empty."""
    rows = notes(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    heading = F.nullif(F.regexp_extract("text", r"^#{1,6}[ \t]+(.+)$", 1), F.lit(""))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where("text <> ''").select("id", (F.col("at") + 1).cast("long").alias("line"), "section")


@query(f"SELECT entity, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_EMAIL}')) AS entity FROM documents) GROUP BY entity")
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as entities, with how often and in how many documents they occur."""
    rows = memories(spark, d).select("id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(_EMAIL), F.lit(0))).alias("entity"))
    each = rows.groupBy("entity", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("entity").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("documents"))


_TURNS = "t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS exchange FROM conversations)"


@query(f"WITH {_TURNS} SELECT conv_id, CAST(exchange AS BIGINT) AS exchange, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id, exchange HAVING len(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) >= 30")
def chat_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn with the replies to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "conversations").withColumn("exchange", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    rows = t.groupBy("conv_id", "exchange").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", "exchange", "turns", F.array_join("lines.line", "\n").alias("text")).where(F.char_length("text") >= 30)


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, CAST(sum(len(coalesce(text, ''))) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def turn_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of each conversation."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.max("turn").alias("last_turn"))


@query(f"WITH q AS ({judging.REGISTERED['quadrant_classify'][1].replace('WITH ' + MEMORIES_SQL + ', v AS', 'WITH ' + MEMORIES_SQL + ', v AS')}) SELECT quadrant, count(id) AS n FROM (SELECT unnest(['core', 'work', 'soul', 'wild']) AS quadrant) LEFT JOIN q USING (quadrant) GROUP BY quadrant")
def quadrant_stats(spark: SparkSession, d: str) -> DataFrame:
    """Records in each quadrant, also where there are none."""
    n = judging.quadrant_classify(spark, d).groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(q,) for q in signals.QUADRANTS], "quadrant string").join(n, "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY lang, source")
def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language and source."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("text").alias("texts"))


@query(f"WITH {MEMORIES_SQL}, t AS (SELECT unnest(tags) AS tag, id, intensity FROM mem) SELECT tag, count(*) AS n, min(id) AS first_id, arg_max(id, intensity * 1e9 - id) AS strongest_id FROM t WHERE tag IS NOT NULL GROUP BY tag HAVING count(*) >= 2")
def tag_cluster_moc(spark: SparkSession, d: str) -> DataFrame:
    """A map of contents: tags of two records or more."""
    t = memories(spark, d).select(F.explode("tags").alias("tag"), "id", "intensity").where("tag is not null")
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max_by("id", F.struct("intensity", -F.col("id"))).alias("strongest_id")).where("n >= 2")


@query(f"WITH {MEMORIES_SQL}, t AS (SELECT unnest(tags) AS tag FROM mem), c AS (SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY tag) SELECT tag, n FROM c ORDER BY n DESC, tag LIMIT 10")
def themes_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent tags."""
    t = memories(spark, d).select(F.explode("tags").alias("tag")).where("tag is not null")
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query("SELECT doc_id AS id, sha256(doc_id || ':' || trim(substring(coalesce(text, ''), 1, 60), ' ') || ':' || coalesce(text, '') || ':neutral') AS seal FROM documents")
def integrity_hash(spark: SparkSession, d: str) -> DataFrame:
    """The seal of each record over its identifier, title and content."""
    return memories(spark, d).select("id", F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.trim("title"), "content", F.lit("neutral")), 256).alias("seal"))
