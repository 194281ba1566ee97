"""Queries over concepts: phrases in whole texts, folded weights, vectors, and anchors matched by concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..sources.tables import cut, table

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _stems_sql(text: str) -> str:
    rule = " ".join(f"WHEN len(w) > {len(e) + C.LEAST_STEM} AND ends_with(w, '{e}') THEN left(w, len(w) - {len(e)})" for e in C.ENDINGS)
    return f"list_transform(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: CASE {rule} ELSE w END)"


#: Concepts are sources; their phrases are the first one, two or three words of their records, at every third record.
_TABLE = f"""concept AS (SELECT DISTINCT concept, phrase FROM (SELECT source AS concept, list_slice({_stems_sql("coalesce(text, '')")}, 1, 1 + doc_id % 3) AS phrase FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 6 = 1) WHERE len(phrase) > 0 AND concept IS NOT NULL)"""
_HITS = f"""words AS (SELECT doc_id AS id, {_stems_sql("coalesce(text, '')")} AS ws FROM documents), u AS (SELECT id, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
hit AS (SELECT id, pos - 1 AS place, len(phrase) AS words, concept FROM u JOIN concept ON phrase[1] = w AND list_slice(ws, pos, pos + len(phrase) - 1) = phrase)"""


def _table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 3 <> 1 or doc_id % 6 = 1")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return cut(docs.select(F.col("source").alias("concept"), F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("phrase")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_TABLE}, {_HITS} SELECT id, concept, count(*) AS hits, count(DISTINCT words) AS lengths, CAST(min(place) AS INTEGER) AS first FROM hit GROUP BY id, concept")
def concepts_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of each whole text, by every phrase in it."""
    return C.counted(_texts(spark, d), _table(spark, d)).select("id", "concept", "hits", "lengths", "first")


@query(f"""WITH RECURSIVE {_TABLE}, {_HITS}, best AS (SELECT id, place, max(words) AS words FROM hit GROUP BY id, place),
w(id, place, words) AS (SELECT id, CAST(-1 AS BIGINT), CAST(1 AS BIGINT) FROM (SELECT DISTINCT id FROM best) UNION ALL
  SELECT id, place, words FROM (SELECT b.id, b.place, b.words, row_number() OVER (PARTITION BY w.id ORDER BY b.place) AS nth FROM w JOIN best b ON b.id = w.id AND b.place >= w.place + w.words) WHERE nth = 1),
kept AS (SELECT * FROM w WHERE place >= 0)
SELECT id, concept, count(*) AS hits, CAST(sum(h.words) AS BIGINT) AS words FROM hit h JOIN kept k USING (id, place, words) GROUP BY id, concept""")
def longest_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of each whole text, by the longest phrases that do not overlap."""
    return C.counted(_texts(spark, d), _table(spark, d), longest=True).select("id", "concept", "hits", "words")


#: Labels are names of parts, weighted by their price in an order; concepts are what a name's words say.
_LOOK = "SELECT DISTINCT 'kind:' || regexp_extract(p_name, '[a-z]+$') AS concept, regexp_extract(p_name, '[a-z]+$') AS phrase FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT 'brand:' || min(p_brand), p_name FROM part WHERE p_partkey % 5 = 0 GROUP BY p_name"


@query(f"""WITH c AS ({_LOOK}), w AS (SELECT l_orderkey AS id, p_name AS label, max(l_quantity / 50) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
n AS (SELECT DISTINCT label, concept FROM (SELECT DISTINCT label FROM w) JOIN c ON contains(' ' || {_stems_sql('label').replace('list_transform', "array_to_string(list_transform", 1)}, ' ') || ' ', ' ' || {_stems_sql('phrase').replace('list_transform', "array_to_string(list_transform", 1)}, ' ') || ' ') WHERE phrase <> '')
SELECT id, coalesce(concept, lower(w.label)) AS concept, round(max(weight), 6) AS weight FROM w LEFT JOIN n ON n.label = w.label GROUP BY ALL""")
def folded_weights(spark: SparkSession, d: str) -> DataFrame:
    """What each order weighs on concepts: the most of any of its parts whose name holds a phrase of the concept."""
    part = table(spark, d, "part")
    kind = F.regexp_extract("p_name", "[a-z]+$", 0)
    concepts = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("kind:"), kind).alias("concept"), kind.alias("phrase")).where("phrase <> ''")
    brands = part.where("p_partkey % 5 = 0").groupBy("p_name").agg(F.min("p_brand").alias("b")).select(F.concat(F.lit("brand:"), "b").alias("concept"), F.col("p_name").alias("phrase"))
    lines = table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("label")), "l_partkey")
    weights = lines.select(F.col("l_orderkey").alias("id"), "label", (F.col("l_quantity") / 50).alias("weight"))
    return C.folded(weights, concepts.unionAll(brands).distinct()).select("id", "concept", F.round("weight", 6).alias("weight"))


@query(f"""WITH RECURSIVE {_TABLE}, {_HITS}, best AS (SELECT id, place, max(words) AS words FROM hit GROUP BY id, place),
w(id, place, words) AS (SELECT id, CAST(-1 AS BIGINT), CAST(1 AS BIGINT) FROM (SELECT DISTINCT id FROM best) UNION ALL
  SELECT id, place, words FROM (SELECT b.id, b.place, b.words, row_number() OVER (PARTITION BY w.id ORDER BY b.place) AS nth FROM w JOIN best b ON b.id = w.id AND b.place >= w.place + w.words) WHERE nth = 1),
kept AS (SELECT * FROM w WHERE place >= 0), covered AS (SELECT id, unnest(range(place, place + words)) AS place FROM kept),
t AS (SELECT id, 'concept:' || concept AS term FROM hit JOIN kept USING (id, place, words) UNION ALL SELECT u.id, u.w FROM u LEFT JOIN covered c ON c.id = u.id AND c.place = u.pos - 1 WHERE c.id IS NULL),
b AS (SELECT id, CAST('0x' || substr(md5(term), 1, 6) AS INTEGER) % {C.BUCKETS} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1, 2)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM b""")
def concept_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of whole texts in which phrases count as their concepts."""
    return C.concept_vectors(_texts(spark, d), _table(spark, d))
