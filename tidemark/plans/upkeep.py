"""Queries that keep a store in order: targets, seals, closed records, links, repairs, reruns, samples, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import LEVELS, level, tokens
from ..operators import graph as G
from ..operators import likesets as L
from ..sources.tables import MEMORIES_SQL, NOTES_SQL, cut, memories, notes, table
from ..streaming.jobs import merged_intentions
from . import search
from .context import NEGATIONS

REGISTERED: dict = {}
_NOW = "2024-02-05 00:00:00"
#: Share of words of a claim that a source must hold; words that do not count. Fixed values.
SUPPORT = 0.6
CLAIM_STOP = ["the", "and", "for", "with", "that", "this", "are", "was", "were", "has", "have", "from", "into", "its", "their"]
#: Words from which a title is close to another; a text restates another from this overlap on. Fixed values.
NEAR, RESTATES = 0.72, 0.72
#: A sweep may not remove more than this share, and is not judged below so many rows. Fixed values.
MOST_REMOVED, LEAST_JUDGED = 0.20, 20


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_TARGET_SQL = "CASE WHEN layer = 'short-term' AND (intensity >= 5 OR access_count >= 3) THEN 'mid-term' WHEN layer = 'mid-term' AND intensity >= 7 THEN 'long-term' END"


@query(f"WITH {MEMORIES_SQL} SELECT id, {_TARGET_SQL} AS target, CASE WHEN {_TARGET_SQL} IS NULL THEN NULL WHEN intensity >= 7 THEN 'intense' WHEN intensity >= 5 THEN 'strong' ELSE 'often used' END AS reason FROM mem")
def promotion_targets(spark: SparkSession, d: str) -> DataFrame:
    """The layer that each record is ready for, if any, and why."""
    c = F.col
    target = F.when((c("layer") == "short-term") & ((c("intensity") >= 5) | (c("access_count") >= 3)), "mid-term").when((c("layer") == "mid-term") & (c("intensity") >= 7), "long-term")
    reason = F.when(target.isNull(), F.lit(None)).when(c("intensity") >= 7, "intense").when(c("intensity") >= 5, "strong").otherwise("often used")
    return memories(spark, d).select("id", target.alias("target"), reason.alias("reason"))


@query(f"WITH {MEMORIES_SQL}, s AS (SELECT supersedes_id AS id, min(created_at) AS closed_at, arg_min(id, created_at) AS by_id FROM mem WHERE supersedes_id IS NOT NULL AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_NOW}') GROUP BY supersedes_id) SELECT m.id, s.closed_at, s.by_id FROM mem m JOIN s ON m.id = s.id WHERE m.valid_to IS NULL OR m.valid_to > TIMESTAMP '{_NOW}'")
def supersession_heal(spark: SparkSession, d: str) -> DataFrame:
    """Open records that a live one supersedes, with the end and the cause that they should have: the oldest superseder's."""
    m = memories(spark, d)
    live = m.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(_NOW).cast("timestamp")))
    first = live.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.min(F.struct("created_at", F.col("id").alias("by_id"))).alias("s"))
    return live.select("id").join(first, "id").select("id", F.col("s.created_at").cast("timestamp_ntz").alias("closed_at"), F.col("s.by_id").alias("by_id"))


_SEAL = "sha256(title || chr(10) || content)"


@query(f"""WITH {MEMORIES_SQL}, s AS (SELECT id, parent_id, title, content, {_SEAL} AS seal, CASE WHEN id % 40 = 5 THEN lag({_SEAL}) OVER (ORDER BY id) WHEN id % 40 = 7 THEN 'x' ELSE {_SEAL} END AS stored FROM mem),
p AS (SELECT s.id, s.seal = s.stored AS ok, s.stored = q.seal AS as_parent FROM s LEFT JOIN s q ON s.parent_id = q.id) SELECT id, CASE WHEN ok THEN 'verified' WHEN coalesce(as_parent, false) THEN 'copied from parent' ELSE 'broken' END AS state FROM p""".replace(f"CASE WHEN id % 40 = 5 THEN lag({_SEAL}) OVER (ORDER BY id) WHEN", "CASE WHEN id % 40 = 5 THEN (SELECT sha256(o.title || chr(10) || o.content) FROM mem o WHERE o.id = mem.id - 1) WHEN"))
def seal_check(spark: SparkSession, d: str) -> DataFrame:
    """Records by their stored seal: right, that of the record they were promoted from, or broken."""
    seal = F.sha2(F.concat("title", F.lit("\n"), "content"), 256)
    m = memories(spark, d).select("id", "parent_id", seal.alias("seal"))
    above = m.select(F.col("id").alias("above"), F.col("seal").alias("above_seal"))
    # every fortieth has the seal of the record before it, another one none
    rows = m.join(above, F.col("above") == F.when(F.col("id") % 40 == 5, F.col("id") - 1).otherwise(F.col("parent_id")), "left")
    stored = F.when(F.col("id") % 40 == 5, F.col("above_seal")).when(F.col("id") % 40 == 7, "x").otherwise(F.col("seal"))
    parents = (F.col("above") == F.col("parent_id")) & (stored == F.col("above_seal"))
    return rows.select("id", F.when(stored == F.col("seal"), "verified").when(F.coalesce(parents, F.lit(False)), "copied from parent").otherwise("broken").alias("state"))


_EDGE_SQL = f"""g AS (SELECT id AS src, 'tag:' || tag AS dst, 'HAS_TAG' AS type FROM (SELECT id, unnest(tags) AS tag FROM mem) WHERE tag IS NOT NULL
UNION SELECT id, 'source:' || source, 'FROM_SOURCE' FROM mem WHERE source IS NOT NULL UNION SELECT id, 'record:' || parent_id, CASE WHEN layer = 'short-term' THEN 'CHUNK_OF' ELSE 'PROMOTED_FROM' END FROM mem WHERE parent_id IS NOT NULL
UNION SELECT id, 'record:' || supersedes_id, 'SUPERSEDES' FROM mem WHERE supersedes_id IS NOT NULL)"""


def record_edges(m: DataFrame) -> DataFrame:
    """(src, dst, type): the edges of records to their tags, their source, where they came from and what they supersede, each once."""
    to = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    lineage = F.when(F.col("layer") == "short-term", "CHUNK_OF").otherwise("PROMOTED_FROM")
    each = [
        m.select(F.col("id").alias("src"), F.explode("tags").alias("t")).where("t is not null").select("src", to("tag", "t").alias("dst"), F.lit("HAS_TAG").alias("type")),
        m.where("source is not null").select(F.col("id").alias("src"), to("source", "source").alias("dst"), F.lit("FROM_SOURCE").alias("type")),
        m.where("parent_id is not null").select(F.col("id").alias("src"), to("record", "parent_id").alias("dst"), lineage.alias("type")),
        m.where("supersedes_id is not null").select(F.col("id").alias("src"), to("record", "supersedes_id").alias("dst"), F.lit("SUPERSEDES").alias("type")),
    ]
    return reduce(DataFrame.unionAll, each).dropDuplicates(["src", "dst", "type"])


@query(f"WITH {MEMORIES_SQL}, {_EDGE_SQL} SELECT src, dst, type FROM g")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges of all records."""
    return record_edges(memories(spark, d))


@query(f"WITH {MEMORIES_SQL}, {_EDGE_SQL} SELECT type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM g GROUP BY type")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each type, and the nodes at both ends."""
    return record_edges(memories(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(f"WITH {MEMORIES_SQL}, e AS (SELECT id AS child, coalesce(supersedes_id, parent_id) AS parent, supersedes_id IS NOT NULL AS meant, layer FROM mem WHERE coalesce(supersedes_id, parent_id) IS NOT NULL) SELECT child, parent, CASE WHEN meant THEN 'kept' WHEN layer = 'short-term' THEN 'to CHUNK_OF' ELSE 'to PROMOTED_FROM' END AS action FROM e")
def lineage_repair(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of edges that were all written as supersessions: those that are stay, chunks and promotions get their own type."""
    e = memories(spark, d).select(F.col("id").alias("child"), F.coalesce("supersedes_id", "parent_id").alias("parent"), "supersedes_id", "layer").where("parent is not null")
    return e.select("child", "parent", F.when(F.col("supersedes_id").isNotNull(), "kept").when(F.col("layer") == "short-term", "to CHUNK_OF").otherwise("to PROMOTED_FROM").alias("action"))


@query(f"WITH {MEMORIES_SQL}, l AS (SELECT id, list_filter([parent_id, supersedes_id, id + 1], lambda x: x IS NOT NULL) AS links, context_tag FROM mem), p AS (SELECT id, unnest(links) AS link FROM l), v AS (SELECT id FROM mem WHERE context_tag IN ('@public', '@community')) SELECT l.id, coalesce((SELECT string_agg(CAST(link AS VARCHAR), ',' ORDER BY link) FROM p WHERE p.id = l.id AND link IN (SELECT id FROM v)), '') AS links FROM l WHERE l.id IN (SELECT id FROM v)")
def redacted_links(spark: SparkSession, d: str) -> DataFrame:
    """The records that a community reader may see, with those of their links that lead to others of these."""
    m = memories(spark, d)
    seen = m.where(level(F.col("context_tag")) <= LEVELS["@community"])
    links = seen.select("id", F.explode(F.array_compact(F.array("parent_id", "supersedes_id", F.col("id") + 1))).alias("link"))
    kept = links.join(seen.select(F.col("id").alias("link")), "link", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("link")), lambda x: x.cast("string")), ",").alias("links"))
    return seen.select("id").join(kept, "id", "left").select("id", F.coalesce("links", F.lit("")).alias("links"))


@query(f"WITH s AS (SELECT doc_id AS id, quality = 1 AS stored FROM labels), n AS (SELECT doc_id AS id, len(coalesce(text, '')) >= 200 AS fresh FROM documents) SELECT n.id, CASE WHEN stored IS NULL THEN 'first evaluation' WHEN stored = fresh THEN 'bump only' WHEN stored THEN 'apply' ELSE 'block and review' END AS decision FROM n LEFT JOIN s ON n.id = s.id")
def rerun_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A stored admission against a new one: same, tighter (taken over), looser (kept back for review), or none stored."""
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("stored"))
    fresh = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.char_length(F.coalesce("text", F.lit(""))) >= 200).alias("fresh"))
    decision = F.when(F.col("stored").isNull(), "first evaluation").when(F.col("stored") == F.col("fresh"), "bump only").when(F.col("stored"), "apply").otherwise("block and review")
    return fresh.join(stored, "id", "left").select("id", decision.alias("decision"))


@query(f"WITH r AS ({rerun_verdicts.__name__}) SELECT 1".replace(f"({rerun_verdicts.__name__})", "(" + REGISTERED["rerun_verdicts"][1] + ")").replace("SELECT 1", "SELECT decision, count(*) AS n, CAST(min(id) AS BIGINT) AS first_id FROM r WHERE decision = 'block and review' GROUP BY decision"))
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What waits for a review, and the first of it."""
    return rerun_verdicts(spark, d).where("decision = 'block and review'").groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {NOTES_SQL}, c AS (SELECT id, name, text, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n', chr(1), 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS claim FROM note),
w AS (SELECT id, claim, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9]{{3,}}'), lambda x: NOT list_contains([{', '.join(f"'{x}'" for x in CLAIM_STOP)}], x))) AS ws, (SELECT lower(n.text) FROM note n WHERE n.id = c.id - 12) AS source FROM c),
j AS (SELECT id, source IS NOT NULL AND (len(ws) = 0 OR len(list_filter(ws, lambda x: contains(source, x))) >= {SUPPORT} * len(ws)) AS supported FROM w)
SELECT id, count(*) AS claims, count(*) FILTER (WHERE supported) AS supported, round(count(*) FILTER (WHERE supported) / count(*), 6) AS score FROM j GROUP BY id""")
def groundedness(spark: SparkSession, d: str) -> DataFrame:
    """Which share of a note's claims the note that it cites, twelve before it, supports; without a citation none."""
    n = notes(spark, d)
    ends = F.filter(F.transform(F.split(F.col("text"), r"\n|(?<=[.!?]) "), lambda x: F.trim(x)), lambda x: x != "")
    claims = n.select("id", (F.col("id") - 12).alias("cited"), F.explode(ends).alias("claim"))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda x: ~x.isin(*CLAIM_STOP)))
    rows = claims.select("id", "cited", words.alias("ws")).join(n.select(F.col("id").alias("cited"), F.lower("text").alias("source")), "cited", "left")
    held = F.size(F.filter("ws", lambda x: F.col("source").contains(x)))
    good = F.col("source").isNotNull() & ((F.size("ws") == 0) | (held >= SUPPORT * F.size("ws")))
    return rows.select("id", good.alias("good")).groupBy("id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("good").alias("supported"), F.round(F.count_if("good") / F.count(F.lit(1)), 6).alias("score"))


_NEG_SQL = "list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9'']+'), lambda w: list_contains([" + ", ".join(f"'{x}'" for x in NEGATIONS) + "], w) OR suffix(w, 'n''t')), lambda w: CASE WHEN suffix(w, 'n''t') THEN 'not' ELSE w END)))"


def _words(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def _denied(c: str) -> Column:
    all_ = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(all_, lambda w: w.isin(*NEGATIONS) | w.endswith("n't")), lambda w: F.when(w.endswith("n't"), "not").otherwise(w))))


def related(p: DataFrame, *keys: str) -> DataFrame:
    """(keys, relation, conflict) of pairs of texts (keys, new, old): how the new one relates to the old, and whether they deny different things."""
    w = p.select(*keys, _words("new").alias("x"), _words("old").alias("y"), _denied("new").alias("nx"), _denied("old").alias("ny"))
    both, either = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    same = (both / either >= RESTATES) & (both == F.size("x")) & (F.col("nx") == F.col("ny"))
    return w.select(*keys, F.when(both == 0, "unrelated").when(same, "unchanged").otherwise("extends").alias("relation"), ((both > 0) & (F.col("nx") != F.col("ny"))).alias("conflict"))


@query(f"""WITH {NOTES_SQL}, p AS (SELECT a.id, a.text AS new, b.text AS old FROM note a JOIN note b ON b.id = a.id - 12), w AS (SELECT id, list_distinct(regexp_extract_all(lower(new), '[a-z0-9]{{3,}}')) AS x, list_distinct(regexp_extract_all(lower(old), '[a-z0-9]{{3,}}')) AS y, {_NEG_SQL.format(t='new')} AS nx, {_NEG_SQL.format(t='old')} AS ny FROM p),
s AS (SELECT *, len(list_intersect(x, y)) AS both_, len(x) + len(y) - len(list_intersect(x, y)) AS any_ FROM w)
SELECT id, CASE WHEN both_ = 0 THEN 'unrelated' WHEN both_ / any_ >= {RESTATES} AND both_ = len(x) AND nx = ny THEN 'unchanged' ELSE 'extends' END AS relation, both_ > 0 AND nx <> ny AS conflict FROM s""")
def relation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """How a note relates to the one of its kind before it: it restates it and adds no word, extends it, or is of something else.

    A conflict is possible where they deny different things.
    """
    n = notes(spark, d)
    p = n.select("id", (F.col("id") - 12).alias("of"), F.col("text").alias("new")).join(n.select(F.col("id").alias("of"), F.col("text").alias("old")), "of")
    return related(p, "id")


@query(f"""WITH {MEMORIES_SQL}, t AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}'))) AS ws, min(id) AS id, count(*) AS copies FROM mem GROUP BY 1), n AS (SELECT id, len(ws) AS n, copies FROM t WHERE len(ws) >= 4), x AS (SELECT id, unnest(ws) AS w FROM t WHERE len(ws) >= 4),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS both_ FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
SELECT p.a, p.b, round(both_ / (m.n + o.n - both_), 6) AS similarity, m.copies AS a_copies, o.copies AS b_copies FROM p JOIN n m ON m.id = p.a JOIN n o ON o.id = p.b WHERE both_ / (m.n + o.n - both_) >= {NEAR}""")
def jaccard_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of titles of four words or more whose sets of words are alike, with how many records have each title's set.

    Sets that are equal are one. Those that share a rare word meet in the task that compares them (likesets.cells), so
    what is shuffled grows with the sets; the pairs are the result and go nowhere else.
    """
    pairs = L.alike(title_sets(memories(spark, d)), NEAR)
    return pairs.select("a", "b", F.round("likeness", 6).alias("similarity"), "a_copies", "b_copies")


def title_sets(m: DataFrame) -> DataFrame:
    """Distinct sets of four words or more of titles (id, copies, ws), by their first record."""
    words = F.array_sort(F.array_distinct(tokens(F.col("title"))))
    return m.groupBy(words.alias("ws")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).where(F.size("ws") >= 4)


_NEAR_PAIRS = f"""{MEMORIES_SQL}, t AS (SELECT list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}'))) AS ws, min(id) AS id, count(*) AS copies FROM mem GROUP BY 1), n AS (SELECT id, len(ws) AS n, copies FROM t WHERE len(ws) >= 4), x AS (SELECT id, unnest(ws) AS w FROM t WHERE len(ws) >= 4),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS both_ FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n m ON m.id = p.a JOIN n o ON o.id = p.b WHERE both_ / (m.n + o.n - both_) >= {NEAR})"""


@query(f"""WITH RECURSIVE {_NEAR_PAIRS}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT id, id AS other FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.id, c.class_id, n.copies, (SELECT count(*) FROM e WHERE e.a = n.id) AS links FROM n JOIN (SELECT id, min(other) AS class_id FROM r GROUP BY id) c ON c.id = n.id""")
def near_title_classes(spark: SparkSession, d: str) -> DataFrame:
    """Titles of four words or more by classes of like ones: a row for each distinct set of words, with its class, its records, and its direct links."""
    sets = title_sets(memories(spark, d))
    each = cut(L.linked(sets, NEAR))
    links = each.groupBy("id").agg(F.sum("links").alias("links"))
    edges = each.where("id <> root").select(F.col("root").alias("src"), F.col("id").alias("dst")).distinct()
    rows = sets.select("id", "copies").join(G.components(edges), "id", "left").join(links, "id", "left")
    return rows.select("id", F.coalesce("component", "id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query(f"""WITH {_NEAR_PAIRS}, q AS (SELECT a AS src, b AS dst, o.content AS old, c.content AS new FROM l JOIN mem o ON o.id = a JOIN mem c ON c.id = b),
w2 AS (SELECT src, dst, list_distinct(regexp_extract_all(lower(new), '[a-z0-9]{{3,}}')) AS x, list_distinct(regexp_extract_all(lower(old), '[a-z0-9]{{3,}}')) AS y, {_NEG_SQL.format(t='new')} AS nx, {_NEG_SQL.format(t='old')} AS ny FROM q),
s AS (SELECT *, len(list_intersect(x, y)) AS shared, len(x) + len(y) - len(list_intersect(x, y)) AS any_ FROM w2)
SELECT src, dst, CASE WHEN shared = 0 THEN 'unrelated' WHEN shared / any_ >= {RESTATES} AND shared = len(x) AND nx = ny THEN 'unchanged' ELSE 'extends' END AS relation, shared > 0 AND nx <> ny AS conflict FROM s""")
def near_relations(spark: SparkSession, d: str) -> DataFrame:
    """How records with like titles relate: the later one restates the earlier, extends it, or is of something else."""
    m = memories(spark, d)
    features = {"words": _words("content"), "denied": F.array_join(_denied("content"), ",")}
    return L.judged(title_sets(m), NEAR, m, features, L.restated(RESTATES), "relation string, conflict boolean")


@query(f"""WITH {_NEAR_PAIRS}, q AS (SELECT a AS src, b AS dst, lower(o.content) AS source, c.content AS text FROM l JOIN mem o ON o.id = a JOIN mem c ON c.id = b),
c AS (SELECT src, dst, source, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n', chr(1), 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS claim FROM q),
w2 AS (SELECT src, dst, source, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z0-9]{{3,}}'), lambda x: NOT list_contains([{', '.join(f"'{x}'" for x in CLAIM_STOP)}], x))) AS ws FROM c),
j AS (SELECT src, dst, len(ws) = 0 OR len(list_filter(ws, lambda x: contains(source, x))) >= {SUPPORT} * len(ws) AS good FROM w2)
SELECT src, dst, count(*) AS claims, count(*) FILTER (WHERE good) AS supported, round(count(*) FILTER (WHERE good) / count(*), 6) AS score FROM j GROUP BY src, dst""")
def near_grounds(spark: SparkSession, d: str) -> DataFrame:
    """Which share of a record's claims the earlier record with a like title supports."""
    m = memories(spark, d)
    ends = F.filter(F.transform(F.split("content", r"\n|(?<=[.!?]) "), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda x: ~x.isin(*CLAIM_STOP)))
    features = {"runs": _words("content"), "claims": F.transform(ends, words)}
    rows = L.judged(title_sets(m), NEAR, m, features, L.supported(SUPPORT), "claims long, supported long")
    return rows.select("*", F.round(F.col("supported") / F.col("claims"), 6).alias("score"))




@query(f"WITH {search._KNN}, r AS (SELECT query_id, id, {search._TOP} FROM scored QUALIFY rank <= 10), h AS (SELECT query_id, q.label AS class, rank, q.label = v.label AS hit FROM r JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = r.id), a AS (SELECT label AS class, count(*) AS relevant FROM embeddings GROUP BY label), m AS (SELECT query_id, class, count(*) FILTER (WHERE hit) AS hits, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS rr FROM h GROUP BY query_id, class) SELECT m.class, count(*) AS queries, round(avg(hits / (relevant - 1.0)), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) FILTER (WHERE hits = 0) AS missed FROM m JOIN a ON m.class = a.class GROUP BY m.class")
def class_bench(spark: SparkSession, d: str) -> DataFrame:
    """For each class of questions: recall at 10, reciprocal rank, and questions without any hit."""
    e = table(spark, d, "embeddings")
    rows = search._neighbours(spark, d).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("class")), "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    hit = F.col("class") == F.col("label")
    m = rows.groupBy("query_id", "class").agg(F.count_if(hit).alias("hits"), F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))
    a = e.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("relevant"))
    return m.join(a, "class").groupBy("class").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hits") / (F.col("relevant") - 1.0)), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count_if(F.col("hits") == 0).alias("missed"))


@query(f"""{search._ARMS_SQL}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY best, score DESC, id) AS rank FROM fused), g AS (SELECT query_id, id FROM lexical WHERE rank <= 3)
SELECT g.query_id, g.id, coalesce(s.rank, 0) AS semantic_rank, r.rank AS fused_rank, CASE WHEN r.rank <= 5 THEN 'found' WHEN s.rank IS NULL THEN 'lost by the semantic arm' ELSE 'lost by fusion' END AS blame FROM g JOIN r ON g.query_id = r.query_id AND g.id = r.id LEFT JOIN semantic s ON g.query_id = s.query_id AND g.id = s.id""")
def arm_blame(spark: SparkSession, d: str) -> DataFrame:
    """Where the lexical arm's first three come out in the fused list, and which stage lost those that fall below the fifth."""
    arms = search._arms(spark, d)
    gold = arms.where("arm = 'lexical' and rank <= 3").select("query_id", "id")
    sem = arms.where("arm = 'semantic'").select("query_id", "id", F.col("rank").alias("s"))
    r = search.R.interleave(arms, 1 << 30).select("query_id", "id", F.col("rank").alias("fused_rank"))
    rows = gold.join(r, ["query_id", "id"]).join(sem, ["query_id", "id"], "left")
    blame = F.when(F.col("fused_rank") <= 5, "found").when(F.col("s").isNull(), "lost by the semantic arm").otherwise("lost by fusion")
    return rows.select("query_id", "id", F.coalesce("s", F.lit(0)).alias("semantic_rank"), "fused_rank", blame.alias("blame"))


@query(f"WITH {MEMORIES_SQL}, w AS (SELECT m.id, n.id AS older FROM mem m JOIN mem n ON n.created_at < m.created_at AND (m.parent_id = n.id OR m.supersedes_id = n.id)), o AS (SELECT older AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS back FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY older DESC) AS nth FROM w) WHERE nth <= 5 GROUP BY older) SELECT id, back FROM o")
def reweave_links(spark: SparkSession, d: str) -> DataFrame:
    """The links back that older records get from those that name them, five for each of these at most."""
    m = memories(spark, d)
    named = m.select("id", "created_at", F.explode(F.array_distinct(F.array_compact(F.array("parent_id", "supersedes_id")))).alias("older"))
    old = m.select(F.col("id").alias("older"), F.col("created_at").alias("then"))
    w = named.join(old, "older").where("then < created_at")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("older")))
    first = w.withColumn("nth", nth).where("nth <= 5")
    return first.groupBy(F.col("older").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("back"))


@query(f"WITH {NOTES_SQL}, c AS (SELECT id, unnest(regexp_extract_all(text, '\\d{{1,3}} U\\.S\\.C\\. \\d+|Section \\d+[A-Z]?|UCC \\d+-\\d+')) AS citation FROM note), s AS (SELECT id, len(regexp_extract_all(text, '[.!?]( |$)')) AS claims FROM note) SELECT citation, count(*) AS notes, min(c.id) AS first_id, CAST(sum(claims) AS BIGINT) AS claims FROM c JOIN s ON c.id = s.id GROUP BY citation")
def claims_by_citation(spark: SparkSession, d: str) -> DataFrame:
    """What is cited, in how many notes, and how many sentences stand beside it."""
    found = F.regexp_extract_all("text", F.lit(r"\d{1,3} U\.S\.C\. \d+|Section \d+[A-Z]?|UCC \d+-\d+"), F.lit(0))
    rows = notes(spark, d).select("id", F.size(F.regexp_extract_all("text", F.lit("[.!?]( |$)"), F.lit(0))).alias("n"), F.explode(found).alias("citation"))
    return rows.groupBy("citation").agg(F.count(F.lit(1)).alias("notes"), F.min("id").alias("first_id"), F.sum("n").alias("claims"))


@query(f"WITH {MEMORIES_SQL}, h AS (SELECT id, context_tag, content, row_number() OVER (ORDER BY md5('seed:' || id), id) AS place FROM mem), k AS (SELECT *, CASE WHEN context_tag = '@chef-only' THEN 'sensitive' WHEN len(content) < 100 THEN 'short' ELSE 'kept' END AS reason FROM h) SELECT reason, count(*) AS n, min(place) AS first_place FROM k GROUP BY reason")
def sample_reasons(spark: SparkSession, d: str) -> DataFrame:
    """In a seeded order of all records, how many can be sampled, how many are sensitive or too short, and where each kind comes first.

    The place of the first of a kind is the number of records before it: counted, not sorted out of one task.
    """
    m = memories(spark, d).select("id", F.md5(F.concat(F.lit("seed:"), F.col("id").cast("string"))).alias("h"), F.when(F.col("context_tag") == "@chef-only", "sensitive").when(F.char_length("content") < 100, "short").otherwise("kept").alias("reason"))
    first = m.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "id")).alias("f"))
    before = m.join(F.broadcast(first.select(F.col("reason").alias("of"), "f")), F.struct("h", "id") <= F.col("f"))  # three rows
    return before.groupBy(F.col("of").alias("reason")).agg(F.count(F.lit(1)).alias("first_place")).join(first.select("reason", "n"), "reason").select("reason", "n", "first_place")


@query("WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS gone FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT n, gone, CASE WHEN n < 20 THEN 'too few to judge' WHEN gone > 0.20 * n THEN 'refused' ELSE 'allowed' END AS verdict FROM t")
def prune_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sweep that would remove the records without a label may run."""
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    t = table(spark, d, "documents").join(known, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("gone"))
    return t.select("n", "gone", F.when(F.col("n") < LEAST_JUDGED, "too few to judge").when(F.col("gone") > MOST_REMOVED * F.col("n"), "refused").otherwise("allowed").alias("verdict"))


@query("SELECT p_name AS name, count(DISTINCT p_size % 7) AS stores, count(DISTINCT p_size) AS versions, count(*) AS copies FROM part GROUP BY p_name HAVING count(DISTINCT p_size % 7) > 1 AND count(DISTINCT p_size) > 1")
def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand for several versions in several stores."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct(F.col("p_size") % 7).alias("stores"), F.countDistinct("p_size").alias("versions"), F.count(F.lit(1)).alias("copies"))
    return p.where("stores > 1 and versions > 1")


@query("SELECT o_custkey AS person, coalesce(max(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END), 0) AS trust, count(*) AS orders FROM orders GROUP BY o_custkey")
def person_trust(spark: SparkSession, d: str) -> DataFrame:
    """The trust of everyone who ordered; who is unknown has none."""
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_custkey") % 5).alias("trust"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.count(F.lit(1)).alias("orders"))
    return o.join(known, F.col("person") == F.col("c_custkey"), "left").select("person", F.coalesce("trust", F.lit(0)).alias("trust"), "orders")


@query(f"WITH {NOTES_SQL}, w AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\\b[A-Z][a-z]{{2,}} [A-Z][a-z]{{2,}}\\b'), lambda x: lower(x)))) AS term FROM note) SELECT term, count(*) AS notes FROM w GROUP BY term")
def protected_terms(spark: SparkSession, d: str) -> DataFrame:
    """Names of two words, in lower case, that a correction must leave alone."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{2,} [A-Z][a-z]{2,}\b"), F.lit(0)), lambda x: F.lower(x)))
    return notes(spark, d).select("id", F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("notes"))


@query("WITH r AS (SELECT user_id % 50 AS id, CASE event_type WHEN 'signup' THEN 'armed' WHEN 'click' THEN 'fired' WHEN 'purchase' THEN 'done' ELSE 'pending' END AS state, epoch_us(ts) AS updated_at, event_id % 4 AS fires FROM events) SELECT id, arg_max(state, (updated_at, state = 'done', state)) AS state, max(updated_at) AS updated_at, max(fires) AS fires FROM r GROUP BY id")
def intention_replicas(spark: SparkSession, d: str) -> DataFrame:
    """Copies of intentions on several hosts, merged the same way in any order."""
    state = F.when(F.col("event_type") == "signup", "armed").when(F.col("event_type") == "click", "fired").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    rows = table(spark, d, "events").select((F.col("user_id") % 50).alias("id"), state.alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), (F.col("event_id") % 4).alias("fires"))
    return merged_intentions(rows)


@query(f"WITH RECURSIVE {MEMORIES_SQL}, c AS (SELECT id FROM mem WHERE id % 33 = 4 UNION SELECT m.id FROM mem m JOIN c ON m.parent_id = c.id) SELECT m.id, CASE WHEN m.id % 33 = 4 THEN 'asked' ELSE 'followed' END AS step FROM mem m JOIN c ON m.id = c.id")
def forget_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Records that are to be forgotten, and all that were made from them, over any number of generations."""
    m = memories(spark, d).select("id", "parent_id", (F.col("id") % 33 == 4).alias("asked"))
    gone = front = G.cut(m.where("asked").select("id"))
    while not front.isEmpty():
        front = G.cut(m.join(front.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").join(gone, "id", "left_anti"))
        gone = G.cut(gone.unionAll(front))
    return gone.select("id", F.when(F.col("id") % 33 == 4, "asked").otherwise("followed").alias("step"))


@query("WITH l AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, arg_max(event_type, (ts, event_id)) AS last_status, max(CASE WHEN event_type = 'error' THEN event_id END) AS last_failure FROM l WHERE n <= 20 GROUP BY user_id")
def sync_failures(spark: SparkSession, d: str) -> DataFrame:
    """What failed among the last twenty entries of each log, and how it stands."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = table(spark, d, "events").withColumn("n", n).where("n <= 20")
    bad = F.col("event_type") == "error"
    return last.groupBy("user_id").agg(F.count_if(bad).alias("failures"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.max(F.when(bad, F.col("event_id"))).alias("last_failure"))


@query(f"WITH {MEMORIES_SQL}, a AS (SELECT substring(md5(CAST(id AS VARCHAR)), 1, 12) AS short FROM mem WHERE layer = 'long-term' AND id % 4 = 0) SELECT id, substring(md5(CAST(id AS VARCHAR)), 1, 12) AS short_id FROM mem WHERE substring(md5(CAST(id AS VARCHAR)), 1, 12) NOT IN (SELECT short FROM a)")
def prune_archived(spark: SparkSession, d: str) -> DataFrame:
    """Index rows whose short identifier is not that of an archived record."""
    m = memories(spark, d).select("id", "layer", F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("short_id"))
    return m.join(m.where("layer = 'long-term' and id % 4 = 0").select("short_id"), "short_id", "left_anti").select("id", "short_id")


@query(f"WITH {NOTES_SQL}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM note) SELECT id, string_agg(line, chr(10) ORDER BY n) AS episode, count(*) AS lines, sum(len(line)) > 60 AS truncated FROM (SELECT * FROM l WHERE n BETWEEN 2 AND 4) GROUP BY id".replace("string_agg(line, chr(10) ORDER BY n) AS episode", "substring(string_agg(line, chr(10) ORDER BY n), 1, 60) AS episode").replace("sum(len(line)) > 60", "len(string_agg(line, chr(10) ORDER BY n)) > 60"))
def episode_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines two to four of each note that has them, up to sixty characters, and whether any were cut off."""
    part = F.slice(F.split("text", "\n"), 2, 3)
    rows = notes(spark, d).select("id", part.alias("p")).where(F.size("p") > 0).withColumn("all", F.array_join("p", "\n"))
    return rows.select("id", F.substring("all", 1, 60).alias("episode"), F.size("p").cast("long").alias("lines"), (F.char_length("all") > 60).alias("truncated"))
