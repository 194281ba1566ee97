"""Queries that put records together: anchors, pages, briefs, observations, maps of contents, and what is left out of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rerank as K
from ..operators import retrieval as R
from ..sources.tables import MEMORIES_SQL, NOTES_SQL, memories, notes, table
from . import extract, judging, ranking, search

REGISTERED: dict = {}
#: Weights of an anchor's fields, and of entities and citations that nobody has named before. Fixed values.
ANCHOR_WEIGHTS = {"labels": 3.0, "moment": 2.0, "title": 1.5, "resonance": 1.0}
NEW_ENTITY, NEW_CITATION = 0.12, 0.18
#: Ranks of authorities in the second way of telling them, and what marks a preview that was all that could be saved. Fixed values.
AUTHORITY_RANK = {"statute": 6, "rule": 5, "case": 5, "form": 4, "secondary": 3, "template": 2, "memory": 1}
STUB = "[recovered from SQLite preview"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_SOUGHT = ["cold brass widget", "promo economy bolt", "large gear"]
_FIELDS = {"labels": "p_type", "moment": "p_name", "title": "p_brand", "resonance": "p_container"}


def _sought_sql() -> str:
    return "q AS (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS term FROM (SELECT unnest([" + ", ".join(f"'{q}'" for q in _SOUGHT) + "]) AS query))"


@query(f"""WITH {_sought_sql()}, w AS ({' UNION ALL '.join(f"SELECT p_partkey AS id, unnest(regexp_extract_all(lower({c}), '[a-z0-9]+')) AS term, {w} AS weight FROM part" for c, w in ((_FIELDS[f], w) for f, w in ANCHOR_WEIGHTS.items() if f != 'resonance'))}),
b AS (SELECT id, term, max(weight) AS weight FROM w GROUP BY id, term), d AS (SELECT term, count(*) AS df FROM b GROUP BY term), n AS (SELECT count(*) AS n FROM part),
s AS (SELECT query, id, round(sum(weight * ln(1 + n / df)), 6) AS score FROM q JOIN b USING (term) JOIN d USING (term), n GROUP BY query, id)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def anchor_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best anchors of three questions: each word counts by how rare it is and by the weightiest field that holds it."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), *(F.col(_FIELDS[f]).alias(f) for f in ANCHOR_WEIGHTS if f != "resonance"))
    asked = spark.createDataFrame([(q, t) for q in _SOUGHT for t in q.split()], "query_id string, term string").distinct()
    words = lambda f: F.regexp_extract_all(F.lower(f), F.lit("[a-z0-9]+"), F.lit(0))
    each = [part.select("id", F.explode(words(f)).alias("term"), F.lit(w).alias("weight")) for f, w in ANCHOR_WEIGHTS.items() if f != "resonance"]
    best = reduce(DataFrame.unionAll, each).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("id", "term").agg(F.max("weight").alias("weight"))  # words of three questions
    df = best.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = float(part.count())
    s = best.join(df, "term").join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.log(1 + n / F.col("df"))), 6).alias("score"))
    return R.top_k(s, 10).select(F.col("query_id").alias("query"), "id", "score", "rank")


@query(f"WITH p AS ({ranking.REGISTERED['procedure_order'][1]}) SELECT query_id, id, place FROM (SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.place) AS place FROM p) WHERE place <= 10")
def finished_page(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of each page after its procedures are in order."""
    page = ranking.procedure_order(spark, d)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return page.select("query_id", "id", place.alias("place")).where("place <= 10")


@query(f"WITH r AS ({ranking.REGISTERED['rare_term_rerank'][1]}), s AS ({search.REGISTERED['decay_scores'][1]}), k AS (SELECT r.query_id, r.id, r.place AS rank, round(pow(greatest(score, 1e-9), 0.15) / r.place, 9) AS key FROM r JOIN s ON r.id = s.id) SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, rank) AS place FROM k")
def chained_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Rare terms first, then how present a record is: one reranker's order is the next one's."""
    first = ranking.rare_term_rerank(spark, d).select("query_id", "id", F.col("place").alias("rank"))
    return K.decay_rerank(first, search.decay_scores(spark, d)).select("query_id", "id", "rank", "place")


@query(f"WITH {MEMORIES_SQL}, k AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM mem WHERE created_at < TIMESTAMP '2024-01-09') SELECT id, (n - 1) // 25 AS page FROM k WHERE n <= 100")
def keyset_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred records before a time, newest first, in pages of twenty-five."""
    first = memories(spark, d).where(F.col("created_at") < F.lit("2024-01-09").cast("timestamp")).orderBy(F.desc("created_at"), "id").limit(100)
    n = F.row_number().over(Window.orderBy(F.desc("created_at"), "id")) - 1
    return first.select("id", F.floor(n / 25).alias("page"))


_RANK_SQL = "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY_RANK.items()) + " END"


@query(f"""WITH {NOTES_SQL}, h AS (SELECT id, lower(name || ' ' || substring(text, 1, 600)) AS h, id % 10 = 9 AS seed FROM note),
t AS (SELECT id, CASE WHEN seed THEN 'memory' WHEN {extract._any(extract.STATUTE, 'h')} THEN 'statute' WHEN {extract._any(extract.RULE, 'h')} THEN 'rule' WHEN {extract._any(extract.CASE_LAW, 'h')} THEN 'case' WHEN {extract._any(extract.FORM, 'h')} THEN 'form' WHEN {extract._any(extract.SECONDARY, 'h')} THEN 'secondary' WHEN {extract._any(extract.TEMPLATE, 'h')} THEN 'template' ELSE 'memory' END AS tier,
  array_to_string(list_filter([{', '.join(f"CASE WHEN contains(h, '{m}') THEN '{m}' END" for m in extract.STATUTE)}], lambda x: x IS NOT NULL)[1:4], ',') AS marks FROM h)
SELECT id, tier, {_RANK_SQL} AS rank, CASE WHEN tier = 'statute' THEN marks ELSE '' END AS signals FROM t""")
def authority_signals(spark: SparkSession, d: str) -> DataFrame:
    """The authority of each note by what it says, its rank, and for statutes the signs of it; every tenth is a seed and no authority."""
    h = F.lower(F.concat_ws(" ", "name", F.substring("text", 1, 600)))
    rows = notes(spark, d).select("id", h.alias("h"), (F.col("id") % 10 == 9).alias("seed"))
    has = lambda ws: reduce(lambda a, b: a | b, (F.col("h").contains(w) for w in ws))
    tier = F.when(F.col("seed"), "memory").when(has(extract.STATUTE), "statute").when(has(extract.RULE), "rule").when(has(extract.CASE_LAW), "case").when(has(extract.FORM), "form").when(has(extract.SECONDARY), "secondary").when(has(extract.TEMPLATE), "template").otherwise("memory")
    marks = F.array_join(F.slice(F.array_compact(F.array(*(F.when(F.col("h").contains(m), m) for m in extract.STATUTE))), 1, 4), ",")
    ranks = F.create_map(*(F.lit(x) for p in AUTHORITY_RANK.items() for x in p))
    return rows.select("id", tier.alias("tier"), marks.alias("marks")).select("id", "tier", F.element_at(ranks, F.col("tier")).alias("rank"), F.when(F.col("tier") == "statute", F.col("marks")).otherwise("").alias("signals"))


_FOUND = r"e AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\b[A-Z][a-z]{2,} [A-Z][a-z]{2,}\b'), lambda x: lower(x)))) AS what, 0.12 AS worth FROM note UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(text, '\d{1,3} U\.S\.C\. \d+|Section \d+[A-Z]?|UCC \d+-\d+'))), 0.18 FROM note)"


@query(f"WITH {NOTES_SQL}, {_FOUND}, f AS (SELECT what, min(id) AS first FROM e GROUP BY what) SELECT id, count(*) AS named, round(least(1.0, coalesce(sum(worth) FILTER (WHERE id = first), 0)), 3) AS score FROM e JOIN f USING (what) GROUP BY id")
def novelty_of_notes(spark: SparkSession, d: str) -> DataFrame:
    """What each note names, and how new it is: names and citations that no earlier note has count."""
    n = notes(spark, d)
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{2,} [A-Z][a-z]{2,}\b"), F.lit(0)), lambda x: F.lower(x)))
    cited = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d{1,3} U\.S\.C\. \d+|Section \d+[A-Z]?|UCC \d+-\d+"), F.lit(0)))
    e = n.select("id", F.explode(names).alias("what"), F.lit(NEW_ENTITY).alias("worth")).unionAll(n.select("id", F.explode(cited).alias("what"), F.lit(NEW_CITATION).alias("worth")))
    first = e.groupBy("what").agg(F.min("id").alias("first"))
    new = F.coalesce(F.sum(F.when(F.col("id") == F.col("first"), F.col("worth"))), F.lit(0.0))
    return e.join(first, "what").groupBy("id").agg(F.count(F.lit(1)).alias("named"), F.round(F.least(F.lit(1.0), new), 3).alias("score"))


@query(f"WITH {MEMORIES_SQL}, c AS (SELECT id, CASE WHEN id % 25 = 3 THEN substring(content, 1, 40) || chr(10) || chr(10) || '{STUB} — full content lost]' ELSE content END AS content, id % 50 = 7 AS flagged FROM mem) SELECT id, CASE WHEN flagged THEN 'flag' ELSE 'content' END AS by FROM c WHERE flagged OR contains(content, '{STUB}')".replace(" AS by FROM", " AS told_by FROM"))
def stub_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of which only a preview is left, by their flag or by their text; some are made so here."""
    content = F.when(F.col("id") % 25 == 3, F.concat(F.substring("content", 1, 40), F.lit(f"\n\n{STUB} — full content lost]"))).otherwise(F.col("content"))
    rows = memories(spark, d).select("id", content.alias("content"), (F.col("id") % 50 == 7).alias("flagged"))
    return rows.where(F.col("flagged") | F.col("content").contains(STUB)).select("id", F.when(F.col("flagged"), "flag").otherwise("content").alias("told_by"))


_OBS = """o AS (SELECT tag, id, substring(title, 1, 16) AS quote, context_tag, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, id) AS nth FROM (SELECT unnest(tags) AS tag, * FROM mem) WHERE tag IS NOT NULL)"""


@query(f"""WITH {MEMORIES_SQL}, {_OBS}, k AS (SELECT tag, count(*) AS n, count(*) FILTER (WHERE context_tag IN ('@public', '@community')) AS seen, string_agg('"' || quote || '" (memory ' || id || ')', chr(10) ORDER BY nth) FILTER (WHERE context_tag IN ('@public', '@community')) AS quotes FROM o WHERE nth <= 5 GROUP BY tag)
SELECT tag, n, seen, tag || ' connects ' || seen || ' memories' || coalesce(chr(10) || chr(10) || quotes, '') AS text FROM k""")
def observation_texts(spark: SparkSession, d: str) -> DataFrame:
    """An observation for each tag over its five newest records, as a community reader may see it: hidden quotes are out and not counted."""
    t = memories(spark, d).select(F.explode("tags").alias("tag"), "id", F.substring("title", 1, 16).alias("quote"), "created_at", F.col("context_tag").isin("@public", "@community").alias("seen")).where("tag is not null")
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), "id"))
    first = t.withColumn("nth", nth).where("nth <= 5")
    line = F.concat(F.lit('"'), F.col("quote"), F.lit('" (memory '), F.col("id").cast("string"), F.lit(")"))
    k = first.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("seen").alias("seen"), F.array_sort(F.collect_list(F.when(F.col("seen"), F.struct("nth", line.alias("line"))))).alias("q"))
    quotes = F.when(F.size("q") > 0, F.concat(F.lit("\n\n"), F.array_join("q.line", "\n"))).otherwise("")
    return k.select("tag", "n", "seen", F.concat(F.col("tag"), F.lit(" connects "), F.col("seen").cast("string"), F.lit(" memories"), quotes).alias("text"))


@query(f"""WITH {MEMORIES_SQL}, {_OBS}, k AS (SELECT tag, list_sort(list({{'id': id, 'quote': quote}})) AS evidence FROM o WHERE nth <= 3 GROUP BY tag) SELECT tag, '[' || array_to_string(list_transform(evidence, lambda e: '{{"id":' || e.id || '}}'), ',') || ']' AS payload, len(evidence) AS n FROM k""")
def observation_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The sorted evidence of each observation as JSON, read back once to count it."""
    t = memories(spark, d).select(F.explode("tags").alias("tag"), "id", "created_at").where("tag is not null")
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), "id"))
    k = t.withColumn("nth", nth).where("nth <= 3").groupBy("tag").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id")))).alias("payload"))
    return k.select("tag", "payload", F.size(F.from_json("payload", "array<struct<id: bigint>>")).cast("long").alias("n"))


@query("WITH t AS (SELECT user_id, event_id, event_type, value, ts, event_type = 'purchase' AS bonus FROM events WHERE value IS NOT NULL) SELECT user_id, arg_max(event_id, (value + CASE WHEN bonus THEN 0.5 ELSE 0 END, event_type, ts, event_id)) AS strongest, round(max(value + CASE WHEN bonus THEN 0.5 ELSE 0 END), 6) AS strength FROM t GROUP BY user_id")
def strongest_feeling(spark: SparkSession, d: str) -> DataFrame:
    """The strongest of each user's events by value with a bonus, then kind, then time."""
    strength = F.col("value") + F.when(F.col("event_type") == "purchase", 0.5).otherwise(0.0)
    rows = table(spark, d, "events").where("value is not null").select("user_id", F.struct(strength.alias("s"), "event_type", "ts", "event_id").alias("key"))
    return rows.groupBy("user_id").agg(F.max("key").alias("k")).select("user_id", F.col("k.event_id").alias("strongest"), F.round("k.s", 6).alias("strength"))


@query(f"WITH q AS ({judging.REGISTERED['quadrant_classify'][1]}), m AS (SELECT doc_id AS id, trim(substring(coalesce(text, ''), 1, 20), ' ') AS title, (doc_id * 7 % 101) / 10.0 AS intensity FROM documents), r AS (SELECT quadrant, m.id, title, count(*) OVER (PARTITION BY quadrant) AS n, row_number() OVER (PARTITION BY quadrant ORDER BY intensity DESC, m.id) AS nth FROM q JOIN m ON q.id = m.id) SELECT quadrant, any_value(n) AS n, '# ' || quadrant || chr(10) || string_agg('- [[' || id || ']] ' || title, chr(10) ORDER BY nth) AS page FROM r WHERE nth <= 10 GROUP BY quadrant")
def quadrant_pages(spark: SparkSession, d: str) -> DataFrame:
    """A map of contents of each quadrant in Markdown, with its ten most intense records."""
    m = memories(spark, d).select("id", F.trim(F.substring("title", 1, 20)).alias("title"), "intensity").join(judging.quadrant_classify(spark, d), "id")
    n = m.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("quadrant").orderBy(F.desc("intensity"), "id"))
    line = F.concat(F.lit("- [["), F.col("id").cast("string"), F.lit("]] "), F.col("title"))
    first = m.withColumn("nth", nth).where("nth <= 10").groupBy("quadrant").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("ls"))
    return first.join(n, "quadrant").select("quadrant", "n", F.concat(F.lit("# "), F.col("quadrant"), F.lit("\n"), F.array_join("ls.line", "\n")).alias("page"))


@query(f"WITH {NOTES_SQL}, p AS (SELECT a.id, b.id AS other, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]{{3,}}')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{{3,}}')) AS y FROM note a JOIN note b ON b.id IN (a.id - 12, a.id - 24, a.id - 36)), s AS (SELECT id, other, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS likeness FROM p) SELECT id, arg_max(other, (likeness, -other)) AS best, max(likeness) AS likeness FROM s GROUP BY id")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """The most alike of the three notes of a kind before each."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    n = notes(spark, d).select("id", words.alias("x"))
    asked = n.select("id", "x", F.explode(F.array(F.col("id") - 12, F.col("id") - 24, F.col("id") - 36)).alias("other"))
    s = F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6)
    rows = asked.join(n.select(F.col("id").alias("other"), F.col("x").alias("y")), "other").select("id", "other", s.alias("likeness"))
    return rows.groupBy("id").agg(F.max_by("other", F.struct("likeness", -F.col("other"))).alias("best"), F.max("likeness").alias("likeness"))


@query(f"{search._ARMS_SQL}, c AS (SELECT query_id, count(*) FILTER (WHERE arm = 'lexical') AS lexical, count(*) FILTER (WHERE arm = 'semantic') AS semantic, count(DISTINCT id) AS fused FROM arms GROUP BY query_id) SELECT q.query_id, coalesce(lexical, 0) AS lexical, coalesce(semantic, 0) AS semantic, coalesce(fused, 0) AS fused, CASE WHEN coalesce(lexical, 0) > 0 AND coalesce(semantic, 0) > 0 THEN 'both' WHEN coalesce(lexical, 0) > 0 THEN 'lexical' WHEN coalesce(semantic, 0) > 0 THEN 'semantic' ELSE 'none' END AS contributing FROM question q LEFT JOIN c ON q.query_id = c.query_id")
def contributing_arms(spark: SparkSession, d: str) -> DataFrame:
    """For each question, what each arm gave, how many records that makes, and which arms had an opinion."""
    of = lambda a: F.count_if(F.col("arm") == a).alias(a)
    c = search._arms(spark, d).groupBy("query_id").agg(of("lexical"), of("semantic"), F.countDistinct("id").alias("fused"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    rows = search._questions(spark, d).select("query_id").join(c, "query_id", "left").select("query_id", *map(zero, ("lexical", "semantic", "fused")))
    lex, sem = F.col("lexical") > 0, F.col("semantic") > 0
    return rows.withColumn("contributing", F.when(lex & sem, "both").when(lex, "lexical").when(sem, "semantic").otherwise("none"))
