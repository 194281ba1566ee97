"""Queries of the retrieval arms, their fusion and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import decay, tokens
from ..operators import retrieval as R
from ..sources.tables import MEMORIES_SQL, memories, table

REGISTERED: dict = {}
TOP = 10


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """What both arms are asked: the title of every record whose id is divisible by 20."""
    return memories(spark, d).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("title").alias("text"))


def _lexical(spark: SparkSession, d: str, k: int = TOP) -> DataFrame:
    found = R.bm25(_questions(spark, d), memories(spark, d), {"content": F.col("content")}, k, own=True)
    return R.top_k(found, k).select("query_id", "id", "score", "rank")


def _semantic(spark: SparkSession, d: str, k: int = TOP) -> DataFrame:
    """The same questions, by hashed embeddings of titles and contents."""
    return R.top_k(R.hashed_nearest(_questions(spark, d), memories(spark, d), F.col("content"), k), k).select("query_id", "id", "score", "rank")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query vectors, those whose id is divisible by 20, and all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), v


def _neighbours(spark: SparkSession, d: str, k: int = TOP) -> DataFrame:
    return R.top_k(R.nearest(*_vectors(spark, d), k), k).select("query_id", "id", "score", "rank")


def _arms(spark: SparkSession, d: str) -> DataFrame:
    lex, sem = _lexical(spark, d), _semantic(spark, d)
    return lex.select("query_id", F.lit("lexical").alias("arm"), "id", "rank").unionAll(sem.select("query_id", F.lit("semantic").alias("arm"), "id", "rank"))


def _bm25_sql(field: str, name: str) -> str:
    return f"""{name}_w AS (SELECT id, regexp_extract_all(lower({field}), '[a-z0-9]{{2,}}') AS ws FROM mem),
{name}_size AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM {name}_w),
{name}_tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ws) AS len, unnest(ws) AS term FROM {name}_w) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM asked JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_size GROUP BY query_id, id)"""


_BENCHMARK = "asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS term FROM benchmark)"
_ASKED = "question AS (SELECT id AS query_id, title AS text FROM mem WHERE id % 20 = 0), asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM question)"
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
_COS = "sum(CAST(a AS DOUBLE) * b) / nullif(sqrt(sum(CAST(a AS DOUBLE) * a)) * sqrt(sum(CAST(b AS DOUBLE) * b)), 0)"
_KNN = f"""scored AS (SELECT query_id, id, round({_COS}, 6) AS score FROM
  (SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(unnest(q.embedding) AS DOUBLE) AS a, CAST(unnest(v.embedding) AS DOUBLE) AS b
   FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) GROUP BY query_id, id)"""
_HASHED = f"""hv AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM
  (SELECT id, CAST('0x' || substr(md5(term), 1, 6) AS INTEGER) % {R.BUCKETS} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]{{2,}}')) AS term FROM mem) GROUP BY 1, 2)),
hq AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS x FROM
  (SELECT query_id, CAST('0x' || substr(md5(term), 1, 6) AS INTEGER) % {R.BUCKETS} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term FROM question) GROUP BY 1, 2)),
hs AS (SELECT query_id, id, round(sum(hq.x * hv.x), 6) AS score FROM hq JOIN hv ON hq.bucket = hv.bucket AND id <> query_id GROUP BY query_id, id)"""
_LEX_SQL = f"WITH {MEMORIES_SQL}, {_ASKED}, {_bm25_sql('content', 'lex')}, lexical AS (SELECT query_id, id, score, {_TOP} FROM lex WHERE id <> query_id QUALIFY rank <= {TOP}), {_HASHED}, semantic AS (SELECT query_id, id, score, {_TOP} FROM hs QUALIFY rank <= {TOP}),"
_ARMS_SQL = f"{_LEX_SQL} arms AS (SELECT query_id, 'lexical' AS arm, id, rank FROM lexical UNION ALL SELECT query_id, 'semantic', id, rank FROM semantic), fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best, count(*) AS n_arms FROM arms GROUP BY query_id, id)"


@query(f"WITH {MEMORIES_SQL}, {_BENCHMARK}, {_bm25_sql('content', 'lex')} SELECT query_id, id, score, {_TOP} FROM lex QUALIFY rank <= {TOP}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents of each benchmark text by Okapi BM25."""
    m = memories(spark, d)
    return R.top_k(R.bm25(_benchmark(spark, d), m, {"content": F.col("content")}, TOP), TOP).select("query_id", "id", "score", "rank")


@query(f"""WITH {MEMORIES_SQL.replace('FROM documents)', ", coalesce(lang, '') || ' ' || coalesce(source, '') AS label FROM documents)")}, {_BENCHMARK}, {', '.join(_bm25_sql(f, n) + f", {n}_t AS (SELECT query_id, id, term, {w} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)) AS s FROM asked JOIN {n}_tf USING (term) JOIN {n}_df USING (term), {n}_size)" for f, n, w in (('title', 'ti', 8.0), ('content', 'co', 1.0), ('label', 'la', 4.0)))},
u AS (SELECT * FROM ti_t UNION ALL SELECT * FROM co_t UNION ALL SELECT * FROM la_t), lex AS (SELECT query_id, id, round(sum(s), 5) AS score, count(DISTINCT term) AS n FROM u GROUP BY query_id, id),
a AS (SELECT query_id, count(*) AS terms FROM asked GROUP BY query_id)
SELECT l.query_id, l.id, score, n = terms AS all_terms, row_number() OVER (PARTITION BY l.query_id ORDER BY n = terms DESC, score DESC, l.id) AS rank FROM lex l JOIN a ON l.query_id = a.query_id QUALIFY rank <= {TOP}""")
def bm25_field_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Titles, contents and labels weighted; records with all terms of the query go first."""
    m = memories(spark, d).withColumn("label", F.concat_ws(" ", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("")), F.coalesce("source", F.lit(""))))
    found = R.bm25(_benchmark(spark, d), m, {f: F.col(f) for f in R.FIELD_WEIGHTS}, TOP, R.FIELD_WEIGHTS, digits=5, whole=True)
    w = Window.partitionBy("query_id").orderBy(F.desc("all_terms"), F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


@query("SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each term occurs."""
    m = memories(spark, d)
    return m.select("id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


_WORDS = "release", "the", "of"


@query(f"""WITH {MEMORIES_SQL}, s AS (SELECT id, {' + '.join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in _WORDS)} AS matched FROM mem)
SELECT id, matched FROM s WHERE matched > 0 AND (matched = 3 OR (SELECT max(matched) FROM s) < 3)""")
def like_and_or_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Records with all words; only if there are none, those with any."""
    s = memories(spark, d).select("id", sum((F.lower("content").contains(w).cast("int") for w in _WORDS[1:]), F.lower("content").contains(_WORDS[0]).cast("int")).alias("matched")).where("matched > 0")
    most = s.agg(F.max("matched").alias("most"))
    return s.join(F.broadcast(most), (F.col("matched") == len(_WORDS)) | (F.col("most") < len(_WORDS))).select("id", "matched")


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN contains(lower(title), 'the') THEN 3 WHEN contains(lower(content), 'the') THEN 2 ELSE 1 END AS score FROM mem WHERE contains(lower(title), 'the') OR contains(lower(content), 'the') OR contains(source, 'the')")
def substring_rank(spark: SparkSession, d: str) -> DataFrame:
    """Where a phrase occurs: title 3, content 2, tags 1."""
    has = lambda c: F.lower(c).contains("the")
    return memories(spark, d).where(has("title") | has("content") | F.col("source").contains("the")).select("id", F.when(has("title"), 3).when(has("content"), 2).otherwise(1).alias("score"))


@query(f"WITH {_KNN} SELECT query_id, id, score, {_TOP} FROM scored QUALIFY rank <= {TOP}")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every twentieth."""
    return _neighbours(spark, d)


#: A cosine that about one in a thousand pairs of the vectors of `embeddings` reaches.
CLOSE = 0.35


@query(f"WITH {_KNN} SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS best FROM scored WHERE score >= {CLOSE}")
def find_similar_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Vectors above a threshold, with the best score of their query."""
    s = R.nearest(*_vectors(spark, d), least=CLOSE)
    return s.withColumn("best", F.max("score").over(Window.partitionBy("query_id")))


@query(f"{_ARMS_SQL} SELECT query_id, id, score, best, n_arms FROM fused")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of both arms, with provenance."""
    return R.rrf(_arms(spark, d))


@query(f"{_ARMS_SQL} SELECT query_id, id, score, best, n_arms, row_number() OVER (PARTITION BY query_id ORDER BY best, score DESC, id) AS rank FROM fused QUALIFY rank <= {TOP}")
def rank_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Ranks interleaved."""
    return R.interleave(_arms(spark, d), TOP)


@query(f"""{_ARMS_SQL}, p AS (SELECT query_id, id, rank AS pin FROM semantic WHERE rank <= 4)
SELECT f.query_id, f.id, score, best, n_arms, pin, row_number() OVER (PARTITION BY f.query_id ORDER BY pin NULLS LAST, best, score DESC, f.id) AS rank FROM fused f LEFT JOIN p ON f.query_id = p.query_id AND f.id = p.id QUALIFY rank <= {TOP}""")
def pinned_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The semantic arm's first four lead."""
    return R.pinned(_arms(spark, d), "semantic", 4, TOP)


@query(f"""{_LEX_SQL[:-1]} SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.id, s.id) AS id, round(coalesce(2.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9) AS score
FROM lexical l FULL JOIN semantic s ON l.query_id = s.query_id AND l.id = s.id""")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings, vectors with twice the weight."""
    return R.rrf(_arms(spark, d), {"semantic": 2.0, "lexical": 1.0}).select("query_id", "id", "score")


_SCALE = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query(f"""{_LEX_SQL} a AS (SELECT query_id, id, {_SCALE} AS x FROM semantic WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, id, {_SCALE} AS y FROM lexical WINDOW w AS (PARTITION BY query_id))
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(0.6 * coalesce(x, 0) + 0.4 * coalesce(y, 0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id""")
def linear_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Scaled scores blended with alpha 0.6."""
    return R.linear_blend(_semantic(spark, d), _lexical(spark, d), 0.6)


@query(f"""{_ARMS_SQL}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY best, score DESC, id) AS rank FROM fused),
c AS (SELECT query_id, r.id, rank, tier, tier IN ('web', 'self-generated') AS capped FROM r JOIN mem ON r.id = mem.id),
n AS (SELECT *, capped AND row_number() OVER (PARTITION BY query_id, capped ORDER BY rank) > 2 AS spare FROM c),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY spare, rank) <= 5)
SELECT query_id, id, rank, tier, spare, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k""")
def tier_cap(spark: SparkSession, d: str) -> DataFrame:
    """Five records a query, at most two of web and generated ones while others are there."""
    ranked = R.interleave(_arms(spark, d), 1 << 30).join(memories(spark, d).select("id", "tier"), "id").select("query_id", "id", "rank", "tier")
    return R.tier_cap(ranked, F.col("tier").isin("web", "self-generated"), 5)


_NOW = "2024-03-01 00:00:00"


@query(f"""WITH {MEMORIES_SQL}, a AS (SELECT id, CASE WHEN layer = 'long-term' THEN 120.0 ELSE 30.0 END AS half, greatest(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(created_at), 0) / 86400e6 AS age, intensity / 10.0 AS i, access_count FROM mem)
SELECT id, round(greatest(pow(0.5, age / half), CASE WHEN least(i, 1) >= 0.5 THEN 0.15 ELSE 0 END) * (1 + ln(1 + access_count)) * (1 + least(i, 1)), 6) AS score FROM a""")
def decay_scores(spark: SparkSession, d: str) -> DataFrame:
    """How present each record is at a fixed time."""
    c = F.col
    return memories(spark, d).select("id", F.round(decay(c("layer"), c("created_at"), F.lit(None).cast("timestamp"), c("access_count"), c("intensity"), F.lit(_NOW).cast("timestamp")), 6).alias("score"))


_REL = "semantic AS (SELECT query_id, s.id, rank, q.label = v.label AS hit FROM (SELECT query_id, id, " + _TOP + f" FROM scored QUALIFY rank <= {TOP}) s JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = s.id)"


@query(f"""WITH {_KNN}, {_REL}, m AS (SELECT query_id, count(*) FILTER (WHERE hit) / {TOP}.0 AS p, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS rr, coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) AS dcg, count(*) FILTER (WHERE hit) AS n FROM semantic GROUP BY query_id)
SELECT query_id, round(p, 6) AS precision_at_k, round(rr, 6) AS reciprocal_rank, CASE WHEN n = 0 THEN 0.0 ELSE round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, n + 1)]), 6) END AS ndcg FROM m""")
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Precision at 10, reciprocal rank and nDCG over retrieved hits; an equal label is relevant."""
    e = table(spark, d, "embeddings")
    hit = (F.col("a") == F.col("b")).cast("int")
    rows = _neighbours(spark, d).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    n = F.sum(hit)
    m = rows.groupBy("query_id").agg(n.alias("n"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"), F.sum(hit / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return m.select("query_id", F.round(F.col("n") / float(TOP), 6).alias("precision_at_k"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.col("dcg") / ideal, 6)).alias("ndcg"))


@query(f"{_LEX_SQL[:-1]} SELECT query_id, count(*) AS n_results, count(*) FILTER (WHERE context_tag NOT IN ('@public', '@community')) AS leaks FROM lexical JOIN mem ON lexical.id = mem.id GROUP BY query_id")
def leak_count(spark: SparkSession, d: str) -> DataFrame:
    """How many unfiltered results a community reader should not see."""
    seen = _lexical(spark, d).join(memories(spark, d).select("id", "context_tag"), "id")
    return seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.count_if(~F.col("context_tag").isin("@public", "@community")).alias("leaks"))


@query(f"""WITH {MEMORIES_SQL}, c AS (SELECT id, layer, len(content) // 4 + 1 AS cost, sum(len(content) // 4 + 1) OVER (PARTITION BY layer ORDER BY intensity DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM mem)
SELECT id, layer, cost, CAST(used AS BIGINT) AS used FROM c WHERE used <= 20000""")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """In each layer, the strongest records until their estimated tokens pass a budget.

    Costs are summed for each strength first; only the rows of strengths that begin within the budget are put in order.
    """
    cost = (F.floor(F.char_length("content") / 4) + 1).cast("long")
    rows = memories(spark, d).select("id", "layer", "intensity", cost.alias("cost"))
    sums = rows.groupBy("layer", "intensity").agg(F.sum("cost").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("layer").orderBy(F.desc("intensity")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).where("before < 20000").select("layer", "intensity", "before")
    own = F.sum("cost").over(Window.partitionBy("layer", "intensity").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(starts, ["layer", "intensity"]).select("id", "layer", "cost", (F.col("before") + own).alias("used")).where("used <= 20000")
