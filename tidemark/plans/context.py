"""Queries that prepare what a reader sees: listings, scores, briefs, titles, snippets, cleaned questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import LEVELS, level, tokens, valid_at
from ..functions.timewords import time_window
from ..sources.tables import MEMORIES_SQL, NOTES_SQL, memories, notes, table
from . import extract, search

REGISTERED: dict = {}
_NOW = "2024-02-05 00:00:00"
#: How much a source of each authority weighs. Fixed values.
AUTHORITY = {"statute": 1.0, "rule": 0.95, "case": 0.92, "form": 0.82, "secondary": 0.7, "template": 0.45, "memory": 0.35}
#: Labels of sources by the tier that they have, and what the labels of web sources begin with. Fixed values.
USER_SOURCES = ["manual", "mcp", "cli", "seed", "telegram", "notion", "convo", "hook", "shared"]
TOOL_SOURCES = ["tool", "tool-output", "command", "shell", "task-pack"]
GENERATED_SOURCES = ["journal-synthesis", "dreaming-engine", "consolidation", "claude-code-hook", "mcp:memory_save_session", "mcp:memory_pre_compact", "observation"]
WEB_STARTS = ["web", "http", "fetch", "browser", "search"]
#: What asks how something is done, and what asks about failures. Fixed values.
HOWTO = r"(?i)\b(how\s+(do|can|should|to|would)\b|steps?\s+(to|for)\b|procedure|runbook|instructions?\s+(to|for)|way\s+to|recover|restore|fix)"
FAILURE = r"(?i)\b(fail\w*|warning|avoid|mistake|went\s+wrong|broke\w*|should\s+i|shouldn'?t|don'?t|do\s+not|why\s+did|didn'?t\s+work|not\s+work\w*|risk\w*|danger\w*)\b"
#: Words that deny. Fixed values.
NEGATIONS = ["never", "not", "no", "without", "except", "cannot", "none", "nor", "neither"]
#: Parts of a sender's name that tell of an assistant. Fixed values.
ASSISTANTS = ["bot", "gpt", "claude", "gemini", "llama", "assistant", "lumina", "copilot", "ai", "opus", "sonnet", "haiku"]
#: Lengths of a short question, a cleaned one, a title that is derived, and a snippet. Fixed values.
SHORT_QUERY, CLEAN_QUERY, TITLE, SNIPPET = 200, 500, 80, 160


def _is(word: str):
    return lambda x: x == word


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


@query(f"""WITH {MEMORIES_SQL} SELECT id, layer, created_at FROM mem WHERE layer = 'mid-term' AND list_contains(tags, 'en') AND created_at <= TIMESTAMP '{_NOW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_NOW}') AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-02-04' ORDER BY created_at DESC, id LIMIT 50""")
def filtered_listing(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty records of a layer with a tag that hold at a time and were made within bounds."""
    m, t = memories(spark, d), lambda s: F.lit(s).cast("timestamp")
    kept = m.where((F.col("layer") == "mid-term") & F.array_contains("tags", "en") & valid_at(t(_NOW), F.col("created_at"), F.col("valid_to")) & (F.col("created_at") >= t("2024-01-05")) & (F.col("created_at") < t("2024-02-04")))
    return kept.orderBy(F.desc("created_at"), "id").limit(50).select("id", "layer", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"WITH {MEMORIES_SQL}, s AS (SELECT id, title, intensity, row_number() OVER (PARTITION BY lower(trim(title, ' ')) ORDER BY intensity DESC, id) AS nth FROM mem WHERE intensity >= 7 AND NOT coalesce(list_contains(tags, 'src1'), false)) SELECT id, intensity FROM s WHERE nth = 1 ORDER BY intensity DESC, id LIMIT 60")
def strongest_records(spark: SparkSession, d: str) -> DataFrame:
    """The sixty most intense records without an excluded tag, one for each title whatever its case."""
    m = memories(spark, d).where((F.col("intensity") >= 7) & ~F.coalesce(F.array_contains("tags", "src1"), F.lit(False)))
    best = m.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.max(F.struct("intensity", (-F.col("id")).alias("down"))).alias("b"))
    return best.select((-F.col("b.down")).alias("id"), F.col("b.intensity").alias("intensity")).orderBy(F.desc("intensity"), "id").limit(60)


_WEIGHT_SQL = "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY.items()) + " END"


@query(f"WITH t AS ({extract.REGISTERED['authority_tier'][1]}) SELECT tier, CAST({_WEIGHT_SQL} AS DOUBLE) AS weight, count(*) AS n, row_number() OVER (ORDER BY {_WEIGHT_SQL} DESC, tier) AS place FROM t GROUP BY tier")
def authority_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many records have each authority, the weightiest first; only tiers, already counted, are put in order."""
    weights = F.create_map(*(F.lit(x) for p in AUTHORITY.items() for x in p))
    n = extract.authority_tier(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.element_at(weights, F.col("tier")))
    return n.select("tier", "weight", "n", F.row_number().over(Window.orderBy(F.desc("weight"), "tier")).alias("place"))


_TERMS = ["the", "release", "then", "data"]


@query(f"""WITH {MEMORIES_SQL}, t AS ({extract.REGISTERED['authority_tier'][1].replace('WITH ' + MEMORIES_SQL + ', h AS', 'WITH h AS')}),
s AS (SELECT m.id, least(1.0, ({' + '.join(f"0.4 * CAST(contains(lower(title), '{w}') AS INT) + 0.1 * CAST(contains(lower(content), '{w}') AS INT)" for w in _TERMS)}) / {len(_TERMS)}) AS words, CAST({_WEIGHT_SQL.replace('CASE tier', 'CASE t.tier')} AS DOUBLE) AS authority,
  pow(0.5, floor((epoch_us(TIMESTAMP '{_NOW}') - epoch_us(created_at)) / 86400e6) / CASE layer WHEN 'short-term' THEN 7 WHEN 'mid-term' THEN 30 ELSE 365 END) AS fade FROM mem m JOIN t ON m.id = t.id WHERE {' OR '.join(f"contains(lower(title || ' ' || content), '{w}')" for w in _TERMS)})
SELECT id, round(0.35 * words + 0.30 * authority + 0.20 * fade + 0.15, 6) AS score, row_number() OVER (ORDER BY round(0.35 * words + 0.30 * authority + 0.20 * fade + 0.15, 6) DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 10""")
def deep_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten best records for a question by the words they hold, their authority and their age."""
    held = lambda c, w: F.lower(c).contains(w).cast("int")
    words = F.least(F.lit(1.0), reduce(lambda a, b: a + b, (0.4 * held("title", w) + 0.1 * held("content", w) for w in _TERMS)) / len(_TERMS))
    weights = F.create_map(*(F.lit(x) for p in AUTHORITY.items() for x in p))
    half = F.when(F.col("layer") == "short-term", 7).when(F.col("layer") == "mid-term", 30).otherwise(365)
    age = F.floor((F.unix_micros(F.lit(_NOW).cast("timestamp")) - F.unix_micros("created_at")) / 86_400e6)
    m = memories(spark, d).where(_any(F.lower(F.concat_ws(" ", "title", "content")), _TERMS)).select("id", words.alias("words"), F.pow(F.lit(0.5), age / half).alias("fade"))
    s = m.join(extract.authority_tier(spark, d), "id").select("id", F.round(0.35 * F.col("words") + 0.30 * F.element_at(weights, F.col("tier")) + 0.20 * F.col("fade") + 0.15, 6).alias("score"))
    best = s.orderBy(F.desc("score"), "id").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


_KEYWORDS = ["release", "password", "invoice", "token"]
_BUDGET = 120


@query(f"""WITH {MEMORIES_SQL}, k AS (SELECT unnest({_list(_KEYWORDS)}) AS word), h AS (SELECT word, id, intensity, title, content, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN contains(lower(title), word) THEN 0 ELSE 1 END, intensity DESC, id) - 1 AS place FROM k JOIN mem ON contains(lower(title), word) OR contains(lower(content), word)),
f AS (SELECT id, round(sum(1.0 / (60 + place)), 9) AS score, max(intensity) AS intensity, any_value(title || ' ' || substring(content, 1, 200)) AS text FROM h WHERE place < 10 GROUP BY id),
c AS (SELECT id, score, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3) AS BIGINT) AS cost, row_number() OVER (ORDER BY score DESC, intensity DESC, id) AS place FROM f),
r AS (SELECT *, CAST(sum(cost) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM c) SELECT id, score, place, cost, used FROM r WHERE used <= {_BUDGET}""")
def auto_context(spark: SparkSession, d: str) -> DataFrame:
    """Ten records for each keyword, fused by rank and cut where their estimated tokens pass a budget: forty rows at most are put in order."""
    m = memories(spark, d)
    hits = [m.where(F.lower("title").contains(w) | F.lower("content").contains(w)).select(F.lit(w).alias("word"), "id", "intensity", F.when(F.lower("title").contains(w), 0).otherwise(1).alias("field"), F.concat_ws(" ", "title", F.substring("content", 1, 200)).alias("text")) for w in _KEYWORDS]
    place = F.row_number().over(Window.partitionBy("word").orderBy("field", F.desc("intensity"), "id")) - 1
    first = reduce(DataFrame.unionAll, hits).withColumn("place", place).where("place < 10")
    f = first.groupBy("id").agg(F.round(F.sum(1.0 / (60 + F.col("place"))), 9).alias("score"), F.max("intensity").alias("intensity"), F.first("text").alias("text"))
    cost = F.floor(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) * 1.3).cast("long")
    c = f.select("id", "score", cost.alias("cost"), F.row_number().over(Window.orderBy(F.desc("score"), F.desc("intensity"), "id")).alias("place"))
    return c.withColumn("used", F.sum("cost").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).where(f"used <= {_BUDGET}").select("id", "score", "place", "cost", "used")


@query(f"""WITH {MEMORIES_SQL}, w AS (SELECT id, regexp_extract_all(lower(title || ' ' || content), '[a-z0-9]+') AS ws FROM mem), g AS (SELECT id, {', '.join(f"len(list_filter(ws, lambda w: w = '{t}')) AS n{i}" for i, t in enumerate(_TERMS))} FROM w)
SELECT id, {' + '.join(f'n{i}' for i in range(len(_TERMS)))} AS hits, {' + '.join(f'CAST(n{i} > 0 AS INT)' for i in range(len(_TERMS)))} AS distinct_hits FROM g WHERE {' + '.join(f'n{i}' for i in range(len(_TERMS)))} > 0 ORDER BY hits DESC, distinct_hits DESC, id LIMIT 20""")
def grep_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Records by how often they hold the words of a question, then by how many of them."""
    w = memories(spark, d).select("id", F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "content")), F.lit("[a-z0-9]+"), F.lit(0)).alias("ws"))
    n = w.select("id", *(F.size(F.filter("ws", _is(t))).alias(f"n{i}") for i, t in enumerate(_TERMS)))
    total = lambda f: reduce(lambda a, b: a + b, (f(F.col(f"n{i}")) for i in range(len(_TERMS))))
    return n.select("id", total(lambda c: c).alias("hits"), total(lambda c: (c > 0).cast("int")).alias("distinct_hits")).where("hits > 0").orderBy(F.desc("hits"), F.desc("distinct_hits"), "id").limit(20)


def clean_question(text: Column) -> Column:
    """A question out of a long prompt: short ones as they are, else the last question, else the last sentence of ten characters, else the end."""
    q = F.regexp_replace(text, r"^\s+|\s+$", "")
    # up to the last question mark, behind the last line or the last sentence before it
    upto = F.regexp_extract(q, r"(?s)^(.*\?)", 1)
    asked = F.trim(F.regexp_extract(upto, r"(?s)(?:^|\n|[.!?] )([^\n]*?\?)$", 1))
    asked = F.trim(F.element_at(F.split(asked, r"[.!?] "), -1))
    sentences = F.filter(F.transform(F.split(q, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.char_length(s) >= 10)
    last = F.try_element_at(sentences, F.lit(-1))
    return (
        F.when(F.char_length(q) <= SHORT_QUERY, q).when(F.char_length(asked) >= 10, F.substring(asked, 1, CLEAN_QUERY))
        .when(last.isNotNull(), F.substring(last, 1, CLEAN_QUERY)).otherwise(F.trim(F.substring(q, -CLEAN_QUERY, CLEAN_QUERY)))
    )


_PROMPT_SQL = "p AS (SELECT id, CASE WHEN id % 3 = 0 THEN repeat('You are a helper of the shop. ', 9) || text ELSE text END AS text FROM note)"


@query(rf"""WITH {NOTES_SQL}, {_PROMPT_SQL}, s AS (SELECT id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: len(x) >= 10) AS xs FROM p)
SELECT id, CASE WHEN len(text) <= {SHORT_QUERY} THEN text WHEN contains(text, '?') THEN list_filter(xs, lambda x: suffix(x, '?'))[-1] ELSE xs[-1] END AS question FROM s""")
def clean_query(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for, out of prompts of which a third have instructions before the question."""
    n = notes(spark, d)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.repeat(F.lit("You are a helper of the shop. "), 9), "text")).otherwise(F.col("text"))
    return n.select("id", clean_question(text).alias("question"))


@query(rf"""WITH {NOTES_SQL}, c AS (SELECT id, list_filter(list_transform(string_split_regex(trim(text), '\s+'), lambda x: array_to_string(regexp_extract_all(x, '[a-zA-Z0-9_]+'), ' ')), lambda x: x <> '')[1:32] AS xs FROM note)
SELECT id, array_to_string(list_transform(xs, lambda x: '"' || x || '"'), ' OR ') AS expression FROM c""")
def match_expression(spark: SparkSession, d: str) -> DataFrame:
    """A question as quoted phrases that no search syntax can break, 32 at most."""
    chunks = F.transform(F.split("text", r"\s+"), lambda x: F.array_join(F.regexp_extract_all(x, F.lit("[a-zA-Z0-9_]+"), F.lit(0)), " "))
    phrases = F.slice(F.filter(chunks, lambda x: x != ""), 1, 32)
    return notes(spark, d).select("id", F.array_join(F.transform(phrases, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ").alias("expression"))


@query(rf"WITH {NOTES_SQL} SELECT id, regexp_matches(text, '{HOWTO.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(text, '{FAILURE.replace(chr(39), chr(39) * 2)}') AS howto, CASE WHEN id % 2 = 0 AND id % 5 = 0 THEN 'WARNING: ' || name ELSE name END AS title FROM note")
def howto_queries(spark: SparkSession, d: str) -> DataFrame:
    """Which notes ask how something is done, and titles that warn of procedures (every second) that failed (every fifth)."""
    failed = (F.col("id") % 2 == 0) & (F.col("id") % 5 == 0)
    return notes(spark, d).select("id", (F.col("text").rlike(HOWTO) & ~F.col("text").rlike(FAILURE)).alias("howto"), F.when(failed, F.concat(F.lit("WARNING: "), "name")).otherwise(F.col("name")).alias("title"))


@query(rf"""WITH {MEMORIES_SQL}, b AS (SELECT id, trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS body, content FROM mem)
SELECT id, CASE WHEN len(body) <= {SNIPPET} THEN body ELSE rtrim(substring(body, 1, {SNIPPET - 3}), ' ') || '...' END AS snippet, CAST(len(content) // 4 AS BIGINT) AS tokens FROM b""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The start of each record on one line, and its estimated tokens."""
    body = F.trim(F.regexp_replace("content", r"[ \t\n\x0B\f\r]+", " "))
    rows = memories(spark, d).select("id", body.alias("body"), "content")
    short = F.when(F.char_length("body") <= SNIPPET, F.col("body")).otherwise(F.concat(F.rtrim(F.substring("body", 1, SNIPPET - 3)), F.lit("...")))
    return rows.select("id", short.alias("snippet"), F.floor(F.char_length("content") / 4).cast("long").alias("tokens"))


@query(rf"""WITH l AS (SELECT doc_id AS id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS xs FROM documents),
c AS (SELECT id, coalesce(xs[1], '') AS line, substring(coalesce(xs[1], ''), 1, {TITLE}) AS cut FROM l),
s AS (SELECT *, len(cut) - strpos(reverse(cut), ' ') AS space FROM c)
SELECT id, CASE WHEN len(line) <= {TITLE} THEN line ELSE rtrim(CASE WHEN contains(cut, ' ') AND space >= {TITLE // 2} THEN substring(cut, 1, space) ELSE cut END, ' .,;:-') END AS title FROM s""")
def derived_titles(spark: SparkSession, d: str) -> DataFrame:
    """A title out of each record's first line that is not empty, cut at a word if that leaves half of the limit."""
    line = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != ""), F.lit(1)), F.lit(""))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), line.alias("line")).withColumn("cut", F.substring("line", 1, TITLE))
    space = TITLE - F.locate(" ", F.reverse("cut"))
    at_word = F.when(F.col("cut").contains(" ") & (space >= TITLE // 2), F.substring(F.col("cut"), F.lit(1), space.cast("int"))).otherwise(F.col("cut"))
    return rows.select("id", F.when(F.char_length("line") <= TITLE, F.col("line")).otherwise(F.rtrim(at_word, F.lit(" .,;:-"))).alias("title"))


@query(r"""WITH s AS (SELECT doc_id AS id, list_filter(string_split(regexp_replace(trim(regexp_replace(substring(coalesce(text, ''), 1, 2000), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS xs FROM documents)
SELECT id, substring(array_to_string(xs[1:2], ' '), 1, 200) AS summary FROM s""")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first two sentences of each record, up to 200 characters of them; a record's head is all that can matter."""
    flat = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 2000), r"[ \t\n\x0B\f\r]+", " "))
    xs = F.filter(F.split(flat, "(?<=[.!?]) "), lambda x: x != "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring(F.array_join(F.slice(xs, 1, 2), " "), 1, 200).alias("summary"))


_SLUG_SQL = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN {_SLUG_SQL.format('title')} = '' THEN 'task' ELSE substring({_SLUG_SQL.format('title')}, 1, 48) END AS slug, substring(sha256(lower(trim(title, ' '))), 1, 12) AS query_hash, sha256(title || chr(10) || content) AS digest, CAST(('0x' || substring(sha256(content), 1, 8)) AS BIGINT) % 64 AS shard FROM mem")
def record_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys made of a record's texts: a slug, the hash of a question, the digest of what is embedded, a shard by the fingerprint."""
    slug = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-"))
    return memories(spark, d).select(
        "id", F.when(slug == "", "task").otherwise(F.substring(slug, 1, 48)).alias("slug"), F.substring(F.sha2(F.lower(F.trim("title")), 256), 1, 12).alias("query_hash"),
        F.sha2(F.concat("title", F.lit("\n"), "content"), 256).alias("digest"), (F.conv(F.substring(F.sha2("content", 256), 1, 8), 16, 10).cast("long") % 64).alias("shard"),
    )


_SOURCE_SQL = f"CASE WHEN list_contains({_list(GENERATED_SOURCES)}, s) THEN 'self-generated' WHEN list_contains({_list(TOOL_SOURCES)}, s) THEN 'tool-output' WHEN list_contains({_list(USER_SOURCES)}, s) OR starts_with(s, 'import') THEN 'user-stated' WHEN {' OR '.join(f'starts_with(s, {chr(39)}{w}{chr(39)})' for w in WEB_STARTS)} THEN 'web' ELSE 'self-generated' END"
#: Labels as writers give them; a record has one by its id.
_LABELS = ["manual", " MCP ", "tool", "https://x.org", "observation", "imported", "who knows", "search", "task-pack", None]


@query(f"WITH {MEMORIES_SQL}, l AS (SELECT id, lower(trim(coalesce([{', '.join('NULL' if x is None else repr(x) for x in _LABELS)}][id % {len(_LABELS)} + 1], ''), ' ')) AS s FROM mem) SELECT id, {_SOURCE_SQL} AS tier FROM l")
def source_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The tier of a source by its label; unknown labels count as generated."""
    s = F.lower(F.trim(F.coalesce(F.get(F.array(*map(F.lit, _LABELS)), (F.col("id") % len(_LABELS)).cast("int")), F.lit(""))))
    rows, c = memories(spark, d).select("id", s.alias("s")), F.col("s")
    web = reduce(lambda a, b: a | b, (c.startswith(w) for w in WEB_STARTS))
    return rows.select("id", F.when(c.isin(*GENERATED_SOURCES), "self-generated").when(c.isin(*TOOL_SOURCES), "tool-output").when(c.isin(*USER_SOURCES) | c.startswith("import"), "user-stated").when(web, "web").otherwise("self-generated").alias("tier"))


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, lower(role || CASE WHEN conv_id % 3 = 0 THEN '-bot' ELSE '' END) AS sender FROM conversations)
SELECT conv_id, turn, contains(t, 'http://') OR contains(t, 'https://') AS has_url, CASE WHEN len(list_filter({_list(ASSISTANTS)}, lambda w: contains(sender, w))) > 0 THEN 'ai' ELSE 'human' END AS sender_role,
  lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM c""")
def message_marks(spark: SparkSession, d: str) -> DataFrame:
    """What each turn contains, who seems to have sent it, and the turns before and after it."""
    sender = F.lower(F.concat("role", F.when(F.col("conv_id") % 3 == 0, "-bot").otherwise("")))
    w, text = Window.partitionBy("conv_id").orderBy("turn"), F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", (text.contains("http://") | text.contains("https://")).alias("has_url"), F.when(_any(sender, ASSISTANTS), "ai").otherwise("human").alias("sender_role"),
        F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"),
    )


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def tail_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("n", n).where("n <= 3").select("conv_id", "turn", "role")


@query(r"WITH w AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}') AS xs FROM documents), p AS (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM w), f AS (SELECT id, lower(x) AS k, arg_min(x, i) AS x, min(i) AS i FROM p GROUP BY id, lower(x)) SELECT id, string_agg(x, ' ' ORDER BY i) AS words FROM f WHERE i <= 30 GROUP BY id")
def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words among the first thirty of each document as first written, in order."""
    xs = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 30)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), xs.alias("xs")).withColumn("low", F.transform("xs", lambda x: F.lower(x)))
    kept = F.filter("xs", lambda x, i: F.array_position("low", F.lower(x)) == i + 1)
    return rows.where(F.size("xs") > 0).select("id", F.array_join(kept, " ").alias("words"))


@query(f"""WITH {MEMORIES_SQL}, p AS (SELECT id, context_tag AS own, lead(context_tag) OVER (ORDER BY id) AS other FROM mem WHERE id % 7 < 2), l AS (SELECT id, own, other, {' + '.join(f"CASE WHEN own = '{t}' THEN {n} ELSE 0 END" for t, n in LEVELS.items())} AS a, {' + '.join(f"CASE WHEN other = '{t}' THEN {n} ELSE 0 END" for t, n in LEVELS.items())} AS b FROM mem_pairs)
SELECT id, CASE WHEN a >= b THEN own ELSE other END AS inherited FROM l""".replace("mem_pairs", "(SELECT m.id, m.context_tag AS own, coalesce(n.context_tag, m.context_tag) AS other FROM mem m LEFT JOIN mem n ON n.id = m.parent_id)").replace("p AS (SELECT id, context_tag AS own, lead(context_tag) OVER (ORDER BY id) AS other FROM mem WHERE id % 7 < 2), ", ""))
def inherited_tag(spark: SparkSession, d: str) -> DataFrame:
    """The stricter of a record's audience and that of the record it came from."""
    m = memories(spark, d)
    above = m.select(F.col("id").alias("parent_id"), F.col("context_tag").alias("other"))
    rows = m.select("id", "parent_id", F.col("context_tag").alias("own")).join(above, "parent_id", "left").withColumn("other", F.coalesce("other", "own"))
    return rows.select("id", F.when(level(F.col("own")) >= level(F.col("other")), F.col("own")).otherwise(F.col("other")).alias("inherited"))


@query(f"""WITH {NOTES_SQL}, r AS (SELECT id, name, regexp_extract(text, '(?i)in\\s+(\\d+)\\s*(minutes?|hours?|days?|weeks?)', 1) AS n, lower(substring(regexp_extract(text, '(?i)in\\s+(\\d+)\\s*(minutes?|hours?|days?|weeks?)', 2), 1, 1)) AS unit, CAST(day AS TIMESTAMP) AS since FROM note)
SELECT id, since + to_minutes(CAST(n AS BIGINT) * CASE unit WHEN 'm' THEN 1 WHEN 'h' THEN 60 WHEN 'd' THEN 1440 ELSE 10080 END) AS due_at FROM r WHERE n <> ''""")
def due_times(spark: SparkSession, d: str) -> DataFrame:
    """When a note that says "in N hours" is due, seen from its day."""
    pattern = r"(?i)in\s+(\d+)\s*(minutes?|hours?|days?|weeks?)"
    rows = notes(spark, d).select("id", "day", F.regexp_extract("text", pattern, 1).alias("n"), F.lower(F.substring(F.regexp_extract("text", pattern, 2), 1, 1)).alias("unit")).where("n <> ''")
    minutes = F.col("n").cast("int") * F.when(F.col("unit") == "m", 1).when(F.col("unit") == "h", 60).when(F.col("unit") == "d", 1440).otherwise(10080)
    return rows.select("id", F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + minutes * 60).cast("timestamp_ntz").alias("due_at"))


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type),
f AS (SELECT user_id, max(mean) / 100 AS intensity, min(mean) / 100 AS valence, avg(mean) / 100 AS coherence, count(*) AS kinds FROM t GROUP BY user_id)
SELECT user_id, least(100, greatest(0, round(100 * least(1.0, 0.30 * least(1, intensity) + 0.15 * least(1, valence) + 0.15 * kinds / 10 + 0.20 * least(1, coherence) + CASE WHEN kinds >= 5 THEN 0.05 ELSE 0 END)))) AS level FROM f""")
def feeling_levels(spark: SparkSession, d: str) -> DataFrame:
    """How overwhelming the values of each user's events are, 0 to 100: a weighted mean with a bonus, held within bounds."""
    t = table(spark, d, "events").where("value is not null").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    f = t.groupBy("user_id").agg((F.max("mean") / 100).alias("i"), (F.min("mean") / 100).alias("v"), (F.avg("mean") / 100).alias("c"), F.count(F.lit(1)).alias("kinds"))
    one = lambda c: F.least(F.lit(1.0), F.col(c))
    raw = F.least(F.lit(1.0), 0.30 * one("i") + 0.15 * one("v") + 0.15 * F.col("kinds") / 10 + 0.20 * one("c") + F.when(F.col("kinds") >= 5, 0.05).otherwise(0.0))
    return f.select("user_id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(100 * raw))).alias("level"))


@query(f"WITH {MEMORIES_SQL}, a AS (SELECT id, date_diff('day', CAST(created_at AS DATE), DATE '2025-03-01') AS days, intensity FROM mem) SELECT id, round(greatest(0.1, 1 - days / 365.0), 6) AS freshness, round(least(1.0, greatest(0.0, coalesce(CASE WHEN id % 4 = 0 THEN intensity / 5 END, 0.6))), 6) AS tilt FROM a WHERE coalesce(CASE WHEN id % 4 = 0 THEN intensity / 5 END, 0.6) > 0")
def anchor_strengths(spark: SparkSession, d: str) -> DataFrame:
    """How fresh an anchor is and how strongly it tilts: its own strength where it has one, within 0 and 1; none at 0 are left."""
    days = F.date_diff(F.lit("2025-03-01").cast("date"), F.to_date("created_at"))
    own = F.coalesce(F.when(F.col("id") % 4 == 0, F.col("intensity") / 5), F.lit(0.6))
    return memories(spark, d).where(own > 0).select("id", F.round(F.greatest(F.lit(0.1), 1 - days / 365.0), 6).alias("freshness"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), own)), 6).alias("tilt"))


@query(f"""WITH {MEMORIES_SQL}, d AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, round(avg(intensity), 4) AS mean FROM mem GROUP BY 1), t AS (SELECT CAST(created_at AS DATE) AS day, unnest(tags) AS tag, count(*) AS n FROM mem GROUP BY 1, 2),
r AS (SELECT day, tag, row_number() OVER (PARTITION BY day ORDER BY n DESC, tag) AS nth FROM t WHERE tag IS NOT NULL), s AS (SELECT day, string_agg(tag, ', ' ORDER BY nth) AS themes FROM r WHERE nth <= 3 GROUP BY day)
SELECT CAST(d.day AS VARCHAR) AS day, n, mean, n || ' records, mostly about ' || coalesce(themes, 'nothing') AS story FROM d LEFT JOIN s ON d.day = s.day""")
def daily_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """A record for each day: how many there were, how intense, and the three tags that came most."""
    m = memories(spark, d).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "tags", "intensity")
    n = m.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("intensity"), 4).alias("mean"))
    t = m.select("day", F.explode("tags").alias("tag")).where("tag is not null").groupBy("day", "tag").agg(F.count(F.lit(1)).alias("c"))
    nth = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("c"), "tag"))
    s = t.withColumn("nth", nth).where("nth <= 3").groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "tag"))), lambda x: x["tag"]), ", ").alias("themes"))
    return n.join(s, "day", "left").select("day", "n", "mean", F.concat(F.col("n").cast("string"), F.lit(" records, mostly about "), F.coalesce("themes", F.lit("nothing"))).alias("story"))


#: A question about time, one kind for each remainder of an event's id.
_TIMES = ["yesterday", "today", "3 days ago", "last week", "this month", "last month", "on 2024-01-15", "in 2024-02", "in 2023", "past 2 weeks", "last friday", "no time at all"]
_DAY = "CAST(ts AS DATE)"
_SPANS = {
    "yesterday": (f"{_DAY} - 1", f"{_DAY}"), "today": (_DAY, f"{_DAY} + 1"), "3 days ago": (f"{_DAY} - 3", f"{_DAY} - 2"),
    "last week": (f"date_trunc('week', {_DAY}) - INTERVAL 7 DAY", f"date_trunc('week', {_DAY})"), "this month": (f"date_trunc('month', {_DAY})", f"date_trunc('month', {_DAY}) + INTERVAL 1 MONTH"),
    "last month": (f"date_trunc('month', {_DAY}) - INTERVAL 1 MONTH", f"date_trunc('month', {_DAY})"), "on 2024-01-15": ("DATE '2024-01-15'", "DATE '2024-01-16'"),
    "in 2024-02": ("DATE '2024-02-01'", "DATE '2024-03-01'"), "in 2023": ("DATE '2023-01-01'", "DATE '2024-01-01'"), "past 2 weeks": (f"{_DAY} - 14", f"{_DAY} + 1"),
    "last friday": (f"{_DAY} - CAST((isodow({_DAY}) + 1) % 7 + 1 AS INTEGER)", f"{_DAY} - CAST((isodow({_DAY}) + 1) % 7 AS INTEGER)"),
}


@query(f"WITH q AS (SELECT event_id, ts, {_list(_TIMES)}[event_id % {len(_TIMES)} + 1] AS text FROM events) SELECT event_id, CAST(CAST(CASE text {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN CAST({a} AS DATE)' for k, (a, _) in _SPANS.items())} END AS DATE) AS VARCHAR) AS from_day, CAST(CAST(CASE text {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN CAST({b} AS DATE)' for k, (_, b) in _SPANS.items())} END AS DATE) AS VARCHAR) AS to_day FROM q")
def parse_time_window(spark: SparkSession, d: str) -> DataFrame:
    """The days that a question means, seen from the day of each event."""
    e = table(spark, d, "events")
    text = F.concat(F.lit("What happened "), F.get(F.array(*map(F.lit, _TIMES)), (F.col("event_id") % len(_TIMES)).cast("int")), F.lit("?"))
    w = e.select("event_id", time_window(text, F.to_date("ts")).alias("w"))
    return w.select("event_id", F.date_format("w.start", "yyyy-MM-dd").alias("from_day"), F.date_format("w.end", "yyyy-MM-dd").alias("to_day"))


#: More ways to ask, the days that each means as SQL, and whether a strict reading takes it for a question about time.
_ASKS = {
    "three days ago": (f"{_DAY} - 3", f"{_DAY} - 2", True), "a week ago": (f"date_trunc('week', {_DAY}) - INTERVAL 7 DAY", f"date_trunc('week', {_DAY})", True),
    "in the past month": (f"{_DAY} - INTERVAL 1 MONTH", f"{_DAY} + 1", True), "over the last two weeks": (f"{_DAY} - 14", f"{_DAY} + 1", True),
    "on 2024-02-30": ("NULL", "NULL", True), "on 2024-13-45": ("DATE '2024-01-01'", "DATE '2025-01-01'", True), "part 1999 of the set": ("NULL", "NULL", True),
    "in may 2023": ("DATE '2023-05-01'", "DATE '2023-06-01'", True), "the rollout may halt": ("NULL", "NULL", True), "on january 5": ("make_date(year(ts), 1, 5)", "make_date(year(ts), 1, 6)", True),
    "the 3rd of march 2024": ("DATE '2024-03-03'", "DATE '2024-03-04'", True), "in december": ("make_date(CASE WHEN month(ts) = 12 THEN year(ts) ELSE year(ts) - 1 END, 12, 1)", "make_date(CASE WHEN month(ts) = 12 THEN year(ts) ELSE year(ts) - 1 END, 12, 1) + INTERVAL 1 MONTH", True),
    "Postmortem 2024-01-16 orphans": ("DATE '2024-01-16'", "DATE '2024-01-17'", False), "Q3 2024 roadmap": ("DATE '2024-01-01'", "DATE '2025-01-01'", False),
    "this week of june 2022": ("DATE '2022-06-01'", "DATE '2022-07-01'", True), "feb 30 2024": ("DATE '2024-02-01'", "DATE '2024-03-01'", False),
}
_ASK = "CASE text " + " ".join(f"WHEN '{k}' THEN CAST({v[0]} AS DATE)" for k, v in _ASKS.items()) + " END"
_ASK_END = "CASE text " + " ".join(f"WHEN '{k}' THEN CAST({v[1]} AS DATE)" for k, v in _ASKS.items()) + " END"
_MEANT = "text IN (" + ", ".join(f"'{k}'" for k, v in _ASKS.items() if v[2]) + ")"


@query(f"WITH q AS (SELECT event_id, ts, {_list(list(_ASKS))}[event_id % {len(_ASKS)} + 1] AS text FROM events), w AS (SELECT event_id, CAST({_ASK} AS VARCHAR) AS a, CAST({_ASK_END} AS VARCHAR) AS b, {_MEANT} AS meant FROM q) SELECT event_id, a AS from_day, b AS to_day, CASE WHEN meant THEN a END AS strict_from, CASE WHEN meant THEN b END AS strict_to FROM w")
def asked_windows(spark: SparkSession, d: str) -> DataFrame:
    """The days that more ways of asking mean, wrong dates and names that hold dates among them, read freely and strictly."""
    asks = F.get(F.array(*map(F.lit, _ASKS)), (F.col("event_id") % len(_ASKS)).cast("int"))
    e = table(spark, d, "events").select("event_id", asks.alias("text"), F.to_date("ts").alias("day"))
    w = e.select("event_id", time_window(F.col("text"), F.col("day")).alias("w"), time_window(F.col("text"), F.col("day"), strict=True).alias("s"))
    shown = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    return w.select("event_id", shown("w.start", "from_day"), shown("w.end", "to_day"), shown("s.start", "strict_from"), shown("s.end", "strict_to"))


@query(f"WITH {search.REGISTERED['bm25_topk'][1].removeprefix('WITH ').rsplit(' SELECT query_id, id, score', 1)[0]}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 10) SELECT r.query_id, r.id, rank, source FROM (SELECT r.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM r JOIN mem ON r.id = mem.id) r WHERE nth <= 2")
def source_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most two results of each source for a question; the order stays."""
    r = search.bm25_topk(spark, d).join(memories(spark, d).select("id", "source"), "id")
    nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))
    return r.withColumn("nth", nth).where("nth <= 2").select("query_id", "id", "rank", "source")


@query(f"WITH {MEMORIES_SQL}, w AS (SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{2,}}')) AS signal, intensity FROM mem WHERE id % 20 = 0), d AS (SELECT DISTINCT id, signal, intensity FROM w), n AS (SELECT signal, count(*) AS df FROM d GROUP BY signal) SELECT id, count(*) FILTER (WHERE df = 1) AS rare, round(1.2 * count(*) FILTER (WHERE df = 1) + 0.05 * min(least(intensity, 8)), 6) AS score FROM d JOIN n USING (signal) GROUP BY id")
def novelty_signals(spark: SparkSession, d: str) -> DataFrame:
    """How many words of a record's title no other of the pool has, and the score that it gets for them."""
    w = memories(spark, d).where("id % 20 = 0").select("id", "intensity", F.explode(F.array_distinct(tokens(F.col("title")))).alias("signal"))
    n = w.groupBy("signal").agg(F.count(F.lit(1)).alias("df"))
    rare = F.count_if(F.col("df") == 1)
    return w.join(n, "signal").groupBy("id").agg(rare.alias("rare"), F.round(1.2 * rare + 0.05 * F.min(F.least("intensity", F.lit(8.0))), 6).alias("score"))
