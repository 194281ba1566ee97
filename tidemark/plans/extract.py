"""Queries that turn texts into entities, claims, chunks and verdicts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..functions.wording import resolve_dates
from ..operators import spelling
from ..sources.tables import MEMORIES_SQL, NOTES_SQL, memories, notes, table

REGISTERED: dict = {}
#: What marks a sentence as a claim, and its least length. Fixed values.
CLAIM_MARKERS = "must", "shall", "required", "prohibited", "cannot", "therefore", "accordingly", "establishes", "demonstrates", "shows that", "provides that", "states that", "claims that"
CLAIM_CHARS = 30
#: Runs of capitalised words and of capitals, and legal citations. Fixed values.
ENTITY = r"\b(?:[A-Z][a-z]{2,20}(?:[ \t]+[A-Z][a-z]{2,20}){0,3}|[A-Z]{2,}(?:[ \t]+[A-Z]{2,}){0,3})\b"
CITATION = r"(?i)\b(?:\d{1,3}[ \t]+(?:U\.?S\.?C\.?|C\.?F\.?R\.?)[ \t]+\d[\w.()-]*|U\.?C\.?C\.?[ \t]*\d[\w.-]*|Section[ \t]+\d[\w.-]*)"
#: Markers of a source's authority, strongest first. Fixed values.
STATUTE = "usc", "u.s.c.", "cfr", "ucc", "statute", "act of"
RULE = "rule", "f.r.", "civil procedure"
CASE_LAW = " v. ", " vs. ", "case law", "opinion", "holding"
FORM = "form ", "fillable form", "irs form", "ao 240", "ao 239"
TEMPLATE = "template", "generated/", "guide bundle"
SECONDARY = "reference/", "american jurisprudence", "american jurispurdence", "american juris", "black's law", "handbook", "practitioner", "treatise"
#: Word overlap up to which a text is new, and from which it restates; words that tell of a change. Fixed values.
NEW_BELOW, RESTATES_FROM = 0.15, 0.72
CHANGE = (
    r"\b(?:actually|correction|correct(?:ed|ion)?|retract(?:ed|ion)?|no[ \t\n]+longer|not[ \t\n]+anymore|not[ \t\n]+any[ \t\n]+more|instead(?:[ \t\n]+of)?|reversed?|revers(?:al|ing)|revised?|updated?|renamed?|replaced?|superse(?:de|ded)|"
    r"now[ \t\n]+(?:is|at|closed|open|active|inactive|done|complete)|used[ \t\n]+to|previously|formerly|deprecat(?:ed|ion)|retir(?:ed|ement)|increased?|decreased?|changed[ \t\n]+(?:to|from)|moved[ \t\n]+to|re-?opened|re-?closed)\b"
)
#: Characters of a chunk and of the overlap of two, and the least length before a break is taken. Fixed values.
CHUNK, OVERLAP, LEAST = 900, 200, 200


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def plain(text: Column) -> Column:
    """Letters beyond ASCII as '_': a word character that no pattern of capitals matches."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "_")


_PLAIN = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')"


def _first_of_equals(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, name) of rows (doc_id, at, name): one for each value whatever its case, as first written."""
    return rows.groupBy("doc_id", F.lower(name).alias("key")).agg(F.min_by(name, "at").alias(name)).select("doc_id", name)


def _found_sql(pattern: str, name: str, rule: str, of: str = "documents") -> str:
    return f"""WITH p AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '{pattern}') AS xs FROM {of}), x AS (SELECT doc_id, unnest(xs) AS {name}, generate_subscripts(xs, 1) AS place FROM p)
SELECT doc_id, arg_min({name}, place) AS {name} FROM x WHERE {rule} GROUP BY doc_id, lower({name})"""


@query(_found_sql(ENTITY, "entity", "len(entity) >= 4 AND NOT regexp_matches(lower(entity), '^(section|tags) ')"))
def title_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names in each document: runs of up to four capitalised words, or of capitals."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(plain(F.coalesce("text", F.lit(""))), F.lit(ENTITY), F.lit(0))).alias("at", "entity"))
    return _first_of_equals(rows.where((F.char_length("entity") >= 4) & ~F.lower("entity").rlike("^(section|tags) ")), "entity")


_NOTE_ROWS = f"(WITH {NOTES_SQL} SELECT id AS doc_id, text FROM note)"


@query(_found_sql(CITATION, "citation", "true", _NOTE_ROWS))
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    """Legal citations in each note."""
    rows = notes(spark, d).select(F.col("id").alias("doc_id"), F.posexplode(F.regexp_extract_all(plain(F.coalesce("text", F.lit(""))), F.lit(CITATION), F.lit(0))).alias("at", "citation"))
    return _first_of_equals(rows, "citation")


@query(rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)) AS xs FROM documents),
x AS (SELECT doc_id, trim(regexp_replace(unnest(xs), '[ \t\n\r]+', ' ', 'g'), ' ') AS claim, generate_subscripts(xs, 1) AS place FROM p)
SELECT doc_id, arg_min(claim, place) AS claim FROM x WHERE len(claim) >= {CLAIM_CHARS} AND ({' OR '.join(f"contains(lower(claim), '{m}')" for m in CLAIM_MARKERS)}) GROUP BY doc_id, lower(claim)""")
def claim_extract(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document that state or demand something."""
    ends = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(ends).alias("at", "s"))
    rows = rows.select("doc_id", "at", F.trim(F.regexp_replace("s", r"[ \t\n\r]+", " ")).alias("claim")).where(F.char_length("claim") >= CLAIM_CHARS)
    return _first_of_equals(rows.where(F.lower("claim").rlike("|".join(CLAIM_MARKERS))), "claim")


def _any(words: tuple[str, ...], of: str) -> str:
    return "(" + " OR ".join(f"contains({of}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(f"""WITH {MEMORIES_SQL}, h AS (SELECT id, lower(title || ' ' || coalesce(source, '') || ' ' || coalesce(tags[1], '')) AS h FROM mem)
SELECT id, CASE WHEN {_any(STATUTE, 'h')} THEN CASE WHEN {_any(RULE, 'h')} THEN 'rule' ELSE 'statute' END WHEN {_any(CASE_LAW, 'h')} THEN 'case' WHEN {_any(FORM, 'h')} THEN 'form' WHEN {_any(TEMPLATE, 'h')} THEN 'template' WHEN {_any(SECONDARY, 'h')} THEN 'secondary' ELSE 'memory' END AS tier FROM h""")
def authority_tier(spark: SparkSession, d: str) -> DataFrame:
    """How much a source's words weigh, by the first markers that occur."""
    h = F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit(""))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("h").contains(w))
    tier = F.when(has(STATUTE), F.when(has(RULE), "rule").otherwise("statute")).when(has(CASE_LAW), "case").when(has(FORM), "form").when(has(TEMPLATE), "template").when(has(SECONDARY), "secondary").otherwise("memory")
    return memories(spark, d).select("id", h.alias("h")).select("id", tier.alias("tier"))


_ASKED = "the release of new data in production"


@query(f"""WITH {MEMORIES_SQL}, s AS (SELECT id, list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(array_to_string(tags, ' '), '')), '[a-z0-9]{{2,}}')) AS ws FROM mem)
SELECT id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(len(list_filter(ws, lambda w: NOT list_contains(regexp_extract_all('{_ASKED}', '[a-z0-9]{{2,}}'), w))) / len(ws), 3) END AS score FROM s""")
def novelty_score(spark: SparkSession, d: str) -> DataFrame:
    """The share of a record's title and tags that a query does not already say."""
    words = F.array_distinct(tokens(F.concat_ws(" ", F.col("title"), F.concat_ws(" ", "tags"))))
    m = memories(spark, d).select("id", words.alias("ws"))
    unseen = F.size(F.array_except("ws", tokens(F.lit(_ASKED))))
    return m.select("id", F.when(F.size("ws") == 0, 0.0).otherwise(F.round(unseen / F.size("ws"), 3)).alias("score"))


@query(rf"""WITH {MEMORIES_SQL}, w AS (SELECT id, supersedes_id, regexp_matches(lower({_PLAIN.replace('text', 'content')}), '{CHANGE}') AS cue, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{{3,}}')) AS ws FROM mem),
j AS (SELECT a.id, a.cue, len(list_intersect(a.ws, b.ws)) AS both_, len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)) AS any_ FROM w a JOIN w b ON a.supersedes_id = b.id)
SELECT id, round(CASE WHEN any_ = 0 THEN 0.0 ELSE both_ / any_ END, 6) AS similarity, CASE WHEN any_ = 0 OR both_ / any_ < {NEW_BELOW} THEN 'new' WHEN cue OR both_ / any_ < {RESTATES_FROM} THEN 'changes' ELSE 'restates' END AS verdict,
  any_ > 0 AND both_ / any_ >= {NEW_BELOW} AND cue <> (both_ / any_ < {RESTATES_FROM}) AS abstained FROM j""")
def triage_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record is new, restates or changes the one before it; it abstains where wording and overlap disagree."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    w = memories(spark, d).select("id", "supersedes_id", F.lower(plain(F.col("content"))).rlike(CHANGE).alias("cue"), words.alias("ws"))
    b = w.select(F.col("id").alias("supersedes_id"), F.col("ws").alias("other"))
    both, either = F.size(F.array_intersect("ws", "other")), F.size(F.array_union("ws", "other"))
    j = w.join(b, "supersedes_id").select("id", "cue", F.when(either == 0, 0.0).otherwise(both / either).alias("s"))
    low = F.col("s") < RESTATES_FROM
    verdict = F.when(F.col("s") < NEW_BELOW, "new").when(F.col("cue") | low, "changes").otherwise("restates")
    return j.select("id", F.round("s", 6).alias("similarity"), verdict.alias("verdict"), ((F.col("s") >= NEW_BELOW) & (F.col("cue") != low)).alias("abstained"))


#: Triggers of the query below: name, phrase, role of the turn it is meant for (null: any), in order of name.
TRIGGERS = [("t1", "release", None), ("t2", "thank you", "user"), ("t3", "data", "assistant"), ("t4", "please", "user"), ("t5", "today", None)]


def fired(text: Column, role: Column, triggers=TRIGGERS, cap: int = 3) -> Column:
    """The first `cap` triggers whose phrase occurs between word boundaries, joined by commas."""
    low = F.lower(text)
    hits = [F.when(low.rlike(rf"(^|[^\w]){phrase}($|[^\w])") & (F.lit(True) if scope is None else role == scope), F.lit(name)) for name, phrase, scope in triggers]
    return F.array_join(F.slice(F.array_compact(F.array(*hits)), 1, cap), ",")


@query(f"WITH {NOTES_SQL}, c AS (SELECT id AS conv_id, text AS t, CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM note), " + "f AS (SELECT conv_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(t), '(^|[^\\w]){p}($|[^\\w])') AND {'true' if r is None else f'role = {chr(39)}{r}{chr(39)}'} THEN '{n}' END" for n, p, r in TRIGGERS) + "], lambda x: x IS NOT NULL)[1:3] AS xs FROM c) SELECT conv_id AS id, array_to_string(xs, ',') AS fired FROM f WHERE len(xs) > 0")
def trigger_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Which triggers each note fires, three at most; every second is meant as a user's."""
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    rows = notes(spark, d).select("id", fired(F.col("text"), role).alias("fired"))
    return rows.where("fired <> ''")


def spans(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """[start, end) of overlapping chunks of at most size; each ends at its last blank line, else its last sentence end, if that leaves enough.

    The places where a text may be cut are listed once, each kind in order; the end of a chunk is searched in the lists.
    """
    blank = [m.start() for m in re.finditer(r"(?=\n\n)", text)]
    stops = [m.start() for m in re.finditer(r"(?=\. )", text)]

    def end_of(start: int) -> int:
        limit = start + size
        if limit >= len(text):
            return len(text)
        before = lambda places: places[i - 1] if (i := bisect_right(places, limit - 2)) else -1
        if (at := before(blank)) > start:
            return at if at - start > least else limit
        return at + 1 if (at := before(stops)) - start > least else limit

    out = [(0, end_of(0))]
    while out[-1][1] < len(text):
        start = max(out[-1][0] + 1, out[-1][1] - overlap)
        out.append((start, end_of(start)))
    return out


_LAST = "CASE WHEN contains({w}, {x}) THEN len({w}) - strpos(reverse({w}), reverse({x})) - 1 ELSE -1 END"
_BARE = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, text, 0 AS chunk, CAST(0 AS BIGINT) AS start, {{end}} AS stop FROM (SELECT *, CAST(0 AS BIGINT) AS since, substring(text, 1, {CHUNK}) AS w FROM t)
  UNION ALL SELECT doc_id, text, chunk, since, {{end}} FROM (SELECT *, substring(text, CAST(since + 1 AS BIGINT), {CHUNK}) AS w FROM (SELECT doc_id, text, chunk + 1 AS chunk, greatest(start + 1, stop - {OVERLAP}) AS since FROM c WHERE stop < len(text)))),
s AS (SELECT doc_id, chunk, start, {_BARE.format('substring(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT))')} AS text FROM c)
SELECT doc_id, chunk, start, substring(md5(start || ':' || text), 1, 12) AS chunk_id, text FROM s WHERE text <> ''""".replace("{end}", f"""CAST(CASE WHEN since + {CHUNK} >= len(text) THEN len(text) WHEN {_LAST.format(w='w', x='chr(10) || chr(10)')} > 0 THEN since + CASE WHEN {_LAST.format(w='w', x='chr(10) || chr(10)')} > {LEAST} THEN {_LAST.format(w='w', x='chr(10) || chr(10)')} ELSE {CHUNK} END
  WHEN {_LAST.format(w='w', x="'. '")} > {LEAST} THEN since + {_LAST.format(w='w', x="'. '")} + 1 ELSE since + {CHUNK} END AS BIGINT)"""))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document with their place; how far one reaches depends on the one before, so a document is one task's loop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, s, t[s:e].strip()) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, (s, e) in enumerate(spans(t)) if t[s:e].strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["doc_id", "chunk", "start", "text"])

    out = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, chunk int, start long, text string")
    return out.select("doc_id", "chunk", "start", F.substring(F.md5(F.concat_ws(":", "start", "text")), 1, 12).alias("chunk_id"), "text")


#: What the phrases of the notes mean, each worked out by itself.
_DATED = [
    (r"(?i)\btoday\b", "strftime(day, '%Y-%m-%d')"), (r"(?i)\btonight\b", "strftime(day, '%Y-%m-%d')"), (r"(?i)\byesterday\b", "strftime(day - 1, '%Y-%m-%d')"), (r"(?i)\btomorrow\b", "strftime(day + 1, '%Y-%m-%d')"),
    (r"(?i)\blast week\b", "'week of ' || strftime(date_trunc('week', day) - INTERVAL 7 DAY, '%Y-%m-%d')"), (r"(?i)\bnext monday\b", "strftime(date_trunc('week', day) + INTERVAL 7 DAY, '%Y-%m-%d')"),
    (r"(?i)\bon tuesday\b", "strftime(day - CAST((isodow(day) + 4) % 7 + 1 AS INTEGER), '%Y-%m-%d')"), (r"(?i)\bon friday\b", "strftime(day + CAST((11 - isodow(day)) % 7 + 1 AS INTEGER), '%Y-%m-%d')"),
]


def _dated_sql() -> str:
    out = "text"
    for phrase, date in _DATED:
        out = f"regexp_replace({out}, '({phrase})', '\\1 (' || {date} || ')', 'g')"
    return out


@query(f"WITH {NOTES_SQL} SELECT id, {_dated_sql()} AS text FROM note")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """Each note with the day that its relative dates mean, seen from the note's day."""
    return notes(spark, d).select("id", resolve_dates(F.col("text"), F.col("day")).alias("text"))


@query()
def spell_correct(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, numbered by both of their keys, corrected by the words that twenty turns hold. SQL cannot express it."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    words = turns.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("word"))
    common = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return spelling.correct(turns, common.select("word")).select("id.conv_id", "id.turn", "text", "n_fixed")
