"""Queries that judge texts, rows and rankings: quadrants, moments, peaks, feelings, admission, anchors, skills, differences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..operators import baselines as B
from ..operators import matching as M
from ..operators import retrieval as R
from ..sources.tables import MEMORIES_SQL, NOTES_SQL, memories, notes, table
from . import batch, search

REGISTERED: dict = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _held(words: list[str], of: str) -> str:
    """How many of the words a text holds, in SQL."""
    return f"len(list_filter({_list(words)}, lambda w: contains({of}, w)))"


_VOTES = {q: f"{_held(words, 'low')} + 2 * len(list_filter(tags, lambda t: list_contains({_list(S.QUADRANT_TAGS[q])}, lower(t))))" + (" + CASE WHEN intensity >= 7 THEN 2 ELSE 0 END" if q == "soul" else "") for q, words in S.QUADRANTS.items()}


@query(f"""WITH {MEMORIES_SQL}, v AS (SELECT id, {', '.join(f"{sql} AS {q}" for q, sql in _VOTES.items())} FROM (SELECT *, lower(title || ' ' || content) AS low FROM mem))
SELECT id, CASE WHEN greatest(core, work, soul, wild) = 0 THEN 'work' WHEN core = greatest(core, work, soul, wild) THEN 'core' WHEN work = greatest(core, work, soul, wild) THEN 'work' WHEN soul = greatest(core, work, soul, wild) THEN 'soul' ELSE 'wild' END AS quadrant FROM v""")
def quadrant_classify(spark: SparkSession, d: str) -> DataFrame:
    """The quadrant of each record."""
    none = F.lit(None).cast("string")
    of = S.quadrant(F.concat_ws(" ", "title", "content"), F.col("tags"), F.col("intensity"), F.lit(False), F.lit(None).cast("array<string>"), none, none)
    return memories(spark, d).select("id", of.alias("quadrant"))


_WORD = r"[\p{L}\p{N}_]"
_NOT = r"[^\p{L}\p{N}_]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _says(kind: str) -> str:
    found = [rf"(?i)(^|{_NOT})({p})($|{_NOT})" for p in S.MOMENTS[kind]]
    if kind == "preference":
        found.append(rf"(?i)(^|{_NOT})(don'?t|do not|stop|avoid|skip)({_NOT}|{_NOT}.*{_NOT})(that|this|doing|using)($|{_NOT})")
    if kind == "milestone":
        found.append(rf"(?i)(^|{_NOT})v\d+\.\d+")
    return "(" + " OR ".join(f"regexp_matches(line, {_quoted(p)})" for p in found) + ")"


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, and each note as one more."""
    n = notes(spark, d).select((-1 - F.col("id")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").unionAll(n)


_SAID = f"(WITH {NOTES_SQL} SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - id, 0, text FROM note)"
_TRIM = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_BARE = _TRIM.format("regexp_replace(line, '[*_`#>~]', '', 'g')")
_CLEAN = _TRIM.format(rf"regexp_replace(regexp_replace({_BARE}, '^[-•]\s*', ''), '^[0-9]+\.\s*', '')")


@query(rf"""WITH l AS (SELECT conv_id, turn, unnest(xs) AS line, generate_subscripts(xs, 1) - 1 AS place FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS xs FROM {_SAID} WHERE len(text) >= {S.SENTENCE_CHARS})),
p AS (SELECT *, {_TRIM.format('line')} AS bare FROM l),
s AS (SELECT conv_id, turn, place, line, {_CLEAN} AS sentence FROM p WHERE len(bare) >= {S.LINE_CHARS} AND NOT ({' OR '.join(f"starts_with(bare, {_quoted(c)})" for c in S.CODE_STARTS)}) AND len(regexp_replace(bare, '\P{{L}}', '', 'g')) / len(bare) >= {S.LETTERS}),
k AS (SELECT conv_id, turn, place, sentence, unnest([{', '.join(f"CASE WHEN {_says(k)} THEN '{k}' END" for k in S.MOMENTS)}]) AS kind, unnest(range(5)) AS nth FROM s WHERE len(sentence) >= {S.SENTENCE_CHARS})
SELECT conv_id, turn, CAST(place AS INTEGER) AS line, kind, sentence FROM (SELECT * FROM k WHERE kind IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(substring(sentence, 1, 30)) ORDER BY place, nth) = 1""")
def extract_moments(spark: SparkSession, d: str) -> DataFrame:
    """Decisions, preferences, milestones, problems and feelings in each turn: a line for each, the first of those that begin alike."""
    t = _said(spark, d).where(F.char_length("text") >= S.SENTENCE_CHARS).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    t = t.where(~S.is_code(F.regexp_replace("said", r"^\s+|\s+$", ""))).select("conv_id", "turn", "line", S.moments(F.col("said")).alias("kinds"), S.sentence(F.col("said")).alias("sentence"))
    # of several kinds of one line only the first can stay, as all of them begin alike
    t = t.where((F.size("kinds") > 0) & (F.char_length("sentence") >= S.SENTENCE_CHARS)).withColumn("start", F.lower(F.substring("sentence", 1, 30)))
    first = t.groupBy("conv_id", "turn", "start").agg(F.min_by(F.struct("line", F.element_at("kinds", 1).alias("kind"), "sentence"), "line").alias("m"))
    return first.select("conv_id", "turn", "m.line", "m.kind", "m.sentence")


_DOUBLED = rf"regexp_replace(text, '({_NOT})', '\1\1', 'g')"
_HEDGES = " + ".join(f"len(regexp_extract_all({_DOUBLED}, {_quoted('(?i)(?:^|' + _NOT + ')(?:' + p.replace(' ', '  ') + ')(?:$|' + _NOT + ')')}))" for p in S.HEDGES)


def _per(known, name: str) -> str:
    return f"round(len(list_filter(ws, lambda w: list_contains({_list(known)}, w))) * 100.0 / n_words, 3) AS {name}"


def _peak_sql(sustained: bool) -> str:
    k = 1.5 if sustained else 2.0
    raised = " + ".join(f"CAST({c} >= {S.USUAL[c]} * {k} AS INTEGER)" for c in ("pet", "we", "you", "present"))
    gates = ["sentence_mean BETWEEN 5 AND 12" if sustained else f"sentence_mean > 0 AND sentence_mean <= {S.USUAL['sentence_mean']} * 0.65", f"{raised} >= {3 if sustained else 2}", "hedges <= 1", "report >= 90"] + ["n_words >= 30"] * sustained
    met = " + ".join(f"CAST(({g}) AS INTEGER)" for g in gates)
    return f"CASE WHEN {met} = {len(gates)} THEN 'peak' WHEN {met} = {len(gates) - 1} THEN 'near' ELSE 'none' END"


@query(rf"""WITH w AS (SELECT conv_id, turn, text, 60 + (conv_id * 37 + turn * 11) % 41 AS report, regexp_extract_all(lower(text), '[a-z'']+') AS ws,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(regexp_extract_all(lower(s), '[a-z'']+'))), lambda k: k > 0) AS sizes FROM conversations WHERE text IS NOT NULL),
m AS (SELECT *, len(ws) AS n_words FROM w WHERE len(ws) > 0),
t AS (SELECT conv_id, turn, report, n_words, round(list_avg(sizes), 2) AS sentence_mean, {_per(S.PET_NAMES, 'pet')}, {_per(S.WE, 'we')}, {_per(S.YOU, 'you')}, {_per(S.PRESENT, 'present')}, {_HEDGES} AS hedges FROM m)
SELECT conv_id, turn, n_words, sentence_mean, "we", "you", present, hedges, {_peak_sql(False)} AS burst, {_peak_sql(True)} AS sustained FROM t""")
def bloom_gate(spark: SparkSession, d: str) -> DataFrame:
    """Measures of each turn with words, and whether it is a peak, of either kind, given a self-report."""
    m = S.turn_measures(F.col("text"))
    report = F.lit(60) + (F.col("conv_id") * 37 + F.col("turn") * 11) % 41
    t = table(spark, d, "conversations").select("conv_id", "turn", report.alias("report"), *(c.alias(k) for k, c in m.items())).where("n_words > 0")
    return t.select("conv_id", "turn", "n_words", "sentence_mean", "we", "you", "present", "hedges", S.peak(F.col("report")).alias("burst"), S.peak(F.col("report"), True).alias("sustained"))


_HIT = {k: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")" for k, (words, _, _) in S.FEELINGS.items()}
_SHOWN = {k: "(" + " OR ".join(f"contains(text, '{x}')" for x in signs) + ")" for k, signs in S.SIGNS.items()}


def _moved(first: str, hits: dict[str, str]) -> str:
    """The mood after each feeling in turn: good ones raise it to theirs at least, bad ones lower it to theirs at most."""
    for k, hit in hits.items():
        first = f"{'greatest' if S.FEELINGS[k][2] > 0 else 'least'}({first}, CASE WHEN {hit} THEN {S.FEELINGS[k][2]} END)"
    return first


def _strongest(first: str, hits: dict[str, str]) -> str:
    return f"greatest({first}, {', '.join(f'CASE WHEN {hit} THEN {S.FEELINGS[k][1]} END' for k, hit in hits.items())})"


@query(rf"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM {_SAID}),
f AS (SELECT conv_id, turn, text, low, least({_strongest('0.0', _HIT)} + CASE WHEN contains(text, '!') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '\p{{Ll}}') AND len(text) > 10 THEN 2 ELSE 0 END, 10.0) AS said,
  list_filter([{', '.join(f"CASE WHEN {_HIT[k]} THEN '{k}' END" for k in S.FEELINGS)}, {', '.join(f"CASE WHEN {_SHOWN[k]} AND NOT {_HIT[k]} THEN '{k}' END" for k in S.SIGNS)}], lambda k: k IS NOT NULL) AS ks FROM c)
SELECT conv_id, turn, CAST({_strongest('said', _SHOWN)} AS DOUBLE) AS intensity, round(CAST({_moved(_moved('0.0', _HIT), _SHOWN)} AS DOUBLE), 6) AS valence, CASE WHEN len(ks) = 0 THEN 'neutral' ELSE array_to_string(ks, ',') END AS labels FROM f""")
def emotion_detect(spark: SparkSession, d: str) -> DataFrame:
    """The feelings of each turn and how strong they are."""
    f = S.feeling(F.col("text"))
    return _said(spark, d).select("conv_id", "turn", f["intensity"].alias("intensity"), F.round(f["valence"], 6).alias("valence"), F.array_join(f["labels"], ",").alias("labels"))


#: Sources of rows as they come: known, untidy, old, unknown, empty and none.
_CAME = "manual", " Session ", "tg", "collective", "", "mystery", None, "notion", "claude_code_hook"
_CAME_SQL = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in _CAME) + "]"


@query(f"""WITH r AS (SELECT doc_id AS id, {_CAME_SQL}[doc_id % 9 + 1] AS source, CASE WHEN doc_id % 18 = 6 THEN ' Telegram' END AS inner_, doc_id % 2 = 0 AS linked,
  [lang, CASE WHEN doc_id % 11 = 0 THEN 'Debug' WHEN doc_id % 13 = 0 THEN ' Ambient' ELSE source END] AS tags FROM documents),
n AS (SELECT *, lower(trim(coalesce(source, inner_))) AS name FROM r),
k AS (SELECT *, CASE WHEN len(list_filter(tags, lambda t: list_contains({_list(S.NO_EVENT)}, lower(t)))) > 0 THEN 'zero_event_artifact'
  WHEN linked AND list_contains({_list(S.SOURCES)}, source) THEN 'already_canonical' WHEN coalesce(name, '') = '' THEN 'null_or_empty'
  WHEN list_contains({_list(S.SOURCES)}, name) THEN CASE WHEN source IS NULL THEN 'dict_truncated' ELSE 'legacy_bare_string' END
  WHEN list_contains({_list(S.OLD_SOURCES)}, name) THEN 'deprecated_vocab' ELSE 'dict_invalid_type' END AS class FROM n)
SELECT id, class, CASE WHEN class IN ('zero_event_artifact', 'null_or_empty', 'dict_invalid_type') THEN 'gate1_unrecoverable' WHEN name = 'tg' THEN 'telegram' WHEN name = 'claude_code_hook' THEN 'claude-code-hook' ELSE name END AS recovered,
  CASE WHEN class = 'zero_event_artifact' THEN 'refuse_zero_event_artifact' WHEN class IN ('null_or_empty', 'dict_invalid_type') THEN 'refuse_gate1_failed'
  WHEN len(list_filter(tags, lambda t: list_contains({_list(S.ECHOES)}, lower(trim(t))))) > 0 THEN 'refuse_collective_echo' WHEN class = 'deprecated_vocab' THEN 'admit_deprecated_remapped'
  WHEN class = 'dict_truncated' THEN 'admit_recovered_dict' ELSE 'admit_known_source' END AS reason FROM k""")
def admission_gates(spark: SparkSession, d: str) -> DataFrame:
    """What is known of where each row came from, and whether it is let in."""
    i = F.col("doc_id")
    came = F.element_at(F.array(*(F.lit(c).cast("string") for c in _CAME)), (i % 9 + 1).cast("int"))
    tag = F.when(i % 11 == 0, "Debug").when(i % 13 == 0, " Ambient").otherwise(F.col("source"))
    r = table(spark, d, "documents").select(i.alias("id"), came.alias("came"), F.when(i % 18 == 6, " Telegram").alias("inner"), F.when(i % 2 == 0, F.array().cast("array<string>")).alias("parents"), F.array("lang", tag).alias("tags"))
    kind, source = S.provenance(F.col("came"), F.col("inner"), F.col("parents"), F.col("tags"), F.lit(False))
    r = r.select("id", "tags", kind.alias("class"), source.alias("recovered"))
    return r.select("id", "class", "recovered", S.admission(F.col("class"), F.col("recovered"), F.col("tags")).alias("reason"))


@query(f"WITH {MEMORIES_SQL}, f AS (SELECT id, access_count, least(1.0, round(CASE layer WHEN 'short-term' THEN 0.3 WHEN 'mid-term' THEN 0.5 ELSE 0.7 END + 0.3 * least(intensity, 10) / 10, 4)) AS first FROM mem) SELECT id, round(CAST(1 - (1 - first) * pow(0.98, access_count) AS DOUBLE), 6) AS importance FROM f")
def importance_init(spark: SparkSession, d: str) -> DataFrame:
    """The importance of each record after its uses."""
    return memories(spark, d).select("id", F.round(S.importance(F.col("layer"), F.col("intensity"), F.col("access_count")), 6).alias("importance"))


#: Tags as people write them.
_WRITTEN = "notes", "Family_Private", "sa​cred", "grıef", "personal‐history-2", "work.plan", "SACRÉD", "history"


@query(rf"""SELECT doc_id AS id, tag FROM (SELECT doc_id, {_list(_WRITTEN)}[doc_id % 8 + 1] AS tag FROM documents)
WHERE NOT regexp_matches(regexp_replace(replace(lower(strip_accents(tag)), 'ı', 'i'), '[-_. ‐' || chr(8203) || ']', '', 'g'), 'sacred|grief|familyprivate|personalhistory')""")
def owner_only_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records that a reader who is not the owner may see, however their tags are written."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("id"), F.element_at(F.array(*map(F.lit, _WRITTEN)), (i % 8 + 1).cast("int")).alias("tag"))
    return rows.where(~S.owner_only(F.array("tag"))).select("id", "tag")


@query("""WITH a AS (SELECT p_brand AS anchor, p_type AS emotion, round(avg(p_size) / 50, 4) AS w FROM part WHERE p_size >= 40 GROUP BY ALL),
m AS (SELECT l_orderkey AS id, p_type AS emotion, round(max(l_quantity) / 50, 4) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
aw AS (SELECT anchor, sum(w) AS w_all FROM a GROUP BY anchor), mw AS (SELECT id, sum(f) AS f_all FROM m GROUP BY id),
u AS (SELECT id, anchor, sum(least(w, f)) AS low, sum(greatest(coalesce(w, 0), coalesce(f, 0))) AS high FROM
  (SELECT p.id, p.anchor, e.emotion, a.w, m.f FROM (SELECT DISTINCT m.id, a.anchor FROM m JOIN a USING (emotion)) p, (SELECT DISTINCT emotion FROM a UNION SELECT DISTINCT emotion FROM m) e
   LEFT JOIN a ON a.anchor = p.anchor AND a.emotion = e.emotion LEFT JOIN m ON m.id = p.id AND m.emotion = e.emotion WHERE a.w IS NOT NULL OR m.f IS NOT NULL) x GROUP BY id, anchor),
l AS (SELECT id, anchor, sum(least(w, f)) AS low FROM m JOIN a USING (emotion) GROUP BY id, anchor),
s AS (SELECT id, anchor, round(0.7 * l.low / w_all + 0.3 * l.low / high, 6) AS score FROM l JOIN u USING (id, anchor) JOIN aw USING (anchor))
SELECT id, anchor, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, anchor) AS rank FROM s WHERE score >= 0.3 QUALIFY rank <= 3""")
def anchor_topology_match(spark: SparkSession, d: str) -> DataFrame:
    """The three brands whose large parts are most like an order's, by kind of part."""
    part = table(spark, d, "part")
    anchors = part.where("p_size >= 40").groupBy(F.col("p_brand").alias("anchor"), F.col("p_type").alias("emotion")).agg(F.round(F.avg("p_size") / 50, 4).alias("weight"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return M.anchors(lines.groupBy(F.col("l_orderkey").alias("id"), F.col("p_type").alias("emotion")).agg(F.round(F.max("l_quantity") / 50, 4).alias("weight")), anchors)


_SKILLS = "blue gear", "hot anvil economy", "widget promo bolt"


@query(f"""WITH {batch.REGISTERED['ledger_scores'][1].removeprefix('WITH ').rsplit('SELECT skill', 1)[0]}, bad AS (SELECT user_id % 200 AS skill, count(*) FILTER (WHERE event_type = 'error') > count(*) FILTER (WHERE event_type = 'purchase') AS worse FROM events GROUP BY ALL),
e AS (SELECT p_partkey AS path, lower(p_name) AS name, lower(p_type || ' ' || p_brand) AS descr, s.net, coalesce(s.followed >= 3 AND net < 0 AND worse, false) AS flagged FROM part LEFT JOIN s ON s.skill = p_partkey % 200 LEFT JOIN bad ON bad.skill = s.skill),
t AS (SELECT q AS query, unnest(string_split(q, ' ')) AS t, len(string_split(q, ' ')) AS n FROM (SELECT unnest({_list(_SKILLS)}) AS q)),
p AS (SELECT query, path, name, net, flagged, n, CASE WHEN list_contains(regexp_extract_all(name, '[a-z0-9]+'), t) THEN 3.0 WHEN len(list_filter(regexp_extract_all(name, '[a-z0-9]+'), lambda x: contains(x, t))) > 0 THEN 1.5 ELSE 0 END
  + CASE WHEN list_contains(regexp_extract_all(descr, '[a-z0-9]+'), t) THEN 1 + 0.25 * least(len(list_filter(regexp_extract_all(descr, '[a-z0-9]+'), lambda x: x = t)) - 1, 2) ELSE 0 END AS pts FROM e, t),
l AS (SELECT query, path, name, flagged, CAST(sum(pts) / any_value(n) AS DOUBLE) AS lex, any_value(coalesce(net, 0)) AS net FROM p GROUP BY ALL HAVING sum(pts) > 0)
SELECT query, path, round(lex * (1 + net / (abs(net) + 5)), 6) AS score, flagged AS anti_pattern, row_number() OVER (PARTITION BY query ORDER BY flagged, round(lex * (1 + net / (abs(net) + 5)), 6) DESC, name, path) AS rank FROM l QUALIFY rank <= 10""".replace("e AS (SELECT user_id", "ev AS (SELECT user_id", 1).replace("FROM e GROUP BY skill", "FROM ev GROUP BY skill", 1))
def skill_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best entries of each of three questions: matching words times the net of their ledger."""
    kind, skill = F.col("event_type"), (F.col("user_id") % 200).alias("skill")
    worse = table(spark, d, "events").groupBy(skill).agg((F.count_if(kind == "error") > F.count_if(kind == "purchase")).alias("worse"))
    ledger = batch.ledger_scores(spark, d).join(worse, "skill").select("skill", "net", ((F.col("followed") >= 3) & (F.col("net") < 0) & F.col("worse")).alias("anti_pattern"))
    entries = table(spark, d, "part").join(ledger, F.col("p_partkey") % 200 == F.col("skill"), "left")
    return M.skills(_SKILLS, entries.select(F.col("p_partkey").alias("path"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), "net", "anti_pattern"))


_HALF = "[1:32]"


def _knn_sql(name: str, part: str) -> str:
    return f"""{name}_s AS (SELECT query_id, id, round({search._COS}, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(unnest(q.embedding{part}) AS DOUBLE) AS a, CAST(unnest(v.embedding{part}) AS DOUBLE) AS b
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) GROUP BY query_id, id),
{name} AS (SELECT s.query_id, s.id, {search._TOP}, q.label = v.label AS hit FROM {name}_s s JOIN embeddings q ON q.vec_id = s.query_id JOIN embeddings v ON v.vec_id = s.id QUALIFY rank <= 10)"""


def _two_arms(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, arm, id, rank, hit): ten nearest by whole vectors and by their first halves, for every twentieth vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    def arm(name: str, e) -> DataFrame:
        rows = v.select("id", e.alias("embedding"))
        return R.top_k(R.nearest(rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), rows, 10), 10).select("query_id", F.lit(name).alias("arm"), "id", "rank")

    both = arm("whole", F.col("embedding")).unionAll(arm("half", F.slice("embedding", 1, 32)))
    label = v.select("id", "label")
    both = both.join(label, "id").join(label.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return both.select("query_id", "arm", "id", "rank", (F.col("label") == F.col("wanted")).alias("hit"))


_DRAWN = "('0x' || substring(md5(r || ':' || query_id), 1, 8))::BIGINT / 4294967296.0"
_TIMES = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in (0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589))


@query(f"""WITH {_knn_sql('a', '')}, {_knn_sql('b', _HALF)},
ra AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS rr FROM a GROUP BY query_id), rb AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS rr FROM b GROUP BY query_id),
f AS (SELECT query_id, CAST(ra.rr - rb.rr AS DOUBLE) AS diff FROM ra JOIN rb USING (query_id)), e AS (SELECT r, diff, {_DRAWN} AS u FROM f, (SELECT unnest(range(2000)) AS r)),
m AS (SELECT r, sum(w * diff) / sum(w) AS m FROM (SELECT r, diff, {_TIMES} AS w FROM e) WHERE w > 0 GROUP BY r), p AS (SELECT m, row_number() OVER (ORDER BY m, r) - 1 AS place FROM m),
b2 AS (SELECT round(min(m) FILTER (WHERE place = 50), 4) AS low, round(min(m) FILTER (WHERE place = 1949), 4) AS high FROM p),
t AS (SELECT count(*) AS n, round(avg(diff), 6) AS mean, count(*) FILTER (WHERE diff > 1e-12) AS wins, count(*) FILTER (WHERE diff < -1e-12) AS losses FROM f)
SELECT n, mean, low, high, wins, losses, low > 0 AND mean >= 0.05 AND wins > losses AS beats_noise FROM t, b2""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Whether whole vectors find equal labels earlier than their first halves do, beyond noise."""
    rr = _two_arms(spark, d).groupBy("query_id", "arm").agg(F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    diff = F.sum(F.when(F.col("arm") == "whole", F.col("rr")).otherwise(-F.col("rr")))
    return M.paired_delta(rr.groupBy("query_id").agg(diff.alias("diff")))


_WEIGHTS = 0.0, 0.5, 1.0, 2.0, 4.0


@query(f"""WITH {_knn_sql('a', '')}, {_knn_sql('b', _HALF)}, w AS (SELECT unnest({list(_WEIGHTS)}) AS weight),
s AS (SELECT weight, query_id, id, round(sum(x), 9) AS score, bool_or(hit) AS hit FROM (SELECT weight, query_id, id, CAST(1.0 AS DOUBLE) / (60 + rank) AS x, hit FROM a, w UNION ALL SELECT weight, query_id, id, CAST(weight AS DOUBLE) / (60 + rank), hit FROM b, w WHERE weight > 0) GROUP BY weight, query_id, id),
r AS (SELECT weight, query_id, hit, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, id) AS place FROM s),
q AS (SELECT weight, query_id, coalesce(1.0 / min(place) FILTER (WHERE hit), 0) AS rr, count(*) FILTER (WHERE hit AND place <= 5) / 5.0 AS p FROM r GROUP BY weight, query_id)
SELECT CAST(weight AS DOUBLE) AS weight, round(avg(CAST(rr AS DOUBLE)), 6) AS mrr, round(avg(CAST(p AS DOUBLE)), 6) AS precision_at_5 FROM q GROUP BY weight""")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank and precision at 5 of the two arms fused, for each weight of the second; weight 0 leaves it out."""
    rows = _two_arms(spark, d).withColumn("weight", F.explode(F.array(*map(F.lit, _WEIGHTS)))).where("arm = 'whole' or weight > 0")
    part = F.when(F.col("arm") == "half", F.col("weight")).otherwise(1.0) / (F.col("rank") + R.RRF_K)
    s = rows.groupBy("weight", "query_id", "id").agg(F.round(F.sum(part), 9).alias("score"), F.max("hit").alias("hit"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), "id")))
    q = s.groupBy("weight", "query_id").agg(F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("place"))), F.lit(0.0)).alias("rr"), (F.count_if(F.col("hit") & (F.col("place") <= 5)) / 5.0).alias("p"))
    return q.groupBy("weight").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("p"), 6).alias("precision_at_5"))


#: Agents are the brands whose parts a note is about.
_TURNS = rf"""turn AS (SELECT p_brand AS agent, id, text FROM note JOIN part ON p_partkey = id), tw AS (SELECT agent, id, regexp_extract_all(lower(text), '[a-z'']+') AS ws,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(regexp_extract_all(lower(s), '[a-z'']+'))), lambda k: k > 0) AS sizes FROM turn),
tm AS (SELECT *, len(ws) AS n_words FROM tw WHERE len(ws) > 0),
ms AS (SELECT agent, id, round(list_avg(sizes), 2) AS sentence_mean, {_per(S.PET_NAMES, 'pet')}, {_per(S.WE, '"we"')}, {_per(S.YOU, '"you"')}, {_per(S.PRESENT, 'present')} FROM tm),
mv AS (SELECT agent, id, unnest(['sentence_mean', 'pet', 'we', 'you', 'present']) AS measure, unnest([CAST(round(x * 1000) AS BIGINT) FOR x IN [sentence_mean, pet, "we", "you", present]]) AS value FROM ms),
st AS (SELECT agent, measure, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / {math.log(B._BASE)!r}::DOUBLE) AS INTEGER) ELSE -1 END AS bucket, count(*) AS n, sum(value)::HUGEINT AS total, sum(value::HUGEINT * value)::HUGEINT AS squares FROM mv GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER w AS upto, sum(n) OVER (PARTITION BY agent, measure) AS turns FROM st WINDOW w AS (PARTITION BY agent, measure ORDER BY bucket)),
md AS (SELECT agent, measure, min(bucket) FILTER (WHERE upto >= ceil(turns / 2.0)) AS mid, any_value(turns) AS turns, sum(total)::DOUBLE AS total, sum(squares)::DOUBLE AS squares FROM cu GROUP BY agent, measure),
bl AS (SELECT agent, measure, CAST(turns AS BIGINT) AS turns, round(total / turns / 1000, 6) AS mean, round(CASE WHEN turns > 1 THEN sqrt(greatest(squares - total * total / turns, 0) / (turns - 1)) / 1000 ELSE 0 END, 6) AS spread,
  round(CASE WHEN mid < 0 THEN 0.0 ELSE pow({B._BASE!r}::DOUBLE, mid) * 2 / ({B._BASE!r}::DOUBLE + 1) / 1000 END, 6) AS median FROM md),
us AS (SELECT *, CASE WHEN turns < {B.LEAST_TURNS} THEN CASE measure {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in S.USUAL.items())} END WHEN measure = '{B.PACE}' THEN median ELSE greatest(mean, {B.FLOOR}) END AS usual FROM bl)"""


def _agents(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("agent")), "id").select("agent", "id", "text")


@query(f"WITH {NOTES_SQL}, {_TURNS} SELECT agent, measure, turns, mean, spread, median, usual FROM us")
def turn_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What is usual in the notes of each brand: means, spreads, and medians from a sketch, of two states that were added up."""
    turns = B.measured(_agents(spark, d))
    return B.baseline(B.merged(B.state(turns.where("value % 2 = 0")), B.state(turns.where("value % 2 <> 0"))))


@query(f"""WITH {NOTES_SQL}, {_TURNS}, ow AS (SELECT agent, {', '.join(f"max(usual) FILTER (WHERE measure = '{k}') AS usual_{k}" for k in S.USUAL)} FROM us GROUP BY agent)
SELECT agent, id, {' + '.join(f'CAST("{k}" >= usual_{k} * 2.0 AS INTEGER)' for k in S.USUAL if k != B.PACE)} AS raised, {B.PACE} > 0 AND {B.PACE} <= usual_{B.PACE} * 0.65 AS short FROM ms JOIN ow USING (agent)""")
def raised_turns(spark: SparkSession, d: str) -> DataFrame:
    """Which notes stand out from their own brand's baseline."""
    turns = _agents(spark, d)
    return B.raised(turns, B.baseline(B.state(B.measured(turns))))
