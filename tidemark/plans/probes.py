"""Typed probes of questions, looked up type by type, and projections of what a group of texts holds by profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import positions as P
from ..sources.tables import NOTES_SQL, cut, notes, table
from .extract import CITATION, CLAIM_CHARS, CLAIM_MARKERS, ENTITY

REGISTERED: dict = {}
#: Kinds of what a text holds, each after the one that outweighs it, with the weight of a hit; semantic probes of a question; hits of a probe. Fixed values.
WEIGHTS = {"citation": 5, "claim": 4, "section": 3, "entity": 2}
SEMANTIC, HITS = 4, 10
#: What makes a probe a citation, and numbers of sections that stand alone. Fixed values.
LEGAL = r"(?i)(?:\b(?:u\.?s\.?c\.?|c\.?f\.?r\.?|u\.?c\.?c\.?))|§|\b\d+-\d+[A-Za-z0-9\-]*\b"
BARE = r"\b\d+-\d+[A-Za-z0-9-]*\b"


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def found(text: Column) -> Column:
    """All (kind, value) of a text, in order: citations, headings, names, and sentences that state or demand something."""
    all_ = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), F.trim(v).alias("value")))
    sentences = F.transform(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " ")))
    claims = F.filter(sentences, lambda s: (F.char_length(s) >= CLAIM_CHARS) & F.regexp_like(F.lower(s), F.lit("|".join(CLAIM_MARKERS))))
    names = F.filter(all_(ENTITY), lambda s: (F.char_length(s) >= 4) & ~F.regexp_like(F.lower(s), F.lit("^(section|tags) ")))
    return F.concat(kind("citation", all_(CITATION)), kind("section", all_(r"(?m)^#{1,6}[ \t]+([^\n]+)$", 1)), kind("entity", names), kind("claim", claims))


_FOUND_SQL = rf"""raw AS (SELECT id, 'citation' AS kind, unnest(regexp_extract_all(text, '{CITATION}')) AS value FROM note
  UNION ALL SELECT id, 'section', unnest(regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+([^\n]+)$', 1)) FROM note
  UNION ALL SELECT id, 'entity', unnest(list_filter(regexp_extract_all(text, '{ENTITY}'), lambda s: len(s) >= 4 AND NOT regexp_matches(lower(s), '^(section|tags) '))) FROM note
  UNION ALL SELECT id, 'claim', unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\n\r]+', ' ', 'g'))), lambda s: len(s) >= {CLAIM_CHARS} AND regexp_matches(lower(s), '{"|".join(CLAIM_MARKERS)}'))) FROM note),
item AS (SELECT DISTINCT id, kind, trim(value) AS value FROM raw)"""
_WORDS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def probes(questions: DataFrame) -> DataFrame:
    """(query_id, kind, probe): what a question (query_id, text) is looked up by, kind by kind.

    Citations and section numbers are looked up among citations and sections, the question itself where it has none. Claims
    and names are looked up by the question and its names of several words, the first SEMANTIC of them.
    """
    text = F.col("text")
    held = found(text)
    of = lambda kind: F.transform(F.filter(held, lambda x: x["kind"] == kind), lambda x: x["value"])
    bare = F.when(F.lower(text).contains("ucc"), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(BARE), F.lit(0)), lambda s: F.array(F.concat(F.lit("UCC "), s), F.concat(F.lit("§ "), s))))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(F.trim(text)), of("citation"), of("entity"), of("section"), bare)
    kept = F.filter(every, lambda p: F.char_length(p) >= 3)
    once = F.filter(kept, lambda p, i: F.array_position(F.transform(kept, lambda x: F.lower(x)), F.lower(p)) == i + 1)
    rows = questions.select("query_id", F.trim("text").alias("text"), once.alias("all"))
    legal = F.filter("all", lambda p: F.regexp_like(p, F.lit(LEGAL)))
    loose = F.filter("all", lambda p: ~F.regexp_like(p, F.lit(LEGAL)) & (F.size(F.split(p, r"\s+")) > 1))
    near = F.slice(F.array_distinct(F.concat(F.array("text"), loose)), 1, SEMANTIC)
    typed = rows.select("query_id", F.when(F.size(legal) > 0, legal).otherwise(F.array("text")).alias("legal"), near.alias("near"))
    each = [typed.select("query_id", F.lit(kind).alias("kind"), F.explode("legal" if kind in ("citation", "section") else "near").alias("probe")) for kind in WEIGHTS]
    return reduce(DataFrame.unionAll, each)


def probe_hits(asked: DataFrame, items: DataFrame, hits: int = HITS) -> DataFrame:
    """(query_id, id, weight, kinds): rows that hold something (id, kind, value) in which a probe (query_id, kind, probe) occurs as a run of words.

    Distinct probes meet distinct values of their kind, and a probe keeps its first `hits` rows before it goes back to the
    questions that share it. They are among the first `hits` rows of each value, so a value that a third of all rows hold is
    cut to a bound before it is joined with probes. A row found by several kinds has the highest weight, and lists all.
    """
    values = items.select("kind", "value").distinct().withColumn("id", F.xxhash64("kind", "value"))
    docs = values.select("id", F.col("kind").alias("field"), _words(F.col("value")).alias("words"))
    want = asked.select("kind", "probe").distinct().withColumn("phrase", _words(F.col("probe"))).where(F.size("phrase") > 0)
    met = want.join(P.phrase_counts(docs, want.select("phrase")).select("phrase", F.col("field").alias("kind"), F.col("id").alias("vid")), ["phrase", "kind"]).select("kind", "probe", "vid")
    # the first rows of a probe are among the first rows of each value that it meets
    place = F.row_number().over(Window.partitionBy("kind", "vid").orderBy("id"))
    held = items.select("kind", F.xxhash64("kind", "value").alias("vid"), "id").distinct().withColumn("nth", place).where(F.col("nth") <= hits).drop("nth")
    rows = met.join(held, ["kind", "vid"]).select("kind", "probe", "id").distinct()
    nth = F.row_number().over(Window.partitionBy("kind", "probe").orderBy("id"))
    first = cut(rows.withColumn("nth", nth).where(F.col("nth") <= hits).select("kind", "probe", "id"))
    weight = F.element_at(F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p)), F.col("kind"))
    return asked.join(first, ["kind", "probe"]).groupBy("query_id", "id").agg(F.max(weight).alias("weight"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query(rf"""WITH {NOTES_SQL}, {_FOUND_SQL}, q AS (SELECT id AS query_id, trim(text) AS text FROM note WHERE id % 7 = 0),
r0 AS (SELECT query_id, 0 AS part, 0 AS pos, text AS p FROM q
  UNION ALL SELECT query_id, 1, unnest(range(len(x))), unnest(x) FROM (SELECT query_id, regexp_extract_all(text, '{CITATION}') AS x FROM q)
  UNION ALL SELECT query_id, 2, unnest(range(len(x))), unnest(x) FROM (SELECT query_id, list_filter(regexp_extract_all(text, '{ENTITY}'), lambda s: len(s) >= 4 AND NOT regexp_matches(lower(s), '^(section|tags) ')) AS x FROM q)
  UNION ALL SELECT query_id, 3, unnest(range(len(x))), unnest(x) FROM (SELECT query_id, regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+([^\n]+)$', 1) AS x FROM q)
  UNION ALL SELECT query_id, 4, unnest(range(len(x))), unnest(x) FROM (SELECT query_id, flatten(list_transform(regexp_extract_all(text, '{BARE}'), lambda s: ['UCC ' || s, '§ ' || s])) AS x FROM q WHERE contains(lower(text), 'ucc'))),
r AS (SELECT query_id, trim(p) AS probe, part, pos FROM r0 WHERE len(trim(p)) >= 3 QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(p)) ORDER BY part, pos) = 1),
legal AS (SELECT query_id, probe FROM r WHERE regexp_matches(probe, '{LEGAL}') UNION ALL SELECT query_id, text FROM q WHERE query_id NOT IN (SELECT query_id FROM r WHERE regexp_matches(probe, '{LEGAL}'))),
near AS (SELECT query_id, probe FROM (SELECT r.query_id, probe, part, pos FROM r JOIN q USING (query_id) WHERE probe <> q.text AND NOT regexp_matches(probe, '{LEGAL}') AND len(regexp_split_to_array(probe, '\s+')) > 1
  UNION ALL SELECT query_id, text, -1, 0 FROM q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, pos) <= {SEMANTIC}),
asked AS (SELECT query_id, unnest(['citation', 'section']) AS kind, probe FROM legal UNION ALL SELECT query_id, unnest(['claim', 'entity']), probe FROM near),
w AS (SELECT DISTINCT kind, probe, ' ' || array_to_string({_WORDS_SQL.format('probe')}, ' ') || ' ' AS s FROM asked), v AS (SELECT id, kind, ' ' || array_to_string({_WORDS_SQL.format('value')}, ' ') || ' ' AS s FROM item),
h AS (SELECT kind, probe, id FROM (SELECT DISTINCT w.kind, w.probe, v.id FROM w JOIN v ON v.kind = w.kind AND contains(v.s, w.s) WHERE w.s <> '  ') QUALIFY row_number() OVER (PARTITION BY kind, probe ORDER BY id) <= {HITS})
SELECT query_id, id, CAST(max(CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items())} END) AS INTEGER) AS weight, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM asked JOIN h USING (kind, probe) GROUP BY query_id, id""")
def structured_probes(spark: SparkSession, d: str) -> DataFrame:
    """Notes found by the citations, sections, claims and names of every seventh note. Questions of one text are looked up once."""
    n = cut(notes(spark, d).select("id", "text"))
    items = n.select("id", F.inline(found(F.col("text")))).distinct()
    questions = n.where("id % 7 = 0").select(F.col("id").alias("asked_by"), "text")
    once = cut(questions.groupBy("text").agg(F.min("asked_by").alias("query_id")))
    answers = cut(probe_hits(probes(once), items))
    same = questions.join(once, "text").select("query_id", "asked_by")
    return same.join(answers, "query_id").select(F.col("asked_by").alias("query_id"), "id", "weight", "kinds")


#: Of each profile: how many of each kind are kept, the fewest that its own rule must leave before others fill up, and markers of what the rule keeps. Fixed values.
LIMITS = {
    "legal": {"citation": 128, "section": 32, "entity": 72, "claim": 48}, "reference": {"citation": 48, "section": 56, "entity": 96, "claim": 72},
    "workflow": {"citation": 24, "section": 48, "entity": 80, "claim": 96}, "default": {"citation": 96, "section": 64, "entity": 192, "claim": 160},
}
FLOORS = {"legal": {"section": 1, "entity": 16, "claim": 12}, "reference": {"section": 16, "entity": 24, "claim": 20}, "workflow": {"section": 16, "entity": 16, "claim": 20}}
MARKERS = {
    ("legal", "entity"): "ucc u.s.c usc c.f.r cfr postal treasury treasurydirect trust court clerk debtor creditor secured lien levy notary executor bank state".split() + ["internal revenue", "united states"],
    ("legal", "claim"): "shall must may holder debtor secured trust court jurisdiction service levy lien notary executor affidavit notice claim rebut postal treasury §".split() + [" ucc ", " usc ", " cfr "],
    ("legal", "section"): "section article chapter notice demand claim affidavit jurisdiction service levy lien trust executor postal treasury ucc".split(),
    ("reference", "entity"): "api sdk tool service endpoint platform framework registry template guide reference library".split(),
    ("reference", "claim"): "supports provides includes allows returns uses requires endpoint parameter configuration template reference".split(),
    ("reference", "section"): "overview usage reference api configuration example examples template parameter tool endpoint".split(),
    ("workflow", "entity"): "step agent service queue task workflow process pipeline job stage state trigger".split(),
    ("workflow", "claim"): "step run execute verify check start stop restart schedule route complete handoff pipeline workflow".split(),
    ("workflow", "section"): "step workflow process runbook procedure checklist setup verification operation routing".split(),
}
WEIGHTY_NAMES = "ucc usc cfr trust court bank postal credit debtor secured treasurydirect treasury".split()
WEIGHTY_CLAIMS = "shall must may holder debtor secured trust court jurisdiction service levy lien".split()
_TITLED = ("legal", "entity"), ("reference", "entity")
_ORDER = {k: i for i, k in enumerate(("citation", "section", "entity", "claim"))}
BUDGETS = 12, 60


def _kept(value: Column, profile: str, kind: str) -> Column:
    """Whether a profile's own rule keeps a value."""
    if (profile, kind) not in MARKERS:
        return F.lit(True)
    low = F.concat(F.lit(" "), F.lower(value), F.lit(" "))
    rule = reduce(lambda a, b: a | b, (low.contains(m) for m in MARKERS[profile, kind]))
    if (profile, kind) in _TITLED:
        rule = rule | (F.regexp_like(value, F.lit("[A-Z]")) & (F.size(F.split(F.trim(value), r"\s+")) >= 2))
    return rule & ~F.startswith(F.lower(value), F.lit(f"generic {kind}")) if profile != "legal" and kind != "section" else rule


def projected(items: DataFrame, profiles: tuple[str, ...] = tuple(LIMITS), budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(profile, budget, grp, kind, place, value): what a group keeps of its items (grp, kind, value, at) under a profile's limits and a budget.

    Within a kind, what the profile's rule keeps goes before what fills up while the rule leaves fewer than its floor; names
    and claims go by weight, citations and sections by first occurrence. Equal values of a group count once, whatever
    their case. A budget is shared: each kind has its share of it by the limits, and what a kind leaves is dealt to the
    others in turn. Windows are those of one group, cut at the limit of its kind before they are sorted whole.
    """
    rows = items.where(F.char_length("value") >= 3).groupBy("grp", "kind", F.lower("value").alias("key")).agg(F.min(F.struct("at", "value")).alias("x")).select("grp", "kind", "key", "x.at", "x.value")
    titled = (F.regexp_like("value", F.lit("[A-Z]")) & (F.size(F.split("value", r"\s+")) > 1)).cast("int")
    name = reduce(lambda a, b: a | b, (F.col("key").contains(m) for m in WEIGHTY_NAMES)).cast("int") * 2 + titled
    claim = reduce(lambda a, b: a + b, (F.col("key").contains(m).cast("int") for m in WEIGHTY_CLAIMS))
    first = F.when(F.col("kind") == "entity", name).when(F.col("kind") == "claim", claim).otherwise(F.lit(0))
    second = F.when(F.col("kind") == "entity", F.size(F.split("value", r"\s+"))).when(F.col("kind") == "claim", F.char_length("value")).otherwise(F.lit(0))
    rows = cut(rows.withColumn("first", first).withColumn("second", second))
    out = []
    for profile in profiles:
        limit, floor, kept = (F.lit(v) for v in (0, 0, True))
        for kind in _ORDER:
            limit = F.when(F.col("kind") == kind, LIMITS[profile][kind]).otherwise(limit)
            floor = F.when(F.col("kind") == kind, min(FLOORS.get(profile, {}).get(kind, 0), LIMITS[profile][kind])).otherwise(floor)
            kept = F.when(F.col("kind") == kind, _kept(F.col("value"), profile, kind)).otherwise(kept)
        marked = rows.withColumn("kept", kept)
        counts = marked.groupBy("grp", "kind").agg(F.count_if("kept").alias("own"))
        marked = marked.join(counts, ["grp", "kind"]).withColumn("short", F.col("own") < floor).where("kept or short")
        by_kept = F.col("kept") & ~((F.col("kind") == "section") & F.col("short"))  # sections fill up in their own order
        ranked = F.col("kind").isin("entity", "claim")
        w = Window.partitionBy("grp", "kind").orderBy(F.desc(by_kept), F.desc("first"), F.desc("second"), F.when(ranked, F.col("key")).desc_nulls_last(), "at", "key")
        placed = marked.withColumn("place", F.row_number().over(w)).withColumn("limit", limit).where(F.col("place") <= F.col("limit"))
        whole = sum(LIMITS[profile].values())
        for budget in budgets:
            over = F.greatest(F.col("place") - F.floor(F.lit(budget) * F.col("limit") / whole), F.lit(0))
            turn = F.row_number().over(Window.partitionBy("grp").orderBy(over, F.element_at(F.create_map(*(F.lit(x) for p in _ORDER.items() for x in p)), F.col("kind")), "place"))
            out.append(placed.withColumn("turn", turn).where(F.col("turn") <= budget).select(F.lit(profile).alias("profile"), F.lit(budget).alias("budget"), "grp", "kind", "place", "value"))
    return reduce(DataFrame.unionAll, out)


def _projection_sql() -> str:
    has = lambda words, of: "(" + " OR ".join(f"contains({of}, '{w}')" for w in words) + ")"
    rules = []
    for (profile, kind), words in MARKERS.items():
        rule = has(words, "' ' || key || ' '")
        if (profile, kind) in _TITLED:
            rule = f"({rule} OR (regexp_matches(value, '[A-Z]') AND len(regexp_split_to_array(value, '\\s+')) >= 2))"
        if profile != "legal" and kind != "section":
            rule += f" AND NOT starts_with(key, 'generic {kind}')"
        rules.append(f"WHEN profile = '{profile}' AND kind = '{kind}' THEN {rule}")
    limits = ", ".join(f"('{p}', '{k}', {n}, {min(FLOORS.get(p, {}).get(k, 0), n)}, {sum(ls.values())}, {_ORDER[k]})" for p, ls in LIMITS.items() for k, n in ls.items())
    claim = " + ".join(f"CASE WHEN contains(key, '{m}') THEN 1 ELSE 0 END" for m in WEIGHTY_CLAIMS)
    return f"""l(profile, kind, lim, floor_, whole, no) AS (VALUES {limits}),
once AS (SELECT grp, kind, lower(value) AS key, arg_min(value, (pos, value)) AS value, min(pos) AS pos FROM it WHERE len(value) >= 3 GROUP BY grp, kind, lower(value)),
s AS (SELECT *, CASE kind WHEN 'entity' THEN CASE WHEN {has(WEIGHTY_NAMES, 'key')} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(value, '[A-Z]') AND contains(value, ' ') THEN 1 ELSE 0 END WHEN 'claim' THEN {claim} ELSE 0 END AS first,
  CASE kind WHEN 'entity' THEN len(regexp_split_to_array(value, '\\s+')) WHEN 'claim' THEN len(value) ELSE 0 END AS second FROM once),
m AS (SELECT *, CASE {' '.join(rules)} ELSE true END AS kept FROM s JOIN l USING (kind)),
c AS (SELECT *, count(*) FILTER (WHERE kept) OVER (PARTITION BY profile, grp, kind) < floor_ AS short FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY profile, grp, kind ORDER BY kept AND NOT (kind = 'section' AND short) DESC, first DESC, second DESC, CASE WHEN kind IN ('entity', 'claim') THEN key END DESC NULLS LAST, pos, key) AS place FROM c WHERE kept OR short),
b AS (SELECT *, unnest({list(BUDGETS)}) AS budget FROM p WHERE place <= lim)
SELECT profile, budget, grp, kind, CAST(place AS INTEGER) AS place, value FROM b QUALIFY row_number() OVER (PARTITION BY profile, budget, grp ORDER BY greatest(place - floor(budget * lim / whole), 0), no, place) <= budget"""


@query(f"WITH {NOTES_SQL}, {_FOUND_SQL}, it AS (SELECT p_brand AS grp, kind, value, id AS pos FROM item JOIN part ON p_partkey = id), {_projection_sql()}")
def projections(spark: SparkSession, d: str) -> DataFrame:
    """What the notes of each brand keep under each profile, with a small and a large budget."""
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"))
    items = notes(spark, d).select("id", F.inline(found(F.col("text")))).distinct().join(brand, "id")
    return projected(items.select("grp", "kind", "value", F.col("id").alias("at")))
