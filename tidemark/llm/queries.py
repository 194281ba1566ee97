"""The registered query of each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, language, line_dedup, packing, pii, quality, resampling, simhash, stream_dedup, suffix_dedup, unigram, warc, weighted_minhash
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
#: The vocabulary of op8; on a cluster, a place that the driver can read.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_pseudonyms(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.stream_exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unigram.encode_pieces(table(spark, sf_dir, "documents"), PIECES)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "exact")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, false) AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


OP3_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
named AS (SELECT doc_id, place, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM split),
full_ AS (SELECT doc_id, place, bare, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM named WHERE bare <> ''),
pairs AS (SELECT doc_id, i, bare AS a, lead(bare) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM full_),
later AS (
  SELECT doc_id, i, 2 AS n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS seen FROM pairs WHERE b IS NOT NULL) WHERE seen > 1
  UNION ALL
  SELECT doc_id, i, 1 FROM (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY doc_id, i) AS seen FROM full_
    WHERE len(list_filter(regexp_split_to_array(bare, '\s+'), lambda x: x <> '')) >= 50) WHERE seen > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later),
dead AS (SELECT f.doc_id, f.place, f.i FROM full_ f JOIN gone g ON f.doc_id = g.doc_id AND f.i = g.i),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR i <> before + 1) AS n_runs
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM dead) GROUP BY doc_id),
kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.place) AS text FROM named n LEFT JOIN dead d ON n.doc_id = d.doc_id AND n.place = d.place WHERE d.place IS NULL GROUP BY n.doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM full_ GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

#: The table of crc32 is made from its polynomial, and each word's from the bytes of its hexadecimal form.
OP12_SQL = r"""
WITH RECURSIVE bits(i, c, step) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE step = 8),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY doc_id, word),
vocab AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM b)),
coded AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(x) // 2), lambda j: (16 * (instr('0123456789ABCDEF', x[2 * j + 1]) - 1) + instr('0123456789ABCDEF', x[2 * j + 2]) - 1)::BIGINT)),
  lambda c, y: xor(c >> 8, l[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocab, tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN coded USING (word) GROUP BY bucket),
gains AS (SELECT i AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE)
  / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
sums AS (SELECT doc_id, sum(n * gain)::BIGINT AS g, sum(n)::BIGINT AS n FROM dw JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (SELECT w.doc_id, len(words)::BIGINT AS n_features, CASE WHEN sums.n IS NULL THEN 0 ELSE (g - ((g % sums.n) + sums.n) % sums.n) // sums.n END::BIGINT AS weight FROM w LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM d) GROUP BY doc, lang, source, term),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT c.lang, source, c.term, sum(c.n)::HUGEINT AS n FROM c JOIN kept USING (lang, term) GROUP BY c.lang, source, c.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, 1 + (1000000000 * (coalesce(own.n, 0) + 2)) // (coalesce(totals.total, 0) + 2 * v.v) AS p,
  1 + (1000000000 * (kept.n + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.lang = a.lang AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
told AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM told) WHERE rank <= 10)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""


def queries() -> dict[str, Query]:
    all_ = op1_quality, op2_pii, op3_line_dedup, op4_exact_dedup, op5_simhash, op6_language, op7_packing, op8_sentencepiece, op9_suffix_dedup, op10_cws, op11_warc, op12_resampling, op13_divergence
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op11_warc": OP11_SQL, "op12_resampling": OP12_SQL, "op13_divergence": OP13_SQL}
