"""Document fingerprints by consistent weighted sampling, with DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, identified, materialise

#: Samples of a fingerprint, and hex digits of each.
SAMPLES, DIGITS = 48, 4
#: Ranges of documents for each shuffle partition.
RANGES = 4


def _uniform(h: Column, at: int, bits: int) -> Column:
    """A number between 0 and 1 from some bits of a hash."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def _variates(term: Column, i: int) -> tuple[Column, Column, Column]:
    """(r, ln c, b) of the i-th sample at a term: r and c from Gamma(2, 1), b uniform, all fixed by two hashes of the term."""
    g, h = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    return -F.ln(_uniform(g, 0, 24) * _uniform(g, 24, 24)), F.ln(-F.ln(_uniform(h, 0, 32) * _uniform(h, 32, 32))), _uniform(g, 48, 16)


def _sample(term: Column, log_weight: Column, i: int) -> Column:
    """ln a of the i-th sample at a term: the least over the terms of a document is its sample.

    With t = floor(ln w / r + b): ln y = r (t - b) and ln a = ln c - ln y - r. Two documents have the same least with a
    probability of their generalised Jaccard similarity, and the value itself names the term and t.
    """
    r, log_c, b = _variates(term, i)
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def words(text: Column) -> Column:
    """The lower-case strings between spaces, tabs and line ends; '' between two of those."""
    for x in ("\n", "\t", "\r"):
        text = F.replace(text, F.lit(x), F.lit(" "))
    return F.split(F.lower(text), " ")


def signatures(weights: DataFrame, keys: list[str], columns: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """(*keys, fingerprints): from rows (*keys, term, weights), a fingerprint of DIGITS hex digits a sample for each weight.

    columns: the name of the fingerprint of each weight column. A weight of 0 leaves the term out; without any term the
    fingerprint is null.
    """
    rows = weights.select(*keys, "term", *(F.ln(F.col(w).cast("double")).alias(w) for w in columns))
    least = rows.groupBy(*keys).agg(*(F.min(_sample(F.col("term"), F.col(w), i)).alias(f"{w}_{i}") for i in range(samples) for w in columns))
    digits = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0"))
    return least.select(*keys, *(F.when(F.col(f"{w}_0").isNotNull(), F.concat(*(digits(f"{w}_{i}") for i in range(samples)))).alias(name) for w, name in columns.items()))


def no_words(samples: int = SAMPLES) -> Column:
    """The fingerprint of texts without a word."""
    return F.lit("0" * DIGITS * samples)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree: an estimate of generalised Jaccard similarity."""
    same = [(F.substring(a, 1 + DIGITS * i, DIGITS) == F.substring(b, 1 + DIGITS * i, DIGITS)).cast("int") for i in range(samples)]
    return sum(same[1:], same[0]).cast("double") / float(samples)


def cws_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): a row for each doc_id and text; null and empty texts have the fingerprint of no words.

    Terms are words, weighted by how often they occur. A null doc_id stays null; rows that share a doc_id are told apart
    by their texts, and rows that share both give one row.
    """
    parts = identified(docs, id_col, text_col).dropDuplicates(["k", "t"])
    terms = parts.select("k", "t", F.explode(words(F.col("text"))).alias("word")).groupBy("k", "t", F.xxhash64("word").alias("term")).agg(F.count_if(F.col("word") != "").alias("weight"))
    marks = signatures(terms, ["k", "t"], {"weight": "fingerprint"}, samples)
    return marks.select(id_of(F.col("k")).alias("doc_id"), F.coalesce("fingerprint", no_words(samples)).alias("fingerprint"))


def ranged(rows: DataFrame, parts: int) -> tuple[Column, list[int]]:
    """The range of each row (k, t, text), ascending in k and descending in t, and the ranges' cuts in k; at most `parts` of like size in bytes.

    The cuts are quantiles of k, in which a row counts once for each mean length that its text has. A k that is a
    quantile several times holds several ranges by itself; its rows are dealt to these by t, the hash of their texts.
    """
    size = F.octet_length("text")
    mean = rows.agg(F.avg(size)).first()[0]
    if mean is None or parts < 2:
        return F.lit(0), []
    copies = rows.select("k", F.explode(F.sequence(F.lit(1), F.ceil((size + 1) / max(1.0, mean)).cast("int"))).alias("copy"))
    cuts = sorted(copies.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 100 * parts)).first()[0])
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("k")))
    if own := {c: n for c, n in Counter(cuts).items() if n > 1}:
        n = F.try_element_at(F.create_map(*(F.lit(x) for p in own.items() for x in p)), F.col("k"))
        up = F.least(n - 1, F.floor((F.col("t").cast("double") / float(1 << 64) + 0.5) * n)).cast("int")
        part = part + F.coalesce(n - 1 - up, F.lit(0))
    return part, cuts


def with_next(rows: DataFrame, parts: int) -> DataFrame:
    """(part, n, k, text, next_k, next_n, next_part, next_text) of rows (k, t, text): each row beside its next.

    The order is by descending k, then by t; next to the last row is the first. Rows are dealt to ranged() parts and
    numbered (n) in each. Only the first (k, t) of each range comes to the driver, to link it with the range above.
    """
    part, _ = ranged(rows, parts)
    placed = rows.select(part.alias("part"), "k", "t", "text")
    heads = placed.groupBy("part").agg(F.min(F.struct((-F.col("k")).alias("down"), "t")).alias("head")).orderBy(F.desc("part")).collect()
    links = [(above["part"], own["part"], -own["head"]["down"], own["head"]["t"]) for above, own in zip(heads, heads[1:] + heads[:1], strict=True)]
    links = rows.sparkSession.createDataFrame(links, "part int, end_part int, end_k long, end_t long")
    firsts = rows.join(F.broadcast(links.select(F.col("end_k").alias("k"), F.col("end_t").alias("t"))), ["k", "t"], "left_semi").groupBy("k", "t").agg(F.min("text").alias("end_text"))
    ends = links.join(firsts, (F.col("k") == F.col("end_k")) & (F.col("t") == F.col("end_t"))).select("part", "end_k", "end_part", "end_text")
    w = Window.partitionBy("part").orderBy(F.desc("k"), F.asc("t"))
    out = placed.select("part", "k", "text", F.row_number().over(w).alias("n"), F.lead("k").over(w).alias("next_k"), F.lead("text").over(w).alias("next_text"))
    out = out.join(ends.hint("shuffle_hash"), "part", "left")
    inside = F.col("next_k").isNotNull()
    pick = lambda a, b: F.when(inside, a).otherwise(b)
    return out.select("part", "n", "k", "text", pick(F.col("next_k"), F.col("end_k")).alias("next_k"), pick(F.col("n") + 1, F.lit(1)).alias("next_n"), pick(F.col("part"), F.col("end_part")).alias("next_part"), pick(F.col("next_text"), F.col("end_text")).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): a row for each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document in descending doc_id (after the last: the first). Null texts count as empty and a null doc_id as the
    largest; rows that share a doc_id follow each other by a hash of their texts. A single document is its own next. An
    empty table gives an empty one. Texts are shuffled once, by ranges of like size; their terms are counted where they
    lie, and what each row comes to is written once to the shared folder, from where its fingerprint is read for the row
    before, too.
    """
    rows = identified(docs, id_col, text_col)
    both = with_next(rows, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    first = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    both = both.withColumn("edited", F.concat(first, F.substring(F.col("next_text"), F.lit(1), half)))
    told = both.select("part", "n", "k", "next_part", "next_n", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # words before the last break of the first half are in both texts: flag 3; the rest of the text has 1, of the edited one 2
    split = both.select("part", "n", words(F.col("text")).alias("own"), words(F.col("edited")).alias("other"), (F.size(words(first)) - 1).alias("shared"))
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))
    runs = F.array(*(F.struct(F.lit(flag).alias("flag"), a.alias("words")) for flag, a in ((3, F.slice("own", F.lit(1), F.col("shared"))), (1, rest("own")), (2, rest("other")))))
    terms = split.select("part", "n", F.explode(runs).alias("run")).select("part", "n", "run.flag", F.explode("run.words").alias("word"))
    flag = F.when(F.col("word") != "", F.col("flag")).otherwise(0)
    weights = terms.select("part", "n", F.xxhash64("word").alias("term"), flag.bitwiseAND(F.lit(1)).alias("w"), F.shiftright(flag, 1).alias("e"))
    weights = weights.groupBy("part", "n", "term").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    marks = signatures(weights, ["part", "n"], {"w": "fingerprint", "e": "edited_fingerprint"}, samples)
    marks = marks.select("part", "n", *(F.coalesce(c, no_words(samples)).alias(c) for c in ("fingerprint", "edited_fingerprint")))
    marked, _ = materialise(told.join(marks, ["part", "n"]), "marks")
    follow = marked.select(F.col("part").alias("next_part"), F.col("n").alias("next_n"), F.col("fingerprint").alias("next_fingerprint"))
    out = marked.join(follow, ["next_part", "next_n"])
    return out.select(
        id_of(F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
