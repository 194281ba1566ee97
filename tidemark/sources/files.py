"""Sources and sinks of records: JSON files, event logs, notes, chat exports; merges and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of record fields, and what an unknown one is read as. Fixed values.
LAYERS, DEFAULT_LAYER = ("short-term", "mid-term", "long-term"), "short-term"
RECORD = (
    "id string, created_at string, layer string, title string, content string, tags array<string>, source string, context_tag string, "
    "parent_id string, valid_from string, valid_to string, supersedes_id string, schema_version int, emotional struct<intensity: double, valence: double>, broken string"
)
EVENT = "id string, skill string, version string, event string, at string, effect string, session string, source string, broken string"


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a folder tree with a JSON file for each record.

    An unknown layer is read as the first one and its own word kept in unknown_layer; a missing version is 1; a time that
    does not parse is null, so a bad end means open. Files that are no JSON, or lack id or content, are rejected with
    their path.
    """
    rows = spark.read.schema(RECORD).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    bad = F.col("broken").isNotNull() | F.col("id").isNull() | F.col("content").isNull()
    known = F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False))
    at = lambda c: F.try_to_timestamp(F.col(c))
    good = rows.where(~bad).select(
        "id", "title", "content", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "source", "context_tag", "parent_id", "supersedes_id", "emotional",
        F.when(known, F.col("layer")).otherwise(DEFAULT_LAYER).alias("layer"), F.when(~known, F.col("layer")).alias("unknown_layer"), F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        at("created_at").alias("created_at"), F.coalesce(at("valid_from"), at("created_at")).alias("valid_from"), at("valid_to").alias("valid_to"),
    )
    return good, rows.where(bad).select("file", "id", "broken")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines logs of several hosts: broken lines are left out, and of equal ids the one of the first file stays."""
    rows = spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_name")).where("broken is null and id is not null")
    names = [c for c in rows.columns if c not in ("broken", "file", "id")]
    one = rows.groupBy("id").agg(F.min_by(F.struct(*names), F.struct("file", "at")).alias("e"))
    return one.select("id", *(F.try_to_timestamp(F.col("e.at")).alias("at") if n == "at" else F.col(f"e.{n}").alias(n) for n in names))


def _heading(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?s)\A---\n(?:.*?\n)??{name}:[ \t]*([^\n]*)\n.*?---", 1), F.lit(""))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, description, body, version) of Markdown files with front matter; version is a hash of the content."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    return rows.select("file", F.coalesce(_heading(F.col("value"), "name"), F.regexp_extract("file", r"([^/]+)\.md$", 1)).alias("name"), _heading(F.col("value"), "description").alias("description"), body.alias("body"), F.substring(F.sha2("value", 256), 1, 16).alias("version"))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """(file, turn, role, text) of chat logs: JSON lines with role and content, or with type and message of those.

    Lines that are neither, and turns without text, are left out; content may be a string or a list of parts with text.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("turn"), F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    part = lambda p: F.array_join(F.transform(get(p, "array<struct<text: string>>"), lambda x: x["text"]), "\n")
    role = F.coalesce(get("$.role"), get("$.message.role"), get("$.type"))
    text = F.coalesce(F.nullif(part("$.content"), F.lit("")), F.nullif(part("$.message.content"), F.lit("")), get("$.content"), get("$.message.content"))
    return rows.select("file", "turn", role.alias("role"), text.alias("text")).where("role is not null and trim(text) <> ''")


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new put in place of those of equal key: what an upsert leaves. Columns are those of old."""
    n = new.select(F.col(key).alias("_key"), F.struct(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in old.columns)).alias("_new"))
    both = old.select(F.col(key).alias("_own"), F.struct(*old.columns).alias("_old")).join(n, F.col("_own") == F.col("_key"), "full")
    return both.select(F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias("r")).select(*(F.col("r")[c].cast(old.schema[c].dataType).alias(c) for c in old.columns))


def write_bundle(rows: DataFrame, path: str) -> None:
    """rows as JSON lines, each with the checksum of its content."""
    body = F.to_json(F.struct(*rows.columns))
    rows.select(body.alias("record"), F.sha2(body, 256).alias("checksum")).write.json(path)


def read_bundle(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows whose checksum holds, and the lines of the others."""
    lines = spark.read.schema("record string, checksum string").json(path).withColumn("holds", F.coalesce(F.sha2("record", 256) == F.col("checksum"), F.lit(False)))
    return lines.where("holds").select(F.from_json("record", schema).alias("r")).select("r.*"), lines.where("not holds").drop("holds")


#: What marks the copy that a file synchroniser left of a record, and the start of a hidden file. Fixed values.
CONFLICT, HIDDEN = ".sync-conflict-", "."
#: Fields that a seed must have. Fixed values.
SEED_FIELDS = ["seed_id", "creator", "experience_summary"]


def conflict_copies(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, of): records that a synchroniser left beside the ones they conflict with, `of` being the file name of these; hidden files are none."""
    rows = spark.read.schema("id string").option("multiLine", True).option("recursiveFileLookup", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), "id")
    return rows.where(F.col("name").contains(CONFLICT) & ~F.col("name").startswith(HIDDEN)).select("file", "id", F.regexp_replace("name", r"\.sync-conflict-[^.]*", "").alias("of"))


def listed(records: DataFrame, layer: str | None = None, tags: list[str] | None = None, created_after: str | None = None, as_of: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of read_records() by layer, all of some tags, from a time on, and as they held at one; the newest first, at most `limit`."""
    out = records
    if layer:
        out = out.where(F.col("layer") == layer)
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if created_after:
        out = out.where(F.col("created_at") >= F.lit(created_after).cast("timestamp"))
    if as_of:
        at = F.lit(as_of).cast("timestamp")
        out = out.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    out = out.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def rejects_by_cause(rejected: DataFrame) -> DataFrame:
    """(cause, files) of what read_records() rejected."""
    cause = F.when(F.col("broken").isNotNull(), "no JSON").when(F.col("id").isNull(), "no id").otherwise("no content")
    return rejected.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("files"))


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """What read_records() rejected as JSON lines, to be looked at; the files stay where they are."""
    rejected.write.mode("append").json(path)


def read_telegram(spark: SparkSession, path: str) -> DataFrame:
    """(chat, message, at, sender, text, has_media, reply_to) of exported chats: a row for each message with text or media.

    A text is a string or a list of strings and of parts with text, which are put together. Service messages are left out.
    """
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).where("v is not null")
    messages = rows.select(F.try_variant_get("v", "$.name", "string").alias("chat"), F.explode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("m"))
    get = lambda p, kind="string": F.try_variant_get("m", p, kind)
    parts = F.array_join(F.transform(get("$.text", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"), F.lit(""))), "")
    out = messages.where(F.coalesce(get("$.type"), F.lit("message")) == "message").select(
        "chat", get("$.id", "long").alias("message"), F.try_to_timestamp(get("$.date")).alias("at"), get("$.from").alias("sender"), F.coalesce(parts, get("$.text"), F.lit("")).alias("text"),
        F.coalesce(get("$.media_type"), get("$.photo"), get("$.file")).isNotNull().alias("has_media"), get("$.reply_to_message_id", "long").alias("reply_to"),
    )
    return out.where("text <> '' or has_media")


def by_day(messages: DataFrame) -> DataFrame:
    """(chat, day, messages, senders, text): the messages of read_telegram() of a day as one record, in order of time."""
    line = F.concat(F.coalesce("sender", F.lit("?")), F.lit(": "), "text")
    rows = messages.groupBy("chat", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_set("sender")).alias("senders"), F.array_sort(F.collect_list(F.struct("at", "message", line.alias("line")))).alias("lines"))
    return rows.select("chat", "day", "messages", F.array_join("senders", ", ").alias("senders"), F.array_join("lines.line", "\n").alias("text"))


def read_seeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seeds, rejected) of a folder of seed files: each field of SEED_FIELDS must be there; rejected ones name what they lack."""
    kind = "seed_id string, creator string, experience_summary string, germination_prompt string, emotional_signature struct<intensity: double, labels: array<string>>"
    rows = spark.read.schema(f"{kind}, broken string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.seed.json").option("columnNameOfCorruptRecord", "broken").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", c) for c in SEED_FIELDS)))
    rows = rows.withColumn("lacks", F.array_join(lacks, ", "))
    return rows.where("lacks = '' and broken is null").drop("broken", "lacks"), rows.where("lacks <> '' or broken is not null").select("file", "lacks")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, title, text) of Markdown journals: an entry for each heading of the second level, numbered in each file."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = rows.select("file", F.posexplode(F.split("value", r"(?m)^## ")).alias("entry", "part")).where("entry > 0")
    return parts.select("file", "entry", F.trim(F.regexp_extract("part", r"\A([^\n]*)", 1)).alias("title"), F.trim(F.regexp_replace("part", r"\A[^\n]*\n?", ""), F.lit(" \n")).alias("text"))


def skill_index(found: DataFrame) -> DataFrame:
    """(name, files, versions, description, current) of read_notes() rows: each skill once, with the version of its first file."""
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("version").alias("versions"), F.min_by("description", "file").alias("description"), F.min_by("version", "file").alias("current"))
