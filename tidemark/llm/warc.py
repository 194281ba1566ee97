"""WARC archives: one transaction for each page, and captures assembled from records of archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, id_of, keyed, materialise, new_path

#: Payloads of fewer bytes are always written in full; bytes of payloads that a file holds, about; the date of records that have none.
LEAST_BYTES, FILE_BYTES, DATE = 100, 16 << 20, "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*lines: tuple[str, Column | str]) -> Column:
    """Header lines; one whose value is null is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v, F.lit("\r\n")), F.lit("")) for name, v in lines))


def _record(kind: Column | str, name: Column, block: Column, *lines: tuple[str, Column | str]) -> Column:
    """A record without the two line ends that close it."""
    head = _lines(("WARC-Type", kind), ("WARC-Record-ID", name), *lines, ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block)


def _urn(*parts: Column | str) -> Column:
    """A record's identifier, from what it is made of."""
    h = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """Write a request, a response or revisit, and a metadata record for each page to gzipped archives in a folder.

    Of pages with equal payloads (html in UTF-8) of at least least_bytes, the one of the smallest page_id is a response; the
    others are revisits, without a payload, that name its record. Request and metadata name theirs as concurrent. The
    metadata holds page_id. Spark's text sink writes the files, with the end of a record as its line end, so an archive
    appears whole or not at all whichever executor is lost. Payloads move once, by page and digest; who is first is found
    from digests alone, counted before the shuffle, and joined between written tables, so Spark can split a hot payload.

    A null html is an empty payload. A null page_id counts as the largest and is left out of the metadata. A null url is left
    out. Rows that share page_id and payload are all responses if theirs is the smallest page_id. Spaces and line ends
    in a url are percent-encoded. An empty table writes an archive without records.
    """
    spark = pages.sparkSession
    own = keyed(pages, id_col, html_col)
    rows = pages.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_KEY)).alias("k"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    light, _ = materialise(own.select("k", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("size")), "payloads")
    total = light.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    first, _ = materialise(light.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").select("digest", "first"), "first")
    again, _ = materialise(light.join(first, "digest").where("k > first").select("k", "digest", "first").distinct(), "revisits")
    copy = F.row_number().over(Window.partitionBy("k", "digest").orderBy("url"))
    rows = rows.join(again, ["k", "digest"], "left").withColumn("copy", copy)
    ident = lambda kind: _urn(kind, F.col("k"), F.col("digest"), F.col("copy"))
    uri, again_ = F.col("url"), F.col("first").isNotNull()
    for sign, code in (("%0D", r"\r"), ("%0A", r"\n"), ("%20", " ")):
        uri = F.regexp_replace(uri, code, sign)
    host = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    common = ("WARC-Date", date), ("WARC-Target-URI", uri)
    main = ident("main")
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n"), _lines(("Host", host)), F.lit("\r\n"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.octet_length("html").cast("string"))), F.lit("\r\n"), F.when(again_, F.lit("")).otherwise(F.col("html")))
    told = _lines(("page_id", id_of(F.col("k")).cast("string")))
    transaction = F.concat_ws(
        _END,
        _record("request", ident("request"), ask, *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")),
        _record(
            F.when(again_, "revisit").otherwise("response"), main, answer, *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(again_, _urn("main", F.col("first"), F.col("digest"), F.lit(1)))), ("WARC-Profile", F.when(again_, F.lit(_SAME_PAYLOAD))),
            ("Content-Type", "application/http;msgtype=response"),
        ),
        _record("metadata", ident("metadata"), told, *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")),
    )
    held = max(1, int(file_bytes * max(1, total["n"]) / max(1, total["bytes"] + 1000 * total["n"])))
    rows.select(transaction.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", held).text(path)


def _http(block: bytes) -> tuple[int | None, bytes]:
    """Status and payload of an HTTP message; chunks of a chunked one are put together."""
    head, _, body = block.partition(b"\r\n\r\n")
    status = re.match(rb"HTTP/\S+\s+(\d{3})", head)
    if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head, re.I):
        whole, rest = [], body
        while m := re.match(rb"([0-9a-fA-F]+)[^\r\n]*\r\n", rest):
            n = int(m[1], 16)
            if not n:
                return status and int(status[1]), b"".join(whole)
            whole.append(rest[m.end() : m.end() + n])
            rest = rest[m.end() + n + 2 :]
    return status and int(status[1]), body


def _claimed(claim: str | None, payload: bytes) -> bool:
    """Whether a payload is what a digest of a known kind says; others are believed."""
    kind, _, value = (claim or "").partition(":")
    if kind.lower() not in ("sha256", "sha1", "md5"):
        return True
    h = hashlib.new(kind.lower(), payload, usedforsecurity=False)
    return value.lower() == h.hexdigest() or value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=")


def records_of(content: bytes) -> Iterator[dict]:
    """The records of one archive, gzipped in whatever number of members or plain; a damaged one says so, and reading goes on at the next."""
    file = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    lost = 0
    try:
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                lost += bool(line.strip())
                continue
            if lost:
                yield {"problem": f"{lost} lines between records"}
                lost = 0
            headers: dict[str, list[str]] = {}
            name = ""
            while (line := file.readline().rstrip(b"\r\n")) != b"":
                text = line.decode("utf-8", "replace")
                if text[0] in " \t" and name:
                    headers[name][-1] += " " + text.strip()
                    continue
                name, _, value = text.partition(":")
                headers.setdefault(name := name.strip().lower(), []).append(value.strip())
            one = {k: v[0] for k, v in headers.items()}
            row = {
                "type": one.get("warc-type"), "record_id": one.get("warc-record-id"), "uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "concurrent": headers.get("warc-concurrent-to", []),
                "refers_to": one.get("warc-refers-to"), "claimed": one.get("warc-payload-digest"), "fields": [], "problem": None,
            }
            length = one.get("content-length", "")
            if not length.isdecimal():
                yield row | {"problem": "no length"}
                continue
            block = file.read(int(length))
            if len(block) < int(length):
                yield row | {"problem": "cut short"}
                return
            kind = one.get("content-type", "").lower()
            row["status"], payload = _http(block) if kind.startswith("application/http") else (None, block)
            if kind.startswith("application/warc-fields"):
                row["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if v]
            if row["type"] == "response" and not _claimed(row["claimed"], payload):
                row["problem"] = "payload is not what its digest says"
            yield row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}
    except (OSError, EOFError, zlib.error) as e:
        yield {"problem": f"unreadable: {type(e).__name__}"}


_KIND = pa.schema(
    [("file", pa.string()), ("at", pa.int32()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent", pa.list_(pa.string())), ("refers_to", pa.string()),
     ("claimed", pa.string()), ("status", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string()), ("payload", pa.binary())]
)
_RECORD = "file string, at int, type string, record_id string, uri string, date string, concurrent array<string>, refers_to string, claimed string, status int, fields map<string,string>, payload_bytes long, payload_digest string, problem string"


def _parsed(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _KIND.names if payloads else _KIND.names[:-1]

        def sent(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KIND.field(n).type) for n in names], names=names)

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for at, r in enumerate(records_of(content.as_py())):
                    rows.append(r | {"file": path, "at": at, "fields": list(dict(r.get("fields") or ()).items())})
                    held += r.get("payload_bytes", 0) if payloads else 0
                    if held > FILE_BYTES or len(rows) >= 5000:
                        yield sent(rows)
                        rows, held = [], 0
                yield sent(rows)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder, with its payload if asked for.

    Each archive is read whole by one task; one of gigabytes should be split before. payload_digest is worked out from
    the bytes that were read; claimed is what the record says. Damaged records have a problem, and the rest of their
    archive is read where a next record can be found.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_parsed(payloads), _RECORD + (", payload binary" if payloads else ""))


def captures(records: DataFrame) -> DataFrame:
    """One row for each response, revisit or resource record: (capture, requests, metadata), each a nested record.

    Records belong together if one names the other as concurrent, in either direction, or both name or are named by a
    third that belongs to the capture (metadata of a request). A capture's requests and metadata come in the order of
    archive and place; a record that names several captures is in each. Those that name none are in no row, and
    neither are records without an identifier. Archives are written to the shared folder beforehand, so both sides of
    each join come from tables.
    """
    own = [c for c in records.columns if c not in ("payload", "concurrent")]
    mains = F.col("type").isin("response", "revisit", "resource")
    records = records.where("record_id is not null")
    anchors = records.where(mains).select(F.struct(*own).alias("capture"), F.col("record_id").alias("anchor"))
    named = records.where(mains).select(F.explode("concurrent").alias("record_id"), F.col("record_id").alias("to"))
    others = records.where(F.col("type").isin("request", "metadata"))
    points = others.select("record_id", F.explode("concurrent").alias("to"))
    points = points.unionAll(points.select(F.col("to").alias("record_id"), F.col("record_id").alias("to"))).unionAll(named).distinct()
    direct = points.join(anchors.select(F.col("anchor").alias("to")).distinct(), "to").select("record_id", F.col("to").alias("anchor"))
    left = points.join(direct.select("record_id"), "record_id", "left_anti").join(direct.select("record_id").distinct().withColumnRenamed("record_id", "to"), "to", "left_semi")
    through = left.join(direct.withColumnRenamed("record_id", "to"), "to").select("record_id", "anchor")
    owner = direct.unionAll(through).distinct()
    parts = others.select("record_id", "type", F.struct("file", "at", *(c for c in own if c not in ("file", "at"))).alias("r")).join(owner, "record_id")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(F.col("r.file"), F.col("r.at"), F.map_entries("r.fields").alias("fields"), *(F.col(f"r.{c}") for c in own if c not in ("file", "at", "fields"))))))
    met = parts.groupBy("anchor").agg(listed("request").alias("requests"), listed("metadata").alias("metadata"))
    return anchors.join(met, "anchor", "left").select("capture", *(F.coalesce(c, F.array()).alias(c) for c in ("requests", "metadata")))


def page_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, requests): pages written to archives, and read back as captures.

    All but the choice of revisits comes from the archives: page_id from a capture's metadata, bytes and digest from the payload
    that was read, for a revisit from the record that it refers to. See write_warc() for odd rows; a null page_id comes back
    as null. Archives stay in the shared folder until it is cleaned.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col, least_bytes)
    records, _ = materialise(read_warc(spark, path), "records")
    field = F.filter(F.element_at("metadata", 1)["fields"], lambda x: x["key"] == "page_id")
    rows, _ = materialise(captures(records).select("capture.*", F.get(field, 0)["value"].cast("long").alias("page_id"), F.size("requests").alias("requests")).drop("fields"), "captures")
    meant = rows.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    whole = rows.where("type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.col("uri").alias("url"), "requests")
    again = rows.where("type = 'revisit'").join(meant, "refers_to", "left")
    return whole.unionAll(again.select("page_id", F.col("bytes").alias("payload_bytes"), F.coalesce("digest", F.substring_index("claimed", ":", -1)).alias("payload_digest"), F.col("type").alias("record_type"), F.col("of").alias("refers_to"), F.col("uri").alias("url"), "requests"))
