"""A data source of the ends of growing line files: `spark.read.format("tails")` and `spark.readStream.format("tails")`.

Options: path (a folder, or a file), suffix (of the files that count, ".jsonl"), bytes (how much of a file's end is read
first, 256 kB), line (the longest line that is put together over two reads, 1 MB). A path may name any store that pyarrow
opens; workers read it without Spark's own file system.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
TAIL_BYTES, LINE_BYTES = 256 * 1024, 1 << 20


class Piece(InputPartition):
    """Lines of a file that end after `start` and not after `stop`; `cut` if the line that holds `start` is not known to begin there."""

    def __init__(self, file: str, start: int, stop: int, cut: bool) -> None:
        self.file, self.start, self.stop, self.cut = file, start, stop, cut


def _opened(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith(("file:", "/")):
        raise ValueError("path must be absolute or a URI")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _sizes(path: str, suffix: str) -> dict[str, int]:
    from pyarrow import fs

    store, top = _opened(path)
    found = store.get_file_info(top)
    files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in files if f.type == fs.FileType.File and f.path.endswith(suffix)}


def _lines(path: str, piece: Piece, longest: int) -> Iterator[tuple[str, int, str]]:
    store, _ = _opened(path)
    with store.open_input_file(piece.file) as f:
        before = piece.start if piece.cut else max(0, piece.start - longest)
        f.seek(before)
        data = f.read(piece.stop - before)
    own = piece.start - before
    # a line that was open at `start` begins after the last line end before it
    begin = data.rfind(b"\n", 0, own) + 1 if own else 0
    if piece.cut and piece.start > 0:
        end = data.find(b"\n")
        if end < 0:
            return
        begin = end + 1
    while (end := data.find(b"\n", begin)) >= 0:
        yield piece.file, before + begin, data[begin:end].removesuffix(b"\r").decode("utf-8", "replace")
        begin = end + 1


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("tails needs a path")
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.tail, self.longest = int(options.get("bytes", TAIL_BYTES)), int(options.get("line", LINE_BYTES))


class TailReader(DataSourceReader):
    """The lines that are whole in the last bytes of each file; one that is cut at the start, or still open at the end, is left out."""

    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return [Piece(f, max(0, n - self.o.tail), n, True) for f, n in sorted(_sizes(self.o.path, self.o.suffix).items())]

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        yield from _lines(self.o.path, partition, self.o.longest)


class TailStream(DataSourceStreamReader):
    """The same as a stream, which goes on from the kept size of each file.

    A file that is met for the first time is read from its last bytes on; one that has shrunk was replaced, and is met anew. A
    line is told in the batch in which its end comes, however many batches it took to be written.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return _sizes(self.o.path, self.o.suffix)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for f, n in sorted(end.items()):
            known = start.get(f)
            if known is None or known > n:
                out.append(Piece(f, max(0, n - self.o.tail), n, True))
            elif known < n:
                out.append(Piece(f, known, n, False))
        return out

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        yield from _lines(self.o.path, partition, self.o.longest)


class Tails(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tails"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return TailReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002, N802
        return TailStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tails)


def skill_calls(lines: DataFrame) -> DataFrame:
    """(file, at, use_id, skill, called_at, session, commands) of transcript lines (file, at, line): each use of a skill with the commands that ran in its turn.

    A turn ends at the next line in which a person wrote, and a skill's window at the next skill or the turn's end; side chains
    are left out. commands holds (command, error) in order; error is null while no result has come. One pass over the
    lines of a file in order; only the calls of one file are held at a time.
    """
    return lines.groupBy("file").applyInPandas(_calls, "file string, at long, use_id string, skill string, called_at string, session string, commands array<struct<command: string, error: boolean>>")


def _written(content) -> bool:
    """Whether a person wrote this, not a tool or the system."""
    texts = [content] if isinstance(content, str) else [b.get("text", "") for b in content if isinstance(b, dict) and b.get("type") == "text"] if isinstance(content, list) else []
    return any(str(t).strip() and not str(t).lstrip().startswith("<") for t in texts)


def _calls(lines):
    import pandas as pd

    calls, window, ran = [], None, {}
    for file, at, line in lines.sort_values("at")[["file", "at", "line"]].itertuples(index=False):
        try:
            record = json.loads(line)
        except ValueError:
            continue
        message = record.get("message") if isinstance(record, dict) and not record.get("isSidechain") else None
        if not isinstance(message, dict):
            continue
        content = message.get("content")
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
        if message.get("role") == "user":
            for b in blocks:
                if b.get("type") == "tool_result" and b.get("tool_use_id") in ran:
                    ran[b["tool_use_id"]]["error"] = bool(b.get("is_error"))
            if _written(content):
                window = None
        elif message.get("role") == "assistant":
            for b in blocks:
                given = b.get("input") if isinstance(b.get("input"), dict) else {}
                if b.get("type") != "tool_use" or not b.get("id"):
                    continue
                if b.get("name") == "Skill" and isinstance(given.get("skill"), str):
                    window = {"file": file, "at": at, "use_id": b["id"], "skill": given["skill"].strip().lstrip("/"), "called_at": record.get("timestamp"), "session": record.get("sessionId") or "", "commands": []}
                    calls.append(window)
                elif b.get("name") == "Bash" and window is not None:
                    ran[b["id"]] = {"command": str(given.get("command", "")), "error": None}
                    window["commands"].append(ran[b["id"]])
    return pd.DataFrame(calls, columns=["file", "at", "use_id", "skill", "called_at", "session", "commands"])


def skill_counts(lines: DataFrame) -> DataFrame:
    """(skill, calls, commands, failed) over all transcripts."""
    c = skill_calls(lines)
    failed = F.size(F.filter("commands", lambda x: F.coalesce(x["error"], F.lit(False))))
    return c.groupBy("skill").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.size("commands")).cast("long").alias("commands"), F.sum(failed).cast("long").alias("failed"))
