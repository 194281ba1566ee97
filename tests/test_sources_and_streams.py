"""Sources, sinks, streams and chunks on small fixtures."""

import datetime
import json
import random

import pandas as pd

from tidemark.plans import extract
from tidemark.sources import files
from tidemark.streaming import jobs


def test_records_and_rejects(spark, tmp_path):
    (tmp_path / "short-term").mkdir()
    put = lambda name, text: (tmp_path / "short-term" / f"{name}.json").write_text(text)
    put("a", json.dumps({"id": "a", "content": "x", "layer": "long-term", "created_at": "2024-01-01T00:00:00Z", "valid_to": "whenever", "tags": ["t"], "schema_version": 2}, indent=1))
    put("b", json.dumps({"id": "b", "content": "y", "layer": "odd", "created_at": "2024-01-01T02:00:00+02:00"}))
    put("c", '{"id": "c", "content"')
    put("d", json.dumps({"id": "d"}))
    good, bad = files.read_records(spark, str(tmp_path))
    got = {r["id"]: r for r in good.collect()}
    assert set(got) == {"a", "b"} and got["a"]["valid_to"] is None and got["a"]["valid_from"] == got["b"]["created_at"]
    assert (got["b"]["layer"], got["b"]["unknown_layer"], got["b"]["schema_version"], got["b"]["tags"]) == ("short-term", "odd", 1, [])
    assert bad.count() == 2


def test_events_first_file_wins(spark, tmp_path):
    (tmp_path / "2024-01-a.jsonl").write_text('{"id": "1", "event": "served", "at": "2024-01-01T00:00:00Z"}\nnot json\n')
    (tmp_path / "2024-01-b.jsonl").write_text('{"id": "1", "event": "followed", "at": "2024-01-01T00:00:00Z"}\n{"id": "2", "event": "served", "at": "2024-01-02T00:00:00Z"}\n')
    assert {r["id"]: r["event"] for r in files.read_events(spark, str(tmp_path)).collect()} == {"1": "served", "2": "served"}


def test_notes_and_chats(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "one.md").write_text("---\nname: First\ndescription: about it\n---\n# Body\ntext")
    (tmp_path / "n" / "two.md").write_text("plain")
    got = {r["name"]: r for r in files.read_notes(spark, str(tmp_path / "n")).collect()}
    assert got["First"]["description"] == "about it" and got["First"]["body"] == "# Body\ntext" and got["two"]["description"] is None
    (tmp_path / "c.jsonl").write_text('{"role": "user", "content": "hi"}\n{"type": "assistant", "message": {"role": "assistant", "content": [{"text": "yes"}, {"text": "no"}]}}\nbroken\n{"role": "user", "content": " "}\n')
    assert [(r["role"], r["text"]) for r in files.read_chats(spark, str(tmp_path / "c.jsonl")).orderBy("turn").collect()] == [("user", "hi"), ("assistant", "yes\nno")]


def test_copies_listings_and_rejects(spark, tmp_path):
    for name, r in {"a.json": {"id": "a", "content": "x", "layer": "mid-term", "tags": ["t", "u"], "created_at": "2024-01-01T00:00:00Z"}, "b.json": {"id": "b", "content": "y", "layer": "mid-term", "tags": ["t"], "created_at": "2024-01-03T00:00:00Z", "valid_to": "2024-01-04T00:00:00Z"}, "b.sync-conflict-20240101-1.json": {"id": "b", "content": "z"}, "c.json": {"id": "c"}}.items():
        (tmp_path / name).write_text(json.dumps(r))
    good, bad = files.read_records(spark, str(tmp_path))
    assert [r["id"] for r in files.listed(good, layer="mid-term", tags=["t"]).collect()] == ["b", "a"]
    assert [r["id"] for r in files.listed(good, layer="mid-term", as_of="2024-01-05", limit=1).collect()] == ["a"]
    assert [r["id"] for r in files.listed(good, tags=["u"], created_after="2024-01-02").collect()] == []
    assert [(r["id"], r["of"]) for r in files.conflict_copies(spark, str(tmp_path)).collect()] == [("b", "b.json")]
    assert [tuple(r) for r in files.rejects_by_cause(bad).collect()] == [("no content", 1)]
    files.write_quarantine(bad, f"{tmp_path}/q")
    assert spark.read.json(f"{tmp_path}/q").count() == 1


def test_chats_seeds_and_journals(spark, tmp_path):
    messages = [{"id": 1, "type": "message", "date": "2024-01-01T10:00:00", "from": "Ada", "text": "hi"}, {"id": 2, "type": "message", "date": "2024-01-01T11:00:00", "from": "Bob", "text": ["see ", {"type": "link", "text": "https://x.org"}], "reply_to_message_id": 1}, {"id": 3, "type": "service", "date": "2024-01-01T11:00:00", "text": "joined"}, {"id": 4, "type": "message", "date": "2024-01-02T11:00:00", "from": "Bob", "text": "", "photo": "p.jpg"}]
    (tmp_path / "t.json").write_text(json.dumps({"name": "Chat", "messages": messages}))
    got = files.read_telegram(spark, str(tmp_path / "t.json"))
    assert [(r["message"], r["text"], r["has_media"], r["reply_to"]) for r in got.orderBy("message").collect()] == [(1, "hi", False, None), (2, "see https://x.org", False, 1), (4, "", True, None)]
    assert [(str(r["day"]), r["messages"], r["senders"], r["text"]) for r in files.by_day(got).orderBy("day").collect()] == [("2024-01-01", 2, "Ada, Bob", "Ada: hi\nBob: see https://x.org"), ("2024-01-02", 1, "Bob", "Bob: ")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.seed.json").write_text(json.dumps({"seed_id": "1", "creator": "c", "experience_summary": "e", "emotional_signature": {"intensity": 7.5, "labels": ["joy"]}}))
    (tmp_path / "s" / "b.seed.json").write_text(json.dumps({"seed_id": "2", "creator": " "}))
    good, bad = files.read_seeds(spark, str(tmp_path / "s"))
    assert [(r["seed_id"], r["emotional_signature"]["intensity"]) for r in good.collect()] == [("1", 7.5)] and [r["lacks"] for r in bad.collect()] == ["creator, experience_summary"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "j.md").write_text("# Journal\n\n## One day\nfirst\n\nmore\n## Next\nlast\n")
    assert [(r["entry"], r["title"], r["text"]) for r in files.read_journal(spark, str(tmp_path / "j")).orderBy("entry").collect()] == [(1, "One day", "first\n\nmore"), (2, "Next", "last")]
    found = spark.createDataFrame([("f1", "s", "d", "v1"), ("f2", "s", "e", "v2"), ("f3", "t", None, "v1")], "file string, name string, description string, version string")
    assert sorted(map(tuple, files.skill_index(found).collect())) == [("s", 2, 2, "d", "v1"), ("t", 1, 1, None, "v1")]


def test_merge_and_bundle(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id long, text string")
    assert sorted(map(tuple, files.merged(old, new).collect())) == [(1, "a"), (2, None), (3, "c")]
    files.write_bundle(old, f"{tmp_path}/b")
    good, bad = files.read_bundle(spark, f"{tmp_path}/b", "id long, text string")
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (2, "b")] and bad.count() == 0
    spark.createDataFrame([('{"id":9}', "0")], "record string, checksum string").write.mode("append").json(f"{tmp_path}/b")
    good, bad = files.read_bundle(spark, f"{tmp_path}/b", "id long, text string")
    assert good.count() == 2 and bad.count() == 1


def _run(spark, parts, schema, job, tmp_path, mode):
    """A stream of one file after another, and the rows that its last batches left for each key."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    job(stream).writeStream.outputMode(mode).foreachBatch(lambda b, n: out.append(b.toPandas().assign(batch=n))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return pd.concat(out)


def test_intentions_fold_like_the_table(spark, tmp_path):
    r = random.Random(3)
    words = ["arm", "fire", "snooze", "done", "cancel", "bogus"]
    rows = [(i % 7, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n), r.choices(words, [5, 6, 3, 1, 1, 2])[0]) for n, i in enumerate(r.choices(range(7), k=60))]
    got = _run(spark, [rows[:30], rows[30:]], "id long, at timestamp, event string", jobs.intentions, tmp_path, "update").sort_values("batch").groupby("id").last()
    for i in got.index:
        now = "pending"
        for _, _, e in (x for x in rows if x[0] == i):
            now = jobs.TRANSITIONS.get((now, e), now)
        assert got.loc[i, "state"] == now


def test_repeats_and_hours(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at), (1, at), (2, at + datetime.timedelta(minutes=5)), (1, at), (3, at + datetime.timedelta(hours=2))]
    got = _run(spark, [rows[:3], rows[3:]], "id long, at timestamp", jobs.once, tmp_path / "a", "append")
    assert sorted(got["id"]) == [1, 2, 3]
    got = _run(spark, [[("k", t) for _, t in rows]], "kind string, at timestamp", jobs.by_hour, tmp_path / "b", "update").sort_values("batch").groupby("hour").last()
    assert got["n"].tolist() == [4, 1]
    after = lambda m: (1, at + datetime.timedelta(minutes=m))
    got = _run(spark, [[after(0), after(40)], [after(80), after(100), after(141)]], "id long, at timestamp", jobs.uses, tmp_path / "c", "update").sort_values("batch")
    assert got["uses"].tolist() == [1, 3]  # 0, 80 and 141: an hour is counted from the last that counted


def test_firing_is_bounded(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = [(1, at + datetime.timedelta(minutes=m), e) for m, e in ((0, "fire"), (5, "fire"), (70, "fire"), (140, "fire"), (150, "done"), (160, "fire"))]
    got = _run(spark, [events], "id long, at timestamp, event string", lambda s: jobs.intentions(s, cooldown_s=3600, max_fires=2), tmp_path, "update")
    assert got[["state", "fires", "refused"]].values.tolist() == [["done", 2, 2]]


def test_replicas_merge_alike_in_any_order(spark):
    rows = [(1, "armed", 5, 1), (1, "done", 5, 0), (1, "fired", 4, 3), (2, "pending", 1, 0), (2, "armed", 2, 0)]
    make = lambda r: sorted(map(tuple, jobs.merged_intentions(spark.createDataFrame(r, "id long, state string, updated_at long, fires long")).collect()))
    assert make(rows) == make(rows[::-1]) == [(1, "done", 5, 3), (2, "armed", 2, 0)]


def test_timers(spark):
    t = datetime.datetime.fromisoformat
    rows = spark.createDataFrame([(1, "pending", t("2024-01-02"), None), (2, "armed", t("2024-01-01"), t("2024-01-01 06:00")), (3, "armed", t("2024-01-01"), t("2024-02-01")), (4, "done", t("2024-01-01"), None), (5, "armed", t("2024-03-01"), None)], "id long, state string, due_at timestamp, snooze_until timestamp")
    assert [r["id"] for r in jobs.due(rows, "2024-01-10").collect()] == [2, 1]
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*(jobs.next_slot(F.lit(d), 10, F.lit(100)) for d in (100, 95, 3, 140))))).collect()] == [110, 105, 103, 140]
    live = spark.createDataFrame([(1, 7, "armed"), (2, 8, "armed"), (3, 7, "done")], "id long, origin_id long, state string")
    records = spark.createDataFrame([(7, t("2024-01-01")), (8, None)], "id long, valid_to timestamp")
    assert [(r["id"], r["event"]) for r in jobs.invalidated(live, records).collect()] == [(1, "invalidate")]


def test_chunks_cover_and_break_well(spark):
    r = random.Random(2)
    text = "".join(r.choice(["word ", "end. ", "para\n\n", "longerword "]) for _ in range(2000))
    spans = extract.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d and b - a <= extract.CHUNK and b - c == extract.OVERLAP
        assert text[b : b + 2] == "\n\n" or text[b - 1] == "." or b - a == extract.CHUNK
    assert extract.spans("") == [(0, 0)] and extract.spans("x" * 900) == [(0, 900)]
    rows = extract.chunk_documents(spark, "/root/testdata/sf0.001")
    assert rows.select("doc_id").distinct().count() > 100 and rows.selectExpr("max(length(text))").first()[0] <= extract.CHUNK
