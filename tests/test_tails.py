"""Ends of growing files, in one read and as a stream that goes on where it was."""

import json

from tidemark.sources import tails


def put(path, *lines, end="\n"):
    with path.open("ab") as f:
        f.write(("\n".join(lines) + end).encode())


def test_lines_cut_at_the_start_are_dropped(spark, tmp_path):
    tails.register(spark)
    put(tmp_path / "a.jsonl", "first line", "second é", "third")
    put(tmp_path / "b.jsonl", "whole", "open", end="")
    put(tmp_path / "c.txt", "other")
    (tmp_path / "d.jsonl").write_bytes(b"")
    read = lambda **o: sorted((r["file"].rsplit("/", 1)[-1], r["at"], r["line"]) for r in spark.read.format("tails").options(**o).load(str(tmp_path)).collect())
    assert read() == [("a.jsonl", 0, "first line"), ("a.jsonl", 11, "second é"), ("a.jsonl", 21, "third"), ("b.jsonl", 0, "whole")]
    assert read(bytes=14) == [("a.jsonl", 21, "third"), ("b.jsonl", 0, "whole")]
    assert read(bytes=3) == [] and [x[2] for x in read(suffix=".txt")] == ["other"]


def test_a_stream_goes_on_at_the_kept_place(spark, tmp_path):
    tails.register(spark)
    (tmp_path / "in").mkdir()
    runs = []

    def run():
        out = str(tmp_path / f"out{len(runs)}")
        runs.append(out)
        keep = lambda df, _: df.write.mode("append").parquet(out)
        q = spark.readStream.format("tails").option("bytes", 20).option("line", 100).load(str(tmp_path / "in")).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        import os

        return sorted((r["file"].rsplit("/", 1)[-1], r["line"]) for r in spark.read.parquet(out).collect()) if os.path.exists(out) else []

    put(tmp_path / "in/a.jsonl", "x" * 30, "seen", "half ", end="")
    assert run() == [("a.jsonl", "seen")]
    put(tmp_path / "in/a.jsonl", "and half", "more", "again ", end="")
    put(tmp_path / "in/b.jsonl", "new")
    assert run() == [("a.jsonl", "half and half"), ("a.jsonl", "more"), ("b.jsonl", "new")]
    put(tmp_path / "in/a.jsonl", "done")
    (tmp_path / "in/b.jsonl").write_bytes(b"z\n")  # replaced by a shorter one
    assert run() == [("a.jsonl", "again done"), ("b.jsonl", "z")]


def test_skills_with_the_commands_of_their_turn(spark, tmp_path):
    tails.register(spark)
    use = lambda i, name, **given: {"type": "tool_use", "id": i, "name": name, "input": given}
    says = lambda role, content, **more: json.dumps({"message": {"role": role, "content": content}, "timestamp": "t", "sessionId": "s", **more})
    lines = [
        says("assistant", [use("b0", "Bash", command="before")]), says("user", "do it"), says("assistant", [use("k1", "Skill", skill="/tidy "), use("b1", "Bash", command="ls")]),
        says("user", [{"type": "tool_result", "tool_use_id": "b1", "is_error": True}]), "broken {", says("assistant", [use("b2", "Bash", command="pwd")]), says("assistant", [use("k9", "Skill", skill="side")], isSidechain=True),
        says("user", [{"type": "text", "text": "<system>"}]), says("assistant", [use("b3", "Bash", command="date")]), says("user", [{"type": "text", "text": "next"}]), says("assistant", [use("b4", "Bash", command="late")]),
        says("assistant", [use("k2", "Skill", skill="other")]), says("assistant", "plain"), "[1]",
    ]
    put(tmp_path / "s.jsonl", *lines)
    read = spark.read.format("tails").load(str(tmp_path))
    got = {r["use_id"]: (r["skill"], [(c["command"], c["error"]) for c in r["commands"]]) for r in tails.skill_calls(read).collect()}
    assert got == {"k1": ("tidy", [("ls", True), ("pwd", None), ("date", None)]), "k2": ("other", [])}
    assert sorted(map(tuple, tails.skill_counts(read).collect())) == [("other", 1, 0, 0), ("tidy", 1, 3, 1)]
