"""What days a question means."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timewords as T


@pytest.mark.parametrize(("text", "want"), [
    ("in june", (6, None, None)), ("june 5", (6, 5, None)), ("5 june 2024", (6, 5, 2024)), ("June, 2024", (6, None, 2024)), ("the 5th of may", (5, 5, None)), ("5 may", (5, 5, None)),
    ("step 3 may fail", None), ("we may 3 times", None), ("people march 4 hours", None), ("may 5", (5, 5, None)), ("may we go", None), ("May we go", None), ("the May plan", (5, None, None)),
    ("March outage", (3, None, None)), ("March on", None), ("since march", (3, None, None)), ("in may", (5, None, None)), ("dismay 5", None), ("mayor of june", (6, None, None)),
    ("may halt, then october 2023", (10, None, 2023)), ("june 5:30", (6, None, None)), ("sept 12th", (9, 12, None)), ("", None), (None, None),
])
def test_months_by_name(text, want):
    assert T.month_named(text) == want


def test_windows(spark):
    day = date(2024, 3, 13)  # a Wednesday
    cases = {
        "on 2024-01-15": ("2024-01-15", "2024-01-16"), "in 2024-02": ("2024-02-01", "2024-03-01"), "on 2024-02-30": None, "in 2024-19": ("2024-01-01", "2025-01-01"), "part 1999 of the set": None,
        "Yesterday?": ("2024-03-12", "2024-03-13"), "two weeks ago": ("2024-02-26", "2024-03-04"), "an month ago": ("2024-02-01", "2024-03-01"), "12 months ago": ("2023-03-01", "2023-04-01"),
        "the past week": ("2024-03-06", "2024-03-14"), "past week of work": None, "last three months": ("2023-12-13", "2024-03-14"), "last wednesday": ("2024-03-06", "2024-03-07"),
        "last week": ("2024-03-04", "2024-03-11"), "last week of june": ("2023-06-01", "2023-07-01"), "in april": ("2023-04-01", "2023-05-01"), "in march": ("2024-03-01", "2024-04-01"),
        "june 31": ("2023-06-01", "2023-07-01"), "may 5 2022": ("2022-05-05", "2022-05-06"), "in 2023": ("2023-01-01", "2024-01-01"), "nothing": None, "": None, None: None, "999 days ago": ("2021-06-18", "2021-06-19"),
    }
    rows = spark.createDataFrame([(t, day) for t in cases], "text string, day date")
    got = {x["text"]: x["w"] and (str(x["w"]["start"]), str(x["w"]["end"])) for x in rows.select("text", T.time_window(F.col("text"), F.col("day")).alias("w")).collect()}
    assert got == cases


def test_strict_windows_want_a_question(spark):
    yes = ["what happened in june", "since 2025-10", "on may 5", "what did we decide june 5", "the June outage", "October 2025", "week of Oct 5", "three days ago", "last week", "back in early 2024"]
    no = ["Postmortem 2026-10-16 sqlite orphans", "Q3 2026 roadmap", "June 5 notes", "Top 10 of 2026", "2024 plan"]
    rows = spark.createDataFrame([(t, date(2024, 3, 13)) for t in yes + no], "text string, day date")
    w = rows.select("text", T.time_window(F.col("text"), F.col("day"), strict=True).alias("w"))
    assert {x["text"] for x in w.collect() if x["w"]} == set(yes)
