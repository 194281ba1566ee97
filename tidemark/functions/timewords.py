"""The days that a question means: dates, months by name, and words such as "three weeks ago"."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Names of months, weekdays and numbers; months that are words as well, and what tells them apart; words before a date.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
ALSO_WORDS = {"may", "march"}
SUBJECTS = {"i", "we", "you", "they", "it", "he", "she", "people", "who"}
FOLLOWERS = {"times", "time", "miles", "mile", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "go", "be"}
MARCH_NOUNS = {"outage", "incident", "review", "report", "deploy", "meeting", "notes", "update"}
MONTH_PREPOSITIONS = {"in", "during", "since", "until", "from", "of"}
CUES = "in|during|since|until|till|before|after|from|on|by|around|throughout|between|as of|back in|early|late|mid"
ASKING = "what|when|which|who|how|why|did|do|does|was|were|is|are|show|list|find|recall|remind|tell"
CAPITAL = "January|February|April|June|July|August|September|October|November|December|Jan|Feb|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"

_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
_MENTION = re.compile(
    rf"(?:(?P<first>\d{{1,2}})(?P<nth>st|nd|rd|th)?\s+(?:of\s+)?)?(?<![a-z])(?P<name>{_NAME})(?![a-z])"
    r"(?P<year>\s*,?\s*20\d{2}\b)?(?:\s*,?\s*(?P<then>\d{1,2})(?:st|nd|rd|th)?\b(?!\s*:))?"
)
_LAST_WORD, _NEXT_WORD = re.compile(r"(\w+)\s+$"), re.compile(r"\s*([a-z]+)")


def month_named(text: str | None) -> tuple[int, int | None, int | None] | None:
    """(month, day, year) of the first month that a text names; day and year where they stand beside it.

    "may" and "march" count with a day or year, after a preposition, or in capitals within a sentence; "March" at its start
    before a thing that happened.
    """
    text = text or ""
    low = text.lower() if len(text.lower()) == len(text) else text.casefold()
    for m in _MENTION.finditer(low):
        name, at, end = m["name"], m.start("name"), m.end("name")
        word = name in ALSO_WORDS
        before = _LAST_WORD.search(low[:at])
        year = int(re.sub(r"\D", "", m["year"])) if m["year"] else None
        day = None
        if m["then"] and year is None:
            after = _NEXT_WORD.match(low, m.end())
            if word and ((before and before[1] in SUBJECTS) or (after and after[1] in FOLLOWERS)):
                continue
            day = int(m["then"])
        elif m["first"] and (not word or year or m["nth"] or re.fullmatch(r"[\s.,!?]*\d{1,2}\s+[a-z]+[\s.,!?]*", low)):
            day = int(m["first"])
        if word and day is None and year is None:
            capital, start = text[at : at + 1].isupper(), not text[:at].strip()
            after = re.match(r" ([a-z]+)", low[end:])
            thing = name == "march" and capital and start and after and after[1].rstrip("s") in {n.rstrip("s") for n in MARCH_NOUNS}
            if not ((capital and not start) or thing or (before and before[1] in MONTH_PREPOSITIONS)):
                continue
        return MONTHS[name], day, year
    return None


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("month", "day", "year")]))
def _months(texts: pd.Series) -> pd.DataFrame:
    found = {t: month_named(t) or (None, None, None) for t in set(texts.dropna())}
    return pd.DataFrame([found.get(t, (None, None, None)) for t in texts], columns=["month", "day", "year"]).astype("Int32")


def asks_for_a_date(text: Column) -> Column:
    """Whether a date in a text is what is asked about, rather than part of a name: a word of time before it, a month with its year, or a question with a month and its day."""
    low = F.lower(text)
    date = rf"(?:20\d{{2}}-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?|20\d{{2}}|{_NAME})\b"
    day = r"\d{1,2}(?:st|nd|rd|th)?"
    return (
        low.rlike(rf"\b(?:{CUES})[\s-]+(?:the\s+)?(?:(?:month|year)\s+of\s+)?(?:(?:early|late|mid)[\s-]+)?{date}")
        | low.rlike(rf"\b(?:{_NAME})\s+20\d{{2}}\b") | low.rlike(rf"\bof\s+(?:the\s+)?(?:{_NAME})\b")
        | (low.rlike(rf"\b(?:{ASKING})\b") & low.rlike(rf"\b(?:(?:{_NAME})\s+{day}|{day}\s+(?:{_NAME}))\b"))
        | F.trim(text).rlike(rf"(?<!^)(?<![.!?]\s)\b(?:{CAPITAL})\b")
    )


def time_window(text: Column, day: Column, strict: bool = False) -> Column:
    """A struct (start, end), the end not within it, of the days that a question means, seen from a day; null if it names no time, or a day that is none.

    The first that applies: a day or a month as numbers; yesterday and today; so many days, weeks or months ago; the last or
    past so many, up to the day itself; the last named weekday; this or last week or month; a month by name, with its
    day if it has one, and without a year the last one that is not to come; a year. With strict, dates and years count
    only where asks_for_a_date() says so.
    """
    low = F.lower(text)
    get = lambda p, i=1: F.nullif(F.regexp_extract(low, p, i), F.lit(""))
    number = r"(\d{1,3}|" + "|".join(NUMBERS) + ")"
    known = F.create_map(*(F.lit(x) for p in NUMBERS.items() for x in p))
    count = lambda s: F.coalesce(F.try_element_at(known, s), F.expr("0") + s.try_cast("int"))
    ago_at, past_at = rf"\b{number}\s+(day|week|month)s?\s+ago\b", rf"\b(?:last|past)\s+{number}\s+(day|week|month)s?\b"
    one_at = r"\bpast\s+(day|week|month)\b(?=\s*(?:[.,;:!?]|$)|\s+(?:or|and|to|on|in|for|about|with|but|from|we|i)\b)"
    ago, ago_unit = count(get(ago_at)), get(ago_at, 2)
    past, past_unit = F.coalesce(count(get(past_at)), F.lit(1)), F.coalesce(get(past_at, 2), get(one_at))
    named = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.coalesce(get(r"\blast\s+(" + "|".join(WEEKDAYS) + r")\b"), F.lit(""))).cast("int") - 1
    before = F.date_sub(day, (F.pmod(F.weekday(day) - named - 1, F.lit(7)) + 1).cast("int"))
    week, first = F.trunc(day, "week").cast("date"), F.trunc(day, "month")
    date = lambda *parts: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", *(F.lit(p) if isinstance(p, int) else p for p in parts)), F.lit("yyyy-MM-dd")).cast("date")
    may = asks_for_a_date(text) if strict else F.lit(True)
    iso, month = get(r"\b(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b"), get(r"\b(20\d{2}-(?:0[1-9]|1[0-2]))\b")
    iso_day, iso_month = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    year, m = get(r"\b(20\d{2})\b").cast("int"), _months(text)
    of = F.coalesce(m["year"], year, F.when(m["month"] <= F.month(day), F.year(day)).otherwise(F.year(day) - 1))
    on, whole = date(of, m["month"], m["day"]), date(of, m["month"], 1)
    cases = [
        (may & iso.isNotNull(), iso_day, F.date_add(iso_day, 1)),
        (may & month.isNotNull(), iso_month, F.add_months(iso_month, 1)),
        (low.rlike(r"\byesterday\b"), F.date_sub(day, 1), day),
        (low.rlike(r"\btoday\b"), day, F.date_add(day, 1)),
        (ago_unit == "day", F.date_sub(day, ago), F.date_add(F.date_sub(day, ago), 1)),
        (ago_unit == "week", F.date_sub(week, ago * 7), F.date_add(F.date_sub(week, ago * 7), 7)),
        (ago_unit == "month", F.add_months(first, -ago), F.add_months(first, 1 - ago)),
        (past_unit == "day", F.date_sub(day, past), F.date_add(day, 1)),
        (past_unit == "week", F.date_sub(day, past * 7), F.date_add(day, 1)),
        (past_unit == "month", F.add_months(day, -past), F.date_add(day, 1)),
        (named >= 0, before, F.date_add(before, 1)),
        (low.rlike(r"\bthis\s+week\b(?!\s+of\b)"), week, F.date_add(week, 7)),
        (low.rlike(r"\blast\s+week\b(?!\s+of\b)"), F.date_sub(week, 7), week),
        (low.rlike(r"\bthis\s+month\b"), first, F.add_months(first, 1)),
        (low.rlike(r"\blast\s+month\b"), F.add_months(first, -1), first),
        (may & m["month"].isNotNull(), F.coalesce(on, whole), F.coalesce(F.date_add(on, 1), F.add_months(whole, 1))),
        (may & year.isNotNull(), date(year, 1, 1), date(year + 1, 1, 1)),
    ]

    out = None
    for case, start, end in cases:
        span = F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
        out = F.when(case, span) if out is None else out.when(case, span)
    return out
