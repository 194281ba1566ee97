"""Texts put in other words: relative dates with the day they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mean a day, by its distance from today. Fixed values.
DAYS_AWAY = {
    "day before yesterday": -2,
    "yesterday": -1,
    "last night": -1,
    "today": 0,
    "tonight": 0,
    "tomorrow": 1,
    "day after tomorrow": 2,
}
#: Phrases that mean a week or a month, by its distance from this one. Fixed values.
WEEKS_AWAY = {"last week": -1, "next week": 1}
MONTHS_AWAY = {"last month": -1, "next month": 1}
#: Days by name, and the words before one that say which is meant. Fixed values.
DAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
DAY_WORDS = ["last", "next", "this", "on"]
#: Words of a sentence that put "on" and a day into the future. Fixed values.
AHEAD = r"(?i)\b(will|won't|going to|plans? to|planned|scheduled|due|upcoming|next steps?|to be|need to|needs to|expects?|expected|by)\b|'ll\b"
#: What is never changed: blocks of code, code, addresses, quotations. Fixed values.
KEPT = ["(?s:```.*?```)", "`[^`\\n]*`", "https?://\\S+", "\"[^\"\\n]*\"", "“[^”\\n]*”"]
#: Parts of a text, which together are the text: what is kept, runs of white space, words, and single signs.
PARTS = "|".join(KEPT) + r"|\s+|[\p{L}\p{N}_]+|(?s:.)"


def _meanings() -> dict[str, tuple[str, int]]:
    """Every phrase with the kind of date that it means and a number: days, weeks, months, or the place of the weekday."""
    table = {p: ("day", n) for p, n in DAYS_AWAY.items()} | {p: ("week", n) for p, n in WEEKS_AWAY.items()} | {p: ("month", n) for p, n in MONTHS_AWAY.items()}
    return table | {f"{w} {d}": (w, n) for w in DAY_WORDS for n, d in enumerate(DAY_NAMES)}


def _date(kind: Column, n: Column, day: Column, sentence: Column) -> Column:
    """What a phrase means, seen from a day."""
    monday = F.trunc(day, "week")
    # the named day after today, and the last one before it: weekdays are counted from the Monday of this week
    after = F.date_add(day, (F.pmod(n - F.weekday(day) - 1, F.lit(7)) + 1).cast("int"))
    before = F.date_sub(day, (F.pmod(F.weekday(day) - n - 1, F.lit(7)) + 1).cast("int"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return (
        F.when(kind == "day", iso(F.date_add(day, n)))
        .when(kind == "week", F.concat(F.lit("week of "), iso(F.date_add(monday, n * 7))))
        .when(kind == "month", F.date_format(F.add_months(F.trunc(day, "month"), n), "yyyy-MM"))
        .when(kind == "this", iso(F.date_add(monday, n)))
        .when((kind == "next") | (kind == "on") & sentence.rlike(AHEAD), iso(after))
        .otherwise(iso(before))
    )


def resolve_dates(text: Column, day: Column) -> Column:
    """A text with the day that each relative date means, in brackets after it. Null text or day: unchanged.

    The text is split into parts; a phrase of one, two or three words is looked up with its words a space apart. One
    that is followed by a genitive s or by brackets with a digit is left as it is, and so is what stands in code, in
    addresses and in quotations.
    """
    meanings = _meanings()
    kinds = F.create_map(*(F.lit(x) for p, (k, _) in meanings.items() for x in (p, k)))
    numbers = F.create_map(*(F.lit(x) for p, (_, n) in meanings.items() for x in (p, n)))
    parts = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(""))

    def marked(p: Column) -> Column:
        low = F.transform(p, lambda x: F.when(x.rlike(r"^\s+$"), F.lit(" ")).otherwise(F.lower(x)))

        def of(q: Column) -> Column:
            phrase = lambda i, n: F.array_join(F.slice(q, F.greatest(i, F.lit(0)) + 1, n), "")

            def tail(i: Column) -> Column:
                """What comes after the phrase that ends with part i, if there is one: brackets with its date."""
                three, two, one = phrase(i - 4, 5), phrase(i - 2, 3), at(q, i)
                found = F.when((i >= 4) & kinds_of(three).isNotNull(), three).when((i >= 2) & kinds_of(two).isNotNull(), two).when(kinds_of(one).isNotNull(), one)
                rest = F.array_join(F.slice(p, i + 2, F.size(p)), "")
                blocked = rest.rlike(r"^['’]s(?![\p{L}\p{N}_])") | rest.rlike(r"^\s*\([^)\n]*\d[^)\n]*\)")
                sentence = F.concat(F.element_at(F.split(F.array_join(F.slice(p, F.lit(1), i + 1), ""), r"\."), -1), F.element_at(F.split(rest, r"\."), 1))
                date = _date(kinds_of(found), F.try_element_at(numbers, found), day, sentence)
                return F.when(found.isNotNull() & ~blocked, F.concat(F.lit(" ("), date, F.lit(")"))).otherwise("")

            return F.array_join(F.transform(p, lambda x, i: F.concat(x, F.when(at(q, i).isin(*ENDS), tail(i)).otherwise(""))), "")

        return F.transform(F.array(low), of)[0]

    def kinds_of(phrase: Column) -> Column:
        return F.try_element_at(kinds, phrase)

    done = F.transform(F.array(parts), marked)[0]
    return F.when(text.isNull() | day.isNull() | (text == ""), text).otherwise(done)


#: The last words of all phrases: only after these is anything looked up.
ENDS = sorted({p.rsplit(" ", 1)[-1] for p in _meanings()})
