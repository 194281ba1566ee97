"""Relative dates by hand, and spelling against brute force."""

import datetime as dt
import difflib
import random
import re

from pyspark.sql import functions as F

from tidemark.functions.wording import resolve_dates
from tidemark.operators import spelling as P

DAY = dt.date(2024, 1, 31)  # a Wednesday


DATED = [
    ("Met yesterday and on Friday.", "Met yesterday (2024-01-30) and on Friday (2024-01-26)."),
    ("We will meet on Friday. Was there on Monday", "We will meet on Friday (2024-02-02). Was there on Monday (2024-01-29)"),
    ("last week, next month, last month", "last week (week of 2024-01-22), next month (2024-02), last month (2023-12)"),
    ('`today` "tomorrow" https://x/today today', '`today` "tomorrow" https://x/today today (2024-01-31)'),
    ("last Wednesday this Monday next Wednesday", "last Wednesday (2024-01-24) this Monday (2024-01-29) next Wednesday (2024-02-07)"),
    ("yesterday (2024-01-30), today's plan", "yesterday (2024-01-30), today's plan"), ("", ""), (None, None),
    ("The day before yesterday, the day after tomorrow, last night and tonight", "The day before yesterday (2024-01-29), the day after tomorrow (2024-02-02), last night (2024-01-30) and tonight (2024-01-31)"),
    ("yesterday's paper of YESTERDAY, todays", "yesterday's paper of YESTERDAY (2024-01-30), todays"),
]


def test_dates(spark):
    """Dates come behind phrases; a text that has them stays as it is, and so does one without a day."""
    rows = spark.createDataFrame([(t, w, DAY, None) for t, w in DATED], "t string, w string, d date, n date")
    for r in rows.select("t", "w", resolve_dates(F.col("t"), F.col("d")).alias("once"), resolve_dates(F.col("w"), F.col("d")).alias("again"), resolve_dates(F.col("t"), F.col("n")).alias("none")).collect():
        assert r["once"] == r["w"] and r["again"] == r["w"] and r["none"] == r["t"]


def test_dates_in_a_table(spark):
    rows = spark.createDataFrame([("today", DAY), (None, DAY), ("today", None)], "t string, d date")
    assert [r[0] for r in rows.select(resolve_dates(F.col("t"), F.col("d"))).collect()] == ["today (2024-01-31)", None, "today"]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _brute(text, words):
    def one(m):
        token = m[0]
        bare = re.sub(P._END, "", token)
        if not bare or any(re.search(p, bare) for p in P.ALONE[:-1]) or bare[0].isupper():
            return token
        low = bare.lower()
        if low in P.TYPOS:
            return P.TYPOS[low] + token[len(bare) :]
        if low in words or len(low) < 4:
            return token
        most = 1 if len(low) <= 5 else 2
        near = sorted(((difflib.SequenceMatcher(None, w, low).ratio(), w) for w in words if _edits(w, low) <= most), reverse=True)
        near = [w for s, w in near if s >= P.LIKENESS]
        return token if not near or len(near) > 1 and _edits(near[1], low) <= _edits(near[0], low) else near[0] + token[len(bare) :]

    return re.sub(r"\S+", one, text)


def test_spelling_like_brute_force(spark):
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcde") + r.choice("aeiou") for _ in range(r.randint(2, 5))) for _ in range(150)} | {"über", "search", "receive"})

    def slip(w):
        i = r.randrange(len(w))
        return r.choice([w, w[:i] + w[i + 1 :], w[:i] + r.choice("abcxyz") + w[i:], w[:i] + r.choice("xyz") + w[i + 1 :], w.upper(), w.title(), w + "1", w[:i] + w[i + 1 :][::-1]])

    texts = [(n, "".join(slip(r.choice(words)) + r.choice([" ", ", ", ".\n", "  ", "! ", "-"]) for _ in range(30))) for n in range(40)]
    texts += [(90, None), (91, ""), (92, " \n "), (93, "Teh teh, recieve's https://recieve.com recieve! recieve_it"), (94, texts[3][1])]
    got = {x["id"]: x for x in P.correct(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert len(got) == len(texts)
    for n, t in texts:
        assert got[n]["text"] == (t if t is None else _brute(t, set(words))), t
    assert sum(x["n_fixed"] for x in got.values()) > 50


def test_every_word_within_its_edits_shares_a_key():
    import random

    r = random.Random(4)
    for _ in range(4000):
        word = "".join(r.choice("abcé") for _ in range(r.randrange(4, 14)))
        near = list(word)
        for _ in range(P.edits_of(len(word))):
            at, kind = r.randrange(len(near) + 1), r.randrange(3)
            if kind == 0:
                near.insert(at, r.choice("abcé"))
            elif at < len(near):
                near[at : at + 1] = [r.choice("abcé")] * (kind - 1)
        if len(near) >= P.LEAST_LENGTH - 1:
            assert P.looked_for(word) & P.found_under("".join(near)), (word, near)
