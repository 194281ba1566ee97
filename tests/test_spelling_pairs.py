"""Words met by what is left of them, against all pairs."""

import difflib
import random

from tidemark.operators import spelling as P


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_words_meet_only_words_that_are_near(spark, monkeypatch):
    """Nothing near is lost, whatever the length, in small blocks too; little that is far away is met, so no keys of words are moved."""
    r = random.Random(3)
    dictionary = sorted({"".join(r.choice("abcdé𝒳") for _ in range(r.randrange(3, 29))) for _ in range(150)})

    def slip(w):
        for _ in range(r.randrange(1, 3)):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abxé") + w[i:], w[:i] + r.choice("abxé") + w[i + 1 :]]) or "a"
        return w

    words = sorted({slip(w) for w in dictionary for _ in range(2)} - set(dictionary))
    near = {(a, b) for a in words if len(a) >= P.LEAST_LENGTH for b in dictionary if abs(len(a) - len(b)) < 3 and _edits(a, b) <= P.edits_of(len(a)) and difflib.SequenceMatcher(None, b, a).ratio() >= P.LIKENESS}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    for blocks, sent in ((P.WORDS, P.SENT), (100, 0)):
        monkeypatch.setattr(P, "WORDS", blocks)
        monkeypatch.setattr(P, "SENT", sent)
        met = [tuple(x) for x in P._short(frame([w for w in words if len(w) >= P.LEAST_LENGTH]), frame(dictionary)).collect()]
        assert {p for p in near if len(p[0]) <= P.LONGEST} <= set(met)
        assert len(met) < 3 * len(near)
        fixed = dict(map(tuple, P.corrections(frame(words), frame(dictionary)).collect()))
        best = {}
        for a, b in near:
            best.setdefault(a, []).append((difflib.SequenceMatcher(None, b, a).ratio(), b))
        for a, found in best.items():
            found.sort(reverse=True)
            assert fixed.get(a) == (found[0][1] if len(found) == 1 or _edits(a, found[1][1]) > _edits(a, found[0][1]) else None), a
        assert set(fixed) <= set(best) | set(P.TYPOS)
    assert any(len(a) > P.LONGEST for a, _ in near)
