"""Phone numbers that are written as such, whatever their area code."""

import random
import re

import pytest

from tidemark.llm import pii


@pytest.mark.parametrize("text", ["+1 (162) 555-6820", "+1 (042) 055-6820", "+1-642-155-6820", "+1.162.555.6820", "(162) 555-6820", "1 (162) 155-6820"])
def test_written_phones_get_pseudonyms(text):
    new, kinds = pii.pseudonymise(f"call {text}, soon", pii.Pseudonyms(b"key"))
    assert kinds == ["phone"] and text not in new
    country = "+1" if text[0] == "+" else "1" if text[0] == "1" else ""
    assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {text}, soon") and new[5:].startswith(country)


def test_bare_digits_must_be_given_out():
    p = pii.Pseudonyms(b"key")
    assert pii.pseudonymise("162-555-6820 or 1-162-555-6820", p) == ("162-555-6820 or 1-162-555-6820", [])
    bare, full = (pii.pseudonymise(t, p)[0] for t in ("642-555-6820", "+1 (642) 555-6820"))
    assert re.sub(r"\D", "", bare) == re.sub(r"\D", "", full)[1:]


def test_phones_stay_different_and_of_their_kind():
    r, p = random.Random(6), pii.Pseudonyms(b"key")
    texts = {f"+1 ({r.randrange(1000):03d}) {r.randrange(1000):03d}-{r.randrange(10000):04d}" for _ in range(500)}
    new = {t: pii.pseudonymise(t, p)[0] for t in texts}
    assert len(set(new.values())) == len(texts)
    assert all(pii._is_phone(re.sub(r"\D", "", t)[1:]) == pii._is_phone(re.sub(r"\D", "", n)[1:]) for t, n in new.items())
