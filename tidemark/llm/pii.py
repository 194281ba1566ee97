"""Pseudonyms for personal data that keep its format."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_of, keyed

ROUNDS = 8
#: Characters that are permuted as one number; longer values are cut.
BLOCK = 512
_LOW, _HIGH = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Pseudonyms:
    """Keyed permutations: equal values get equal pseudonyms in every document, different ones different ones.

    With `inverse`, the way back: who has the key can restore each value from its pseudonym.
    """

    def __init__(self, key: bytes, inverse: bool = False):
        self.key = hashlib.sha256(key).digest()
        self.inverse = inverse
        self.known: dict[tuple[str, str], str] = {}

    def _word(self, tweak: str, i: int, half: int, size: int) -> int:
        """A number that is wider than size by 128 bits, from the key and all that is given."""
        return int.from_bytes(hashlib.shake_256(self.key + f"{tweak}|{i}|{half:x}".encode()).digest((size.bit_length() + 7) // 8 + 16), "big")

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A Feistel network over 0 ... size - 1; it is walked along its cycle until it falls into the range."""
        if size < 2:
            return value
        side, tweak = math.isqrt(size - 1) + 1, f"{tweak}|{size:x}"
        while True:
            left, right = divmod(value, side)
            if self.inverse:
                for i in reversed(range(ROUNDS)):
                    left, right = (right - self._word(tweak, i, left, side)) % side, left
            else:
                for i in range(ROUNDS):
                    left, right = right, (left + self._word(tweak, i, right, side)) % side
            value = left * side + right
            if value < size:
                return value

    def characters(self, text: str, tweak: str) -> str:
        """Digits become digits and letters letters of the same case; everything else stays in place.

        A value is permuted in blocks of BLOCK characters; what comes before a block is a part of its tweak.
        """
        out, before = [], ""
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            out.append(self._block(block, f"{tweak}{before}"))
            plain = out[-1] if self.inverse else block
            before = "|" + hashlib.sha256((before + plain).encode("utf-8", "surrogatepass")).hexdigest()
        return "".join(out)

    def _block(self, text: str, tweak: str) -> str:
        radix = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        size, value = 1, 0
        for c, r in zip(text, radix, strict=True):
            if r > 1:
                value, size = value * r + (int(c) if r == 10 else ord(c.lower()) - 97), size * r
        shape = re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "0", text))
        value, out = self.permute(value, size, f"{tweak}|{shape}"), []
        for c, r in zip(reversed(text), reversed(radix), strict=True):
            if r > 1:
                value, d = divmod(value, r)
                c = str(d) if r == 10 else chr(97 + d) if c.islower() else chr(65 + d)
            out.append(c)
        return "".join(reversed(out))

    def digits(self, text: str, tweak: str, valid: Callable[[str], bool] = lambda d: True, end: Callable[[str], str] = lambda d: "") -> str:
        """The digits of text in place of which others come: `end` makes check digits, and all are `valid`."""
        own = re.sub(r"\D", "", text)
        n = len(own) - len(end(own))
        new = own[:n]
        while True:
            new = str(self.permute(int(new), 10**n, tweak)).zfill(n)
            if valid(new + end(new + own[n:])):
                break
        new = iter(new + end(new + own[n:]))
        return re.sub(r"\d", lambda _: next(new), text)

    def date(self, day: datetime.date) -> datetime.date:
        return datetime.date.fromordinal(_LOW + self.permute(day.toordinal() - _LOW, _HIGH - _LOW + 1, "date"))

    def hexadecimal(self, text: str) -> str:
        """Hex digits for hex digits, in the case of the text; in blocks, as in characters()."""
        out, before = [], ""
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK].lower()
            out.append(f"{self.permute(int(block, 16), 16 ** len(block), f'hex{before}'):0{len(block)}x}")
            before = "|" + hashlib.sha256((before + (out[-1] if self.inverse else block)).encode()).hexdigest()
        return "".join(out).upper() if text.upper() == text else "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit after these."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1]


def _is_phone(d: str) -> bool:
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"


def _written_as_phone(text: str) -> bool:
    """With +1 or brackets, any ten digits are meant as a phone number, also with an area code that is not given out."""
    return text.startswith("+1") or "(" in text


def _is_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _date(y: str, m: str, d: str) -> datetime.date | None:
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return day if _LOW <= day.toordinal() <= _HIGH else None


_EMAIL = re.compile(r"(?<![\w.+%-])([A-Za-z0-9][\w.+%-]*)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.ASCII)
_SECRET = re.compile(r"((?:token|password|passwd|pwd|secret|api_?key|apikey|access_?key)\s*([=:])\s*([\"']?))([A-Za-z0-9_\-/+]{8,})", re.ASCII | re.IGNORECASE)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)
_END = r"(?![\w])(?!\.\d)"
_NUMBER = re.compile(
    rf"(?<![\w.])(?:(?P<iso>\d{{4}}-\d{{2}}-\d{{2}})(?:(?=T\d\d)|{_END})|(?:"
    r"(?P<dmy>\d{2}[./]\d{2}[./]\d{4})|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4})|(?P<world>\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5})"
    rf"){_END})",
    re.ASCII,
)


def _number(p: Pseudonyms, m: re.Match) -> tuple[str, str]:
    """(kind, pseudonym) of a match that proves valid; kind '' if it does not."""
    kind, text = m.lastgroup or "", m[0]
    d = re.sub(r"\D", "", text)
    if kind == "iso" and (day := _date(text[:4], text[5:7], text[8:])):
        return "date", p.date(day).isoformat()
    if kind == "dmy" and (day := _date(text[6:], text[3:5], text[:2])):
        return "date", p.date(day).strftime(f"%d{text[2]}%m{text[5]}%Y")
    if kind == "ip" and all(int(x) < 256 and str(int(x)) == x for x in text.split(".")):
        v = p.permute(int.from_bytes(bytes(map(int, text.split(".")))), 1 << 32, "ip")
        return "ip", ".".join(map(str, v.to_bytes(4)))
    if kind == "ssn" and _is_ssn(d):
        return "ssn", p.digits(text, "ssn", _is_ssn)
    if kind == "card" and _is_card(d):
        return "card", p.digits(text, "card", end=lambda x: luhn_digit(x[: len(d) - 1]) if len(x) >= len(d) - 1 else "0")
    if kind == "phone" and ((given_out := _is_phone(d[-10:])) or _written_as_phone(text)):
        cut = len(text) - len(re.search(r"(?:\D*\d){10}$", text)[0])
        return "phone", text[:cut] + p.digits(text[cut:], "phone", lambda x: _is_phone(x) == given_out)
    if kind == "world" and 8 <= len(d) <= 15:
        cut = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d{2}", text).end()
        return "phone", text[:cut] + p.digits(text[cut:], f"phone{text[:cut]}")
    return "", text


def _is_secret(sign: str, quote: str, value: str) -> bool:
    """Whether what stands behind such a word is meant as a secret: a word of prose after a colon is not."""
    return bool(re.search(r"\d", value)) or sign == "=" or bool(quote) or not re.fullmatch(r"[A-Za-z]?[a-z]+|[A-Z]+", value)


#: Characters of an IBAN by country, as registered. Fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_end(text: str) -> int:
    """How much of a match is a valid IBAN: the longest part that ends with a group and has its country's length; 0 if there is none."""
    for end in [len(text), *(m.start() for m in reversed(list(re.finditer(" ", text))))]:
        flat = text[:end].replace(" ", "")
        if len(flat) == IBAN_LENGTHS.get(flat[:2], len(flat)) and 15 <= len(flat) <= 34 and _iban_check(flat[:2], flat[4:]) == flat[2:4]:
            return end
    return 0


def _iban(p: Pseudonyms, flat: str) -> str:
    rest = p.characters(flat[4:], "iban")
    return flat[:2] + _iban_check(flat[:2], rest) + rest


def finds(text: str, p: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the personal data in a text; none overlap.

    All are found in the text as it came. Secrets go before addresses, those before IBANs and those before other
    numbers: what overlaps a find of an earlier kind is not looked at.
    """
    out: list[tuple[int, int, str, str]] = []

    def once(kind: str, value: str, make: Callable[[], str]) -> str:
        if (kind, value) not in p.known:
            if len(p.known) >= 1 << 16:
                p.known.clear()
            p.known[kind, value] = make()
        return p.known[kind, value]

    def free(start: int, end: int) -> bool:
        return all(end <= a or b <= start for a, b, _, _ in out)

    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            v = m[4]
            if _is_secret(m[2], m[3], v):
                plain = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v)
                out.append((m.start(4), m.end(4), "secret", once("secret", v, lambda v=v, plain=plain: p.hexadecimal(v) if plain else p.characters(v, "secret"))))
    if "@" in text:
        for m in _EMAIL.finditer(text):
            if free(*m.span()):
                out.append((*m.span(), "email", once("email", m[0], lambda m=m: p.characters(m[1], "email") + "@" + m[2])))
    if re.search(r"\d", text):
        for m in _IBAN.finditer(text):
            if (n := _iban_end(m[0])) and free(m.start(), m.start() + n):
                flat = m[0][:n].replace(" ", "")
                new = iter(once("iban", flat, lambda flat=flat: _iban(p, flat)))
                out.append((m.start(), m.start() + n, "iban", "".join(c if c == " " else next(new) for c in m[0][:n])))
        taken, at = sorted((a, b) for a, b, _, _ in out), 0
        while m := _NUMBER.search(text, at):
            if hit := next((b for a, b in taken if a < m.end() and m.start() < b), None):
                at = max(hit, m.start() + 1)
                continue
            kind, new = _number(p, m)
            if kind:
                out.append((*m.span(), kind, new))
            at = m.end()
    return sorted(out)


def pseudonymise(text: str, p: Pseudonyms) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds that were found, in order of place."""
    found = finds(text, p)
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), [kind for _, _, kind, _ in found]


#: The setting that holds the key, and the keys of applications without one.
KEY_SETTING = "spark.tidemark.pii.key"
_OWN_KEYS: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key in KEY_SETTING; an application without one has a random key of its own, so its pseudonyms link within it alone."""
    if given := spark.conf.get(KEY_SETTING, None):
        return given.encode()
    return _OWN_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pii_pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_pii, kinds): each whole text with pseudonyms for its personal data.

    Cards (Luhn), IBANs (mod 97), social security numbers, phone numbers, IPv4 addresses and dates (ISO and day first,
    1900 to 2099) are checked; valid ones are permuted by a keyed Feistel network over the values of their format and
    stay valid, with separators in place. E-mail addresses keep their domain and the pattern of their local part;
    tokens and passwords behind such a word keep theirs, whatever their length. An IBAN has one pseudonym with and
    without spaces. Equal values get equal pseudonyms everywhere, and no table links them: the key does. All finds are
    made in the text as it came and replaced once. kinds is sorted and has an entry for each find.

    A null text stays null, with no finds. All rows stay, repeated ones too; a null doc_id stays null. Texts are worked
    on where they lie, without a shuffle. An empty table gives an empty one.
    """
    null = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)).alias("k"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for b in batches:
            done = [(None, []) if (t := x.as_py()) is None else pseudonymise(t, p) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(k) for _, k in done], pa.int64()), pa.array([",".join(sorted(k)) for _, k in done], pa.string())],
                names=["k", "text", "n_pii", "kinds"],
            )

    return null.mapInArrow(run, "k long, text string, n_pii long, kinds string").select(id_of(F.col("k")).alias("doc_id"), "text", "n_pii", "kinds")
