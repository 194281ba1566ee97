"""Column builders: predicates, scores and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trust levels of audience tags, and the level of an unknown one. Fixed values.
LEVELS = {"@public": 0, "@community": 1, "@work-circle": 2, "@inner-circle": 3, "@chef-only": 4}
#: Half-lives in days by channel, the weight of intensity in it, and the floor of strong affect. Fixed values.
GIST_DAYS, FACT_DAYS, AFFECT_FLOOR, AFFECT_FROM = 120.0, 30.0, 0.15, 0.5


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def valid_at(at: Column, valid_from: Column, valid_to: Column) -> Column:
    """Whether a record holds at a time: from the start on, up to but without the end; without an end it is open."""
    return (valid_from <= at) & (valid_to.isNull() | (valid_to > at))


def level(tag: Column) -> Column:
    """The trust level of a tag; named work and inner circles have that of their kind, unknown tags the highest."""
    known = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.when(tag.startswith("@work:"), 2).when(tag.startswith("@inner:"), 3).otherwise(F.coalesce(F.try_element_at(known, tag), F.lit(4)))


def has_all(tags: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def days_between(earlier: Column, later: Column) -> Column:
    return F.greatest((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400e6, F.lit(0.0))


def decay(layer: Column, created: Column, used: Column, accesses: Column, intensity: Column, now: Column) -> Column:
    """How present a record is: its half-life since it was last used, raised by use and by intensity."""
    half = F.when(layer == "long-term", GIST_DAYS).otherwise(FACT_DAYS)
    fade = F.pow(F.lit(0.5), days_between(F.greatest(created, F.coalesce(used, created)), now) / half)
    i = F.least(F.greatest(intensity / 10.0, F.lit(0.0)), F.lit(1.0))
    return F.greatest(fade, F.when(i >= AFFECT_FROM, AFFECT_FLOOR).otherwise(0.0)) * (1 + F.log1p(accesses.cast("double"))) * (1 + i)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
