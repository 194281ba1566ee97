"""Corrections of misspelt words, found once for each distinct word and put back into whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import cut

#: Frequent misspellings and the words meant. Fixed values.
TYPOS = {
    "teh": "the",
    "recieve": "receive",
    "recieved": "received",
    "definately": "definitely",
    "seperate": "separate",
    "seperated": "separated",
    "occured": "occurred",
    "occuring": "occurring",
    "becuase": "because",
    "thier": "their",
    "wich": "which",
    "untill": "until",
    "wierd": "weird",
    "freind": "friend",
    "adress": "address",
    "arguement": "argument",
    "begining": "beginning",
    "beleive": "believe",
    "calender": "calendar",
    "catagory": "category",
    "cemetary": "cemetery",
    "changable": "changeable",
    "collegue": "colleague",
    "comming": "coming",
    "commited": "committed",
    "completly": "completely",
    "concious": "conscious",
    "curiousity": "curiosity",
    "embarass": "embarrass",
    "enviroment": "environment",
    "existance": "existence",
    "familar": "familiar",
    "finaly": "finally",
    "foriegn": "foreign",
    "goverment": "government",
    "grammer": "grammar",
    "harrass": "harass",
    "knoe": "know",
    "kno": "know",
    "befor": "before",
    "befroe": "before",
    "pleese": "please",
    "chekc": "check",
    "realy": "really",
    "writte": "write",
    "alredy": "already",
    "diferent": "different",
    "meny": "many",
    "tesing": "testing",
    "lsresdy": "already",
    "acheive": "achieve",
    "accross": "across",
    "aparent": "apparent",
    "apparant": "apparent",
    "assasin": "assassin",
    "basicaly": "basically",
    "beggining": "beginning",
    "buisness": "business",
    "dissapear": "disappear",
    "dissapoint": "disappoint",
    "enviromental": "environmental",
    "exagerate": "exaggerate",
    "explaination": "explanation",
    "gaurd": "guard",
    "gaurantee": "guarantee",
    "hieght": "height",
    "immediatly": "immediately",
    "independant": "independent",
    "intergrate": "integrate",
    "knowlege": "knowledge",
    "libary": "library",
    "maintainance": "maintenance",
    "millenium": "millennium",
    "neccessary": "necessary",
    "noticable": "noticeable",
    "occassion": "occasion",
    "paralel": "parallel",
    "peice": "piece",
    "posession": "possession",
    "prefered": "preferred",
    "priviledge": "privilege",
    "publically": "publicly",
    "recomend": "recommend",
    "refered": "referred",
    "relevent": "relevant",
    "reccommend": "recommend",
    "succesful": "successful",
    "supercede": "supersede",
    "tommorow": "tomorrow",
    "truely": "truly",
    "usualy": "usually",
    "wether": "whether",
}
#: Tokens left alone: with digits, inner capitals, all capitals or signs, hyphens, addresses, code, or a capital at the start. Fixed values.
ALONE = r"[0-9]", r"[A-Z][a-z]+[A-Z]", r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$", r"[-_]", r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$", r"[`*_#{}\[\]\\]", r"^\p{Lu}"
#: The least length and likeness of a word near another, and the edits allowed up to five letters and beyond. Fixed values.
LEAST_LENGTH, LIKENESS, SHORT, EDITS_SHORT, EDITS = 4, 0.84, 5, 1, 2
_END = r"[.,!?;:'\")]+$"


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, _END, "")


def _open(bare: Column, protected: list[str]) -> Column:
    """Whether a token without its last marks may be changed at all."""
    out = bare != ""
    for p in ALONE:
        out = out & ~bare.rlike(p)
    return out & ~F.lower(bare).isin(*protected) if protected else out


def edits_of(length: int) -> int:
    """The edits that a word of a length may have."""
    return EDITS_SHORT if length <= SHORT else EDITS


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of a word's parts, all but as long as each other."""
    at = [length * i // parts for i in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def looked_for(word: str) -> set[str]:
    """Keys under which a word looks for others: wherever a part of a word that is so many edits away could lie in it."""
    n, k = len(word), edits_of(len(word))
    return {f"{k}:{m}:{i}:{word[s : s + end - start]}" for m in range(n - k, n + k + 1) for i, (start, end) in enumerate(cuts(m, k + 1)) for s in range(max(0, start - k), min(start + k, n - (end - start)) + 1)}


def found_under(word: str) -> set[str]:
    """Keys under which a dictionary's word is found: of its parts, one more than there may be edits, one is left whole."""
    n = len(word)
    return {f"{k}:{n}:{i}:{word[start:end]}" for k in {EDITS_SHORT, EDITS} for i, (start, end) in enumerate(cuts(n, k + 1)) if start < end}


def _keys(words: DataFrame, name: str, keys: Callable[[str], set[str]]) -> DataFrame:
    """(name, key) of words (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(w, k) for w in b.column(0).to_pylist() for k in keys(w)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in each], pa.string()), pa.array([k for _, k in each], pa.string())], names=[name, "key"])

    return words.where(F.char_length("word") >= LEAST_LENGTH - 1).select("word").mapInArrow(run, f"{name} string, key string")


#: The longest words that are compared by the letters they share; words of a block, of those that are met at once, and of a dictionary that is sent to every task at most. Fixed values.
LONGEST, WORDS, MET, SENT = 24, 1 << 16, 1 << 10, 1 << 17


def shared(length: int, near: int) -> int:
    """The fewest letters, in their order, that a word and a dictionary's word of such lengths share if they are within the edits and as like as they must be."""
    m = max(length, near) - edits_of(length)
    while 2.0 * m / (length + near) < LIKENESS:
        m += 1
    return m


def _kept(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all that is left of words of one length (letters, a row each) with n of their letters."""
    ways = list(combinations(range(letters.shape[1]), n))
    out = np.zeros((len(ways), len(letters)), np.uint64)
    for h, way in zip(out, ways, strict=True):
        for i in way:
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += letters[:, i]
    return out.ravel(), np.tile(np.arange(len(letters)), len(ways))


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near) of blocks of words and of a dictionary's (length, words, other, nears), each of one length."""
    for b in batches:
        for length, words, other, nears in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = shared(length, other)
            if n > min(length, other):
                continue
            theirs = _letters(nears, other)
            mine = _letters(words, length)
            for at in range(0, len(nears), WORDS >> 2):
                key, row = _kept(theirs[at : at + (WORDS >> 2)], n)
                o = np.argsort(key)
                key, row = key[o], row[o] + at
                for i in range(0, len(words), MET):
                    own, who = _kept(mine[i : i + MET], n)
                    first, last = np.searchsorted(key, own), np.searchsorted(key, own, "right")
                    many = last - first
                    pair = np.repeat(who, many) * len(nears) + row[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    pair = np.unique(pair)
                    found = [[words[i + k] for k in (pair // len(nears)).tolist()], [nears[k] for k in (pair % len(nears)).tolist()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], names=["word", "near"])


def _short(odd: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, near) of words of up to LONGEST letters that share enough letters in their order; some more by chance.

    Words are dealt into blocks of one length and meet the blocks of the dictionary whose lengths come near. What is left
    of a word without the letters it may lose is made in the task, so no key of a word is moved. A large dictionary is
    shuffled, once for each part of the words.
    """
    length, (n, m) = F.char_length("word"), (max(1, -(-x.count() // WORDS)) for x in (odd, dictionary))
    dealt = lambda words, parts: words.groupBy(length.alias("length"), F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list("word").alias("words"))
    theirs = dealt(dictionary.where(length <= LONGEST + EDITS), m).select(F.col("length").alias("other"), F.col("words").alias("nears"))
    theirs = theirs.withColumn("length", F.explode(F.sequence(F.col("other") - EDITS, F.col("other") + EDITS)))
    mine = dealt(odd.where(length <= LONGEST), n)
    if m * WORDS <= SENT:
        both = mine.join(F.broadcast(theirs), "length")
    else:
        both = mine.join(theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("shuffle_hash"), ["length", "part"])
    return both.select("length", "words", "other", "nears").mapInArrow(_met, "word string, near string")


@F.pandas_udf(DoubleType())
def likeness(near: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(near, word, strict=True)], dtype=float)


def corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, fixed) of distinct lower-case words that are frequent misspellings or have one nearest word in a dictionary (word).

    Words that are near and like enough share most of their letters in order, so they agree in something that is left of both
    without the others. Of the parts of a longer word, one more than the edits that are allowed, one lies whole in any word that
    is so near, moved by no more places than there are edits; lengths, parts and places are what these are joined on. Of the two
    likest the first is taken, unless the second needs no more edits. Words farther away are never looked at.
    """
    table = F.create_map(*(F.lit(x) for pair in TYPOS.items() for x in pair))
    known = words.select("word", F.try_element_at(table, F.col("word")).alias("fixed"))
    dictionary = cut(dictionary.select("word").distinct())
    odd = cut(known.where(F.col("fixed").isNull() & (F.char_length("word") >= LEAST_LENGTH)).select("word").join(dictionary, "word", "left_anti"))
    far = F.levenshtein("word", "near", EDITS)  # -1 beyond
    long = _keys(odd.where(F.char_length("word") > LONGEST), "word", looked_for).hint("shuffle_hash")
    met = _keys(dictionary.where(F.char_length("word") > LONGEST - EDITS), "near", found_under).join(long, "key").select("word", "near")
    near = met.unionAll(_short(odd, dictionary)).where((far >= 0) & (far <= F.when(F.char_length("word") <= SHORT, EDITS_SHORT).otherwise(EDITS)))
    pairs = near.select("word", "near").distinct().withColumn("edits", far).withColumn("like", likeness("near", "word")).where(F.col("like") >= LIKENESS)
    w = Window.partitionBy("word").orderBy(F.desc("like"), F.desc("near"))
    first = pairs.withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead("edits").over(w)).where("nth = 1 and (next is null or next > edits)")
    return known.where("fixed is not null").unionAll(first.select("word", F.col("near").alias("fixed")))


def correct(texts: DataFrame, dictionary: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """(id, text, n_fixed) of texts (id, text): each token corrected but for its last marks. Null texts stay null."""
    protected = [p.lower() for p in protected or []]
    bare = F.filter(F.transform(F.split("text", r"\s+"), _bare), lambda b: _open(b, protected))
    used = cut(texts.select("id", F.explode(F.array_distinct(F.transform(bare, F.lower))).alias("word")).distinct())
    fixes = cut(corrections(used.select("word").distinct(), dictionary))
    each = used.join(fixes, "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("fixes"))
    parts = F.regexp_extract_all(F.when(F.col("fixes").isNotNull(), F.col("text")), F.lit(r"\s+|\S+"), F.lit(0))
    fix = lambda t: F.try_element_at(F.col("fixes"), F.lower(_bare(t)))
    fixed = lambda t: F.when(fix(t).isNotNull() & _open(_bare(t), protected), F.concat(fix(t), F.regexp_extract(t, _END, 0)))
    rows = texts.select("id", "text").join(each, "id", "left").select("id", "text", F.transform(parts, lambda t: F.struct(t.alias("t"), fixed(t).alias("new"))).alias("parts"))
    put = F.array_join(F.transform("parts", lambda p: F.coalesce(p["new"], p["t"])), "")
    return rows.select("id", F.when(F.col("parts").isNull(), F.col("text")).otherwise(put).alias("text"), F.when(F.col("parts").isNull(), 0).otherwise(F.size(F.filter("parts", lambda p: p["new"].isNotNull()))).alias("n_fixed"))
