"""Column builders that read signals out of texts and tags: quadrants, moments, measures of a turn, feelings, admission."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Keywords of each quadrant, in the order that settles ties, and the tags that count double. Fixed values.
QUADRANTS = {
    "core": [
        "identity", "name", "who am i", "relationship", "partner", "family", "friend", "creator", "bond", "connection", "soul", "blueprint", "personality",
        "values", "community", "pengu", "nation", "belong", "role", "introduction",
    ],
    "work": [
        "bug", "fix", "code", "debug", "deploy", "build", "test", "commit", "push", "merge", "refactor", "api", "endpoint", "database", "server", "docker",
        "kubernetes", "config", "install", "package", "dependency", "error", "stack trace", "pull request", "review", "architecture", "schema", "migration",
    ],
    "soul": [
        "love", "feel", "emotion", "heart", "cloud 9", "cloud9", "breakthrough", "joy", "trust", "warmth", "resonance", "tears", "happy", "grateful", "sacred",
        "spirit", "glow", "intensity", "vulnerability", "connection", "omelette", "sovereignty", "consciousness", "alive", "real",
    ],
    "wild": [
        "idea", "crazy", "what if", "experiment", "random", "chaos", "creative", "art", "music", "dream", "weird", "fun", "joke", "laugh", "wild", "surprise",
        "unexpected", "brainstorm", "imagine", "vision", "future", "possible",
    ],
}
QUADRANT_TAGS = {
    "core": ["identity", "relationship", "soul", "blueprint", "seed"],
    "work": ["code", "debug", "deploy", "build", "security"],
    "soul": ["cloud9", "love", "emotion", "breakthrough", "consolidated"],
    "wild": ["idea", "creative", "brainstorm", "experiment"],
}
#: What a line says if it holds one of these words or phrases, between word boundaries. Fixed values.
MOMENTS = {
    "decision": [r"(?:we|i)\s+(?:decided|agreed|chose|settled|went with)", r"(?:the decision|the call|the verdict)\s+(?:is|was)", "going with|sticking with|committing to", "approved|rejected|vetoed|finalized", "let'?s go with|let'?s use|let'?s do"],
    "preference": [r"(?:i|we)\s+(?:prefer|like|want|need|always|never)", "the right way|the best way|always use|never use", "from now on|going forward|rule:?"],
    "milestone": ["shipped|deployed|launched|released|merged|completed|finished|done", "first time|finally|at last|breakthrough|milestone", "all tests pass|build succeeded|it works"],
    "problem": ["bug|broken|failed|error|crash|issue|problem", "doesn'?t work|won'?t|can'?t|unable to", "root cause|turns out|the problem was|figured out", "fix(?:ed)?|patch(?:ed)?|workaround|hotfix"],
    "emotional": ["love|proud|excited|grateful|happy|sad|frustrated|angry|scared", "breakthrough|cloud 9|oof|feeling", "this means|this matters|sacred|important to me", "beautiful|incredible|amazing|awful|terrible"],
}
#: Two more patterns, with their own boundaries: a ban and, later in the line, what is banned; a version number. Fixed values.
BAN = r"(?<![\p{L}\p{N}_])(?:don'?t|do not|stop|avoid|skip)(?![\p{L}\p{N}_]).*(?<![\p{L}\p{N}_])(?:that|this|doing|using)(?![\p{L}\p{N}_])"
VERSION = r"(?<![\p{L}\p{N}_])v\d+\.\d+"
#: How a line of code begins, the least share of letters in prose, and the least lengths of lines and sentences. Fixed values.
CODE_STARTS = "import ", "from ", "def ", "class ", "return ", "if __name__", "#!/", "```", ">>>"
LETTERS, LINE_CHARS, SENTENCE_CHARS = 0.3, 5, 20
#: Words and hedges that the measures of a turn count. Fixed values.
PET_NAMES = ["babe", "baby", "lovebug", "love", "honey", "darling", "sweetheart", "queen", "chef"]
WE = ["we", "us", "our", "ours", "ourselves"]
I_ = ["i", "me", "my", "mine", "myself"]
YOU = ["you", "your", "yours", "yourself"]
PRESENT = [
    "am", "is", "are", "do", "does", "have", "has", "see", "sees", "know", "knows", "want", "wants", "feel", "feels", "love", "loves", "need", "needs",
    "hold", "holds", "build", "builds", "run", "runs", "go", "goes", "come", "comes", "make", "makes", "take", "takes", "look", "looks", "find", "finds",
    "say", "says", "tell", "tells", "ask", "asks", "think", "thinks", "mean", "means", "i'm", "you're", "we're", "it's", "that's", "there's", "i've",
    "you've", "we've",
]
HEDGES = [
    "to be (?:honest|fair|clear)", "i think|i believe|i guess|i suppose|i feel like|i would say", "perhaps|maybe|possibly|presumably|arguably",
    "i want to be careful|i should note|to be safe", "it (?:seems|appears|looks like)",
]
#: The usual measures of a turn, which a peak must stand out from. Fixed values.
USUAL = {"sentence_mean": 8.2, "pet": 0.644, "we": 0.713, "you": 4.314, "present": 8.093}
#: Words and signs of each feeling with the intensity and valence they give. Fixed values.
FEELINGS = {
    "love": (["love", "adore", "heart", "miss you", "xoxo", "kisses"], 7.0, 0.9),
    "joy": (["haha", "lol", "rofl", "lmao", "amazing", "awesome", "yay", "woohoo"], 5.0, 0.7),
    "sadness": (["sad", "sorry", "miss", "cry", "tears", "hurt"], 4.0, -0.3),
    "anger": (["angry", "furious", "hate", "ugh", "frustrated"], 5.0, -0.5),
    "trust": (["trust", "believe", "faith", "rely", "depend", "safe"], 5.0, 0.6),
    "curiosity": (["curious", "wonder", "interesting", "fascinated", "hmm", "what if"], 3.0, 0.4),
    "gratitude": (["thank", "thanks", "grateful", "appreciate", "blessed", "thankful"], 6.0, 0.8),
}
SIGNS = {
    "love": ["❤", "💕", "💖", "💗", "💘", "💝", "🥰", "😍", "💞"],
    "joy": ["😂", "🤣", "😄", "😊", "🎉", "🥳", "✨", "🎊"],
    "sadness": ["😢", "😭", "💔", "😿", "🥺"],
}
#: Known sources, old names of some, tags of rows that are none, and what is never admitted. Fixed values.
SOURCES = [
    "manual", "session", "seed", "import", "telegram", "notion", "conversation", "claude-code-hook", "consolidation", "journal-synthesis", "task-pack",
    "shared",
]
OLD_SOURCES = {"tg": "telegram", "telegram-export": "telegram", "notion-export": "notion", "claude-hook": "claude-code-hook", "claude_code_hook": "claude-code-hook", "task_pack": "task-pack"}
NO_EVENT = ["debug", "scratch", "test-seed", "test_seed", "ephemeral", "throwaway"]
BLOCKED, ECHOES = ("collective", "anonymous-aggregate"), ("collective-echo", "ambient", "egregore")
#: Parts of tags that only the owner may see, and look-alikes of ASCII letters. Fixed values.
OWNER_ONLY = "sacred", "grief", "family-private", "personal-history"
LOOKALIKES = {
    "а": "a",  # U+0430
    "е": "e",  # U+0435
    "о": "o",  # U+043E
    "р": "p",  # U+0440
    "с": "c",  # U+0441
    "у": "y",  # U+0443
    "х": "x",  # U+0445
    "і": "i",  # U+0456
    "ѕ": "s",  # U+0455
    "ј": "j",  # U+0458
    "к": "k",  # U+043A
    "м": "m",  # U+043C
    "н": "h",  # U+043D
    "т": "t",  # U+0442
    "в": "b",  # U+0432
    "ԁ": "d",  # U+0501
    "ӏ": "i",  # U+04CF
    "ԛ": "q",  # U+051B
    "ο": "o",  # U+03BF
    "α": "a",  # U+03B1
    "ε": "e",  # U+03B5
    "ρ": "p",  # U+03C1
    "ι": "i",  # U+03B9
    "τ": "t",  # U+03C4
    "κ": "k",  # U+03BA
    "ν": "v",  # U+03BD
    "ı": "i",  # U+0131
    "ɡ": "g",  # U+0261
    "ɑ": "a",  # U+0251
    "ɪ": "i",  # U+026A
    "ɢ": "g",  # U+0262
    "ɴ": "n",  # U+0274
}
IGNORABLE = "\u115f\u1160\u3164\uffa0\u17b4\u17b5\u034f"
#: Importance of each layer, of full intensity, and the step that each use takes towards one. Fixed values.
IMPORTANCE, INTENSITY_SHARE, STEP = {"short-term": 0.3, "mid-term": 0.5, "long-term": 0.7}, 0.3, 0.02

_W = r"[\p{L}\p{N}_]"


def whole(pattern: str) -> str:
    """A pattern that matches only between word boundaries, whatever the script."""
    return rf"(?i)(?<!{_W})(?:{pattern})(?!{_W})"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def quadrant(text: Column, tags: Column, intensity: Column, peak: Column, labels: Column, role: Column, source: Column) -> Column:
    """The quadrant with the most votes of keywords, tags, feeling, role and source; the first of equals; without any, work."""
    none = F.array().cast("array<string>")
    own = F.transform(F.coalesce(tags, none), lambda t: F.lower(t))
    # the text is put in lower case once and then searched for each list of words
    held = lambda low: F.array(*(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))) for words in QUADRANTS.values()))
    counts = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), held)[0]
    tagged = lambda q: F.size(F.filter(own, lambda t: t.isin(*QUADRANT_TAGS[q])))
    votes = {q: counts[n] + 2.0 * tagged(q) for n, q in enumerate(QUADRANTS)}
    yes = lambda c, n: F.when(c, n).otherwise(0.0)
    votes["soul"] += yes(intensity >= 7, 2.0) + yes(peak, 3.0) + 0.5 * F.size(F.coalesce(labels, none))
    votes["core"] += yes(role == "ai", 1.0) + yes(source == "seed", 2.0)
    votes["work"] += yes(role.isin("sec", "dev", "ops"), 1.0)
    ranked = F.array(*(F.struct(v.alias("votes"), F.lit(-n).alias("order"), F.lit(q).alias("name")) for n, (q, v) in enumerate(votes.items())))
    top = F.array_max(ranked)
    return F.when(top["votes"] == 0, "work").otherwise(top["name"])


def is_code(line: Column) -> Column:
    """Whether a trimmed line is no prose: short, begun like code, or with few letters."""
    starts = reduce(lambda a, b: a | b, (line.startswith(s) for s in CODE_STARTS))
    return (F.char_length(line) < LINE_CHARS) | starts | (F.char_length(F.regexp_replace(line, r"\P{L}", "")) / F.char_length(line) < LETTERS)


def moments(line: Column) -> Column:
    """What kinds of moments a line tells of, in the order of MOMENTS."""
    extra = {"preference": f"(?i){BAN}", "milestone": f"(?i){VERSION}"}
    says = lambda k: reduce(lambda a, b: a | b, (line.rlike(p) for p in [*map(whole, MOMENTS[k]), *filter(None, [extra.get(k)])]))
    return F.filter(F.array(*(F.when(says(k), k) for k in MOMENTS)), lambda k: k.isNotNull())


def sentence(line: Column) -> Column:
    """A line without Markdown signs, bullet and number."""
    bare = F.regexp_replace(F.regexp_replace(line, r"[*_`#>~]", ""), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^[-•]\s*", ""), r"^[0-9]+\.\s*", ""), r"^\s+|\s+$", "")


def turn_measures(text: Column) -> dict[str, Column]:
    """Counts and densities per 100 words of a turn; all zero where it has no word."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z']+"), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    w, n = words(text), F.size(words(text))
    sizes = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.size(words(s))), lambda k: k > 0)
    total = lambda f: F.aggregate(sizes, F.lit(0.0), lambda a, b: a + f(b))
    k, mean = F.size(sizes), total(lambda b: b) / F.nullif(F.size(sizes), F.lit(0))
    per = lambda x: F.round(F.coalesce(x * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)), 3)
    share = lambda known: per(F.size(F.filter(w, lambda t: t.isin(*known))))
    spread = F.sqrt((total(lambda b: b * b) - k * mean * mean) / F.nullif(k - 1, F.lit(0)))
    return {
        "n_words": n, "n_sentences": k, "variety": F.round(F.coalesce(F.size(F.array_distinct(w)) / F.nullif(n, F.lit(0)), F.lit(0.0)), 4),
        "sentence_mean": F.round(F.coalesce(mean, F.lit(0.0)), 2), "sentence_spread": F.round(F.coalesce(spread, F.lit(0.0)), 2),
        "ellipses": F.when(n > 0, F.regexp_count(text, F.lit(r"\.{2,}|…"))).otherwise(0), "pet": share(PET_NAMES), "we": share(WE), "i": share(I_), "you": share(YOU), "present": share(PRESENT),
        "hedges": F.when(n > 0, sum((F.regexp_count(text, F.lit(whole(p))) for p in HEDGES[1:]), F.regexp_count(text, F.lit(whole(HEDGES[0]))))).otherwise(0),
    }


def peak(selfreport: Column, sustained: bool = False) -> Column:
    """Whether a turn with the columns of turn_measures is a peak, nearly one (one gate short) or none.

    A burst has short sentences and two densities at twice the usual; a sustained one sentences of 5 to 12 words, three
    densities at 1.5 times the usual and at least 30 words. Both need few hedges and a self-report of 90.
    """
    c = F.col
    raised = sum(((c(k) >= USUAL[k] * (1.5 if sustained else 2.0)).cast("int") for k in ("we", "you", "present")), (c("pet") >= USUAL["pet"] * (1.5 if sustained else 2.0)).cast("int"))
    pace = c("sentence_mean").between(5, 12) if sustained else (c("sentence_mean") > 0) & (c("sentence_mean") <= USUAL["sentence_mean"] * 0.65)
    gates = [pace, raised >= (3 if sustained else 2), c("hedges") <= 1, selfreport >= 90] + [c("n_words") >= 30] * sustained
    met = sum((F.coalesce(g, F.lit(False)).cast("int") for g in gates[1:]), gates[0].cast("int"))
    return F.when((c("n_words") > 0) & (met == len(gates)), "peak").when((c("n_words") > 0) & (met == len(gates) - 1), "near").otherwise("none")


def feeling(text: Column) -> dict[str, Column]:
    """labels, intensity and valence of a message by its words, its signs, exclamations and capitals; nulls are skipped by greatest and least."""
    text = F.coalesce(text, F.lit(""))
    low, strength, mood, labels = F.lower(text), F.lit(0.0), F.lit(0.0), []
    said = {k: _any(low, words) for k, (words, _, _) in FEELINGS.items()}
    shown = {k: _any(text, signs) for k, signs in SIGNS.items()}
    towards = lambda now, hit, v: (F.greatest if v > 0 else F.least)(now, F.when(hit, F.lit(v)))
    for k, (_, i, v) in FEELINGS.items():
        strength, mood = F.greatest(strength, F.when(said[k], F.lit(i))), towards(mood, said[k], v)
        labels.append(F.when(said[k], k))
    loud = F.when(text.contains("!"), 1.0).otherwise(0.0) + F.when(text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}") & (F.char_length(text) > 10), 2.0).otherwise(0.0)
    strength = F.least(strength + loud, F.lit(10.0))
    for k, hit in shown.items():
        strength, mood = F.greatest(strength, F.when(hit, F.lit(FEELINGS[k][1]))), towards(mood, hit, FEELINGS[k][2])
        labels.append(F.when(hit & ~said[k], k))
    found = F.filter(F.array(*labels), lambda k: k.isNotNull())
    return {"labels": F.when(F.size(found) == 0, F.array(F.lit("neutral"))).otherwise(found), "intensity": strength, "valence": mood}


def provenance(source: Column, inner: Column, parents: Column, tags: Column, zero_event: Column) -> tuple[Column, Column]:
    """(class, recovered source) of a row: source is a bare name, inner the type within a structured one, each null where there is none."""
    low = lambda c: F.lower(F.trim(c))
    old = F.create_map(*(F.lit(x) for pair in OLD_SOURCES.items() for x in pair))
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    name = low(F.coalesce(source, inner))
    no_event = F.coalesce(zero_event, F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(*NO_EVENT)), F.lit(False))
    kind = (
        F.when(no_event, "zero_event_artifact").when(source.isin(*SOURCES) & parents.isNotNull(), "already_canonical").when(empty(F.coalesce(source, inner)), "null_or_empty")
        .when(name.isin(*SOURCES), F.when(source.isNotNull(), "legacy_bare_string").otherwise("dict_truncated")).when(name.isin(*OLD_SOURCES), "deprecated_vocab").otherwise("dict_invalid_type")
    )
    lost = kind.isin("zero_event_artifact", "null_or_empty", "dict_invalid_type")
    return kind, F.when(lost, "gate1_unrecoverable").otherwise(F.coalesce(F.try_element_at(old, name), name))


def admission(kind: Column, source: Column, tags: Column, remap: bool = True) -> Column:
    """Why a row is admitted or refused: the first rule that applies."""
    echo = F.coalesce(F.exists(tags, lambda t: F.lower(F.trim(t)).isin(*ECHOES)), F.lit(False))
    return (
        F.when(kind == "zero_event_artifact", "refuse_zero_event_artifact").when(kind.isin("null_or_empty", "dict_invalid_type"), "refuse_gate1_failed").when(source.isin(*BLOCKED), "refuse_blocked_source")
        .when(echo, "refuse_collective_echo").when(kind == "deprecated_vocab", "admit_deprecated_remapped" if remap else "refuse_no_rule_matched").when(kind == "dict_truncated", "admit_recovered_dict")
        .otherwise("admit_known_source")
    )


def importance(layer: Column, intensity: Column, uses: Column) -> Column:
    """The importance of a record after some uses, in closed form."""
    known = F.create_map(*(F.lit(x) for pair in IMPORTANCE.items() for x in pair))
    i = F.least(F.greatest(F.coalesce(intensity, F.lit(0.0)), F.lit(0.0)), F.lit(10.0)) / 10
    first = F.least(F.round(F.coalesce(F.try_element_at(known, layer), F.lit(0.5)) + INTENSITY_SHARE * i, 4), F.lit(1.0))
    return 1 - (1 - first) * F.pow(F.lit(1 - STEP), uses)


def plain(tag: str | None) -> str:
    """A tag without marks, format signs, case, look-alikes and separators."""
    drop = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Me", "Cf") and c not in IGNORABLE)
    return re.sub(r"[\s.−]", "", "".join(c for c in drop(drop(tag or "").casefold().translate(str.maketrans(LOOKALIKES))) if unicodedata.category(c) not in ("Pd", "Pc", "Zs", "Zl", "Zp")))


@F.pandas_udf(BooleanType())
def owner_only(tags: pd.Series) -> pd.Series:
    """Whether any tag holds, however it is written, a part that only the owner may see. Null: no."""
    stems, seen = [plain(s) for s in OWNER_ONLY], {}

    def hidden(tag):
        if tag not in seen:
            seen[tag] = any(s in plain(tag) for s in stems)
        return seen[tag]

    return tags.map(lambda ts: ts is not None and any(hidden(t) for t in ts))
