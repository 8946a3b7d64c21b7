"""Text functions: normal forms, tokens, hashes and edit distance, as column expressions where Spark has
them and as plain functions for the driver."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.porter2 import stem

#: Unicode white space, for regular expressions of Java and Python alike.
WS = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_WS = re.compile(f"{WS}+")
#: Any other character.
INK = f"[^{WS[1:]}"

#: What parts words, and the places inside camelCase ones.
_APART = "[^\\p{IsAlphabetic}\\p{N}]+"
_INSIDE = ("(?<=[\\p{IsLowercase}\\p{N}])(?=\\p{IsUppercase})"
           "|(?<=\\p{IsUppercase})(?=\\p{IsUppercase}\\p{IsLowercase})")


def collapse(c: Column) -> Column:
    """Trimmed, with runs of white space as one blank; case kept."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalized(c: Column) -> Column:
    return F.lower(collapse(c))


def normalize(s: str) -> str:
    return _WS.sub(" ", s).strip(" ").lower()


def normalize_content(s: str) -> str:
    return _WS.sub(" ", s).strip(" ")


def edge_type(c: Column) -> Column:
    """Lower case; runs of white space, hyphens and underscores are one underscore; none at the ends."""
    joined = F.regexp_replace(F.lower(c), f"(?:{WS}|[_-])+", "_")
    return F.regexp_replace(joined, "^_|_$", "")


def normalize_edge_type(s: str) -> str:
    from strataloom.model import Rejected

    out = re.sub(f"(?:{WS}|[_-])+", "_", s.lower()).strip("_")
    if not out:
        raise Rejected("an edge type must not be empty")
    return out


def content_hash(s: str) -> str:
    """FNV-1a, 64 bits, of the normalised content."""
    h = 0xCBF29CE484222325
    for b in normalize_content(s).encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@F.pandas_udf(T.StringType())
def content_hashes(contents: pd.Series) -> pd.Series:
    return contents.map(content_hash, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(words):
        out = []
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = stem(w)
            out.append(s)
        return out

    return tokens.map(one, na_action="ignore")


def analyzed(c: Column, stemming: bool = True) -> Column:
    """Tokens of a text, repeats included: words cut at what is not a letter or digit and inside camelCase,
    lower-cased, stemmed."""
    words = F.filter(F.split(c, _APART), lambda w: w != "")
    # Only a word with a capital behind its first letter can be cut; the rest skip the slower pattern.
    parts = F.flatten(F.transform(words, lambda w: F.when(
        F.substring(w, 2, 1 << 30) != F.lower(F.substring(w, 2, 1 << 30)), F.split(w, _INSIDE)).otherwise(F.array(w))))
    lowered = F.transform(parts, F.lower)
    return _stemmed(lowered) if stemming else lowered


def analyze(s: str, stemming: bool = True) -> list[str]:
    """The same on the driver."""
    out = []
    for word in re.findall(r"[^\W_]+", s):
        begin = 0
        for i in range(1, len(word)):
            last, here = word[i - 1], word[i]
            after_small = here.isupper() and (last.islower() or last.isnumeric())
            before_small = last.isupper() and here.isupper() and i + 1 < len(word) and word[i + 1].islower()
            if after_small or before_small:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:])
    return [stem(w.lower()) if stemming else w.lower() for w in out]


def token_set(c: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), f"{WS}+"), lambda w: w != ""))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other holds; 1 for two empty ones, null for one."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.nullif(smaller, F.lit(0)))


def recorder_tokens(c: Column) -> Column:
    """Distinct runs of at least three of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), 1))


def is_used(memory: Column, text: Column) -> Column:
    """Whether at least half of a memory's tokens occur in a text; none make it false."""
    tokens = recorder_tokens(memory)
    return F.coalesce(F.size(F.array_intersect(tokens, recorder_tokens(text))) / F.nullif(F.size(tokens), F.lit(0)) >= 0.5,
                      F.lit(False))


def bounded_levenshtein(a: str, b: str, most: int) -> int | None:
    """Edit distance of characters, or None above `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


# ---------------------------------------------------------------- contradiction

# Words that negate what follows, words that negate what precedes, words without content.
FORWARD_CUES = frozenset("not never no longer instead without rather over versus vs replaced replaces removed remove".split())
BACKWARD_CUES = frozenset("dropped drops removed remove gone deprecated retired stopped killed disabled discontinued "
                          "replaced replaces".split())
EMPTY_WORDS = frozenset("a an the of to in on for its it is are as by with and or now only both this that using use uses "
                        "chose runs run was were be been their them people up".split())
FORWARD_REACH = 4


def claims(s: str) -> tuple[set[str], set[str]]:
    """(asserted, negated) content words: cues negate up to four words after them, or the content word
    before them; a plain plural counts as its singular."""
    words = [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]
    cues = FORWARD_CUES | BACKWARD_CUES
    kept = [None if w in EMPTY_WORDS or w in cues else (w[:-1] if len(w) > 3 and w[-1] == "s" else w) for w in words]
    negated: set[str] = set()
    for i, w in enumerate(words):
        if w in FORWARD_CUES:
            negated.update(k for k in kept[i + 1 : i + 1 + FORWARD_REACH] if k)
        if w in BACKWARD_CUES:
            negated.update([k for k in kept[:i] if k][-1:])
    return {k for k in kept if k} - negated, negated


def relation(a: str, b: str) -> str:
    """'supersession' if one text asserts what the other negates, else 'duplicate'."""
    (asserted_a, negated_a), (asserted_b, negated_b) = claims(a), claims(b)
    return "supersession" if negated_a & asserted_b or negated_b & asserted_a else "duplicate"


@F.pandas_udf(T.StringType())
def relations(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([relation(x or "", y or "") for x, y in zip(a, b)])


def band(score: Column) -> Column:
    return F.when(score >= 0.80, "likely").otherwise("possible")
