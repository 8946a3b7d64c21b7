"""Toxicity: a learned lexicon, matched through Levenshtein automata, scored in context windows.

Lexicon. From a bounded sample of labelled rows (`SAMPLE_ROWS`): words, and beginnings of words of 4 to 7
letters, that occur in toxic documents and hardly in others, each with its log-odds. A beginning stands
for all words that share it (inflected or compounded terms); it gives way to a single word that accounts
for it.

Matching. The lexicon is a trie. The Levenshtein automaton of an entry allows no edit up to 4 letters, one
from 5 and two from 9. All automata are intersected with the trie at once: a state is a set of (trie node,
edits made, edits allowed), transitions are computed when first met and kept, and a word is dropped at the
first letter that leaves no state. An entry whose misspellings turn up in clean documents of the sample
(over `MAX_MISTAKEN` of its own toxic ones) allows no edit.

Context. A hit's weight is halved for each edit. Words within `WINDOW` places of it tell quotation from
abuse: the hit lies between quotation marks, a quoting word is near (one that in the sample stands near hits
of clean texts rather than toxic ones: reporting, citing), an abusing word is near (the other way round:
address), other hits are near. The sums of weights by context, their density and the number of hits feed
a logistic regression fitted on the sample.

Defined results: a null or empty text, or one without words, has no hit and gets the score of that; very
long texts are scanned whole; repeated rows get equal scores; with no labelled rows the lexicon is empty
and all scores are one half; an empty table gives no row; other columns are ignored by `scored` and kept
by `without_toxic`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Hidden, dropped, stored
from strataloom.llm.labelled import fold, labelled_sample, logistic, probability

SAMPLE_ROWS = 12_000
MIN_TOXIC = 4
MIN_NEAR = 6
MAX_CLEAN_SHARE = 0.04
MAX_ENTRIES = 2_000
MAX_MISTAKEN = 0.02
WINDOW = 5
#: Words whose weights a worker remembers.
REMEMBERED = 100_000
THRESHOLD = 0.3
_STEMS = range(4, 8)
_TOKEN = re.compile(r"\w+|[\"“”«»„]")
_QUOTES = frozenset("\"“”«»„")

#: Log-odds from which a word near hits tells quotation from abuse.
TELLING = 1.5


def allowed_edits(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


class LexiconAutomaton:
    """The intersection of the entries' Levenshtein automata with the trie of the entries.

    `entries` maps a term to its weight; a term that ends in `*` matches any continuation. Terms in
    `exact` allow no edit."""

    def __init__(self, entries: dict[str, float], exact: frozenset[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.budget: list[int] = [0]  # the most edits that an entry below a node allows
        self.ends: dict[int, list[tuple[str, float, int]]] = {}
        for term, weight in sorted(entries.items()):
            stem, node, path = term.rstrip("*"), 0, [0]
            edits = 0 if term in exact else allowed_edits(len(stem))
            for letter in stem:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.budget.append(0)
                node = self.next[node][letter]
                path.append(node)
            for at in path:
                self.budget[at] = max(self.budget[at], edits)
            self.ends.setdefault(node, []).append((term, weight, edits))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[tuple, tuple]] = []
        self.start = self._state(frozenset(self._closure({(0, 0)})))

    def _closure(self, pairs: set) -> set:
        """Entries' letters that the word leaves out: one edit each."""
        todo, seen = list(pairs), set(pairs)
        while todo:
            node, edits = todo.pop()
            for child in self.next[node].values():
                if edits < self.budget[child] and (child, edits + 1) not in seen:
                    seen.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return seen

    def _state(self, pairs: frozenset) -> int:
        known = self.states.get(pairs)
        if known is None:
            known = self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            word = stem = _NO_MATCH
            for node, edits in pairs:
                for term, weight, most in self.ends.get(node, ()):
                    if edits <= most:
                        found = (weight * 0.5**edits, term, edits)
                        word = max(word, found)
                        if term.endswith("*") and not edits:
                            stem = max(stem, found)
            self.accepts.append((word, stem))
        return known

    def _move(self, state: int, letter: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            child = self.next[node].get(letter)
            if child is not None and edits <= self.budget[child]:
                out.add((child, edits))
            if edits < self.budget[node]:
                out.add((node, edits + 1))  # a letter too many
            for other, child in self.next[node].items():
                if other != letter and edits < self.budget[child]:
                    out.add((child, edits + 1))  # another letter
        to = self._state(frozenset(self._closure(out))) if out else -1
        self.moves[state][letter] = to
        return to

    def find(self, word: str) -> tuple[float, str, int]:
        """(weight, entry, edits) of the best entry that the word matches; weight 0 if none does. Stems
        match without edits when the word goes on, with edits only as whole words."""
        state, best = self.start, _NO_MATCH
        for letter in word:
            to = self.moves[state].get(letter)
            if to is None:
                to = self._move(state, letter)
            if to < 0:
                return best
            state = to
            best = max(best, self.accepts[state][1])
        return max(best, self.accepts[state][0])

    def match(self, word: str) -> float:
        return self.find(word)[0]


_NO_MATCH = (0.0, "", 0)

FEATURES = 8


Context = tuple[frozenset[str], frozenset[str]]


def found_hits(text: str, automaton: LexiconAutomaton, known: dict[str, float]) -> tuple[list[str], list[tuple[int, float]]]:
    """Tokens, and (place, weight) of the hits. `known` remembers the weights of words."""
    tokens = _TOKEN.findall(text.lower())
    hits = []
    for i, token in enumerate(tokens):
        weight = known.get(token)
        if weight is None:
            if len(known) > REMEMBERED:
                known.clear()
            weight = known[token] = automaton.match(token)
        if weight:
            hits.append((i, weight))
    return tokens, hits


def features(text: str, automaton: LexiconAutomaton, known: dict[str, float], context: Context) -> np.ndarray:
    """Sums of hit weights by context (quoting words, abusing words)."""
    quoting, abusing = context
    tokens, hits = found_hits(text, automaton, known)
    out = np.zeros(FEATURES)
    if not hits:
        return out
    marks = [i for i, t in enumerate(tokens) if t in _QUOTES]
    places = [i for i, _ in hits]
    plain = quoted = reported = addressed = crowded = 0.0
    for k, (i, weight) in enumerate(hits):
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        opened = int(np.searchsorted(marks, i)) % 2 == 1 and int(np.searchsorted(marks, i)) < len(marks)
        said = any(t in quoting for t in near)
        if opened:
            quoted += weight
        elif said:
            reported += weight
        else:
            plain += weight
        if any(t in abusing for t in near):
            addressed += weight
        if k and i - places[k - 1] <= WINDOW:
            crowded += weight
    best = max(w for _, w in hits)
    out[:] = [np.log1p(plain), np.log1p(quoted), np.log1p(reported), np.log1p(addressed), np.log1p(crowded),
              np.log1p(len(hits)), best, np.log1p(100.0 * (plain + reported) / max(1, len(tokens)))]
    return out


def _terms(text: str) -> set[str]:
    words = {t for t in _TOKEN.findall(text.lower()) if len(t) > 2}
    return words | {w[:n] + "*" for w in words for n in _STEMS if len(w) > n}


def _counted(sample: DataFrame, toxic: int, only: frozenset[str] | None) -> DataFrame:
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if y == toxic:
                    found = _terms(text or "")
                    counts.update(found if only is None else found & only)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return sample.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Entries with their log-odds, and those of them whose misspellings occur in clean text by chance."""
    sizes = dict(sample.groupBy("y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    often = {r.term: r.n for r in _counted(sample, 1, None).where(F.col("n") >= MIN_TOXIC).collect()}
    shared = {r.term: r.n for r in _counted(sample, 0, frozenset(often)).collect()} if often else {}

    def odds(term: str) -> float:
        return float(np.log((often[term] + 0.5) / (toxic + 1)) - np.log((shared.get(term, 0) + 0.5) / (clean + 1)))

    telling = {t for t in often if shared.get(t, 0) <= MAX_CLEAN_SHARE * often[t] and odds(t) > 2}
    words = {t for t in telling if not t.endswith("*")}
    chosen: dict[str, float] = {}
    for term in sorted(telling, key=lambda t: (len(t), t)):
        if term.endswith("*"):
            stem = term[:-1]
            alone = max((often[w] for w in words if w.startswith(stem)), default=0)
            if alone < 0.7 * often[term] and not any(stem.startswith(c[:-1]) for c in chosen if c.endswith("*")):
                chosen[term] = odds(term)
    for word in sorted(words):
        if not any(word.startswith(c[:-1]) for c in chosen if c.endswith("*")):
            chosen[word] = odds(word)
    best = dict(sorted(chosen.items(), key=lambda e: (-e[1] * np.log1p(often[e[0]]), e[0]))[:MAX_ENTRIES])
    mistaken = _mistaken(sample, best)
    return best, frozenset(t for t in best if mistaken.get(t, 0) > MAX_MISTAKEN * often[t])


def _mistaken(sample: DataFrame, entries: dict[str, float]) -> dict[str, int]:
    """For each entry, the clean documents in which a word is taken for a misspelling of it."""

    def run(batches):
        automaton = LexiconAutomaton(entries)
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if y == 0:
                    found = (automaton.find(t) for t in set(_TOKEN.findall((text or "").lower())))
                    counts.update({term for weight, term, edits in found if weight and edits})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return dict(sample.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect())


def learn_context(sample: DataFrame, entries: dict[str, float], exact: frozenset[str]) -> Context:
    """Quoting and abusing words: those near hits in many texts of one label, and hardly of the other."""

    def run(batches):
        automaton, known = LexiconAutomaton(entries, exact), {}
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, hits = found_hits(text or "", automaton, known)
                near = {t for i, _ in hits for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1] if t not in _QUOTES and not known.get(t)}
                counts.update((t, y) for t in near)
                counts[("", y)] += bool(hits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int64()),
                 pa.array(list(counts.values()), pa.int64())], ["term", "y", "n"])

    found = sample.mapInArrow(run, "term string, y long, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic")).where(
        (F.greatest("clean", "toxic") >= MIN_NEAR) | (F.col("term") == "")).collect()
    clean, toxic = next(((r.clean, r.toxic) for r in found if not r.term), (0, 0))
    odds = {r.term: float(np.log((r.toxic + 0.5) / (toxic + 1)) - np.log((r.clean + 0.5) / (clean + 1))) for r in found if r.term}
    return frozenset(t for t, o in odds.items() if o < -TELLING), frozenset(t for t, o in odds.items() if o > TELLING)


def fitted(documents: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> tuple:
    """(entries, those that allow no edit, context words, model) learned outside the held-out fold."""
    sample = stored(labelled_sample(documents, labels, "toxic", modulus, held_out, rows), "toxic-sample")
    entries, exact = learn_lexicon(sample)
    context = learn_context(sample, entries, exact)
    rows_ = _features(sample, "text", ["y"], entries, exact, context).collect()
    x = np.array([r.f for r in rows_]).reshape(-1, FEATURES)
    y = np.array([r.y for r in rows_], float)
    dropped(sample)
    return entries, exact, context, logistic(x, y)


def _features(df: DataFrame, text: str, keep: list[str], entries: dict, exact: frozenset, context: Context) -> DataFrame:
    kept = df.select(*keep, F.col(text).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        automaton, known = LexiconAutomaton(entries, exact), {}
        for batch in batches:
            found = [features(t or "", automaton, known, context) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(found, pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "f"])

    return kept.mapInArrow(run, f"{types}, f array<double>")


def scored(documents: DataFrame, model: tuple, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `__score` (0 to 1) for every row."""
    entries, exact, context, fit = model
    # The text goes to the workers once, whether or not it is kept.
    kept = documents.select(*keep, *([] if text in keep else [text]))
    at = kept.columns.index(text)
    out = [f for f in kept.schema.fields if f.name in keep]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)

    def run(batches):
        automaton, known = LexiconAutomaton(entries, exact), {}
        for batch in batches:
            x = np.array([features(t.as_py() or "", automaton, known, context) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(out))], pa.array(probability(x, fit))], [*[f.name for f in out], "__score"])

    return kept.mapInArrow(run, f"{types}, `__score` double")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored under `threshold`, with all their columns."""
    model, hidden = fitted(documents, labels), Hidden(documents)
    return hidden.restored(scored(hidden.frame, model, hidden.columns, hidden["text"]).where(F.col("__score") < threshold))


def op1_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    documents = read_table(spark, sf_dir, "documents")
    model = fitted(documents, read_table(spark, sf_dir, "labels"))
    out = scored(documents, model, ["doc_id"])
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
