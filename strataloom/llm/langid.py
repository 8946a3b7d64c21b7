"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased. A word's score for a language is the sum of the weights of its
features: beginnings and endings of one to three letters, letter pairs and triples with the word's ends,
and the word itself (the learned lexicon). Features are hashed to a fixed table. Learned transitions
between the languages of neighbouring words join them to a chain; forward-backward gives each word's
probability of each language, so switches within a text are labelled where they happen. The text's
language is the one with the largest sum of probabilities, its score that sum's share.

Training uses a bounded sample of texts (`SAMPLE_ROWS`, by a hash of the id), each whole, cut into windows
of `WINDOW` words. A window carries its text's language; windows of different texts
are put together to sequences, so that transitions are learned from both staying and switching. The
conditional likelihood is maximised by AdaGrad in minibatches.

Defined results: a null or empty text, or one without a letter, is `und` with score 0; very long texts are
labelled whole; repeated rows get equal results; with no labelled rows every text is `und`; ties go to the
language first in order; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.labelled import fold, text_sample

SAMPLE_ROWS = 1_000
WINDOW = 48
TABLE_BITS = 17
EPOCHS = 4
BATCH = 128
RATE = 0.2
REMEMBERED = 300_000
#: Bytes of text labelled together.
STEP = 4 << 20
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (categories L*). The pattern also takes numbers that are no digits, such as ½ or Ⅷ; words
    with such signs are parted at them."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split(" ") if part]


def feature_ids(word: str) -> list[int]:
    """Hashed features of a word."""
    marked = f"<{word}>"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)] + [f"w{word}"]
    names += [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    mask = (1 << TABLE_BITS) - 1
    return [zlib.crc32(name.encode()) & mask for name in names]


class Chain:
    """Weights of a trained field: languages, feature table and transitions."""

    def __init__(self, languages: list[str], table: np.ndarray, start: np.ndarray, transition: np.ndarray):
        self.languages, self.table, self.start, self.transition = languages, table, start, transition


class WordScores(dict):
    """Row numbers of words in a table of exponentiated scores; words are scored when first met."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain
        self.scores = np.empty((1 << 12, len(chain.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        raw = self.chain.table[feature_ids(word)].sum(axis=0)
        self.scores[n] = np.exp(np.maximum(raw - raw.max(), -30))
        self[word] = n
        return n


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling length, and for each step the number of rows that still go on."""
    order = np.argsort(-lengths, kind="stable")
    going = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
    return order, going


def posteriors(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probabilities of the languages of each word; rows' words follow each other in `scores`. All rows
    take a step together."""
    first = np.cumsum(lengths) - lengths
    order, going = _order(lengths)
    begin = first[order]
    end = begin + lengths[order] - 1
    step = np.exp(transition).astype(np.float32)
    forward = np.empty_like(scores)
    state = None
    for t, n in enumerate(going.tolist()):
        at = begin[:n] + t
        state = scores[at] * (np.exp(start).astype(np.float32) if t == 0 else state[:n] @ step)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    state = None
    out = np.empty_like(scores)
    for t, n in enumerate(going.tolist()):
        at = end[:n] - t
        if t == 0:
            state = np.ones((n, scores.shape[1]), np.float32)
        else:
            state = (scores[at + 1] * state[:n]) @ step.T
            state /= state.sum(axis=1, keepdims=True)
        both = forward[at] * state
        out[at] = both / both.sum(axis=1, keepdims=True)
    return out


# ---------------------------------------------------------------- training


def _sample(documents: DataFrame, modulus: int, held_out: int, rows: int) -> list[tuple[str, list[str]]]:
    """(language, window of words) of a bounded sample of labelled texts."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(modulus) != held_out))
    chosen = text_sample(usable, rows, "lang")

    def run(batches):
        for batch in batches:
            langs, windows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for a in range(0, len(words), WINDOW):
                    langs.append(lang)
                    windows.append(words[a : a + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.list_(pa.string()))],
                                             ["lang", "words"])

    found = chosen.select("lang", "text").mapInArrow(run, "lang string, words array<string>").collect()
    return sorted((r.lang, list(r.words)) for r in found)


def train(windows: list[tuple[str, list[str]]]) -> Chain | None:
    """The field that windows of known language teach."""
    languages = sorted({lang for lang, words in windows if words})
    if not languages:
        return None
    k, label = len(languages), {lang: i for i, lang in enumerate(languages)}
    ids: dict[str, int] = {}
    feats: list[list[int]] = []
    texts = []
    for lang, words in windows:
        for w in words:
            if w not in ids:
                ids[w] = len(feats)
                feats.append(feature_ids(w))
        if words:
            texts.append((np.array([ids[w] for w in words]), label[lang]))
    size = np.array([len(f) for f in feats])
    flat, at = np.concatenate([np.array(f) for f in feats]), np.cumsum(size) - size
    table, start, transition = np.zeros((1 << TABLE_BITS, k)), np.zeros(k), np.eye(k)
    sums = [np.full_like(table, 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)]
    draw = np.random.default_rng(17)

    def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[words]
        owner = np.repeat(np.arange(len(words)), n)
        return flat[np.repeat(at[words] - np.cumsum(n) + n, n) + np.arange(len(owner))], owner

    for _ in range(EPOCHS):
        order = draw.permutation(len(texts))
        sequences, i = [], 0
        while i < len(order):  # one to three windows make a sequence
            n = int(draw.integers(1, 4))
            parts = [texts[j] for j in order[i : i + n]]
            sequences.append((np.concatenate([p for p, _ in parts]),
                              np.concatenate([np.full(len(p), y) for p, y in parts])))
            i += n
        for b in range(0, len(sequences), BATCH):
            batch = sequences[b : b + BATCH]
            words, truth = np.concatenate([w for w, _ in batch]), np.concatenate([y for _, y in batch])
            lengths = np.array([len(w) for w, _ in batch])
            kinds, where = np.unique(words, return_inverse=True)
            ids_, owner = features(kinds)
            raw = np.zeros((len(kinds), k))
            np.add.at(raw, owner, table[ids_])
            score = np.exp(np.maximum(raw - raw.max(axis=1, keepdims=True), -30)).astype(np.float32)[where]
            grad_e, grad_s, grad_t = _gradient(score, truth, lengths, start, transition)
            per_word = np.zeros((len(kinds), k))
            np.add.at(per_word, where, grad_e)
            grad = np.zeros_like(table)
            np.add.at(grad, ids_, per_word[owner])
            touched = np.unique(ids_)
            g = grad[touched] / len(batch) + 1e-5 * table[touched]
            sums[0][touched] += g * g
            table[touched] += -RATE * g / np.sqrt(sums[0][touched])
            for weights, total, g in ((start, sums[1], grad_s / len(batch)), (transition, sums[2], grad_t / len(batch))):
                total += g * g
                weights -= RATE * g / np.sqrt(total)
    return Chain(languages, table.astype(np.float32), start, transition)


def _gradient(score, truth, lengths, start, transition):
    """Expected minus observed counts: by word, of first labels, of label pairs."""
    n, k = score.shape
    marginal = posteriors(score, lengths, start, transition).astype(np.float64)
    grad_e = marginal.copy()
    grad_e[np.arange(n), truth] -= 1
    first = np.cumsum(lengths) - lengths
    grad_s = grad_e[first].sum(axis=0)
    inner = np.ones(n, bool)
    inner[first] = False
    here = np.flatnonzero(inner)
    # Pair probabilities: forward(a) * step(a, b) * score(b) * backward(b), from the marginals themselves.
    step = np.exp(transition)
    forward = _forward(score, lengths, start, step)
    predicted = forward[here - 1] @ step
    ratio = marginal[here] / np.maximum(predicted, 1e-30)
    pairs = (forward[here - 1].T @ ratio) * step
    observed = np.zeros((k, k))
    np.add.at(observed, (truth[here - 1], truth[here]), 1)
    return grad_e, grad_s, pairs - observed


def _forward(score, lengths, start, step):
    first = np.cumsum(lengths) - lengths
    order, going = _order(lengths)
    begin, out, state = first[order], np.empty(score.shape), None
    for t, n in enumerate(going.tolist()):
        at = begin[:n] + t
        state = score[at] * (np.exp(start) if t == 0 else state[:n] @ step)
        state /= state.sum(axis=1, keepdims=True)
        out[at] = state
    return out


def fitted(documents: DataFrame, modulus: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Chain | None:
    return train(_sample(documents, modulus, held_out, rows))


# ---------------------------------------------------------------- labelling


class Labeller:
    """Labels texts in one worker; scores of words are remembered."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, WordScores(chain)

    def words(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of texts that have any, and the texts' lengths."""
        if len(self.known) > REMEMBERED:
            self.known = WordScores(self.chain)
        rows = np.fromiter((self.known[w] for words in texts for w in words), np.int64)
        lengths = np.array([len(words) for words in texts], np.int64)
        if not len(rows):
            return np.zeros((0, len(self.chain.languages)), np.float32), lengths
        return posteriors(self.known.scores[rows], lengths, self.chain.start, self.chain.transition), lengths

    def languages(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores, a = [UNDETERMINED] * len(texts), [0.0] * len(texts), 0
        while a < len(texts):
            b, held, split = a, 0, []
            while b < len(texts) and (b == a or held < STEP):
                split.append(words_of(texts[b]))
                held += len(texts[b] or "")
                b += 1
            filled = [i for i, words in enumerate(split) if words]
            if filled:
                found, lengths = self.words([split[i] for i in filled])
                mass = np.add.reduceat(found.astype(np.float64), np.cumsum(lengths) - lengths, axis=0)
                best = mass.argmax(axis=1)
                for i, row, top in zip(filled, mass, best.tolist()):
                    names[a + i], scores[a + i] = self.chain.languages[top], float(min(1.0, row[top] / row.sum()))
            a = b
        return names, scores


def identified(documents: DataFrame, chain: Chain | None, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score for every row."""
    kept = documents.select(*[F.col(c).alias(c) for c in keep], F.col("text").alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = labeller.languages(texts) if labeller else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "__lang", "__score"])

    return kept.mapInArrow(run, f"{types}, `__lang` string, `__score` double")


def word_languages(documents: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and `spans`: runs of words of one language (language, first word, words, mean probability)."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found, _ = labeller.words([words_of(text)]) if words_of(text) else (np.zeros((0, 1)), None)
                best = found.argmax(axis=1) if len(found) else np.zeros(0, np.int64)
                cuts = np.flatnonzero(np.diff(best)) + 1
                edges = [0, *cuts.tolist(), len(best)] if len(best) else [0]
                out.append([{"lang": shared.value.languages[best[a]], "first": a, "words": b - a,
                             "p": float(found[a:b].max(axis=1).mean())} for a, b in zip(edges, edges[1:])])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, spans array<struct<lang:string,first:long,words:long,p:double>>")


def op8_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    documents = read_table(spark, sf_dir, "documents")
    out = identified(documents, fitted(documents), ["doc_id"])
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"),
                      F.col("__score").alias("score"))
