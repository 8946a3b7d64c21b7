"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled side is web text whose labels are not
looked at. A scorer g minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss l: the part in the maximum estimates the risk on negatives from unlabelled text,
and is kept from going below zero, where it would only fit noise. The class prior is estimated from
positives and unlabelled texts alone (`class_prior`): a scorer fitted on half of both is cut where, on the
other half, the share of unlabelled texts above the cut is least in proportion to that of positives, plus a
margin for the size of the sample. That ratio bounds the prior from above, and is it where only positives score so high.

g is additive: each of the text's measures (character classes, word lengths, repetition of words, word
pairs and lines) is cut at its quantiles, and each interval has a weight; neighbouring weights are shrunk
towards each other. Both samples are bounded (`SAMPLE_ROWS` each) and chosen by a hash of the id.

Defined results: null and empty texts have measures of zero and are scored like any; very long texts are
measured whole; repeated rows get equal scores; without positives every score is one half; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import steps, text_bytes
from strataloom.llm.labelled import fold, labelled_sample, text_sample
from strataloom.llm.words import LOWER, UNBLANK, word_bounds, word_hashes, window_hashes

SAMPLE_ROWS = 12_000
BINS = 24
ROUNDS = 1500
PRIOR_ROUNDS = 300
RATE = 0.05
SMOOTH = 1e-4
THRESHOLD = 0.5

_KINDS = np.zeros(256, np.int64)  # 0 other signs, 1 small letters, 2 capitals, 3 digits, 4 blanks, 5 sentence marks
_KINDS[97:123] = 1
_KINDS[128:] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[32, 9, 11, 12, 13, 10]] = 4
_KINDS[[ord(c) for c in ".,;:'\"-()"]] = 5
_N_KINDS = 6

MEASURES = ("other", "small", "capital", "digit", "blank", "mark", "words", "word_bytes", "long_words", "distinct_words",
            "distinct_pairs", "distinct_triples", "same_as_last", "commonest", "distinct_lines", "lines", "tail_signs",
            "bytes")


def _distinct_share(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the share of distinct values, and the share of its commonest value."""
    total = np.bincount(row, minlength=rows)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(r[fresh], minlength=rows)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, r[fresh], runs)
    some = np.maximum(total, 1)
    return np.where(total, distinct / some, 1.0), most / some


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, measures) of the texts of a step."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    row_of_byte = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row_of_byte * _N_KINDS + _KINDS[data], minlength=rows * _N_KINDS).reshape(rows, _N_KINDS)
    low = LOWER[data]
    starts, ends, before = word_bounds(low, offsets, UNBLANK)
    words = np.diff(before)
    row = np.repeat(np.arange(rows), words)
    length = ends - starts
    hashes = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    some = np.maximum(words, 1)
    distinct, most = _distinct_share(hashes, row, rows)
    grams = []
    for n in (2, 3):
        h = window_hashes(hashes, n)
        inside = row[: len(h)] == row[n - 1 : n - 1 + len(h)]
        grams.append(_distinct_share(h[inside], row[: len(h)][inside], rows)[0])
    same = np.zeros(rows)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        same = np.bincount(row[1:][again], minlength=rows) / some
    line_member = np.ones(256, bool)
    line_member[10] = False
    line_starts, line_ends, line_before = word_bounds(low, offsets, line_member)
    lines = np.diff(line_before)
    line_row = np.repeat(np.arange(rows), lines)
    line_hash = word_hashes(low, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    distinct_lines, _ = _distinct_share(line_hash, line_row, rows)
    tail = _KINDS[data[ends - 1]] == 0 if len(ends) else np.zeros(0, bool)
    share = kinds / np.maximum(size, 1)[:, None]
    return np.column_stack([
        share, np.log1p(words), np.bincount(row, length, minlength=rows) / some,
        np.bincount(row, length > 14, minlength=rows) / some, distinct, grams[0], grams[1], same, most, distinct_lines,
        np.log1p(lines), np.bincount(row, tail, minlength=rows) / some, np.log1p(size)])


def all_measures(column) -> np.ndarray:
    data, offsets = text_bytes(column)
    out = [np.zeros((0, len(MEASURES)))]
    for a, b in steps(offsets):
        out.append(measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return np.concatenate(out)


# ---------------------------------------------------------------- non-negative risk


def _onehot(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Interval of each measure as a column index of the weight vector."""
    at, out = 0, np.empty(x.shape, np.int64)
    for j, e in enumerate(edges):
        out[:, j] = at + np.searchsorted(e, x[:, j], side="right")
        at += len(e) + 1
    return out


def _score(places: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return weights[places].sum(axis=1) + bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk at the weights `w` (intercept last) of interval places p and u; the direction of
    its descent; and whether the part on negatives fell below zero. There the direction is that of raising
    it again, which keeps the fit from staying in noise."""
    gp, gu = _score(p, w[:-1], w[-1]), _score(u, w[:-1], w[-1])
    sp, su = _sigmoid(gp), _sigmoid(gu)

    def slope(places: np.ndarray, factor: np.ndarray) -> np.ndarray:
        g = np.bincount(places.ravel(), np.repeat(factor, places.shape[1]), minlength=len(w) - 1)
        return np.append(g, factor.sum())

    # The logistic loss of calling a row negative is log(1 + e^g), with slope sigmoid(g).
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    on_p, on_n = slope(p, prior * (sp - 1) / len(p)), slope(u, su / len(u)) - slope(p, prior * sp / len(p))
    clipped = negative < 0
    return float(positive + max(0.0, negative)), -on_n if clipped else on_p + on_n, bool(clipped)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Interval edges, their weights and the intercept that minimise the non-negative risk (Adam)."""
    start, kinds = float(np.log(prior / (1 - prior))), positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return [np.zeros(0)] * kinds, np.zeros(kinds), start
    both = np.concatenate([positive, unlabelled])
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(both[:, j], np.concatenate([[0.005, 0.02], grid, [0.98, 0.995]])))
             for j in range(kinds)]
    p, u = _onehot(positive, edges), _onehot(unlabelled, edges)
    size = sum(len(e) + 1 for e in edges)
    breaks = np.cumsum([len(e) + 1 for e in edges])[:-1]
    w = np.zeros(size + 1)
    w[-1] = start
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        grad = risk(w, p, u, prior)[1]
        bumps = np.diff(w[:-1])
        bumps[breaks - 1] = 0
        grad[:-2] -= SMOOTH * bumps
        grad[1:-1] += SMOOTH * bumps
        grad[:-1] += SMOOTH * 0.1 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return edges, w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, within 0.05 and 0.95; one half without rows."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    halves = [x[np.lexsort(x.T)] for x in (positive, unlabelled)]  # by value: the split depends on no order of rows
    edges, weights, bias = fit_nnpu(halves[0][::2], halves[1][::2], 0.5, PRIOR_ROUNDS)
    p, u = (np.sort(_score(_onehot(x[1::2], edges), weights, bias)) for x in halves)
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    margin = sum(np.sqrt(np.log(4 / chance) / (2 * len(x))) for x in (p, u))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def fitted(documents: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> tuple:
    """Model learned outside the held-out fold, from trusted positives and unlabelled texts."""
    trusted = labelled_sample(documents, labels.where("quality = 1"), "quality", modulus, held_out, rows).select("text")
    web = text_sample(documents.where(fold(modulus) != held_out), rows)
    positive, unlabelled = (np.array([r.f for r in _measured(s).collect()]).reshape(-1, len(MEASURES))
                            for s in (trusted, web))
    return fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))


def _measured(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = all_measures(batch.column(0))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], ["f"])

    return df.select("text").mapInArrow(run, "f array<double>")


def scored(documents: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """The columns `keep` and `__score` (0 to 1) for every row."""
    edges, weights, bias = model
    kept = documents.select(*[F.col(c).alias(c) for c in keep], F.col("text").alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            g = _score(_onehot(all_measures(batch.column(batch.num_columns - 1)), edges), weights, bias)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)],
                 pa.array(1 / (1 + np.exp(-np.clip(g, -30, 30))))], [*batch.schema.names[:-1], "__score"])

    return kept.mapInArrow(run, f"{types}, `__score` double")


def op2_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    documents = read_table(spark, sf_dir, "documents")
    out = scored(documents, fitted(documents, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
