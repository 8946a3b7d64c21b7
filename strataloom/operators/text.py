"""Full-text search: per-scope BM25 with weighted expansions, typo recovery and recency.

All statistics are per scope, so a scope's ranking never depends on text it does not hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import scoring
from strataloom.functions import text as X
from strataloom.model import IndexSpec, Rejected, ScopeSet, SearchOptions, created_ms

K1, B = 1.2, 0.75
DISCOUNT = 0.6
MAX_FUZZY = 4
MIN_PREFIX = 3


@dataclass(frozen=True)
class TextIndex:
    """postings (scope, term, id, tf), docs (scope, id, len), stats (scope, n_docs, total_len)."""

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame


def doc_text(nodes: DataFrame, spec: IndexSpec) -> DataFrame:
    """Nodes with `body`: their declared text properties joined by blanks; null where there are none."""
    body = None
    for label in dict.fromkeys(label for label, _ in spec.text):
        parts = [F.when(F.col("props")[p]["t"] == "s", F.col("props")[p]["s"]) for lab, p in spec.text if lab == label]
        some = F.coalesce(*parts).isNotNull()
        one = F.when((F.col("label") == label) & some, F.concat_ws(" ", *parts))
        body = one if body is None else F.coalesce(body, one)
    return nodes.withColumn("body", body if body is not None else F.lit(None).cast("string"))


def term_freqs(bodies: DataFrame, stemming: bool = True) -> DataFrame:
    """(scope, id, term, tf) of rows (scope, id, body)."""
    tokens = bodies.select("scope", "id", F.explode(X.analyzed(F.col("body"), stemming)).alias("term"))
    return tokens.groupBy("scope", "id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def build(bodies: DataFrame, stemming: bool = True) -> TextIndex:
    """Index of rows (scope, id, body), one row per id; a text without a token is no document. Lengths come
    straight from the texts: only the postings shuffle."""
    docs = bodies.select("scope", "id", F.size(X.analyzed(F.col("body"), stemming)).cast("long").alias("len")).where("len > 0")
    return TextIndex(term_freqs(bodies, stemming), docs, corpus_stats(docs))


def save(index: TextIndex, path: str) -> TextIndex:
    """Write an index and read it back. Postings are laid out by term, so that a request's few terms are
    found by the statistics and Bloom filters of the files, and no text is analysed again."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "scope", "id").write.option(
        "parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    index.docs.repartition("scope", "id").write.parquet(f"{path}/docs")
    load(index.docs.sparkSession, path, False).docs.transform(corpus_stats).coalesce(1).write.parquet(f"{path}/stats")
    return load(index.docs.sparkSession, path)


def load(spark, path: str, with_stats: bool = True) -> TextIndex:
    docs = spark.read.parquet(f"{path}/docs")
    stats = spark.read.parquet(f"{path}/stats") if with_stats else corpus_stats(docs)
    return TextIndex(spark.read.parquet(f"{path}/postings"), docs, stats)


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").cast("long").alias("total_len"))


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(postings: DataFrame, scope: str) -> DataFrame:
    return postings.where(F.col("scope") == scope).select("term").distinct().orderBy("term")


def bm25(tf: Column, length: Column, df: Column, n_docs: Column, total_len: Column) -> Column:
    idf = F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (total_len / n_docs)))


def score(index: TextIndex, weighted: DataFrame) -> DataFrame:
    """(id, score) for weighted terms (scope, term, weight). The terms of a request are few, so only
    their postings are read, and df is counted on them."""
    hits = index.postings.join(F.broadcast(weighted), ["scope", "term"])
    df = hits.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), ["scope", "term"]).join(index.docs, ["scope", "id"]).join(F.broadcast(index.stats), "scope")
    return rows.groupBy("id").agg(F.sum(F.col("weight") * bm25(
        F.col("tf"), F.col("len"), F.col("df"), F.col("n_docs"), F.col("total_len"))).alias("score"))


def fuzzy_expansions(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(scope, q, term, rank): for each query term the nearest MAX_FUZZY terms of the scope's vocabulary
    `terms` (scope, term): one a beginning of the other (from three letters on, rank 1), or few edits apart
    (rank is their number)."""
    q, t = F.col("q"), F.col("term")
    shorter = F.least(F.char_length(q), F.char_length(t))
    prefix = (shorter >= MIN_PREFIX) & (F.startswith(q, t) | F.startswith(t, q))
    most = F.when(F.char_length(q) < 3, 0).when(F.char_length(q) < 6, 1).otherwise(2)
    edits = F.expr("levenshtein(q, term)")
    near = (F.abs(F.char_length(q) - F.char_length(t)) <= most) & (edits <= most)
    found = terms.join(F.broadcast(queries), (q != t) & (prefix | near)).withColumn(
        "rank", F.when(prefix, F.lit(1)).otherwise(edits))
    w = Window.partitionBy("scope", "q").orderBy("rank", "term")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_FUZZY).select("scope", "q", "term", "rank")


def fuzzy(vocab: list[str], q: str) -> list[str]:
    """The same for one term on the driver."""
    most = 0 if len(q) < 3 else 1 if len(q) < 6 else 2
    ranked = []
    for t in vocab:
        if t == q:
            continue
        if min(len(q), len(t)) >= MIN_PREFIX and (q.startswith(t) or t.startswith(q)):
            ranked.append((1, t))
        else:
            d = X.bounded_levenshtein(q, t, most)
            if d is not None:
                ranked.append((d, t))
    return [t for _, t in sorted(ranked)[:MAX_FUZZY]]


def weighted_terms(index: TextIndex, scopes: list[str], terms: list[str], expansions: list[tuple[str, list[str]]],
                   fuzzy_on: bool, stemming: bool) -> list[tuple[str, str, float]]:
    """(scope, term, weight): exact terms count whole; expansions of a term, and for terms the scope does
    not hold its nearest terms, are discounted. A term counts once in a scope, with its best weight."""
    exact = sorted(set(terms))
    out: dict[tuple[str, str], float] = {}
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame([(t,) for t in exact], "term string")
    held = {(r.scope, r.term) for r in index.postings.where(F.col("scope").isin(scopes)).join(
        F.broadcast(wanted), "term").select("scope", "term").distinct().collect()}
    for scope in scopes:
        for t in exact:
            if (scope, t) in held:
                out[scope, t] = 1.0
    for scope in scopes:
        for t in exact:
            for word, more in expansions:
                if (X.analyze(word, stemming) or [None])[0] == t:
                    for e in more:
                        for token in X.analyze(e, stemming):
                            out.setdefault((scope, token), DISCOUNT)
    missed = [(s, t) for s in scopes for t in exact if (s, t) not in held]
    if fuzzy_on and missed:
        queries = spark.createDataFrame(missed, "s string, q string")
        terms_ = index.postings.select("scope", "term").distinct()
        near = fuzzy_expansions(terms_.join(F.broadcast(queries.select(F.col("s").alias("scope")).distinct()), "scope", "left_semi"),
                                queries.select("q").distinct())
        misses = set(missed)
        for r in near.orderBy("scope", "q", "rank", "term").collect():
            if (r.scope, r.q) in misses:
                out.setdefault((r.scope, r.term), DISCOUNT)
    return [(s, t, w) for (s, t), w in sorted(out.items())]


def search(nodes: DataFrame, index: TextIndex, scopes: ScopeSet, query: str, k: int, options: SearchOptions | None = None,
           expansions: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(id, score) of the best k nodes; equal scores by id."""
    options = options or SearchOptions()
    terms = X.analyze(query, options.stem)
    if k < 1:
        raise Rejected("k must be positive")
    if not terms:
        raise Rejected("the query has no term")
    scoring.check_recency(options.recency_weight, options.half_life_ms)
    spark = nodes.sparkSession
    weights = weighted_terms(index, scopes.names(), terms, expansions or [], options.fuzzy, options.stem)
    found = score(index, spark.createDataFrame(weights, "scope string, term string, weight double"))
    seen = nodes.where(scopes.admits(F.col("scope"))).select("id")
    found = found.join(seen, "id", "left_semi")
    if options.recency_weight > 0:
        found = found.withColumn("score", F.col("score") * scoring.recency(
            created_ms(F.col("id")), options.now_ms or 0, options.recency_weight, options.half_life_ms))
    return found.orderBy(F.desc("score"), "id").limit(k)
