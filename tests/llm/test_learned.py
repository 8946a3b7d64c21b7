"""Learned operators on small made corpora: held-out results, odd rows, clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import langid, quality, toxicity
from strataloom.llm.labelled import fold

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(8)
    plain = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rd", "sk")]
    bad = ["zorkwit", "glimfraud", "plonkish"]
    docs, labels = [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[draw.randrange(8)] = draw.choice(bad)
        junk = i % 5 == 0
        text = " ".join(words) if not junk else " ".join(w.upper() + "!!" for w in words[:8] * 5)
        docs.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "x")]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.fitted(docs, labels)
    out = toxicity.scored(docs, model, ["doc_id"]).withColumn("held", fold(4) == 2).collect()
    held = [(r.doc_id, r["__score"]) for r in out if r.held and r.doc_id is not None and r.doc_id < 1000]
    assert held and all((s >= 0.3) == (i % 4 == 0) for i, s in held)
    assert len(out) == docs.count() and all(0 <= r["__score"] <= 1 for r in out)
    some = spark.createDataFrame([(1, "say zorkwitt now"), (2, "a glimfrauds b"), (3, "bant dord")], SCHEMA)
    scores = {r.doc_id: r["__score"] for r in toxicity.scored(some, model, ["doc_id"]).collect()}
    assert scores[1] > 0.3 and scores[2] > 0.3 and scores[3] < 0.3
    wide = docs.withColumn("score", F.lit("mine"))
    kept = toxicity.without_toxic(wide, labels)
    assert kept.columns == wide.columns and kept.count() < wide.count()
    none = toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0)), ["doc_id"])
    assert {r["__score"] for r in none.collect()} == {0.5}


def test_automaton_is_levenshtein():
    from strataloom.functions.text import bounded_levenshtein

    words = ["abcde", "abxde", "hello", "helloworld"]
    automaton = toxicity.LexiconAutomaton(dict.fromkeys(words, 1.0))
    draw = random.Random(3)
    for _ in range(3000):
        w = list(draw.choice(words))
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "x", "l"])
        w = "".join(w)
        want = max((0.5 ** d for t in words for d in [bounded_levenshtein(w, t, toxicity.allowed_edits(len(t)))] if d is not None), default=0.0)
        assert automaton.match(w) == want, w
    stems = toxicity.LexiconAutomaton({"grum*": 2.0})
    assert stems.match("grumbling") == 2.0 and stems.match("gru") == 0.0


def test_quotation_counts_apart():
    automaton = toxicity.LexiconAutomaton({"idiot": 4.0})
    context = frozenset({"wrote"}), frozenset({"you"})
    plain, quoted = (toxicity.features(t, automaton, {}, context) for t in ("you idiot go", 'he wrote "idiot" here'))
    assert plain[0] > 0 and plain[3] > 0 and plain[1] == 0 and quoted[1] > 0 and quoted[0] == 0
    said = toxicity.features("he wrote idiot here", automaton, {}, context)
    assert said[2] > 0 and said[0] == 0


def test_context_words_are_learned(spark):
    rows = [(f"they noted idiot once {i}", 0) for i in range(10)] + [(f"thou idiot now {i}", 1) for i in range(10)]
    quoting, abusing = toxicity.learn_context(spark.createDataFrame(rows, "text string, y int"), {"idiot": 4.0}, frozenset())
    assert quoting == {"they", "noted", "once"} and abusing == {"thou", "now"}


def test_quality(spark, corpus):
    docs, labels = corpus
    model = quality.fitted(docs, labels)
    out = quality.scored(docs, model, ["doc_id"]).withColumn("held", fold(3) == 1).collect()
    held = [(r.doc_id, r["__score"]) for r in out if r.held and r.doc_id is not None and r.doc_id < 1000]
    right = np.mean([(s >= 0.5) == (i % 5 != 0) for i, s in held])
    assert right > 0.95 and len(out) == docs.count()
    prior = quality.scored(docs, quality.fitted(docs, labels.limit(0)), ["doc_id"])
    assert {round(r["__score"], 6) for r in prior.collect()} == {0.5}
    assert quality.scored(docs.limit(0), model, ["doc_id"]).count() == 0


def test_risk_and_its_slope():
    draw = np.random.default_rng(4)
    p, u = draw.integers(0, 3, (30, 1)), draw.integers(0, 3, (50, 1))

    def by_hand(w, prior):
        loss = lambda z: np.log1p(np.exp(-z))
        g = lambda x: w[x[:, 0]] + w[-1]
        negative = loss(-g(u)).mean() - prior * loss(-g(p)).mean()
        return prior * loss(g(p)).mean(), negative

    seen = set()
    for prior in (0.2, 0.6, 0.9):
        for _ in range(30):
            w = draw.normal(size=4) * 3
            value, slope, clipped = quality.risk(w, p, u, prior)
            a, b = by_hand(w, prior)
            assert np.isclose(value, a + max(0, b)) and clipped == (b < 0)
            seen.add(clipped)
            for k in range(4):
                step = np.eye(4)[k] * 1e-6
                up, down = by_hand(w + step, prior), by_hand(w - step, prior)
                want = -(up[1] - down[1]) / 2e-6 if clipped else (sum(up) - sum(down)) / 2e-6
                assert np.isclose(slope[k], want, atol=1e-5)
    assert seen == {True, False}


def test_fit_reaches_the_least_risk():
    draw = np.random.default_rng(6)
    x = lambda n, share: (draw.random((n, 1)) < share).astype(float)
    positive, unlabelled, prior = x(300, 0.9), np.concatenate([x(300, 0.9), x(300, 0.2)]), 0.5
    edges, weights, bias = quality.fit_nnpu(positive, unlabelled, prior)
    p, u = quality._onehot(positive, edges), quality._onehot(unlabelled, edges)
    got = quality.risk(np.append(weights, bias), p, u, prior)[0]
    grid = np.linspace(-6, 6, 121)
    least = min(quality.risk(np.append(np.where(np.arange(len(weights)) == p.max(), a, b), 0.0), p, u, prior)[0] for a in grid for b in grid)
    assert got <= least + 0.01


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior(share):
    draw = np.random.default_rng(7)
    good, bad = draw.normal(0, 1, (4000, 2)), draw.normal(3, 1, (4000, 2))
    n = int(4000 * share)
    got = quality.class_prior(draw.normal(0, 1, (2000, 2)), np.concatenate([good[:n], bad[: 4000 - n]]))
    assert abs(got - share) < 0.07
    assert quality.class_prior(np.zeros((0, 2)), good) == 0.5


def test_languages(spark):
    draw = random.Random(5)
    syllables = {"aa": ["ka", "ko", "ki", "tu"], "bb": ["sch", "ung", "ein", "er"], "cc": ["eau", "oi", "que", "re"]}
    word = lambda lang: "".join(draw.choice(syllables[lang]) for _ in range(3))
    rows = [(i, " ".join(word(lang) for _ in range(25)), lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    chain = langid.fitted(docs)
    out = langid.identified(docs, chain, ["doc_id", "lang"]).withColumn("held", fold(5) == 0).collect()
    held = [r for r in out if r.held and r.doc_id < 900]
    assert held and np.mean([r["__lang"] == r.lang for r in held]) > 0.97
    assert {r["__lang"] for r in out if r.doc_id >= 900} == {"und"} and all(0 <= r["__score"] <= 1 for r in out)
    odd = ["½ ² Ⅷ", "12 ٣ ①", "\u0301 _ 日本", "é", "½a"]
    got = langid.identified(spark.createDataFrame(list(enumerate(odd)), SCHEMA), chain, ["doc_id"]).collect()
    assert [r["__lang"] == "und" for r in sorted(got)] == [True, True, False, False, False]
    assert langid.words_of("x²y Ⅷth _a_ 日本") == ["x", "y", "th", "a", "日本"]
    mixed = spark.createDataFrame([(1, " ".join([word("aa") for _ in range(15)] + [word("cc") for _ in range(15)]))], SCHEMA)
    spans = langid.word_languages(mixed, chain).first().spans
    assert [s.lang for s in spans] == ["aa", "cc"] and abs(spans[0].words - 15) <= 2
    assert {r["__lang"] for r in langid.identified(docs, None, ["doc_id"]).collect()} == {"und"}


def test_posteriors_are_exact():
    draw = np.random.default_rng(1)
    score, start, step = draw.random((9, 3)).astype(np.float32) + 0.1, draw.normal(size=3), draw.normal(size=(3, 3))
    lengths = np.array([4, 0, 5])
    got = langid.posteriors(score, lengths, start, step)
    at = 0
    for n in (4, 5):
        own, mass = score[at : at + n].astype(float), np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            p = np.exp(start[path[0]]) * own[0, path[0]]
            for t in range(1, n):
                p *= np.exp(step[path[t - 1], path[t]]) * own[t, path[t]]
            mass[np.arange(n), path] += p
        assert np.allclose(got[at : at + n], mass / mass.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


CLASHES = ["n_words", "runs", "spans", "items", "n_hit", "__hit", "__n_bytes", "n_bytes", "n_removed", "kept", "removed", "rid", "root", "name",
           "digest", "k0", "k1", "text0", "__score", "__text", "f", "y", "score", "open", "marks", "term", "fp", "keys", "s", "part", "length"]


def test_stages_with_clashing_columns_and_odd_rows(spark, tmp_path, corpus):
    import corpus_pipeline

    docs, labels = corpus
    long = "word " * 40_000
    odd = spark.createDataFrame([(2000, long), (2001, long), (2002, None), (None, None), (2003, ""), (2003, ""), (2004, "x" * 200_000)], SCHEMA)
    wide = docs.unionByName(odd).select("doc_id", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)], "text")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "bant dord " * 9), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (wide, wide.limit(0)):
            after = stage(spark, frame, str(tmp_path))
            assert after.columns == wide.columns, name
            rows = after.collect()
            assert all(r[c] == i for r in rows for i, c in enumerate(CLASHES)), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).count() >= wide.count()


def test_operators_on_empty_tables_and_long_texts(spark, tmp_path, corpus):
    from strataloom.llm import queries

    docs, labels = corpus
    wide = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    long = [(3000, "lorem ipsum dolor " * 30_000), (3001, "é" * 100_000), (3002, " \n" * 50_000), (3000, None), (None, "lorem")]
    some = spark.createDataFrame(long, SCHEMA).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
                                                      F.lit(None).cast("long").alias("n_chars"))
    for kind, frame in (("empty", wide.limit(0)), ("long", wide.limit(80).unionByName(some))):
        folder = f"{tmp_path}/{kind}"
        frame.write.parquet(f"{folder}/documents.parquet")
        (labels.limit(0) if kind == "empty" else labels).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "lorem ipsum dolor " * 8)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        n = frame.count()
        for name, query in queries.QUERIES.items():
            rows = query(spark, folder).collect()
            if name.startswith("op6"):
                assert len(rows) >= n and len({(r.doc_id, r.piece) for r in rows}) <= len(rows)
            else:
                assert len(rows) == n, name


def test_pipeline_stages(spark, tmp_path, corpus):
    import corpus_pipeline

    docs, labels = corpus
    wide = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    folder = str(tmp_path)
    wide.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "never seen words in any of the documents at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == wide.columns, name
        now = spark.createDataFrame(after.collect(), wide.schema)
    assert corpus_pipeline.ORACLE_SQL is None and 0 < now.count() < wide.count()
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() >= now.where("doc_id is not null").count()
