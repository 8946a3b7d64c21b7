import math

import pytest
from pyspark.sql import functions as F

from strataloom.functions import scoring
from strataloom.functions import text as X
from strataloom.functions.porter2 import stem
from strataloom.model import (DEFAULT_SPEC, EARLIER_SPECS, DateTime, IndexSpec, Rejected, ScopeSet, created_ms, id_ms, new_id,
                              plain, spec_decision, ulid_text, ulid_value, upgraded_spec, value)

STEMS = {"caresses": "caress", "flies": "fli", "dies": "die", "agreed": "agre", "owned": "own", "meeting": "meet",
         "itemization": "item", "traditional": "tradit", "generously": "generous", "hopping": "hop", "hoping": "hope",
         "relational": "relat", "running": "run", "happily": "happili", "cries": "cri", "ties": "tie", "by": "by", "say": "say",
         "gas": "gas", "kiwis": "kiwi", "skies": "sky", "proceeding": "proceed", "controlling": "control"}


@pytest.mark.parametrize("word,expected", STEMS.items())
def test_stems(word, expected):
    assert stem(word) == expected


def test_analysis_agrees_on_driver_and_cluster(spark):
    texts = ["HTTPServer fooBar", "getURLFor x2Y", "L'été, Größe!", "", "a_b-c  d", "ABCdef running"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for stemming in (True, False):
        got = [r[0] for r in rows.select(X.analyzed(F.col("t"), stemming)).collect()]
        assert got == [X.analyze(t, stemming) for t in texts]
    assert X.analyze("HTTPServer", False) == ["http", "server"]


def test_normal_forms(spark):
    s = "  Foo  BAR\t"
    row = spark.createDataFrame([(s, "- Works  AT_")], "a string, b string").select(X.normalized(F.col("a")), X.edge_type(F.col("b"))).first()
    assert tuple(row) == ("foo bar", "works_at")
    assert X.normalize(s) == "foo bar" and X.normalize_edge_type("- Works  AT_") == "works_at"
    with pytest.raises(Rejected):
        X.normalize_edge_type(" - ")
    assert X.content_hash("a  b") == X.content_hash(" a b ") and len(X.content_hash("")) == 16
    assert X.content_hash("") == "cbf29ce484222325"


def test_bounded_levenshtein():
    assert X.bounded_levenshtein("kitten", "sitting", 3) == 3
    assert X.bounded_levenshtein("kitten", "sitting", 2) is None
    assert X.bounded_levenshtein("", "", 0) == 0


@pytest.mark.parametrize("a,b,expected", [
    ("the store keeps data in alpha", "the store now keeps data in beta, not alpha", "supersession"),
    ("tests run on ubuntu and windows", "tests no longer run on windows, only ubuntu", "supersession"),
    ("tests run only on ubuntu (windows dropped)", "tests no longer run on windows, only ubuntu", "duplicate"),
    ("the alpha backend is used for storage", "the alpha backend was removed", "supersession"),
    ("alpha is the storage backend", "the storage backend is alpha", "duplicate")])
def test_relation(a, b, expected):
    assert X.relation(a, b) == expected == X.relation(b, a)


def test_ids_and_values(spark):
    x = new_id(1_700_000_000_000)
    assert id_ms(x) == 1_700_000_000_000 and ulid_text(ulid_value(x)) == x
    assert spark.createDataFrame([(x,)], "id string").select(created_ms(F.col("id"))).first()[0] == 1_700_000_000_000
    with pytest.raises(Rejected):
        ulid_value("nope")
    for v in ("a", 5, 2.5, True, b"x", DateTime(5)):
        assert plain(value(v)) == v
    assert value(5) != value(DateTime(5))
    for bad in (float("nan"), 1 << 63, None, [1]):
        with pytest.raises(Rejected):
            value(bad)


def test_specs_and_scopes(spark):
    with pytest.raises(Rejected):
        IndexSpec(equality=(("A", "x"), ("A", "x")))
    assert all(upgraded_spec(s) == DEFAULT_SPEC for s in EARLIER_SPECS)
    own = IndexSpec((("A", "x"),))
    assert upgraded_spec(own) == own
    assert spec_decision(None, own, 1, 1) == "create" and spec_decision(own, own, 1, 2) == "reindex" and spec_decision(own, own, 1, 1) == "keep"
    rows = spark.createDataFrame([("shared",), ("a",)], "scope string")
    assert rows.where(ScopeSet().admits(F.col("scope"))).count() == 0
    assert rows.where(ScopeSet.of("a", shared=True).admits(F.col("scope"))).count() == 2


def test_factors(spark):
    row = spark.range(1).select(scoring.recency(F.lit(0), 1000, 0.5, 1000.0), scoring.access(F.lit(0), 1.0), scoring.access(F.lit(9), 1.0)).first()
    grown = math.log(10)
    assert row[0] == pytest.approx(0.75) and row[1] == 1.0 and row[2] == pytest.approx(1 + grown / (1 + grown))
    with pytest.raises(Rejected):
        scoring.check_recency(1.5, 1.0)
