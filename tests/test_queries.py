"""Every registered query of the library agrees with its SQL on the smallest tables."""

import math
import random
import re
from pathlib import Path

import duckdb
import pytest

from strataloom.operators import containment
from strataloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the bundled tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def form(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    found = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(form(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    got = sorted(tuple(form(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with long, empty and null texts: their folder, the benchmark's and the documents' texts."""
    draw, d = random.Random(4), str(tmp_path_factory.mktemp("small"))
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice((4, 12, 30))))) for k in range(12)] + [(12, ""), (13, "a b")]
    docs = [(k, " ".join(draw.choices(vocabulary, k=draw.choice((5, 40, 400))))) for k in range(24)] + [(24, ""), (25, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, t, len(t or "")) for k, t in docs], "doc_id long, text string, n_chars long").write.parquet(
        f"{d}/documents.parquet")
    assert sum(len(t or "") >= 1500 for _, t in docs) > 3
    return d, items, docs


def test_used_rule(spark, small):
    d, items, docs = small
    words = lambda t: set(re.findall("[a-z0-9]{3,}", (t or "").lower()))
    want = {(i, k) for i, m in items for k, t in docs if words(m) and 2 * len(words(m) & words(t)) >= len(words(m))}
    assert {tuple(r) for r in catalog.QUERIES["used_rule"](spark, d).select("item_id", "doc_id").collect()} == want


def test_dup_pairs_text(spark, small):
    d, items, docs = small
    rows = [(i, set(t.lower().split())) for i, t in items] + [(1000000 + k, set((t or "").lower().split())) for k, t in docs]
    want = {(a, b): round(len(x & y) / min(len(x), len(y)), 6) for a, x in rows for b, y in rows
            if a < b and x and y and len(x & y) >= 0.7 * min(len(x), len(y))}
    empty = [a for a, x in rows if not x]
    want |= {(empty[0], b): 1.0 for b in empty[1:]}  # rows without a word are linked to the first of them
    got = catalog.QUERIES["dup_pairs_text"](spark, d).collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want)


def test_dup_pairs_text_shuffles_no_candidates(spark, tmp_path):
    d, small = str(tmp_path), 40
    texts = [" ".join(f"common{j}" for j in range(k % 7, k % 7 + 8)) + " " + " ".join(f"own{k}x{j}" for j in range(k % 5)) for k in range(300)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts[:small])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(texts[small:])], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    found = catalog.QUERIES["dup_pairs_text"](spark, d)
    sets = [(k if k < small else 1000000 + k - small, set(t.split())) for k, t in enumerate(texts)]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= 0.7 * min(len(x), len(y))}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 1000
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no word is a row of its own


def test_containment_in_blocks(spark):
    draw = random.Random(8)
    sets = [draw.sample(range(-40, 40), draw.choice((1, 2, 3, 10, 40))) for _ in range(150)]
    sets += [sets[3]] * 5 + [[2**63 - 1, -(2**63)]] * 2
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, w array<long>").repartition(3)
    for rows in (1, 7, 8192):
        got = [tuple(r) for r in containment.pairs(frame, 0.7, rows).collect()]
        want = {(a, b, len({*x} & {*y}) / min(len(x), len(y))) for a, x in enumerate(sets) for b, y in enumerate(sets)
                if a < b and len({*x} & {*y}) >= 0.7 * min(len(x), len(y))}
        assert set(got) == want and len(got) == len(want)


def test_whole_lineitem_and_customer(spark, tmp_path):
    lines = [(1, 7), (1, 9), (1, 9), (2, 7), (400, 7), (400, 8), (900, 9), (900, 7), (901, 7), (901, 9), (901, 10)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.version for r in catalog.QUERIES["policy_match"](spark, str(tmp_path)).collect()) == [1, 900]
    names = [(k, "acme CORP" if k == 70 else f"Customer {k}") for k in (1, 2, 3, 4, 70, 71)]
    spark.createDataFrame(names, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = catalog.QUERIES["resolve_alias"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in found) == ["C000000000001", "C000000000002", "C000000000070"]
