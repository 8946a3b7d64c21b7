import pytest
from pyspark.sql import functions as F

from strataloom.engine import MemoryGraph
from strataloom.model import Compacted, RecallQuery, Rejected, ScopeSet, new_id
from strataloom.operators import graph, hygiene, recall, text, vector, workgraph
from strataloom.sources import batch as B
from strataloom.sources import json_io as J
from strataloom.sources.oplog import with_retry
from strataloom.model import Busy

T0 = 1_700_000_000_000
SHARED = ScopeSet(shared=True)


@pytest.fixture()
def store(spark, tmp_path):
    return MemoryGraph(spark, str(tmp_path / "store"))


def ids(df):
    return [r.id for r in df.collect()]


def test_temporal_traversal(spark):
    s1 = "01HF7YAT00ASDW8Z3078W7S9WF"
    nodes = spark.createDataFrame([("a", s1, "Memory"), ("b", "shared", "Entity"), ("c", "shared", "Entity")], "id string, scope string, label string")
    edges = spark.createDataFrame([("e1", s1, "about", "a", "b", 100, None), ("e2", "shared", "relates", "b", "c", 100, 200)],
                                  "id string, scope string, ty string, src string, dst string, valid_from long, valid_to long")
    scopes = ScopeSet.of(s1, shared=True)

    def walk(**o):
        args = {"scopes": scopes, "seeds": ["a"], "max_hops": 2, "as_of": 300} | o
        return graph.traverse(nodes, edges, **args)

    assert set(ids(walk().nodes)) == {"a", "b"}
    sub = walk(as_of=150)
    assert set(ids(sub.nodes)) == {"a", "b", "c"} and set(ids(sub.edges)) == {"e1", "e2"}
    assert set(ids(walk(as_of=100).nodes)) == {"a", "b", "c"} and set(ids(walk(as_of=200).nodes)) == {"a", "b"}
    assert set(ids(walk(as_of=99).nodes)) == {"a"}
    assert set(ids(walk(as_of=150, max_hops=1).edges)) == {"e1"}
    assert set(ids(walk(as_of=150, direction="in", seeds=["c"]).nodes)) == {"a", "b", "c"}
    assert ids(walk(scopes=SHARED).nodes) == [] and ids(walk(edge_types=[], as_of=150).edges) == []
    for hops in (0, 5):
        with pytest.raises(Rejected):
            walk(max_hops=hops)


def test_pagerank_small_and_distributed_agree(spark):
    nodes = [f"n{i}" for i in range(8)]
    pairs = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "n3"), ("n3", "n4"), ("n3", "n4"), ("n5", "n5"), ("n6", "n0")]
    seeds = [("n0", 0.7), ("n3", 0.3), ("gone", 1.0)]
    small = graph.pagerank_arrays(nodes, pairs, seeds)
    nd = spark.createDataFrame([(n,) for n in nodes], "id string")
    ed = spark.createDataFrame(pairs, "src string, dst string")
    spark.sparkContext.setCheckpointDir("/tmp/strataloom-checkpoints")
    large = [(r.id, r.score) for r in graph.pagerank(nd, ed, seeds, rounds=12, driver_edges=0).collect()]
    assert [i for i, _ in small] == [i for i, _ in large]
    assert all(abs(a[1] - b[1]) < 5e-3 for a, b in zip(small, large))
    assert graph.pagerank_arrays(nodes, pairs, [("gone", 1.0)]) == []


def test_log_rules(store):
    a, b = new_id(T0), new_id(T0 + 1)
    make = lambda x: B.op("CreateNode", id=x, scope="shared", label="Entity", props={"name": "n"})
    with pytest.raises(Rejected):
        store.submit([])
    assert store.submit([make(a), make(b)], T0) == (1, 2)
    for bad in ([make(a)], [B.op("SetNodeProps", id="zz", props={}, del_keys=[])], [B.op("CloseEdge", id="zz")],
                [B.op("SetEmbedding", id=a, model="m", vector=[float("nan")])], [B.op("CreateEdge", id="e", scope="shared", ty="t", src=a, dst="zz")]):
        with pytest.raises(Rejected):
            store.submit(bad, T0)
    assert store.current_seq() == 2
    e = new_id(T0)
    store.submit([B.op("CreateEdge", id=e, scope="shared", ty="knows", src=a, dst=b, props={}), B.op("SetEmbedding", id=a, model="m", vector=[1.0, 0.0]),
                  B.op("SetNodeProps", id=a, props={"x": 1}, del_keys=["name"])], T0 + 10)
    with pytest.raises(Rejected):
        store.submit([B.op("SetEmbedding", id=b, model="m", vector=[1.0])])
    assert store.node(SHARED, a)["props"] == {"x": 1} and store.node(ScopeSet(), a) is None
    assert store.edges().first().valid_from == T0 + 10
    store.submit([B.op("RemoveNode", id=b)], T0 + 20)
    assert store.edges().count() == 0
    store.submit([make(b)], T0 + 30)
    assert store.node(SHARED, b) is not None and store.edges().count() == 0
    before = sorted(map(str, store.nodes().collect()))
    assert sorted(map(str, store.rebuild_state()["nodes"].collect())) == before
    store.compact_ops(6)
    assert sorted(map(str, store.nodes().collect())) == before
    with pytest.raises(Compacted):
        store.ops_since(1)
    with pytest.raises(Rejected):
        store.rebuild_state()
    store.compact_ops(store.current_seq() + 1)
    assert store.ops_since(store.current_seq() + 1).count() == 0 and store.current_seq() == 7
    again = MemoryGraph.open_stored(store.spark, store.log.path)
    assert sorted(map(str, again.nodes().collect())) == before


def test_batch_language(store):
    made = store.submit_batch([B.create_entity("Ann"), B.create_memory("Ann likes tea"), B.link("#1", "#0", "About Person")], now_ms=T0)
    assert store.edges().first().ty == "about_person" and store.edges().first().src == made[1]
    for bad in ([B.link("#0", "#1", "t")], [B.create_node("Memory")], [{"op": "nope"}], ["x"], [B.create_entity("a", {"name": "b"})],
                [B.create_entity("x"), B.close_edge("#0")], [B.create_memory("x", {"a": None})]):
        with pytest.raises(Rejected, match="command #"):
            B.resolve(bad)
    assert J.changes_from_json({"a": None, "b": 2}) == ({"b": 2}, ["a"])
    with pytest.raises(Rejected):
        J.vector_from_json([True])


def test_remember_and_search(store):
    first = store.remember("Drew prefers Colima over Docker", ["Drew", "drew ", "Colima"], now_ms=T0)
    assert first["created"] and len(first["entities"]) == 2
    again = store.remember("Drew  prefers Colima over Docker", ["DREW"], now_ms=T0 + 5)
    assert not again["created"] and again["ops"] == 0 and again["memory"] == first["memory"]
    with pytest.raises(Rejected):
        store.remember("x", [" "])
    with pytest.raises(Rejected):
        store.create_memory("x", props={"content_hash": "y"})
    assert ids(store.search_memories(SHARED, "colma prefering", now_ms=T0 + 10))[0] == first["memory"]
    second = store.remember("Drew prefers Podman", ["Drew"], supersedes=[first["memory"]], now_ms=T0 + 100)
    assert first["memory"] not in ids(store.search_memories(SHARED, "prefers", now_ms=T0 + 200))
    assert second["memory"] in ids(store.search_memories(SHARED, "prefers", now_ms=T0 + 200))
    assert store.add_alias(first["entities"][0], "Andrew", SHARED, T0) and not store.add_alias(first["entities"][0], "andrew", SHARED, T0)
    assert store.existing_entity(SHARED, "ANDREW") == first["entities"][0]
    assert store.add_synonym("podman", "container", both=True, now_ms=T0) == 2 and store.add_synonym("podman", "Container", now_ms=T0) == 0
    assert second["memory"] in ids(store.search_memories(SHARED, "container", now_ms=T0 + 200))
    edge, made = store.link(first["entities"][0], first["entities"][1], "Works At", now_ms=T0)
    assert made and store.link(first["entities"][0], first["entities"][1], "works-at", now_ms=T0) == (edge, False)
    store.nodes_by_label(SHARED, "Memory", bump=True)
    assert store.access_stats(SHARED, second["memory"]).first().access_count == 1


def test_fuzzy_guards_and_rejections(spark):
    assert text.fuzzy(["ther", "there", "other", "th", "t"], "ther") == ["other", "there"]
    nodes = spark.createDataFrame([("a", "shared"), ("b", "shared")], "id string, scope string")
    index = text.build(spark.createDataFrame([("shared", "a", "alpha beta"), ("shared", "b", "")], "scope string, id string, body string"))
    assert index.docs.count() == 1
    with pytest.raises(Rejected):
        text.search(nodes, index, SHARED, "!!", 3)
    with pytest.raises(Rejected):
        text.search(nodes, index, SHARED, "alpha", 0)
    weights = {t: w for _, t, w in text.weighted_terms(index, ["shared"], ["alpha", "betas"], [("alpha", ["beta"])], True, False)}
    assert weights == {"alpha": 1.0, "beta": 0.6}


def test_vectors(spark):
    nodes = spark.createDataFrame([(x, "shared") for x in "abcd"], "id string, scope string")
    vs = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "m", [1.0, 0.0]), ("c", "m", [0.0, 0.0]), ("d", "m", [1.0])],
                               "id string, model string, vector array<float>")
    assert ids(vector.search(nodes, vs, SHARED, "m", [2.0, 0.0], 5)) == ["a", "b"]
    assert ids(vector.search(nodes, vs, SHARED, "other", [1.0, 0.0], 5)) == []
    for bad in ([], [float("inf")]):
        with pytest.raises(Rejected):
            vector.search(nodes, vs, SHARED, "m", bad, 5)
    many = spark.createDataFrame([(f"v{i:02d}", [float(i % 7 + 1), float(i % 3)]) for i in range(30)], "id string, vector array<float>")
    one = {(r.u, r.v) for r in vector.similar_pairs(many, 0.99).collect()}
    assert one == {(r.u, r.v) for r in vector.similar_pairs(many, 0.99, block=4).collect()} and one


def test_fusion_and_tuning():
    assert recall.fuse_lists([(1.0, ["a", "b"]), (0.5, ["b"])])[0][0] == "b"
    assert (recall.depth(1), recall.depth(15), recall.depth(99)) == (30, 45, 50)
    for bad in ({"k": 0}, {"text_weight": 0, "vector_weight": 0, "graph_weight": 0}, {"access_weight": 2.0}, {"labels": []},
                {"label_weights": {"": 1.0}}, {"recency_weight": -1.0}):
        with pytest.raises(Rejected):
            recall.validate(RecallQuery(SHARED, "x", **bad))


def test_containment_pairs(spark):
    rows = [("a", "alpha beta gamma delta"), ("b", "Alpha beta gamma epsilon"), ("c", "zeta"), ("d", ""), ("e", None), ("f", "alpha beta")]
    got = {(r.u, r.v): round(r.score, 2) for r in hygiene.containment_pairs(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got == {("a", "b"): 0.75, ("a", "f"): 1.0, ("b", "f"): 1.0, ("d", "e"): 1.0}


def test_work_graphs():
    g = workgraph.from_yaml("""
version: 1
goal: g
nodes:
  - {id: a, kind: agent, prompt: p, output: {schema: {type: object}}, budget: {retries: 1, repairs: 1}}
  - {id: b, kind: command, run: x, needs: [a, a]}
  - {id: c, kind: gate, needs: [b]}
  - {id: d, kind: command, run: y, needs: [c]}
""")
    assert workgraph.validate(g) == [] and workgraph.order(g) == ["a", "b", "c", "d"]
    run = workgraph.execute(g, lambda step, attempt: (step.id != "a" or attempt > 1, "r"))
    assert [run.state(x) for x in "abcd"] == ["COMPLETED", "COMPLETED", "BLOCKED", "SKIPPED"] and run.state("a", 1) == "PENDING"
    run = workgraph.execute(g, lambda step, attempt: (False, "no"), lambda step, why: step)
    assert run.state("a") == "BLOCKED" and run.state("b") == "SKIPPED" and len(run.attempts["a"]) <= 4
    assert workgraph.failure_context(g, run)[0]["id"] == "a" and "a failed" in workgraph.replan_goal(g, run)
    bad = workgraph.WorkGraph("g", [workgraph.Step("a", "agent", ("b",)), workgraph.Step("a", "command", run="x"), workgraph.Step("c", "odd", ("z",))])
    assert len(workgraph.validate(bad)) >= 4
    loop = workgraph.WorkGraph("g", [workgraph.Step("a", "gate", ("b",)), workgraph.Step("b", "gate", ("a",))])
    assert workgraph.validate(loop) == ["the graph has a cycle"]


def test_busy_retry():
    waits = []

    def attempt():
        raise Busy("held")

    with pytest.raises(Busy):
        with_retry(100, attempt, waits.append)
    assert waits == [0.025, 0.05, 0.025]


def test_feed_equals_log(store, tmp_path):
    from strataloom.streaming import feed

    store.remember("a b", ["E"], now_ms=T0)
    store.remember("c d", ["E"], now_ms=T0 + 1)
    got = feed.run_available(feed.changes(store.spark, store.log.path).select("seq", "op"), "feed_test", str(tmp_path / "cp"))
    assert sorted(r.seq for r in got.collect()) == list(range(1, store.current_seq() + 1))
    bumps = store.spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 1, 120)], "id string, n long, at long")
    assert {(r.id, r.n, r.at) for r in feed.coalesced(bumps).collect()} == {("a", 3, 9), ("b", 1, 120)}
