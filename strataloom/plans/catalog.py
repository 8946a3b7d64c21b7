"""Queries over the bundled tables, one for each operator, with the DuckDB SQL that must agree.

Orderings end with an id; sums of doubles are rounded on both sides."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import scoring
from strataloom.functions import text as X
from strataloom.model import MEMORY, RecallQuery, ScopeSet, not_superseded
from strataloom.operators import fold, graph, hygiene, lookup, recall, text, vector
from strataloom.sources import tables
from strataloom.sources.shared import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SEGMENT = "BUILDING"
BUSINESS = ScopeSet.of(SEGMENT, shared=True)
SOURCES = ScopeSet.of("src0", "src1", "src2")
ALL_SOURCES = ScopeSet.of(*[f"src{i}" for i in range(20)])
AS_OF = 946_684_800_000  # 2000-01-01
NOW = tables.DOCUMENT_EPOCH_MS + 30 * tables.DAY_MS
SEED_CUSTOMER = "C000000000001"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def _key(prefix: str, column: str) -> str:
    return f"'{prefix}' || lpad(cast({column} as varchar), 12, '0')"


# ---------------------------------------------------------------- the graph in SQL

NODES_SQL = f"""nodes as (
  select {_key('R', 'r_regionkey')} as id, 'shared' as scope, 'Region' as label, r_name as name, cast(null as double) as acctbal, 0 as created_ms from region
  union all select {_key('N', 'n_nationkey')}, 'shared', 'Nation', n_name, null, 0 from nation
  union all select {_key('S', 's_suppkey')}, 'shared', 'Supplier', s_name, s_acctbal, 0 from supplier
  union all select {_key('P', 'p_partkey')}, 'shared', 'Part', p_name, null, 0 from part
  union all select {_key('C', 'c_custkey')}, c_mktsegment, 'Customer', c_name, c_acctbal, 0 from customer
  union all select {_key('O', 'o_orderkey')}, c_mktsegment, 'Order', null, null, (epoch_us(o_orderdate) // 1000)
            from orders join customer on o_custkey = c_custkey)"""
EDGES_SQL = f"""edges as (
  select {_key('ER', 'n_nationkey')} as id, 'shared' as scope, 'in_region' as ty, {_key('N', 'n_nationkey')} as src,
         {_key('R', 'n_regionkey')} as dst, cast(0 as bigint) as valid_from, cast(null as bigint) as valid_to from nation
  union all select {_key('ES', 's_suppkey')}, 'shared', 'in_nation', {_key('S', 's_suppkey')}, {_key('N', 's_nationkey')}, 0, null from supplier
  union all select {_key('EC', 'c_custkey')}, c_mktsegment, 'in_nation', {_key('C', 'c_custkey')}, {_key('N', 'c_nationkey')}, 0, null from customer
  union all select {_key('EO', 'o_orderkey')}, c_mktsegment, 'placed_by', {_key('O', 'o_orderkey')}, {_key('C', 'o_custkey')},
            (epoch_us(o_orderdate) // 1000), null from orders join customer on o_custkey = c_custkey
  union all select concat_ws('-', 'EL', l_orderkey, l_partkey, l_suppkey, l_linenumber, (epoch_us(l_shipdate) // 1000)), c_mktsegment, 'contains',
            {_key('O', 'l_orderkey')}, {_key('P', 'l_partkey')}, (epoch_us(l_shipdate) // 1000),
            case when l_linestatus = 'F' then (epoch_us(l_shipdate) // 1000) + 7776000000 end
            from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""
IN_BUSINESS = f"scope in ('shared', '{SEGMENT}')"


def _scope_order(alias: str = "") -> str:
    return f"{alias}scope <> 'shared', {alias}scope, {alias}id"


# ---------------------------------------------------------------- lookups


@query("node_lookup", f"with {NODES_SQL} select id, scope, label, name from nodes where {IN_BUSINESS} and id = 'P000000000007'")
def _(spark, d):
    found = lookup.node(tables.business_nodes(spark, d), BUSINESS, "P000000000007")
    return found.select("id", "scope", "label", F.col("props")["name"]["s"].alias("name"))


@query("nodes_by_label", f"with {NODES_SQL} select id, scope from nodes where {IN_BUSINESS} and label = 'Customer'")
def _(spark, d):
    return lookup.nodes_by_label(tables.business_nodes(spark, d), BUSINESS, "Customer").select("id", "scope")


@query("newest_k", f"with {NODES_SQL} select id, created_ms from nodes where {IN_BUSINESS} and label = 'Order' order by id desc limit 25")
def _(spark, d):
    return lookup.nodes_by_label_newest(tables.business_nodes(spark, d), BUSINESS, "Order", 25).select("id", "created_ms")


@query("recent_memories", f"""select {_key('D', 'doc_id')} as id, source as scope from documents where source in ('src0','src1','src2')
  order by id desc limit 8""")
def _(spark, d):
    return lookup.nodes_by_label_newest(tables.memories(spark, d), SOURCES, MEMORY, 8).select("id", "scope")


@query("nodes_by_prop_exact", f"""with {NODES_SQL} select id from nodes where label = 'Part' and name = (select p_name from part where p_partkey = 5)""")
def _(spark, d):
    name = tables.table(spark, d, "part").where("p_partkey = 5").first()["p_name"]
    return lookup.nodes_by_prop(tables.business_nodes(spark, d), BUSINESS, "Part", "name", name).select("id")


@query("nodes_by_prop_normalized", f"""with {NODES_SQL} select id from nodes where label = 'Part'
  and lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) = (select lower(trim(p_name)) from part where p_partkey = 5)""")
def _(spark, d):
    name = tables.table(spark, d, "part").where("p_partkey = 5").first()["p_name"]
    return lookup.nodes_by_prop_normalized(tables.business_nodes(spark, d), BUSINESS, "Part", "name", f"  {name.upper()} ").select("id")


@query("float_range", f"with {NODES_SQL} select id, acctbal from nodes where {IN_BUSINESS} and label = 'Customer' and acctbal between 1000 and 5000")
def _(spark, d):
    found = lookup.nodes_by_float_range(tables.business_nodes(spark, d), BUSINESS, "Customer", "acctbal", 1000.0, 5000.0)
    return found.select("id", F.col("props")["acctbal"]["f"].alias("acctbal"))


@query("multi_get", f"with {NODES_SQL} select id, label from nodes where id in (select {_key('O', 'l_orderkey')} from lineitem where l_quantity > 48)")
def _(spark, d):
    ids = tables.table(spark, d, "lineitem").where("l_quantity > 48").select(tables.key_id("O", "l_orderkey").alias("id"))
    return lookup.multi_get(tables.business_nodes(spark, d), ids).select("id", "label")


_EDGE = ["id", "scope", "ty", "src", "dst", "valid_from", "valid_to"]
_EDGE_SQL = ", ".join(_EDGE)


@query("edges_from", f"with {EDGES_SQL} select {_EDGE_SQL} from edges where {IN_BUSINESS} and src = 'N000000000003'")
def _(spark, d):
    return lookup.edges_from(tables.business_edges(spark, d), BUSINESS, "N000000000003").select(*_EDGE)


@query("edges_to", f"with {EDGES_SQL} select {_EDGE_SQL} from edges where {IN_BUSINESS} and dst = 'N000000000003' and ty = 'in_nation' and valid_to is null")
def _(spark, d):
    return lookup.edges_to(tables.business_edges(spark, d), BUSINESS, "N000000000003", ty="in_nation", open_only=True).select(*_EDGE)


@query("edges_between", f"with {EDGES_SQL} select {_EDGE_SQL} from edges where src = (select {_key('O', 'min(l_orderkey)')} from lineitem) "
       f"and dst = (select {_key('P', 'min(l_partkey)')} from lineitem where l_orderkey = (select min(l_orderkey) from lineitem))")
def _(spark, d):
    first = tables.table(spark, d, "lineitem").selectExpr("min(struct(l_orderkey, l_partkey)) as x").first()["x"]
    return lookup.all_edges_between(tables.business_edges(spark, d), f"O{first[0]:012d}", f"P{first[1]:012d}").select(*_EDGE)


@query("open_edges_between", f"with {EDGES_SQL} select id from edges where src = 'C000000000001' and valid_to is null "
       f"and dst = (select {_key('N', 'c_nationkey')} from customer where c_custkey = 1)")
def _(spark, d):
    nation = tables.table(spark, d, "customer").where("c_custkey = 1").first()["c_nationkey"]
    return lookup.open_edges_between(tables.business_edges(spark, d), "C000000000001", f"N{nation:012d}")


@query("get_edges_as_of", f"""with {EDGES_SQL} select {_EDGE_SQL} from edges where dst = 'P000000000011' and {IN_BUSINESS}
  and valid_from <= {AS_OF} and (valid_to is null or {AS_OF} < valid_to)""")
def _(spark, d):
    return lookup.get_edges(tables.business_edges(spark, d), BUSINESS, "P000000000011", "both", as_of=AS_OF).select(*_EDGE)


@query("access_stats", f"""select {_key('D', 'doc_id')} as id, cast(count(event_id) as bigint) as access_count,
  coalesce(max((epoch_us(ts) // 1000)), 0) as last_accessed_at from documents left join (select * from events where event_type = 'view') e on user_id = doc_id
  where source in ('src0','src1','src2') group by doc_id""")
def _(spark, d):
    return lookup.access_stats(tables.memories(spark, d), fold.counters(tables.bumps(spark, d)), SOURCES)


@query("access_merge", f"""select {_key('D', 'user_id')} as id, count(*) as access_count, max((epoch_us(ts) // 1000)) as last_accessed_at
  from events where event_type = 'view' group by user_id""")
def _(spark, d):
    return fold.counters(tables.bumps(spark, d))


@query("storage_counts", f"with {NODES_SQL}, {EDGES_SQL} select 'nodes' as \"table\", count(*) as \"rows\" from nodes union all select 'edges', count(*) from edges")
def _(spark, d):
    report = lookup.storage_report({"nodes": tables.business_nodes(spark, d), "edges": tables.business_edges(spark, d)})
    return report.select("table", "rows")


# ---------------------------------------------------------------- traversal


def _walk_sql(seeds: str, hops: int, as_of: int, types: str = "", direction: str = "both") -> str:
    live = f"{IN_BUSINESS} and valid_from <= {as_of} and (valid_to is null or {as_of} < valid_to) {types}"
    sides = {"out": "select id, src as near, dst as far from live", "in": "select id, dst as near, src as far from live"}
    steps = sides[direction] if direction != "both" else f"{sides['out']} union all {sides['in']}"
    rounds = "".join(f""", r{h} as (select distinct far as id from steps join r{h - 1} on near = r{h - 1}.id join seen on seen.id = far)"""
                     for h in range(1, hops + 1))
    union = " union all ".join(f"select id, {h} as hop from r{h}" for h in range(hops + 1))
    return f"""with {NODES_SQL}, {EDGES_SQL}, live as (select * from edges where {live}), steps as ({steps}),
      seen as (select id from nodes where {IN_BUSINESS}), r0 as (select id from seen where id in ({seeds})){rounds},
      visited as (select id, min(hop) as hop from ({union}) group by id)"""


@query("traverse_1hop", _walk_sql(f"'{SEED_CUSTOMER}'", 1, AS_OF) + " select id, hop from visited")
def _(spark, d):
    sub = graph.traverse(tables.business_nodes(spark, d), tables.business_edges(spark, d), ScopeSet.of(SEGMENT, shared=True),
                         [SEED_CUSTOMER], 1, AS_OF)
    return sub.nodes.select("id", "hop")


def _big_customer(spark, d) -> str:
    r = tables.table(spark, d, "customer").where(F.col("c_mktsegment") == SEGMENT).agg(F.min("c_custkey")).first()
    return f"C{r[0]:012d}"


_BIG_SQL = f"select {_key('C', 'min(c_custkey)')} from customer where c_mktsegment = '{SEGMENT}'"


@query("traverse_2hop_as_of", _walk_sql(_BIG_SQL, 2, AS_OF) + " select id, hop from visited")
def _(spark, d):
    sub = graph.traverse(tables.business_nodes(spark, d), tables.business_edges(spark, d), BUSINESS, [_big_customer(spark, d)], 2, AS_OF)
    return sub.nodes.select("id", "hop")


@query("traverse_edges", _walk_sql(_BIG_SQL, 2, AS_OF) + """ select distinct s.id as id from steps s join visited v on v.id = s.near and v.hop < 2
  join visited w on w.id = s.far""")
def _(spark, d):
    sub = graph.traverse(tables.business_nodes(spark, d), tables.business_edges(spark, d), BUSINESS, [_big_customer(spark, d)], 2, AS_OF)
    return sub.edges.select("id")


@query("traverse_typed_out", _walk_sql(f"select {_key('O', 'o_orderkey')} from orders where o_orderkey < 40", 3, AS_OF,
                                       "and ty in ('placed_by', 'in_nation', 'in_region')", "out") + " select id, hop from visited")
def _(spark, d):
    seeds = [f"O{r[0]:012d}" for r in tables.table(spark, d, "orders").where("o_orderkey < 40").select("o_orderkey").collect()]
    sub = graph.traverse(tables.business_nodes(spark, d), tables.business_edges(spark, d), BUSINESS, seeds, 3, AS_OF,
                         ["placed_by", "in_nation", "in_region"], "out")
    return sub.nodes.select("id", "hop")


@query("traverse_multi_seed_in", _walk_sql("'P000000000001', 'P000000000002', 'P000000000003'", 1, AS_OF, "", "in") + " select id, hop from visited")
def _(spark, d):
    sub = graph.traverse(tables.business_nodes(spark, d), tables.business_edges(spark, d), BUSINESS,
                         ["P000000000001", "P000000000002", "P000000000003"], 1, AS_OF, direction="in")
    return sub.nodes.select("id", "hop")


@query("common_neighbours", f"""with {NODES_SQL}, {EDGES_SQL}, live as (select * from edges where {IN_BUSINESS} and valid_from <= {AS_OF}
  and (valid_to is null or {AS_OF} < valid_to)), pairs as (select distinct * from (select src as near, dst as far from live union all select dst, src from live) where near <> far)
  select a.near as id, a.far as neighbour from pairs a join pairs b on a.far = b.far
  where b.near = ({_BIG_SQL}) and a.near <> b.near""")
def _(spark, d):
    return graph.common_neighbours(tables.business_edges(spark, d), BUSINESS, _big_customer(spark, d), AS_OF)


def _pagerank_sql(rounds: int) -> str:
    """PageRank from one nation over regions and nations, unrolled."""
    steps = "".join(f""", k{i} as (select n.id, 0.15 * n.home + 0.85 * (coalesce(f.x, 0) + (select coalesce(sum(r), 0) from k{i - 1} join deg using (id) where d = 0) * n.home) as r
      from home n left join (select l.v as id, sum(k.r / deg.d) as x from l join k{i - 1} k on k.id = l.u join deg on deg.id = l.u group by l.v) f on f.id = n.id)"""
                    for i in range(1, rounds + 1))
    return f"""with l as (select {_key('N', 'n_nationkey')} as u, {_key('R', 'n_regionkey')} as v from nation
       union all select {_key('R', 'n_regionkey')}, {_key('N', 'n_nationkey')} from nation),
     ids as (select {_key('N', 'n_nationkey')} as id from nation union all select {_key('R', 'r_regionkey')} from region),
     deg as (select ids.id, count(l.u) as d from ids left join l on l.u = ids.id group by ids.id),
     home as (select id, case when id = 'N000000000001' then 1.0 else 0.0 end::double as home from ids),
     k0 as (select id, home as r from home){steps}
     select id, round(r, 6) as score from k{rounds} where id <> 'N000000000001'"""


@query("pagerank", _pagerank_sql(30))
def _(spark, d):
    nodes = tables.business_nodes(spark, d).where("label in ('Nation', 'Region')")
    edges = tables.business_edges(spark, d).where("ty = 'in_region'")
    return graph.pagerank(nodes.select("id"), edges, [("N000000000001", 1.0)]).select("id", F.round("score", 6).alias("score"))


@query("reaches_command", """with recursive g as (select * from (values ('a','agent',1), ('b','command',0), ('c','gate',0), ('d','command',0)) t(id, kind, declares)),
  e as (select * from (values ('a','c'), ('c','d')) t(src, dst)),
  r(src, id) as (select id, id from g where kind = 'agent' and declares = 1 union select r.src, e.dst from r join e on e.src = r.id)
  select distinct r.src as agent, r.id as command from r join g on g.id = r.id where g.kind = 'command'""")
def _(spark, d):
    from strataloom.operators import workgraph

    g = workgraph.WorkGraph("g", [
        workgraph.Step("a", "agent", prompt="p", output={"type": "object"}), workgraph.Step("b", "command", run="x"),
        workgraph.Step("c", "gate", needs=("a",)), workgraph.Step("d", "command", needs=("c",), run="y")])
    return workgraph.unchecked_claims(spark, g, checked=True)


# ---------------------------------------------------------------- op log

_OPS_SQL = f"""ops as (select event_id + 1 as seq, (epoch_us(ts) // 1000) as ms, event_type as kind, {_key('U', 'user_id')} as uid,
    {_key('U', 'user_id + 1')} as vid, {_key('X', 'event_id')} as xid, round(value, 2) as v from events),
  gone as (select uid as id, max(seq) as removed from ops where kind = 'error' group by uid),
  born as (select uid as id, max(seq) as born from ops where kind = 'signup' group by uid),
  alive as (select b.id, b.born from born b left join gone g on g.id = b.id where removed is null or born > removed)"""


@query("fold_nodes", f"with {_OPS_SQL} select id, 'shared' as scope, 'User' as label from alive")
def _(spark, d):
    return fold.nodes(tables.event_ops(spark, d)).select("id", "scope", "label")


@query("fold_props", f"""with {_OPS_SQL}, w as (
    select uid as id, seq, 'joined' as k, cast(ms as varchar) as v from ops where kind = 'signup'
    union all select uid, seq, kind, cast(cast(round(v * 100) as bigint) as varchar) from ops where kind in ('click', 'view')
    union all select uid, seq, 'last', kind from ops where kind in ('click', 'view')
    union all select uid, seq, 'click', null from ops where kind = 'view'),
  ranked as (select w.*, row_number() over (partition by w.id, k order by seq desc) as n from w join alive a on a.id = w.id and seq >= born)
  select id, k, v from ranked where n = 1 and v is not null""")
def _(spark, d):
    x = F.col("v")
    text_ = F.when(x["t"] == "s", x["s"]).when(x["t"] == "i", x["i"].cast("string")).otherwise(F.round(x["f"] * 100).cast("long").cast("string"))
    return fold.nodes(tables.event_ops(spark, d)).select("id", F.explode("props").alias("k", "v")).select("id", "k", text_.alias("v"))


_FOLD_EDGES_SQL = f"""with {_OPS_SQL} select xid as id, o.uid as src, o.vid as dst, ms as valid_from from ops o
  left join gone g on g.id = o.uid left join gone h on h.id = o.vid
  where kind = 'purchase' and (g.removed is null or g.removed < seq) and (h.removed is null or h.removed < seq)"""


@query("fold_edges", _FOLD_EDGES_SQL)
def _(spark, d):
    return fold.edges(tables.event_ops(spark, d)).select("id", "src", "dst", "valid_from")


@query("remove_cascade", f"""with {_OPS_SQL} select count(*) as dropped from ops o left join gone g on g.id = o.uid left join gone h on h.id = o.vid
  where kind = 'purchase' and (g.removed > seq or h.removed > seq)""")
def _(spark, d):
    ops = tables.event_ops(spark, d)
    made = ops.where("op = 'CreateEdge'").select("id")
    return made.join(fold.edges(ops).select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))


@query("current_seq", "select cast(max(event_id) + 1 as bigint) as current_seq from events")
def _(spark, d):
    return fold.current_seq(tables.event_ops(spark, d))


@query("ops_since", "select event_id + 1 as seq, event_type as kind from events where event_id + 1 >= 500")
def _(spark, d):
    ops = fold.ops_since(tables.event_ops(spark, d), 500)
    kinds = F.create_map(*[F.lit(x) for p in (("CreateNode", "signup"), ("RemoveNode", "error"), ("CreateEdge", "purchase")) for x in p])
    return ops.select("seq", F.coalesce(kinds[F.col("op")], F.col("props")["last"]["s"]).alias("kind"))


@query("compacted_log", "select count(*) as n, min(event_id + 1) as first from events where event_id + 1 >= 300")
def _(spark, d):
    return fold.compacted(tables.event_ops(spark, d), 300).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


@query("state_supersede", """with s as (select user_id, event_type, ts, event_id, lag(event_type) over w as last from events
    window w as (partition by user_id order by ts, event_id)), f as (select * from s where last is null or last <> event_type)
  select user_id as src, event_type as dst, (epoch_us(ts) // 1000) as valid_from,
    (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) // 1000) as valid_to from f""")
def _(spark, d):
    e = tables.table(spark, d, "events").select(
        F.lit("shared").alias("scope"), F.col("user_id").alias("src"), F.lit("HAS_STATE").alias("ty"), F.col("event_type").alias("dst"),
        tables.ms("ts").alias("valid_from"), F.col("event_id").alias("seq"))
    return fold.superseded(e).select("src", "dst", "valid_from", "valid_to")


@query("state_as_of", """with s as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n
    from events where (epoch_us(ts) // 1000) <= 1705000000000) select user_id as src, event_type as dst from s where n = 1""")
def _(spark, d):
    from strataloom.model import live_at

    e = tables.table(spark, d, "events").select(
        F.lit("shared").alias("scope"), F.col("user_id").alias("src"), F.lit("HAS_STATE").alias("ty"), F.col("event_type").alias("dst"),
        tables.ms("ts").alias("valid_from"), F.col("event_id").alias("seq"))
    return fold.superseded(e).where(live_at(1705000000000)).select("src", "dst")


@query("vector_dim_pin", "select 'm64' as model, min(len(embedding)) as dim from embeddings")
def _(spark, d):
    e = tables.embeddings(spark, d)
    ops = e.select(F.lit("SetEmbedding").alias("op"), "model", "vector", F.substring("id", 2, 12).cast("long").alias("seq"))
    return fold.vector_dims(ops)


@query("embedding_backfill", f"select {_key('D', 'doc_id')} as id from documents where doc_id not in (select vec_id from embeddings)")
def _(spark, d):
    m, e = tables.memories(spark, d), tables.embeddings(spark, d)
    made = m.select("id", F.lit("CreateNode").alias("op"), "label", "props", F.lit(None).cast("string").alias("model"))
    done = e.select("id", F.lit("SetEmbedding").alias("op"), F.lit(None).cast("string").alias("label"),
                    F.lit(None).cast(m.schema["props"].dataType).alias("props"), "model")
    return fold.unembedded(made.unionByName(done), tables.MODEL, [("Memory", "content")])


@query("rejected_edges", f"""with {NODES_SQL}, e as (select 'C000000000001' as src, {_key('C', 'c_custkey')} as dst, 'shared' as scope from customer
    union all select {_key('C', 'c_custkey')}, 'Z0', c_mktsegment from customer where c_custkey <= 5
    union all select {_key('C', 'c_custkey')}, 'N000000000001', 'MACHINERY' from customer)
  select e.src, e.dst, e.scope, case when a.id is null or b.id is null then 'missing endpoint'
    when a.scope <> b.scope and a.scope <> 'shared' and b.scope <> 'shared' then 'cross scope' else 'edge scope' end as reason
  from e left join nodes a on a.id = e.src left join nodes b on b.id = e.dst
  where a.id is null or b.id is null or (a.scope <> b.scope and a.scope <> 'shared' and b.scope <> 'shared')
    or (e.scope <> 'shared' and e.scope <> case when a.scope <> 'shared' then a.scope when b.scope <> 'shared' then b.scope else e.scope end)""")
def _(spark, d):
    c = tables.table(spark, d, "customer")
    cid = tables.key_id("C", "c_custkey")
    e = c.select(F.lit("C000000000001").alias("src"), cid.alias("dst"), F.lit("shared").alias("scope")).union(
        c.where("c_custkey <= 5").select(cid, F.lit("Z0"), "c_mktsegment")).union(
        c.select(cid, F.lit("N000000000001"), F.lit("MACHINERY")))
    return fold.rejected_edges(e, tables.business_nodes(spark, d))


# ---------------------------------------------------------------- text

_TOKENS_SQL = f"""tok as (select source as scope, {_key('D', 'doc_id')} as id,
    unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text,
      '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as term from documents),
  tf as (select scope, id, term, count(*) as tf from tok group by all),
  docs as (select scope, id, sum(tf) as len from tf group by all),
  stats as (select scope, count(*) as n_docs, sum(len) as total_len from docs group by scope),
  dfs as (select scope, term, count(*) as df from tf group by all)"""
_TERMS = ("with", "der", "thing", "stion")
_BM25 = "ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total_len / n_docs)))"


_SAVED: dict[tuple[str, str], str] = {}


def _index(spark, d) -> text.TextIndex:
    """The saved text index of the documents, built when it is first asked for in this application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SAVED:
        path = f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
        text.save(text.build(tables.bodies(spark, d), stemming=False), path)
        _SAVED[key] = path
    return text.load(spark, _SAVED[key])


@query("term_freq", f"with {_TOKENS_SQL} select scope, id, term, tf from tf where term in ('with', 'und', 'les')")
def _(spark, d):
    tf = text.term_freqs(tables.bodies(spark, d), stemming=False)
    return tf.where(F.col("term").isin("with", "und", "les")).select("scope", "id", "term", F.col("tf").cast("long").alias("tf"))


@query("corpus_stats", f"with {_TOKENS_SQL} select scope, n_docs, cast(total_len as bigint) as total_len from stats")
def _(spark, d):
    return _index(spark, d).stats


@query("doc_freq", f"with {_TOKENS_SQL} select scope, term, df from dfs where df >= 3")
def _(spark, d):
    return text.doc_freq(_index(spark, d).postings).where("df >= 3")


@query("scope_vocabulary", f"with {_TOKENS_SQL} select distinct term from tf where scope = 'src3'")
def _(spark, d):
    return text.vocabulary(_index(spark, d).postings, "src3")


@query("bm25_topk", f"""with {_TOKENS_SQL} select id, round(sum({_BM25}), 6) as score from tf join docs using (scope, id)
  join stats using (scope) join dfs using (scope, term) where scope in ('src0','src1','src2') and term in ('with', 'that', 'ndre')
  group by id order by score desc, id limit 10""")
def _(spark, d):
    from strataloom.model import SearchOptions

    found = text.search(tables.memories(spark, d), _index(spark, d), SOURCES, "That with NDRE", 10, SearchOptions(fuzzy=False, stem=False))
    return found.select("id", F.round("score", 6).alias("score"))


@query("bm25_recency", f"""with {_TOKENS_SQL}, s as (select id, sum({_BM25}) as score from tf join docs using (scope, id) join stats using (scope)
    join dfs using (scope, term) where scope in ('src0','src1','src2') and term in ('the') group by id)
  select id, round(score * (0.7 + 0.3 * pow(2, -greatest({NOW} - ({tables.DOCUMENT_EPOCH_MS} + cast(substr(id, 2) as bigint) * 60000), 0) / 2592000000.0)), 6) as score
  from s order by score desc, id limit 10""")
def _(spark, d):
    index, docs = _index(spark, d), tables.memories(spark, d)
    weights = spark.createDataFrame([(s, "the", 1.0) for s in SOURCES.names()], "scope string, term string, weight double")
    found = text.score(index, weights).join(docs.select("id", "created_ms"), "id")
    found = found.select("id", (F.col("score") * scoring.recency(F.col("created_ms"), NOW, 0.3, 30 * 86_400_000.0)).alias("score"))
    return found.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("weighted_expansion", f"""with {_TOKENS_SQL}, w as (select * from (values ('with', 1.0), ('that', 0.6), ('from', 0.6)) t(term, weight))
  select id, round(sum(weight * {_BM25}), 6) as score from tf join w using (term) join docs using (scope, id) join stats using (scope)
  join dfs using (scope, term) where scope = 'src1' group by id order by score desc, id limit 20""")
def _(spark, d):
    from strataloom.model import SearchOptions

    found = text.search(tables.memories(spark, d), _index(spark, d), ScopeSet.of("src1"), "with", 20, SearchOptions(fuzzy=False, stem=False),
                        [("with", ["that from"])])
    return found.select("id", F.round("score", 6).alias("score"))


@query("fuzzy_terms", f"""with {_TOKENS_SQL}, q as (select unnest(['ther', 'inge', 'erstion', 'th']) as q), v as (select distinct scope, term from tf where scope in ('src0', 'src1')),
  c as (select scope, q, term, case when least(length(q), length(term)) >= 3 and (starts_with(q, term) or starts_with(term, q)) then 1
      when levenshtein(q, term) <= case when length(q) < 3 then 0 when length(q) < 6 then 1 else 2 end then levenshtein(q, term) end as rank
    from v, q where q <> term),
  n as (select *, row_number() over (partition by scope, q order by rank, term) as n from c where rank is not null)
  select scope, q, term, cast(rank as int) as rank from n where n <= 4""")
def _(spark, d):
    terms = _index(spark, d).postings.where(F.col("scope").isin("src0", "src1")).select("scope", "term").distinct()
    queries = spark.createDataFrame([("ther",), ("inge",), ("erstion",), ("th",)], "q string")
    return text.fuzzy_expansions(terms, queries).select("scope", "q", "term", F.col("rank").cast("int").alias("rank"))


@query("normal_forms", r"""select p_partkey as id, lower(trim(regexp_replace(' ' || p_name || '  x ', '\s+', ' ', 'g'))) as normal,
  regexp_replace(regexp_replace(lower('- ' || p_type || ' _'), '[\s_-]+', '_', 'g'), '^_|_$', '', 'g') as edge_type from part""")
def _(spark, d):
    p = tables.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), X.normalized(F.concat(F.lit(" "), "p_name", F.lit("  x "))).alias("normal"),
                    X.edge_type(F.concat(F.lit("- "), "p_type", F.lit(" _"))).alias("edge_type"))


@query("camel_split", r"""with w as (select unnest(['HTTPServer fooBar', 'getURLFor x2Y', 'plain words', 'ABCdef']) as s)
  select s, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x)), ' ') as tokens from w""")
def _(spark, d):
    s = spark.createDataFrame([("HTTPServer fooBar",), ("getURLFor x2Y",), ("plain words",), ("ABCdef",)], "s string")
    return s.select("s", F.array_join(X.analyzed(F.col("s"), stemming=False), " ").alias("tokens"))


# ---------------------------------------------------------------- vectors

_QV_SQL = "(select embedding from embeddings where vec_id = 7)"


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in tables.table(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]]


@query("vector_topk", f"""select {_key('D', 'vec_id')} as id, round(list_cosine_similarity(embedding::double[], {_QV_SQL}::double[]), 6) as score
  from embeddings join documents on doc_id = vec_id order by list_cosine_similarity(embedding::double[], {_QV_SQL}::double[]) desc, id limit 20""")
def _(spark, d):
    found = vector.search(tables.memories(spark, d), tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, _query_vector(spark, d), 20)
    return found.select("id", F.round("score", 6).alias("score"))


@query("vector_candidates", f"""select {_key('D', 'vec_id')} as id, round(list_cosine_similarity(embedding::double[], {_QV_SQL}::double[]), 6) as score
  from embeddings join documents on doc_id = vec_id where lang = 'fr' and list_cosine_similarity(embedding::double[], {_QV_SQL}::double[]) >= 0.05
  order by list_cosine_similarity(embedding::double[], {_QV_SQL}::double[]) desc, id limit 10""")
def _(spark, d):
    some = tables.memories(spark, d).where(F.col("props")["lang"]["s"] == "fr").select("id")
    found = vector.search(tables.memories(spark, d), tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, _query_vector(spark, d), 10, some, 0.05)
    return found.select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- fusion

_VEC_LEG = f"""vl as (select {_key('D', 'vec_id')} as id, row_number() over (order by list_cosine_similarity(embedding::double[], {_QV_SQL}::double[]) desc, vec_id) as rank
  from embeddings join documents on doc_id = vec_id qualify rank <= 30)"""
_TEXT_LEG = f"""{_TOKENS_SQL}, ts as (select id, sum({_BM25}) as score from tf join docs using (scope, id) join stats using (scope)
    join dfs using (scope, term) where term in ('with', 'that') group by id),
  tl as (select id, row_number() over (order by round(score, 9) desc, id) as rank from ts qualify rank <= 30)"""
_RRF_SQL = f"""with {_TEXT_LEG}, {_VEC_LEG},
  rrf as (select id, sum(p) as score from (select id, 1.0 / (60 + rank) as p from tl union all select id, 1.0 / (60 + rank) from vl) group by id)"""


def _legs(spark, d) -> DataFrame:
    index, docs = _index(spark, d), tables.memories(spark, d)
    weights = spark.createDataFrame([(s, t, 1.0) for s in ALL_SOURCES.names() for t in ("with", "that")], "scope string, term string, weight double")
    by_text = text.score(index, weights).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    by_vector = vector.search(docs, tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, _query_vector(spark, d), 30)
    return recall.fuse([(1.0, by_text), (1.0, by_vector)])


@query("rrf_fusion", _RRF_SQL + " select id, round(score, 9) as score from rrf")
def _(spark, d):
    return _legs(spark, d).select("id", F.round("score", 9).alias("score"))


def _adjust(spark, d, **options) -> DataFrame:
    q = RecallQuery(ALL_SOURCES, "", **options)
    out = recall.adjusted(_legs(spark, d), tables.memories(spark, d), fold.counters(tables.bumps(spark, d)), q, NOW)
    return out.select("id", F.round("score", 9).alias("score"))


@query("access_boost", _RRF_SQL + f""", c as (select {_key('D', 'user_id')} as id, count(*) as n from events where event_type = 'view' group by user_id)
  select id, round(score * (1 + 0.5 * ln(1 + coalesce(n, 0)) / (1 + ln(1 + coalesce(n, 0)))), 9) as score from rrf left join c using (id)""")
def _(spark, d):
    return _adjust(spark, d, access_weight=0.5)


@query("label_weighted", _RRF_SQL + " select id, round(score * 0.25, 9) as score from rrf")
def _(spark, d):
    return _adjust(spark, d, labels=["Memory", "Entity"], label_weights={"Entity": 0.5, "Memory": 0.25})


@query("tombstone_filter", _RRF_SQL + """ select id, round(score, 9) as score from rrf where cast(substr(id, 2) as bigint) % 3 <> 0""")
def _(spark, d):
    from strataloom.model import int_value

    dead = F.col("id").substr(2, 12).cast("long") % 3 == 0
    nodes = tables.memories(spark, d).withColumn("props", F.when(dead, F.map_concat("props", F.create_map(
        F.lit("superseded_at"), int_value(F.lit(NOW))))).otherwise(F.col("props")))
    q = RecallQuery(ALL_SOURCES, "", tombstone="superseded_at")
    return recall.adjusted(_legs(spark, d), nodes, None, q, NOW).select("id", F.round("score", 9).alias("score"))


def memory_edges(spark: SparkSession, d: str) -> DataFrame:
    """Memories of one source and language follow each other."""
    from pyspark.sql import Window

    m = tables.memories(spark, d)
    w = Window.partitionBy("scope", F.col("props")["lang"]["s"]).orderBy("id")
    return m.select(F.concat(F.lit("F"), "id").alias("id"), "scope", F.lit("follows").alias("ty"), F.col("id").alias("src"),
                    F.lag("id").over(w).alias("dst"), F.col("created_ms").alias("valid_from"),
                    F.lit(None).cast("long").alias("valid_to")).where("dst is not null")


_FOLLOWS_SQL = f"""mem as (select {_key('D', 'doc_id')} as id, source, lang from documents),
  follows as (select * from (select id as u, lag(id) over (partition by source, lang order by id) as v from mem) where v is not null),
  steps as (select u as near, v as far from follows union all select v, u from follows)"""


def _rank_sql(rounds: int, seeds: str, nodes: str, links: str) -> str:
    """Named steps of personalised PageRank: seeds (id, w) on the undirected simple graph of nodes (id) and
    links (u, v with u < v). The last step is k<rounds> (id, r)."""
    steps = "".join(f""", k{i} as materialized (select h.id, 0.15 * h.home + 0.85 * (coalesce(f.x, 0) + (select coalesce(sum(r), 0) from k{i - 1} join deg using (id) where d = 0) * h.home) as r
      from home h left join (select b.v as id, sum(k.r / deg.d) as x from both_ b join k{i - 1} k on k.id = b.u join deg on deg.id = b.u group by b.v) f on f.id = h.id)"""
                    for i in range(1, rounds + 1))
    return f"""both_ as materialized (select u, v from {links} union all select v, u from {links}),
      deg as materialized (select n.id, count(b.u) as d from {nodes} n left join both_ b on b.u = n.id group by n.id),
      home as materialized (select n.id, coalesce(s.w, 0.0) / (select sum(w) from {seeds} join {nodes} using (id)) as home from {nodes} n left join {seeds} s using (id)),
      k0 as (select id, home as r from home){steps}"""


def _leg_sql(name: str, scored: str, depth: int) -> str:
    return f"""{name} as materialized (select id, row_number() over (order by score desc, id) as rank from ({scored}) qualify rank <= {depth})"""


_COSINE = f"list_cosine_similarity(embedding::double[], {_QV_SQL}::double[])"
_RECALL_SQL = f"""with {_TOKENS_SQL}, {_FOLLOWS_SQL},
  {_leg_sql('tl', f"select id, sum({_BM25}) as score from tf join docs using (scope, id) join stats using (scope) join dfs using (scope, term) where term in ('that', 'with', 'the') group by id", 30)},
  {_leg_sql('vl', f"select {_key('D', 'vec_id')} as id, {_COSINE} as score from embeddings join documents on doc_id = vec_id", 30)},
  first as (select id, sum(1.0 / (60 + rank)) as w from (select * from tl union all select * from vl) group by id),
  seeds as materialized (select id, w from first order by w desc, id limit 5),
  ball as materialized (select id from seeds union select far from steps join seeds on near = id),
  links as materialized (select distinct least(u, v) as u, greatest(u, v) as v from follows where u in (select id from seeds) or v in (select id from seeds)),
  {_rank_sql(graph.ROUNDS, 'seeds', 'ball', 'links')},
  {_leg_sql('gl', f"select id, r::float::double as score from k{graph.ROUNDS} where id not in (select id from seeds)", 30)},
  fused as (select id, sum(w / (60 + rank)) as score from (select *, 1.0 as w from tl union all select *, 1.0 from vl union all select *, 0.5 from gl) group by id),
  seen as (select {_key('D', 'user_id')} as id, count(*) as n from events where event_type = 'view' group by user_id)
  select id, round(score * (1 + 0.3 * ln(1 + coalesce(n, 0)) / (1 + ln(1 + coalesce(n, 0)))), 6) as score from fused left join seen using (id)
  order by score * (1 + 0.3 * ln(1 + coalesce(n, 0)) / (1 + ln(1 + coalesce(n, 0)))) desc, id limit 10"""


@query("hybrid_recall", _RECALL_SQL)
def hybrid_recall(spark, d):
    """Text, vector and graph together, with access counts."""
    q = RecallQuery(ALL_SOURCES, "that with the", k=10, model=tables.MODEL, vector=_query_vector(spark, d), now_ms=NOW,
                    access_weight=0.3, labels=["Memory"], fuzzy=False, stem=False)
    found = recall.recall(tables.memories(spark, d), memory_edges(spark, d), tables.embeddings(spark, d), _index(spark, d), q,
                          fold.counters(tables.bumps(spark, d)))
    return found.select("id", F.round("score", 6).alias("score"))


_TARGET = "D000000000007"
_SUGGEST_SQL = f"""with {_FOLLOWS_SQL},
  h1 as (select '{_TARGET}' as id union select far from steps where near = '{_TARGET}'),
  h2 as materialized (select id from h1 union select far from steps join h1 on near = id),
  ball as materialized (select id from h2 union select far from steps join h2 on near = id),
  links as materialized (select distinct least(near, far) as u, greatest(near, far) as v from steps join h2 on near = id),
  seeds as (select '{_TARGET}' as id, 1.0 as w),
  {_rank_sql(graph.ROUNDS, 'seeds', 'ball', 'links')},
  own as (select far as id from steps where near = '{_TARGET}'),
  {_leg_sql('gl', f"select id, r::float::double as score from k{graph.ROUNDS} where id <> '{_TARGET}' and id not in (select id from own)", 30)},
  sim as (select {_key('D', 'vec_id')} as id, {_COSINE} as score from embeddings join documents on doc_id = vec_id where vec_id <> 7),
  {_leg_sql('vl', "select id, score from sim where id not in (select id from own)", 30)},
  fused as (select id, sum(1.0 / (60 + rank)) as score from (select * from gl union all select * from vl) group by id order by score desc, id limit 5),
  shared as (select s.near as id, count(distinct s.far) as common from steps s join own on own.id = s.far where s.near <> '{_TARGET}' group by s.near)
  select id, round(f.score, 6) as score, cast(coalesce(common, 0) as int) as common, round(s.score, 6) as similarity
  from fused f left join shared using (id) left join (select id, score from sim where id in (select id from vl)) s using (id)"""


@query("suggest_links", _SUGGEST_SQL)
def _(spark, d):
    found = graph.suggest_links(tables.memories(spark, d), memory_edges(spark, d), tables.embeddings(spark, d), ALL_SOURCES,
                                _TARGET, 5, NOW, tables.MODEL)
    return found.select("id", F.round("score", 6).alias("score"), F.size("common_neighbors").alias("common"), F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- hygiene


@query("dup_pairs_vector", f"""with m as (select {_key('D', 'vec_id')} as id, embedding::double[] as e from embeddings join documents on doc_id = vec_id)
  select a.id as a, b.id as b, round(list_cosine_similarity(a.e, b.e), 6) as similarity,
    case when list_cosine_similarity(a.e, b.e) >= 0.8 then 'likely' else 'possible' end as band
  from m a join m b on a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.4""")
def _(spark, d):
    found = hygiene.duplicate_pairs_by_vector(tables.memories(spark, d), tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, 0.4)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"), "band")


@query("dup_pairs_text", """with m as (select item_id as id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from benchmark
    union all select 1000000 + doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) from documents),
  t as (select id, unnest(w) as t from m),
  c as (select a.id as a, b.id as b, count(*) as n from t a join t b on a.t = b.t and a.id < b.id group by all),
  e as (select id, min(id) over () as first from m where len(w) = 0)
  select c.a, c.b, round(n / least(len(x.w), len(y.w))::double, 6) as similarity from c join m x on x.id = c.a join m y on y.id = c.b
  where n >= 0.7 * least(len(x.w), len(y.w)) union all select first, id, 1.0 from e where id <> first""")
def _(spark, d):
    m = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content")).union(
        tables.table(spark, d, "documents").select(F.col("doc_id") + 1000000, "text"))
    return hygiene.containment_pairs(m).select(F.col("u").alias("a"), F.col("v").alias("b"), F.round("score", 6).alias("similarity"))


@query("orphans", f"""with m as (select {_key('D', 'doc_id')} as id, source, lang, doc_id from documents)
  select id from (select id, lag(id) over (partition by source, lang order by id) as dst from m) where dst is null""")
def _(spark, d):
    return hygiene.orphans(tables.memories(spark, d), memory_edges(spark, d), ALL_SOURCES).select("id")


@query("stale", f"""with c as (select user_id, max((epoch_us(ts) // 1000)) as seen from events where event_type = 'view' group by user_id)
  select {_key('D', 'doc_id')} as id, greatest({tables.DOCUMENT_EPOCH_MS} + doc_id * 60000, coalesce(seen, 0)) as effective_ms
  from documents left join c on user_id = doc_id where 1706500000000 - greatest({tables.DOCUMENT_EPOCH_MS} + doc_id * 60000, coalesce(seen, 0)) >= 2592000000""")
def _(spark, d):
    made = F.lit(tables.DOCUMENT_EPOCH_MS) + F.col("id").substr(2, 12).cast("long") * 60_000
    return hygiene.stale(tables.memories(spark, d), fold.counters(tables.bumps(spark, d)), ALL_SOURCES, 1706500000000, 30.0, made)


@query("not_superseded", f"select {_key('D', 'doc_id')} as id from documents where doc_id % 4 <> 0")
def _(spark, d):
    from strataloom.model import int_value

    dead = F.col("id").substr(2, 12).cast("long") % 4 == 0
    nodes = tables.memories(spark, d).withColumn("props", F.when(dead, F.map_concat("props", F.create_map(
        F.lit("superseded_at"), int_value(F.lit(1))))).otherwise(F.col("props")))
    return nodes.where(not_superseded()).select("id")


@query("consolidate_edges", f"""with {EDGES_SQL}, o as (select {_key('C', 'min(c_custkey)')} as keep, {_key('C', 'max(c_custkey)')} as gone from customer),
  k as (select dst, ty from edges, o where src = keep and valid_to is null)
  select distinct e.dst, e.ty, e.scope from edges e, o where src = gone and valid_to is null and dst not in (keep, gone)
    and not exists (select 1 from k where k.dst = e.dst and k.ty = e.ty)""")
def _(spark, d):
    r = tables.table(spark, d, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return hygiene.inherited_edges(tables.business_edges(spark, d), f"C{r[0]:012d}", f"C{r[1]:012d}")


@query("dedup_content", """select min(doc_id) as keep, count(*) as copies from documents group by trim(regexp_replace(text, '\\s+', ' ', 'g')) having count(*) > 1""")
def _(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("content"))
    return docs.groupBy("content").agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("keep", "copies")


@query("resolve_alias", """select {0} as id from customer where c_custkey in (1, 2)""".format(_key("C", "c_custkey")))
def _(spark, d):
    c = tables.table(spark, d, "customer")
    from strataloom.model import string_value

    entity = c.select(tables.key_id("C", "c_custkey").alias("id"), F.lit("shared").alias("scope"), F.lit("Entity").alias("label"),
                      F.create_map(F.lit("name"), string_value(F.when(F.col("c_custkey") == 1, "Acme  Corp").otherwise(F.col("c_name")))).alias("props"))
    alias = c.select(tables.key_id("A", "c_custkey").alias("id"), F.lit("shared").alias("scope"), F.lit("Alias").alias("label"),
                     F.create_map(F.lit("name"), string_value(F.when(F.col("c_custkey").isin(2, 3), "ACME corp").otherwise(
                         F.concat(F.lit("alias of "), F.col("c_name"))))).alias("props"))
    edges = c.select(tables.key_id("L", "c_custkey").alias("id"), F.lit("shared").alias("scope"), F.lit("alias_of").alias("ty"),
                      tables.key_id("A", "c_custkey").alias("src"), tables.key_id("C", "c_custkey").alias("dst"), F.lit(0).cast("long").alias("valid_from"),
                      F.when(F.col("c_custkey") == 3, 5).cast("long").alias("valid_to"))
    return lookup.resolve_entities(entity.unionByName(alias), edges, ScopeSet(shared=True), " acme corp").select("id")


# ---------------------------------------------------------------- composed verbs


def _superseded_half(spark, d) -> DataFrame:
    """Memories of which every fourth is dated as superseded."""
    from strataloom.model import int_value

    dead = F.col("id").substr(2, 12).cast("long") % 4 == 0
    return tables.memories(spark, d).withColumn("props", F.when(dead, F.map_concat("props", F.create_map(
        F.lit("superseded_at"), int_value(F.lit(1))))).otherwise(F.col("props")))


@query("find_duplicates_newest", f"""with m as (select {_key('D', 'vec_id')} as id, embedding::double[] as e from embeddings join documents on doc_id = vec_id where doc_id % 4 <> 0)
  select a.id as a, b.id as b, round(list_cosine_similarity(a.e, b.e), 6) as similarity
  from m a join m b on a.id < b.id order by list_cosine_similarity(a.e, b.e) desc, a, b limit 25""")
def _(spark, d):
    """The report of likely duplicates: the most alike pairs of live memories."""
    found = hygiene.find_duplicates(_superseded_half(spark, d), tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, 0.2, 25)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("near_duplicates_vector", f"""select id, round(score, 6) as score from (select {_key('D', 'vec_id')} as id, doc_id, {_COSINE} as score
  from embeddings join documents on doc_id = vec_id order by score desc, id limit 3) where doc_id % 4 <> 0 and score >= 0.68""")
def _(spark, d):
    found = hygiene.near_duplicates(_superseded_half(spark, d), tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, _query_vector(spark, d))
    return found.select("id", F.round("score", 6).alias("score"))


@query("memory_health", f"""with m as (select {_key('D', 'doc_id')} as id, source, lang, doc_id from documents),
  f as (select id, lag(id) over (partition by source, lang order by id) as dst, doc_id from m),
  v as (select doc_id, embedding::double[] as e from embeddings join documents on doc_id = vec_id where doc_id % 4 <> 0),
  p as (select count(*) as n from v a join v b on a.doc_id < b.doc_id where list_cosine_similarity(a.e, b.e) >= 0.8),
  o as (select count(*) as n from f where dst is null and doc_id % 4 <> 0),
  c as (select user_id, max((epoch_us(ts) // 1000)) as seen from events where event_type = 'view' group by user_id),
  s as (select count(*) as n from documents left join c on user_id = doc_id where doc_id % 4 <> 0
        and 1706500000000 - greatest({tables.DOCUMENT_EPOCH_MS} + doc_id * 60000, coalesce(seen, 0)) >= 2592000000)
  select (select count(*) from documents where doc_id % 4 <> 0) as scanned, p.n as strong_pairs, o.n as orphans, s.n as stale,
    p.n + o.n + s.n > 0 as needs_attention from p, o, s""")
def _(spark, d):
    nodes, vectors = _superseded_half(spark, d), tables.embeddings(spark, d)
    made = F.lit(tables.DOCUMENT_EPOCH_MS) + F.col("id").substr(2, 12).cast("long") * 60_000
    pairs = hygiene.duplicate_pairs_by_vector(nodes, vectors, ALL_SOURCES, tables.MODEL, hygiene.LIKELY)
    out = hygiene.health(pairs, hygiene.orphans(nodes, memory_edges(spark, d), ALL_SOURCES),
                         hygiene.stale(nodes, fold.counters(tables.bumps(spark, d)), ALL_SOURCES, 1706500000000, 30.0, made),
                         hygiene.live_memories(nodes, ALL_SOURCES))
    strong = pairs.agg(F.count(F.lit(1)).alias("strong_pairs"))
    return out.crossJoin(strong).select("scanned", "strong_pairs", "orphans", "stale", "needs_attention")


@query("consolidation_plan", f"""with m as (select {_key('D', 'vec_id')} as id, embedding::double[] as e from embeddings join documents on doc_id = vec_id),
  p as (select a.id as a, b.id as b, list_cosine_similarity(a.e, b.e) as s from m a join m b on a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.4)
  select a as keep, b as "drop" from p qualify row_number() over (partition by b order by s desc, a) = 1""")
def _(spark, d):
    return hygiene.first_of_pairs(hygiene.duplicate_pairs_by_vector(tables.memories(spark, d), tables.embeddings(spark, d), ALL_SOURCES, tables.MODEL, 0.4))


@query("label_filter", _RRF_SQL + " select id, round(score, 9) as score from rrf where cast(substr(id, 2) as bigint) % 5 = 0")
def _(spark, d):
    """Rankings cut to a list of labels after fusion."""
    nodes = tables.memories(spark, d).withColumn("label", F.when(F.col("id").substr(2, 12).cast("long") % 5 == 0, "Entity").otherwise("Memory"))
    q = RecallQuery(ALL_SOURCES, "", labels=["Entity"])
    return recall.adjusted(_legs(spark, d), nodes, None, q, NOW).select("id", F.round("score", 9).alias("score"))


@query("close_edges", f"""with {_OPS_SQL}, e as ({_FOLD_EDGES_SQL.partition('select xid')[1]}{_FOLD_EDGES_SQL.partition('select xid')[2]})
  select id, valid_from, case when valid_from % 2 = 0 then valid_from + 1000 end as valid_to from e""")
def _(spark, d):
    """Half of the edges closed a second after they began."""
    ops = tables.event_ops(spark, d)
    last = 10**9
    closed = ops.where("op = 'CreateEdge' and valid_from % 2 = 0").withColumns({
        "seq": F.col("seq") + last, "op": F.lit("CloseEdge"), "valid_to": F.col("valid_from") + 1000, "valid_from": F.lit(None).cast("long"),
        **{c: F.lit(None).cast(ops.schema[c].dataType) for c in ("ty", "src", "dst", "props")}})
    return fold.edges(ops.unionByName(closed)).select("id", "valid_from", "valid_to")


@query("set_embeddings", f"""select {_key('D', 'vec_id')} as id, round(list_sum(embedding::double[]), 5) as total, len(embedding) as dim
  from embeddings where vec_id % 10 <> 3""")
def _(spark, d):
    """The vectors that a log of embeddings and removals folds to."""
    ops, e = tables.event_ops(spark, d), tables.embeddings(spark, d)
    number = F.col("id").substr(2, 12).cast("long")
    fill = lambda df, **given: df.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in ops.schema])
    same = {"batch_id": F.lit(0).cast("long"), "committed_ms": F.lit(0).cast("long"), "id": F.col("id")}
    made = fill(e, **same, seq=number + 1, op=F.lit("CreateNode"), scope=F.lit("shared"), label=F.lit("Memory"), props=F.create_map().cast(ops.schema["props"].dataType))
    put = fill(e, **same, seq=number + 10**7, op=F.lit("SetEmbedding"), model=F.col("model"), vector=F.col("vector").cast("array<float>"))
    gone = fill(e.where(number % 10 == 3), **same, seq=number + 10**8, op=F.lit("RemoveNode"))
    found = fold.vectors(made.unionByName(put).unionByName(gone))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("id", F.round(total, 5).alias("total"), F.size("vector").cast("long").alias("dim"))


@query("find_by_prop_aliased", f"""select {_key('C', 'c_custkey')} as id from customer where c_name = (select c_name from customer where c_custkey = 3) or c_custkey = 5""")
def _(spark, d):
    """Entities of a name, through an open alias too."""
    from strataloom.model import string_value

    c = tables.table(spark, d, "customer")
    wanted = c.where("c_custkey = 3").first()["c_name"]
    entity = c.select(tables.key_id("C", "c_custkey").alias("id"), F.lit("shared").alias("scope"), F.lit("Entity").alias("label"),
                      F.create_map(F.lit("name"), string_value(F.col("c_name"))).alias("props"))
    alias = c.where("c_custkey = 5").select(tables.key_id("A", "c_custkey").alias("id"), F.lit("shared").alias("scope"), F.lit("Alias").alias("label"),
                                            F.create_map(F.lit("name"), string_value(F.lit(f" {wanted.upper()} "))).alias("props"))
    edges = c.where("c_custkey = 5").select(tables.key_id("L", "c_custkey").alias("id"), F.lit("shared").alias("scope"), F.lit("alias_of").alias("ty"),
                                            tables.key_id("A", "c_custkey").alias("src"), tables.key_id("C", "c_custkey").alias("dst"),
                                            F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return lookup.resolve_entities(entity.unionByName(alias), edges, ScopeSet(shared=True), wanted).select("id")


# ---------------------------------------------------------------- episodes, work graphs

_USED_SQL = """m as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as w from benchmark),
  t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as w from documents)"""


@query("used_rule", f"with {_USED_SQL} select item_id, doc_id from m, t where len(m.w) > 0 and len(list_intersect(m.w, t.w)) >= 0.5 * len(m.w)")
def _(spark, d):
    from strataloom.operators import episodes

    memories = tables.table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("memory"))
    return episodes.used_pairs(memories, tables.table(spark, d, "documents").select("doc_id", "text"))


@query("episode_returns", """select conv_id, turn, row_number() over (partition by conv_id order by turn) as rank from conversations where role = 'assistant'""")
def _(spark, d):
    from strataloom.operators import episodes

    c = tables.table(spark, d, "conversations").where("role = 'assistant'")
    hits = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn"))).alias("hits"))
    return episodes.returned(hits, "conv_id").select("conv_id", F.col("hit.turn").alias("turn"), F.col("rank").cast("long").alias("rank"))


@query("artifact_hashes", "select page_id, sha256(html) as sha, case when url like '%.md' then 'prompt' else 'config' end as kind, octet_length(encode(html)) <= 65536 as inline from pages")
def _(spark, d):
    from strataloom.operators import episodes

    p = tables.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    return episodes.artifacts(p).select("page_id", "sha", "kind", F.col("inline").isNotNull().alias("inline"))


@query("policy_match", """with v as (select l_orderkey as version, list_sort(list(distinct l_partkey)) as parts from lineitem group by 1)
  select version from v where parts = (select parts from v order by version limit 1)""")
def _(spark, d):
    from strataloom.operators import episodes

    includes = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_partkey").cast("string").alias("sha"))
    first = includes.agg(F.min("version")).first()[0]
    wanted = [r.sha for r in includes.where(F.col("version") == first).select("sha").distinct().collect()]
    return episodes.matching_versions(includes, wanted)


@query("dag_bound", """select sum(case kind when 'agent' then 1 + retries + 2 * repairs else 0 end)::bigint as agent_calls,
  sum(case kind when 'command' then 1 + retries else 0 end)::bigint as command_runs
  from (select case o_orderpriority when '1-URGENT' then 'agent' when '2-HIGH' then 'command' else 'gate' end as kind,
        o_orderkey % 3 as retries, o_orderkey % 2 as repairs from orders)""")
def _(spark, d):
    from strataloom.operators import workgraph

    o = tables.table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "agent").when(F.col("o_orderpriority") == "2-HIGH", "command").otherwise("gate")
    return workgraph.bound(o.select(kind.alias("kind"), (F.col("o_orderkey") % 3).alias("retries"), (F.col("o_orderkey") % 2).alias("repairs")))


@query("run_report", """with s as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
  select event_type as state, count(*) as n, min(user_id) as first from s where n = 1 group by event_type""")
def _(spark, d):
    from strataloom.operators import workgraph

    e = tables.table(spark, d, "events").select(
        F.lit("shared").alias("scope"), F.col("user_id").alias("src"), F.lit("HAS_STATE").alias("ty"), F.col("event_type").alias("dst"),
        tables.ms("ts").alias("valid_from"), F.col("event_id").alias("seq"))
    return workgraph.run_report(fold.superseded(e))
