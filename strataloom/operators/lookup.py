"""Scoped point lookups, scans and edge listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.model import ALIAS, ALIAS_OF, ENTITY, NAME, IndexSpec, Rejected, ScopeSet, is_open, live_at


def node(nodes: DataFrame, scopes: ScopeSet, node_id: str) -> DataFrame:
    return nodes.where(scopes.admits(F.col("scope")) & (F.col("id") == node_id))


def multi_get(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes whose id is in `ids` (id)."""
    return nodes.join(ids, "id", "left_semi")


def nodes_by_label(nodes: DataFrame, scopes: ScopeSet, label: str) -> DataFrame:
    """Shared nodes first, then scope by scope, by id."""
    found = nodes.where(scopes.admits(F.col("scope")) & (F.col("label") == label))
    return found.orderBy(F.col("scope") != "shared", "scope", "id")


def nodes_by_label_newest(nodes: DataFrame, scopes: ScopeSet, label: str, k: int) -> DataFrame:
    return nodes.where(scopes.admits(F.col("scope")) & (F.col("label") == label)).orderBy(F.desc("id")).limit(k)


def _declared(spec: IndexSpec | None, label: str, prop: str) -> None:
    if spec is not None and (label, prop) not in spec.equality:
        raise Rejected(f"({label}, {prop}) is not declared for equality")


def nodes_by_prop(nodes: DataFrame, scopes: ScopeSet, label: str, prop: str, value, spec: IndexSpec | None = None) -> DataFrame:
    """Nodes whose property equals `value` in type and value; floats are not looked up."""
    from strataloom.model import value as tagged

    _declared(spec, label, prop)
    want = tagged(value)
    if want["t"] == "f":
        raise Rejected("floats are not looked up by equality")
    arm = {"s": "s", "i": "i", "d": "i", "b": "b", "y": "y"}[want["t"]]
    v = F.col("props")[prop]
    return nodes.where(scopes.admits(F.col("scope")) & (F.col("label") == label) & (v["t"] == want["t"]) & (v[arm] == F.lit(want[arm])))


def nodes_by_prop_normalized(nodes: DataFrame, scopes: ScopeSet, label: str, prop: str, value, spec: IndexSpec | None = None) -> DataFrame:
    """As nodes_by_prop, with texts compared in normal form."""
    if not isinstance(value, str):
        return nodes_by_prop(nodes, scopes, label, prop, value, spec)
    _declared(spec, label, prop)
    v = F.col("props")[prop]
    return nodes.where(scopes.admits(F.col("scope")) & (F.col("label") == label) & (v["t"] == "s")
                       & (X.normalized(v["s"]) == X.normalize(value)))


def nodes_by_float_range(nodes: DataFrame, scopes: ScopeSet, label: str, prop: str, low: float, high: float) -> DataFrame:
    v = F.col("props")[prop]
    return nodes.where(scopes.admits(F.col("scope")) & (F.col("label") == label) & (v["t"] == "f") & v["f"].between(low, high))


def edges_from(edges: DataFrame, scopes: ScopeSet, src: str, dst: str | None = None, ty: str | None = None,
               open_only: bool = False) -> DataFrame:
    """Edges out of a node; only the edge's own scope counts."""
    return _listed(edges, scopes, "src", src, "dst", dst, ty, open_only)


def edges_to(edges: DataFrame, scopes: ScopeSet, dst: str, src: str | None = None, ty: str | None = None,
             open_only: bool = False) -> DataFrame:
    return _listed(edges, scopes, "dst", dst, "src", src, ty, open_only)


def _listed(edges, scopes, near, near_id, far, far_id, ty, open_only):
    found = edges.where(scopes.admits(F.col("scope")) & (F.col(near) == near_id))
    if far_id is not None:
        found = found.where(F.col(far) == far_id)
    if ty is not None:
        found = found.where(F.col("ty") == ty)
    if open_only:
        found = found.where(is_open())
    return found.orderBy("id")


def all_edges_between(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("id")


def open_edges_between(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return all_edges_between(edges, src, dst).where(is_open()).select("id")


def get_edges(edges: DataFrame, scopes: ScopeSet, node_id: str, direction: str = "both", ty: str | None = None,
              as_of: int | None = None, open_only: bool | None = None) -> DataFrame:
    """Edges of a node in a direction: open ones by default, or those live at `as_of`. A type is meant as
    given or in normal form."""
    if as_of is not None and open_only:
        raise Rejected("as_of and open_only exclude each other")
    if as_of is not None and as_of <= 0:
        raise Rejected("as_of must be positive")
    if direction not in ("out", "in", "both"):
        raise Rejected(f"unknown direction {direction!r}")
    ends = {"out": F.col("src") == node_id, "in": F.col("dst") == node_id,
            "both": (F.col("src") == node_id) | (F.col("dst") == node_id)}[direction]
    found = edges.where(scopes.admits(F.col("scope")) & ends)
    if ty is not None:
        found = found.where(F.col("ty").isin(ty, X.normalize_edge_type(ty)))
    if as_of is not None:
        found = found.where(live_at(as_of))
    elif open_only is None or open_only:
        found = found.where(is_open())
    return found.orderBy("id")


def access_stats(nodes: DataFrame, counters: DataFrame, scopes: ScopeSet, node_id: str | None = None) -> DataFrame:
    """Counts of the nodes in scope; zeros where nothing was counted."""
    seen = nodes.where(scopes.admits(F.col("scope"))).select("id")
    if node_id is not None:
        seen = seen.where(F.col("id") == node_id)
    return seen.join(counters, "id", "left").select(
        "id", F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
        F.coalesce("last_accessed_at", F.lit(0)).cast("long").alias("last_accessed_at"))


def resolve_entities(nodes: DataFrame, edges: DataFrame, scopes: ScopeSet, name: str) -> DataFrame:
    """Entities of a name in normal form, and those that an alias of the name points to by an open edge."""
    seen = nodes.where(scopes.admits(F.col("scope")))
    v = F.col("props")[NAME]
    named = seen.where((v["t"] == "s") & (X.normalized(v["s"]) == X.normalize(name)))
    direct = named.where(F.col("label") == ENTITY).select("id")
    aliases = named.where(F.col("label") == ALIAS).select(F.col("id").alias("src"))
    aimed = edges.where(scopes.admits(F.col("scope")) & (F.col("ty") == ALIAS_OF) & is_open()).join(aliases, "src", "left_semi")
    through = aimed.select(F.col("dst").alias("id")).join(seen.where(F.col("label") == ENTITY).select("id"), "id", "left_semi")
    return seen.join(direct.unionByName(through).distinct(), "id", "left_semi").orderBy("id")


def storage_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and approximate bytes (of their JSON form) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b")).agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("bytes"))
        out = row if out is None else out.unionByName(row)
    return out
