"""JSON in and out: property values, vectors, nodes, edges and subgraphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.model import DateTime, Rejected


def prop_from_json(v):
    """A property from a JSON scalar; arrays, objects, null and integers beyond 64 bits are rejected."""
    if isinstance(v, bool | str):
        return v
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise Rejected(f"integer out of range: {v}")
        return v
    if isinstance(v, float):
        if not math.isfinite(v):
            raise Rejected("a float must be finite")
        return v
    raise Rejected(f"a property must be a scalar, not {type(v).__name__}")


def props_from_json(obj) -> dict:
    if not isinstance(obj, dict):
        raise Rejected("props must be an object")
    return {str(k): prop_from_json(v) for k, v in obj.items()}


def changes_from_json(obj) -> tuple[dict, list[str]]:
    """Properties to write and keys to remove (those given as null)."""
    if not isinstance(obj, dict):
        raise Rejected("props must be an object")
    return ({k: prop_from_json(v) for k, v in obj.items() if v is not None}, sorted(k for k, v in obj.items() if v is None))


def vector_from_json(v) -> list[float]:
    if not isinstance(v, list) or not v:
        raise Rejected("a vector is a non-empty array of numbers")
    out = []
    for x in v:
        if isinstance(x, bool) or not isinstance(x, int | float) or not math.isfinite(x):
            raise Rejected("a vector holds finite numbers")
        out.append(float(x))
    return out


def prop_to_json(v):
    if isinstance(v, bytes | DateTime):
        raise Rejected(f"{type(v).__name__} has no JSON form")
    return v


def merged_required(key: str, value, extra: dict | None) -> dict:
    """Properties with a required one that the caller may not give as well."""
    props = props_from_json(extra or {})
    if key in props:
        raise Rejected(f"props must not hold {key!r}")
    return {key: value, **props}


def plain_props(props: Column) -> Column:
    """Tagged properties as a map of JSON text."""
    one = lambda v: F.when(v["t"] == "s", F.to_json(F.array(v["s"]))).when(v["t"] == "i", F.to_json(F.array(v["i"]))).when(
        v["t"] == "f", F.to_json(F.array(v["f"]))).when(v["t"] == "b", F.to_json(F.array(v["b"])))
    return F.transform_values(props, lambda k, v: F.regexp_replace(one(v), r"^\[|\]$", ""))


def _props_text(props: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(plain_props(props))), lambda e: F.concat(
        F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _joined(head: Column, *rest: tuple[str, Column]) -> Column:
    """An object's text with further members that are JSON text already."""
    out = F.regexp_replace(head, r"\}$", "")
    for name, text in rest:
        out = F.concat(out, F.lit(f',"{name}":'), text)
    return F.concat(out, F.lit("}"))


def nodes_to_json(nodes: DataFrame) -> DataFrame:
    """One column `json`: {id, scope, label, props}; embeddings are left out."""
    return nodes.select(_joined(F.to_json(F.struct("id", "scope", "label")), ("props", _props_text(F.col("props")))).alias("json"))


def edges_to_json(edges: DataFrame) -> DataFrame:
    """One column `json`: {id, scope, type, from, to, props, valid_from, valid_to}."""
    head = F.to_json(F.struct("id", "scope", F.col("ty").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to")))
    until = F.coalesce(F.col("valid_to").cast("string"), F.lit("null"))
    return edges.select(_joined(head, ("props", _props_text(F.col("props"))), ("valid_from", F.col("valid_from").cast("string")),
                                ("valid_to", until)).alias("json"))
