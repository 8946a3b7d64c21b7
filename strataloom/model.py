"""Data model: ids, scopes, property values, schemas, requests and errors."""

from __future__ import annotations

import hashlib
import math
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 1
SHARED = "shared"
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

# Labels, properties and edge types with a meaning to the composed verbs.
ENTITY, MEMORY, ALIAS, SYNONYM = "Entity", "Memory", "Alias", "Synonym"
NAME, CONTENT, TERM, EXPANSION = "name", "content", "term", "expansion"
CONTENT_HASH, SUPERSEDED_AT = "content_hash", "superseded_at"
ALIAS_OF, ABOUT = "alias_of", "about"


class StrataError(Exception):
    """Base of the engine's errors."""


class Rejected(StrataError):
    """The request is invalid; nothing was changed."""


class Compacted(StrataError):
    """The asked part of the op log is gone; `oldest` is the first sequence number left."""

    def __init__(self, oldest: int):
        super().__init__(f"op log starts at {oldest}")
        self.oldest = oldest


class UnsupportedFormat(StrataError):
    """The store was written by a newer version."""


class Busy(StrataError):
    """Another writer holds the store."""


class Closed(StrataError):
    """The store handle was closed."""


# ---------------------------------------------------------------- ids


def ulid_text(value: int) -> str:
    """A 128-bit number as 26 characters; text order is number order."""
    return "".join(ALPHABET[value >> shift & 31] for shift in range(125, -1, -5))


def ulid_value(text: str) -> int:
    if len(text) != 26 or text[0] > "7" or any(c not in ALPHABET for c in text.upper()):
        raise Rejected(f"not an id: {text!r}")
    value = 0
    for c in text.upper():
        value = value << 5 | ALPHABET.index(c)
    return value


def new_id(now_ms: int | None = None) -> str:
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    return ulid_text((ms & (1 << 48) - 1) << 80 | int.from_bytes(os.urandom(10), "big"))


def id_ms(text: str) -> int:
    """When an id was made."""
    return ulid_value(text) >> 80


def created_ms(column: Column) -> Column:
    """The same as an expression over ids."""
    digits = F.filter(F.split(F.substring(column, 1, 10), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda n, c: n * 32 + F.position(c, F.lit(ALPHABET)) - 1)


def scope_for_path(path: str) -> str:
    """The scope id of a directory: the first 16 bytes of its real path's SHA-256."""
    digest = hashlib.sha256(os.path.realpath(path).encode()).digest()
    return ulid_text(int.from_bytes(digest[:16], "big"))


# ---------------------------------------------------------------- scopes, specs


@dataclass(frozen=True)
class ScopeSet:
    """The scopes a read may see. An empty set sees nothing."""

    ids: frozenset[str] = frozenset()
    shared: bool = False

    @staticmethod
    def of(*ids: str, shared: bool = False) -> "ScopeSet":
        return ScopeSet(frozenset(ids), shared)

    def names(self) -> list[str]:
        return ([SHARED] if self.shared else []) + sorted(self.ids)

    def admits(self, scope: Column) -> Column:
        names = self.names()
        return scope.isin(names) if names else F.lit(False)


@dataclass(frozen=True)
class IndexSpec:
    """Declared (label, property) pairs for equality lookups and for text search."""

    equality: tuple[tuple[str, str], ...] = ()
    text: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        for name in ("equality", "text"):
            pairs = getattr(self, name)
            if len(set(pairs)) != len(pairs):
                raise Rejected(f"repeated pair in {name}")

    def canonical(self) -> "IndexSpec":
        return IndexSpec(tuple(sorted(self.equality)), tuple(sorted(self.text)))


DEFAULT_SPEC = IndexSpec(
    equality=((ENTITY, NAME), (ALIAS, NAME), (SYNONYM, TERM), (MEMORY, CONTENT_HASH)),
    text=((MEMORY, CONTENT), (ENTITY, NAME), (ALIAS, NAME)),
)
#: Earlier defaults, which a store may carry and which give way to the current one.
EARLIER_SPECS = (
    IndexSpec(((ENTITY, NAME),), ((MEMORY, CONTENT),)),
    IndexSpec(((ENTITY, NAME),), ((MEMORY, CONTENT), (ENTITY, NAME))),
)


def upgraded_spec(spec: IndexSpec) -> IndexSpec:
    """The current default for any earlier default; a spec of someone's own stays as it is."""
    return DEFAULT_SPEC if spec.canonical() in {s.canonical() for s in EARLIER_SPECS} else spec


def spec_decision(stored: IndexSpec | None, wanted: IndexSpec, stored_version: int, version: int) -> str:
    """What opening a store with `wanted` must do: 'create', 'keep' or 'reindex'."""
    if stored is None:
        return "create"
    return "keep" if stored.canonical() == wanted.canonical() and stored_version == version else "reindex"


# ---------------------------------------------------------------- properties

VALUE = T.StructType([
    T.StructField("t", T.StringType()), T.StructField("s", T.StringType()), T.StructField("i", T.LongType()),
    T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("y", T.BinaryType())])
PROPS = T.MapType(T.StringType(), VALUE)


@dataclass(frozen=True)
class DateTime:
    """Milliseconds since the epoch, told apart from an integer."""

    ms: int


def value(v) -> dict:
    """The tagged form of a Python value: str, bool, int, finite float, bytes or DateTime."""
    out = dict.fromkeys(("t", "s", "i", "f", "b", "y"))
    if isinstance(v, bool):
        out.update(t="b", b=v)
    elif isinstance(v, str):
        out.update(t="s", s=v)
    elif isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise Rejected(f"integer out of range: {v}")
        out.update(t="i", i=v)
    elif isinstance(v, float):
        if not math.isfinite(v):
            raise Rejected("a float must be finite")
        out.update(t="f", f=v)
    elif isinstance(v, bytes):
        out.update(t="y", y=v)
    elif isinstance(v, DateTime):
        out.update(t="d", i=v.ms)
    else:
        raise Rejected(f"not a property value: {type(v).__name__}")
    return out


def plain(v) -> object:
    """The Python value of a tagged one."""
    tag = v["t"]
    if tag == "d":
        return DateTime(v["i"])
    return v[tag]


def string_value(column: Column) -> Column:
    return F.struct(F.lit("s").alias("t"), column.cast("string").alias("s"), F.lit(None).cast("long").alias("i"),
                    F.lit(None).cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"),
                    F.lit(None).cast("binary").alias("y"))


def float_value(column: Column) -> Column:
    return F.struct(F.lit("f").alias("t"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("i"),
                    column.cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"),
                    F.lit(None).cast("binary").alias("y"))


def int_value(column: Column) -> Column:
    return F.struct(F.lit("i").alias("t"), F.lit(None).cast("string").alias("s"), column.cast("long").alias("i"),
                    F.lit(None).cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"),
                    F.lit(None).cast("binary").alias("y"))


def text_prop(prop: str, props: str = "props") -> Column:
    """A property if it is text, else null."""
    v = F.col(props)[prop]
    return F.when(v["t"] == "s", v["s"])


# ---------------------------------------------------------------- schemas

OPS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("committed_ms", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("id", T.StringType()), T.StructField("scope", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("ty", T.StringType()), T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()), T.StructField("props", PROPS), T.StructField("del_keys", T.ArrayType(T.StringType())),
    T.StructField("model", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("valid_from", T.LongType()), T.StructField("valid_to", T.LongType())])
NODES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("props", PROPS)])
EDGES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("ty", T.StringType()),
    T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("props", PROPS),
    T.StructField("valid_from", T.LongType()), T.StructField("valid_to", T.LongType())])
VECTORS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType()))])
BUMPS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("at", T.LongType())])


# ---------------------------------------------------------------- predicates


def live_at(t: int | Column) -> Column:
    """Half-open validity: from `valid_from` on, up to but without `valid_to`."""
    at = F.lit(t) if isinstance(t, int) else t
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def is_open() -> Column:
    return F.col("valid_to").isNull()


def of_types(types: list[str] | None) -> Column:
    """None admits all edge types, an empty list none."""
    if types is None:
        return F.lit(True)
    return F.col("ty").isin(types) if types else F.lit(False)


def not_superseded() -> Column:
    return ~F.coalesce(F.map_contains_key("props", F.lit(SUPERSEDED_AT)), F.lit(False))


def not_tombstoned(prop: str, now_ms: int) -> Column:
    """A node whose integer property is at or before `now_ms` is gone; other types of value keep it."""
    v = F.col("props")[prop]
    return ~F.coalesce((v["t"] == "i") & (v["i"] <= now_ms), F.lit(False))


@dataclass(frozen=True)
class Subgraph:
    nodes: object
    edges: object


@dataclass
class SearchOptions:
    """Options of text search."""

    fuzzy: bool = True
    recency_weight: float = 0.0
    half_life_ms: float = 30 * 86_400_000.0
    now_ms: int | None = None
    stem: bool = True


@dataclass
class RecallQuery:
    """A hybrid recall request."""

    scopes: ScopeSet
    text: str
    k: int = 10
    model: str | None = None
    vector: list[float] | None = None
    now_ms: int | None = None
    recency_weight: float = 0.0
    half_life_ms: float = 30 * 86_400_000.0
    text_weight: float = 1.0
    vector_weight: float = 1.0
    graph_weight: float = 0.5
    access_weight: float = 0.0
    labels: list[str] | None = None
    label_weights: dict[str, float] = field(default_factory=dict)
    tombstone: str | None = None
    expansions: list[tuple[str, list[str]]] = field(default_factory=list)
    fuzzy: bool = True
    stem: bool = True
