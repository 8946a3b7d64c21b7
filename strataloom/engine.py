"""The engine's front: one object over an op log, with every read, write and composed verb."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.model import (ABOUT, ALIAS, ALIAS_OF, CONTENT, CONTENT_HASH, DEFAULT_SPEC, ENTITY, EXPANSION, MEMORY, NAME, SHARED,
                              SUPERSEDED_AT, SYNONYM, TERM, IndexSpec, RecallQuery, Rejected, ScopeSet, SearchOptions, Subgraph,
                              is_open, new_id, not_superseded, plain, upgraded_spec)
from strataloom.operators import fold, graph, hygiene, lookup, recall, text, vector
from strataloom.sources import batch as B
from strataloom.sources import json_io as J
from strataloom.sources.oplog import OpLog


def _now(now_ms: int | None) -> int:
    return int(time.time() * 1000) if now_ms is None else now_ms


class MemoryGraph:
    """A temporal property graph over an op log.

    Tables are folds of the log as of the last write; point verbs plan on the driver over small lookups,
    all other reads return DataFrames. With `bump`, a read counts the nodes it returns."""

    def __init__(self, spark: SparkSession, path: str, spec: IndexSpec | None = DEFAULT_SPEC, stored: bool = False, stem: bool = True):
        self.spark, self.stem = spark, stem
        self.log = OpLog(spark, path, None if stored else spec, stored)

    # ---- opening

    @staticmethod
    def open(spark: SparkSession, path: str) -> "MemoryGraph":
        return MemoryGraph(spark, path, IndexSpec())

    @staticmethod
    def open_with(spark: SparkSession, path: str, spec: IndexSpec) -> "MemoryGraph":
        return MemoryGraph(spark, path, spec)

    @staticmethod
    def open_stored(spark: SparkSession, path: str, upgrade: bool = False) -> "MemoryGraph":
        found = MemoryGraph(spark, path, stored=True)
        wanted = upgraded_spec(found.index_spec())
        return MemoryGraph(spark, path, wanted) if upgrade and wanted != found.index_spec() else found

    def close(self) -> None:
        self.log.close()

    def index_spec(self) -> IndexSpec:
        return self.log.manifest.spec()

    def info(self) -> dict:
        m = self.log.manifest
        scopes = [r.scope for r in self.nodes().select("scope").distinct().orderBy("scope").collect()]
        return {"path": self.log.path, "current_seq": self.log.current_seq(), "floor": m.floor, "scopes": scopes,
                "equality": m.equality, "text": m.text, "embedder": "off"}

    # ---- tables

    def nodes(self) -> DataFrame:
        return fold.nodes(self.log.state_ops())

    def edges(self) -> DataFrame:
        return fold.edges(self.log.state_ops())

    def vectors(self) -> DataFrame:
        return fold.vectors(self.log.state_ops())

    def counters(self) -> DataFrame:
        return fold.counters(self.log.bumps())

    def text_index(self) -> text.TextIndex:
        docs = text.doc_text(self.nodes(), self.index_spec()).where("body is not null")
        return text.build(docs.select("scope", "id", "body"), self.stem)

    def rebuild_state(self) -> dict[str, DataFrame]:
        """State replayed from the log alone; refused once the log was compacted."""
        if self.log.manifest.compacted:
            raise Rejected("the log was compacted")
        ops = self.log.ops()
        return {"nodes": fold.nodes(ops), "edges": fold.edges(ops), "vectors": fold.vectors(ops)}

    def storage_report(self) -> DataFrame:
        return lookup.storage_report({"ops": self.log.ops(), "nodes": self.nodes(), "edges": self.edges(), "vectors": self.vectors()})

    def dump(self, name: str) -> DataFrame:
        """A whole table in order: nodes, edges, adjacency, postings, vectors, vector_dims, labels."""
        tables = {"nodes": (self.nodes, ["id"]), "edges": (self.edges, ["id"]), "vectors": (self.vectors, ["model", "id"]),
                  "vector_dims": (lambda: fold.vector_dims(self.log.state_ops()), ["model"]),
                  "adjacency": (lambda: graph.adjacency(self.edges()).select("near", "ty", "far", "id"), ["near", "ty", "far", "id"]),
                  "postings": (lambda: self.text_index().postings, ["scope", "term", "id"]),
                  "labels": (lambda: self.nodes().select("label", "scope", "id"), ["label", "scope", "id"])}
        make, order = tables[name]
        return make().orderBy(*order)

    # ---- log

    def submit(self, ops: list[dict], now_ms: int | None = None) -> tuple[int, int]:
        return self.log.submit(ops, now_ms)

    def submit_batch(self, commands: list[dict], scope: str = SHARED, now_ms: int | None = None) -> list[str | None]:
        ops, made = B.resolve(commands, scope, now_ms)
        self.log.submit(ops, now_ms)
        return made

    def ops_since(self, seq: int) -> DataFrame:
        return self.log.ops_since(seq)

    def current_seq(self) -> int:
        return self.log.current_seq()

    def compact_ops(self, keep_from: int) -> None:
        self.log.compact(keep_from)

    # ---- reads

    def _counted(self, found: DataFrame, bump: bool, now_ms: int | None) -> DataFrame:
        if bump:
            self.log.bump([r.id for r in found.select("id").collect()], _now(now_ms))
        return found

    def node(self, scopes: ScopeSet, node_id: str, bump: bool = False, now_ms: int | None = None) -> dict | None:
        row = self._counted(lookup.node(self.nodes(), scopes, node_id), bump, now_ms).first()
        return None if row is None else {"id": row.id, "scope": row.scope, "label": row.label,
                                         "props": {k: plain(v) for k, v in sorted(row.props.items())}}

    def nodes_by_label(self, scopes: ScopeSet, label: str, bump: bool = False) -> DataFrame:
        return self._counted(lookup.nodes_by_label(self.nodes(), scopes, label), bump, None)

    def nodes_by_label_newest(self, scopes: ScopeSet, label: str, k: int, bump: bool = False) -> DataFrame:
        return self._counted(lookup.nodes_by_label_newest(self.nodes(), scopes, label, k), bump, None)

    def recent_memories(self, scopes: ScopeSet, k: int = 8) -> DataFrame:
        if not 1 <= k <= 100:
            raise Rejected("k must be 1 to 100")
        return self.nodes_by_label_newest(scopes, MEMORY, k)

    def nodes_by_prop(self, scopes: ScopeSet, label: str, prop: str, value, bump: bool = False) -> DataFrame:
        return self._counted(lookup.nodes_by_prop(self.nodes(), scopes, label, prop, value, self.index_spec()), bump, None)

    def nodes_by_prop_normalized(self, scopes: ScopeSet, label: str, prop: str, value, bump: bool = False) -> DataFrame:
        return self._counted(lookup.nodes_by_prop_normalized(self.nodes(), scopes, label, prop, value, self.index_spec()), bump, None)

    def nodes_by_float_range(self, scopes: ScopeSet, label: str, prop: str, low: float, high: float) -> DataFrame:
        return lookup.nodes_by_float_range(self.nodes(), scopes, label, prop, low, high)

    def find_by_prop(self, scopes: ScopeSet, label: str, prop: str, value, exact: bool = False) -> DataFrame:
        """By exact or normal form; entities by name are found through their aliases too."""
        if exact:
            return self.nodes_by_prop(scopes, label, prop, value)
        if (label, prop) == (ENTITY, NAME):
            return lookup.resolve_entities(self.nodes(), self.edges(), scopes, value)
        return self.nodes_by_prop_normalized(scopes, label, prop, value)

    def edges_from(self, scopes: ScopeSet, src: str, dst=None, ty=None, open_only=False) -> DataFrame:
        return lookup.edges_from(self.edges(), scopes, src, dst, ty, open_only)

    def edges_to(self, scopes: ScopeSet, dst: str, src=None, ty=None, open_only=False) -> DataFrame:
        return lookup.edges_to(self.edges(), scopes, dst, src, ty, open_only)

    def all_edges_between(self, src: str, dst: str) -> DataFrame:
        return lookup.all_edges_between(self.edges(), src, dst)

    def open_edges_between(self, src: str, dst: str) -> DataFrame:
        return lookup.open_edges_between(self.edges(), src, dst)

    def get_edges(self, scopes: ScopeSet, node_id: str, **options) -> DataFrame:
        return lookup.get_edges(self.edges(), scopes, node_id, **options)

    def access_stats(self, scopes: ScopeSet, node_id: str) -> DataFrame:
        return lookup.access_stats(self.nodes(), self.counters(), scopes, node_id)

    def traverse(self, scopes: ScopeSet, seeds: list[str], max_hops: int = 2, edge_types: list[str] | None = None,
                 direction: str = "both", as_of: int | None = None, bump: bool = False) -> Subgraph:
        if edge_types is not None:  # a type is meant as given or in normal form
            edge_types = sorted({t for given in edge_types for t in (given, X.normalize_edge_type(given))})
        found = graph.traverse(self.nodes(), self.edges(), scopes, seeds, max_hops, _now(as_of), edge_types, direction)
        self._counted(found.nodes, bump, as_of)
        return found

    def search_text(self, scopes: ScopeSet, query: str, k: int = 10, options: SearchOptions | None = None) -> DataFrame:
        return text.search(self.nodes(), self.text_index(), scopes, query, k, options or SearchOptions(stem=self.stem))

    def search_vector(self, scopes: ScopeSet, model: str, query: list[float], k: int = 10, candidates: DataFrame | None = None) -> DataFrame:
        return vector.search(self.nodes(), self.vectors(), scopes, model, query, k, candidates)

    def recall(self, q: RecallQuery) -> DataFrame:
        return recall.recall(self.nodes(), self.edges(), self.vectors(), self.text_index(), q, self.counters())

    def search_memories(self, scopes: ScopeSet, query: str, k: int = 10, now_ms: int | None = None, model: str | None = None,
                        vector: list[float] | None = None) -> DataFrame:
        """Recall with the defaults of the front end: synonyms, recency, memories before entities, no
        superseded fact."""
        q = RecallQuery(scopes, query, k, model, vector, now_ms, recency_weight=0.3, labels=[MEMORY, ENTITY],
                        label_weights={ENTITY: 0.5}, tombstone=SUPERSEDED_AT, expansions=self._synonyms(scopes, query), stem=self.stem)
        return self.recall(q)

    def _synonyms(self, scopes: ScopeSet, query: str) -> list[tuple[str, list[str]]]:
        terms = sorted(set(X.analyze(query, self.stem)))
        held = self.nodes().where(scopes.admits(F.col("scope")) & (F.col("label") == SYNONYM)).select(
            F.col("props")[TERM]["s"].alias("t"), F.col("props")[EXPANSION]["s"].alias("e")).where(F.col("t").isin(terms) if terms else F.lit(False))
        found: dict[str, set[str]] = {}
        for r in held.collect():
            found.setdefault(r.t, set()).add(r.e)
        return [(t, sorted(es)[:4]) for t, es in sorted(found.items())]

    def suggest_links(self, scopes: ScopeSet, node_id: str, k: int = 5, as_of: int | None = None, model: str | None = None,
                      floor: float | None = None) -> DataFrame:
        return graph.suggest_links(self.nodes(), self.edges(), self.vectors(), scopes, node_id, k, _now(as_of), model, floor)

    # ---- hygiene

    def find_duplicate_memories(self, scopes: ScopeSet, model: str | None = None, least: float = hygiene.REVIEW, limit: int = 100) -> DataFrame:
        return hygiene.find_duplicates(self.nodes(), self.vectors(), scopes, model, least, limit)

    def find_orphan_memories(self, scopes: ScopeSet, limit: int = 100) -> DataFrame:
        if not 1 <= limit <= 1000:
            raise Rejected("the limit must be 1 to 1000")
        return hygiene.orphans(self.nodes(), self.edges(), scopes).limit(limit)

    def find_stale_memories(self, scopes: ScopeSet, days: float = 30.0, limit: int = 100, now_ms: int | None = None) -> DataFrame:
        if not 1 <= limit <= 1000:
            raise Rejected("the limit must be 1 to 1000")
        return hygiene.stale(self.nodes(), self.counters(), scopes, _now(now_ms), days).limit(limit)

    def memory_health(self, scopes: ScopeSet, model: str | None = None, now_ms: int | None = None) -> DataFrame:
        nodes = self.nodes()
        pairs = hygiene.find_duplicates(nodes, self.vectors(), scopes, model, hygiene.LIKELY, 1000)
        return hygiene.health(pairs, hygiene.orphans(nodes, self.edges(), scopes),
                              hygiene.stale(nodes, self.counters(), scopes, _now(now_ms)), hygiene.live_memories(nodes, scopes))

    def supersede(self, node_id: str, scopes: ScopeSet, now_ms: int) -> list[dict]:
        """Operations that date a memory as superseded and close its open edges; none if it was already."""
        row = lookup.node(self.nodes(), scopes, node_id).first()
        if row is None or row.label != MEMORY:
            raise Rejected(f"{node_id} is no memory of these scopes")
        if SUPERSEDED_AT in row.props:
            return []
        out = [B.op("SetNodeProps", id=node_id, props={SUPERSEDED_AT: now_ms}, del_keys=[])]
        for r in self.edges().where((F.col("src") == node_id) & is_open()).select("id").orderBy("id").collect():
            out.append(B.op("CloseEdge", id=r.id, valid_to=now_ms))
        return out

    def consolidate_memories(self, keep: str, drop: str, scopes: ScopeSet, now_ms: int | None = None) -> int:
        """`keep` takes over the open edges of `drop` that it lacks; `drop` is superseded. Edges taken."""
        now = _now(now_ms)
        if keep == drop or self.node(scopes, keep) is None:
            raise Rejected("two memories of these scopes are needed")
        taken = [B.op("CreateEdge", id=new_id(now), scope=r.scope, ty=r.ty, src=keep, dst=r.dst, props={}, valid_from=now)
                 for r in hygiene.inherited_edges(self.edges(), keep, drop).collect()]
        self.submit(taken + self.supersede(drop, scopes, now), now)
        return len(taken)

    # ---- composed verbs

    def existing_memory(self, scope: str, content: str) -> str | None:
        """The oldest live memory of the scope with this content in normal form."""
        seen = self.nodes().where((F.col("scope") == scope) & (F.col("label") == MEMORY) & not_superseded())
        same = seen.where((F.col("props")[CONTENT_HASH]["s"] == X.content_hash(content))
                          & (X.collapse(F.col("props")[CONTENT]["s"]) == X.normalize_content(content)))
        return same.agg(F.min("id")).first()[0]

    def existing_entity(self, scopes: ScopeSet, name: str) -> str | None:
        return lookup.resolve_entities(self.nodes(), self.edges(), scopes, name).agg(F.min("id")).first()[0]

    def _memory_op(self, content: str, scope: str, props: dict | None, now: int) -> dict:
        for key in (CONTENT_HASH, SUPERSEDED_AT):
            if key in (props or {}):
                raise Rejected(f"props must not hold {key!r}")
        merged = J.merged_required(CONTENT, content, props)
        return B.op("CreateNode", id=new_id(now), scope=scope, label=MEMORY, props={**merged, CONTENT_HASH: X.content_hash(content)})

    def create_memory(self, content: str, scope: str = SHARED, props: dict | None = None, now_ms: int | None = None) -> tuple[str, bool]:
        """(id, made): a memory of equal content is found again."""
        found = self.existing_memory(scope, content)
        if found:
            return found, False
        made = self._memory_op(content, scope, props, _now(now_ms))
        self.submit([made], now_ms)
        return made["id"], True

    def create_entity(self, name: str, scope: str = SHARED, props: dict | None = None, now_ms: int | None = None) -> tuple[str, bool]:
        """(id, made): an entity of the name is found again, and gets only properties it lacks."""
        if not name.strip():
            raise Rejected("an entity needs a name")
        scopes = ScopeSet(frozenset({scope} - {SHARED}), True)
        found = self.existing_entity(scopes, name)
        if found:
            held = self.node(scopes, found)["props"]
            fresh = {k: v for k, v in J.props_from_json(props or {}).items() if k not in held}
            if fresh:
                self.submit([B.op("SetNodeProps", id=found, props=fresh, del_keys=[])], now_ms)
            return found, False
        made = B.op("CreateNode", id=new_id(_now(now_ms)), scope=scope, label=ENTITY, props=J.merged_required(NAME, name, props))
        self.submit([made], now_ms)
        return made["id"], True

    def remember(self, content: str, entities: list[str], scope: str = SHARED, edge_type: str = ABOUT, props: dict | None = None,
                 supersedes: list[str] | None = None, now_ms: int | None = None) -> dict:
        """Store a fact about entities in one batch: the memory and the entities are found again or made,
        each entity is linked once, superseded facts are dated."""
        now, ty = _now(now_ms), X.normalize_edge_type(edge_type)
        names: dict[str, str] = {}
        for e in entities:
            if e.strip():
                names.setdefault(X.normalize(e), e)
        if not names:
            raise Rejected("at least one entity is needed")
        scopes = ScopeSet(frozenset({scope} - {SHARED}), True)
        memory = self.existing_memory(scope, content)
        if memory in (supersedes or []):
            memory = None
        ops, made = [], memory is None
        if made:
            first = self._memory_op(content, scope, props, now)
            memory = first["id"]
            ops.append(first)
        linked, entity_ids = set(), []
        if not made:
            linked = {r.dst for r in self.edges().where((F.col("src") == memory) & (F.col("ty") == ty) & is_open()).select("dst").collect()}
        for name in names.values():
            found = self.existing_entity(scopes, name)
            if found is None:
                o = B.op("CreateNode", id=new_id(now), scope=scope, label=ENTITY, props={NAME: name})
                ops.append(o)
                found = o["id"]
            if found not in entity_ids:
                entity_ids.append(found)
                if found not in linked:
                    ops.append(B.op("CreateEdge", id=new_id(now), scope=scope, ty=ty, src=memory, dst=found, props={}, valid_from=now))
        for old in supersedes or []:
            ops += self.supersede(old, scopes, now)
        if ops:
            self.submit(ops, now)
        return {"memory": memory, "created": made, "entities": entity_ids, "ops": len(ops)}

    def add_alias(self, entity: str, alias: str, scopes: ScopeSet, now_ms: int | None = None) -> bool:
        """Another name for an entity; False if it has it already."""
        row = self.node(scopes, entity)
        if row is None or row["label"] != ENTITY:
            raise Rejected(f"{entity} is no entity of these scopes")
        if not alias.strip():
            raise Rejected("an alias must not be empty")
        held = {r.id for r in lookup.resolve_entities(self.nodes(), self.edges(), scopes, alias).select("id").collect()}
        if held - {entity}:
            raise Rejected(f"{alias!r} names another entity")
        if held:
            return False
        now = _now(now_ms)
        x = new_id(now)
        self.submit([B.op("CreateNode", id=x, scope=row["scope"], label=ALIAS, props={NAME: alias}),
                     B.op("CreateEdge", id=new_id(now), scope=row["scope"], ty=ALIAS_OF, src=x, dst=entity, props={}, valid_from=now)], now)
        return True

    def add_synonym(self, term: str, expansion: str, scope: str = SHARED, both: bool = False, now_ms: int | None = None) -> int:
        """Search for `expansion` as well where `term` is asked for; pairs that were new."""
        pairs = [(term, expansion)] + ([(expansion, term)] if both else [])
        ops = []
        for a, b in pairs:
            tokens = X.analyze(a, self.stem)
            if not tokens or not b.strip():
                raise Rejected("a synonym needs two terms")
            if X.analyze(b, self.stem)[:1] == tokens[:1]:
                raise Rejected("a term is no synonym of itself")
            low = b.strip().lower()
            known = self.nodes().where((F.col("scope") == scope) & (F.col("label") == SYNONYM) & (F.col("props")[TERM]["s"] == tokens[0])
                                       & (F.col("props")[EXPANSION]["s"] == low))
            if known.isEmpty():
                ops.append(B.op("CreateNode", id=new_id(_now(now_ms)), scope=scope, label=SYNONYM, props={TERM: tokens[0], EXPANSION: low}))
        if ops:
            self.submit(ops, now_ms)
        return len(ops)

    def link(self, src: str, dst: str, ty: str, scope: str = SHARED, props: dict | None = None, supersede: bool = False,
             now_ms: int | None = None) -> tuple[str, bool]:
        """(id, made): an open edge of the same ends, type and scope is found again. With `supersede`, other
        open edges of the type from the source are closed in the same batch."""
        now, ty = _now(now_ms), X.normalize_edge_type(ty)
        mine = self.edges().where((F.col("src") == src) & (F.col("ty") == ty) & is_open()).select("id", "dst", "scope").orderBy("id").collect()
        same = [r.id for r in mine if r.dst == dst and r.scope == scope]
        ops = [B.op("CloseEdge", id=r.id, valid_to=now) for r in mine if supersede and r.dst != dst]
        edge = same[0] if same else new_id(now)
        if not same:
            ops.append(B.op("CreateEdge", id=edge, scope=scope, ty=ty, src=src, dst=dst, props=J.props_from_json(props or {}), valid_from=now))
        if ops:
            self.submit(ops, now)
        return edge, not same
