"""The batch language: a JSON array of commands, with `#N` for the id that command N made."""

from __future__ import annotations

from strataloom.functions.text import normalize_edge_type
from strataloom.model import CONTENT, ENTITY, MEMORY, NAME, SHARED, Rejected, new_id, ulid_value
from strataloom.sources import json_io as J


# ---------------------------------------------------------------- builders of commands


def _command(op: str, **parts) -> dict:
    return {"op": op, **{k: v for k, v in parts.items() if v is not None}}


def create_memory(content, props=None, scope=None):
    return _command("create_memory", content=content, props=props, scope=scope)


def create_entity(name, props=None, scope=None):
    return _command("create_entity", name=name, props=props, scope=scope)


def create_node(label, props=None, scope=None):
    return _command("create_node", label=label, props=props, scope=scope)


def link(src, dst, ty, props=None, scope=None, valid_from=None):
    return {**_command("link", type=ty, props=props, scope=scope, valid_from=valid_from), "from": src, "to": dst}


def set_node_props(node_id, props):
    return {"op": "set_node_props", "id": node_id, "props": props}


def remove_node(node_id):
    return _command("remove_node", id=node_id)


def close_edge(edge_id, valid_to=None):
    return _command("close_edge", id=edge_id, valid_to=valid_to)


def set_embedding(node_id, model, vector):
    return _command("set_embedding", id=node_id, model=model, vector=vector)


# ---------------------------------------------------------------- operations


def op(kind: str, **parts) -> dict:
    """An operation row without its number."""
    row = dict.fromkeys(("op", "id", "scope", "label", "ty", "src", "dst", "props", "del_keys", "model", "vector", "valid_from", "valid_to"))
    row.update(op=kind, **parts)
    return row


class _Compiler:
    def __init__(self, scope: str, now_ms: int | None):
        self.scope, self.now_ms = scope, now_ms
        self.made: list[tuple[str, str] | None] = []
        self.ops: list[dict] = []

    def fail(self, why: str):
        raise Rejected(f"command #{len(self.made)}: {why}")

    def text(self, c: dict, key: str) -> str:
        if not isinstance(c.get(key), str):
            self.fail(f"{key!r} must be text")
        return c[key]

    def time(self, c: dict, key: str) -> int | None:
        v = c.get(key)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int)):
            self.fail(f"{key!r} must be an integer")
        return v

    def scope_of(self, c: dict) -> str:
        s = c.get("scope")
        if s is None:
            return self.scope
        if not isinstance(s, str):
            self.fail("'scope' must be text")
        if s != SHARED:
            self.ids_only(s)
        return s

    def ids_only(self, s: str) -> str:
        try:
            ulid_value(s)
        except Rejected as e:
            self.fail(str(e))
        return s

    def ref(self, c: dict, key: str, kind: str) -> str:
        raw = self.text(c, key)
        if not raw.startswith("#"):
            return self.ids_only(raw)
        if not raw[1:].isdigit():
            self.fail(f"{raw!r} is no reference")
        n = int(raw[1:])
        if n >= len(self.made):
            self.fail(f"{raw} must be an earlier command")
        if self.made[n] is None:
            self.fail(f"{raw} made nothing")
        if self.made[n][1] != kind:
            self.fail(f"{raw} is a {self.made[n][1]}, not a {kind}")
        return self.made[n][0]

    def node(self, c: dict, label: str, props: dict) -> None:
        x = new_id(self.now_ms)
        self.ops.append(op("CreateNode", id=x, scope=self.scope_of(c), label=label, props=props))
        self.made.append((x, "node"))

    def run(self, c) -> None:
        if not isinstance(c, dict):
            self.fail("a command is an object")
        name = c.get("op")
        if name == "create_memory":
            self.node(c, MEMORY, J.merged_required(CONTENT, self.text(c, "content"), c.get("props")))
        elif name == "create_entity":
            self.node(c, ENTITY, J.merged_required(NAME, self.text(c, "name"), c.get("props")))
        elif name == "create_node":
            label = self.text(c, "label")
            if not label or label in (ENTITY, MEMORY):
                self.fail(f"label {label!r} is reserved or empty")
            self.node(c, label, J.props_from_json(c.get("props") or {}))
        elif name == "link":
            x = new_id(self.now_ms)
            self.ops.append(op("CreateEdge", id=x, scope=self.scope_of(c), ty=normalize_edge_type(self.text(c, "type")),
                               src=self.ref(c, "from", "node"), dst=self.ref(c, "to", "node"),
                               props=J.props_from_json(c.get("props") or {}), valid_from=self.time(c, "valid_from")))
            self.made.append((x, "edge"))
        else:
            self.change(c, name)
            self.made.append(None)

    def change(self, c: dict, name) -> None:
        if name == "set_node_props":
            if "props" not in c:
                self.fail("set_node_props needs 'props'")
            props, gone = J.changes_from_json(c["props"])
            self.ops.append(op("SetNodeProps", id=self.ref(c, "id", "node"), props=props, del_keys=gone))
        elif name == "remove_node":
            self.ops.append(op("RemoveNode", id=self.ref(c, "id", "node")))
        elif name == "close_edge":
            self.ops.append(op("CloseEdge", id=self.ref(c, "id", "edge"), valid_to=self.time(c, "valid_to")))
        elif name == "set_embedding":
            self.ops.append(op("SetEmbedding", id=self.ref(c, "id", "node"), model=self.text(c, "model"),
                               vector=J.vector_from_json(c.get("vector"))))
        else:
            self.fail(f"unknown op {name!r}")


def resolve(batch, scope: str = SHARED, now_ms: int | None = None) -> tuple[list[dict], list[str | None]]:
    """Operations of a batch and the id that each command made. Errors name the command."""
    if not isinstance(batch, list):
        raise Rejected("a batch is an array of commands")
    compiler = _Compiler(scope, now_ms)
    for c in batch:
        try:
            compiler.run(c)
        except Rejected as e:
            if str(e).startswith("command #"):
                raise
            raise Rejected(f"command #{len(compiler.made)}: {e}") from None
    return compiler.ops, [m[0] if m else None for m in compiler.made]
