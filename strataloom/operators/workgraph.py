"""Work graphs: validation, order, cost bound, run state as superseding edges, and a deterministic
executor with injected outcomes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.model import Rejected

# Kinds of steps, and states of a step in a run.
KINDS = ("agent", "command", "gate")
STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "RETRYING", "REPAIRING", "SKIPPED", "BLOCKED")


@dataclass(frozen=True)
class Step:
    id: str
    kind: str
    needs: tuple[str, ...] = ()
    prompt: str | None = None
    run: str | None = None
    output: dict | None = None
    retries: int = 0
    repairs: int = 0


@dataclass(frozen=True)
class WorkGraph:
    goal: str
    steps: list[Step]
    version: int = 1


def from_yaml(source: str) -> WorkGraph:
    """A graph from its YAML text."""
    import yaml

    raw = yaml.safe_load(source)
    steps = []
    for n in raw.get("nodes", []):
        budget, output = n.get("budget") or {}, n.get("output") or {}
        steps.append(Step(str(n["id"]), n["kind"], tuple(n.get("needs") or ()), n.get("prompt"), n.get("run"),
                          output.get("schema"), int(budget.get("retries", 0)), int(budget.get("repairs", 0))))
    return WorkGraph(raw.get("goal", ""), steps, int(raw.get("version", 1)))


def order(graph: WorkGraph) -> list[str]:
    """A topological order; steps that are free at once come in the order of declaration."""
    needs = {s.id: set(s.needs) for s in graph.steps}
    done: list[str] = []
    ready = [s.id for s in graph.steps if not needs[s.id]]
    while ready:
        here = ready.pop(0)
        done.append(here)
        for s in graph.steps:
            if here in needs[s.id]:
                needs[s.id].discard(here)
                if not needs[s.id]:
                    ready.append(s.id)
    if len(done) < len(graph.steps):
        raise Rejected("the graph has a cycle")
    return done


def descendants(graph: WorkGraph, start: str) -> set[str]:
    after: dict[str, list[str]] = {}
    for s in graph.steps:
        for n in s.needs:
            after.setdefault(n, []).append(s.id)
    seen, todo = set(), [start]
    while todo:
        for x in after.get(todo.pop(), []):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def validate(graph: WorkGraph) -> list[str]:
    """All faults of a graph, in one list; none means it can run."""
    faults, ids = [], [s.id for s in graph.steps]
    faults += [f"duplicate id {x}" for x in dict.fromkeys(ids) if ids.count(x) > 1]
    by_id = {s.id: s for s in graph.steps}
    for s in graph.steps:
        if s.kind not in KINDS:
            faults.append(f"{s.id}: unknown kind {s.kind}")
        if s.kind == "agent" and not (s.prompt or "").strip():
            faults.append(f"{s.id}: an agent needs a prompt")
        if s.kind == "command" and not (s.run or "").strip():
            faults.append(f"{s.id}: a command needs a line to run")
        faults += [f"{s.id}: needs unknown step {n}" for n in s.needs if n not in by_id]
        if s.output is not None and not isinstance(s.output, dict):
            faults.append(f"{s.id}: the output schema is not a mapping")
    if not faults:
        for s in graph.steps:
            if s.kind == "agent" and s.output is not None and not any(by_id[x].kind == "command" for x in descendants(graph, s.id)):
                faults.append(f"{s.id}: no command checks its output")
        try:
            order(graph)
        except Rejected as e:
            faults.append(str(e))
    return faults


def frames(spark: SparkSession, graph: WorkGraph) -> tuple[DataFrame, DataFrame]:
    """(steps, needs) as tables."""
    steps = spark.createDataFrame(
        [(s.id, s.kind, s.output is not None, s.retries, s.repairs, i) for i, s in enumerate(graph.steps)],
        "id string, kind string, declares boolean, retries long, repairs long, at int")
    needs = spark.createDataFrame([(n, s.id) for s in graph.steps for n in dict.fromkeys(s.needs)], "src string, dst string")
    return steps, needs


def reachable(needs: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(src, id) of all pairs where `id` is after `src` within `hops` steps."""
    out = state = start.select(F.col("id").alias("src"), "id")
    for _ in range(hops):
        state = state.join(needs.select(F.col("src").alias("id"), "dst"), "id").select("src", F.col("dst").alias("id")).distinct()
        out = out.unionByName(state)
    return out.distinct()


def unchecked_claims(spark: SparkSession, graph: WorkGraph, checked: bool = False) -> DataFrame:
    """Agents that declare an output which no command after them checks; or, with `checked`, pairs of such
    an agent and a command after it."""
    steps, needs = frames(spark, graph)
    agents = steps.where("kind = 'agent' and declares").select("id")
    found = reachable(needs, agents, len(graph.steps)).join(steps.where("kind = 'command'").select("id"), "id").select(
        F.col("src").alias("agent"), F.col("id").alias("command"))
    return found if checked else agents.withColumnRenamed("id", "agent").join(found, "agent", "left_anti")


def bound(steps: DataFrame) -> DataFrame:
    """The most model calls and command runs before a graph halts."""
    agent = F.when(F.col("kind") == "agent", 1 + F.col("retries") + 2 * F.col("repairs")).otherwise(0)
    command = F.when(F.col("kind") == "command", 1 + F.col("retries")).otherwise(0)
    return steps.agg(F.sum(agent).cast("long").alias("agent_calls"), F.sum(command).cast("long").alias("command_runs"))


def same_contract(a: Step, b: Step) -> bool:
    """Whether a repaired step keeps what others rely on: all but its prompt."""
    return (a.id, a.kind, a.needs, a.output, a.retries, a.repairs, a.run) == (b.id, b.kind, b.needs, b.output, b.retries, b.repairs, b.run)


def run_report(states: DataFrame) -> DataFrame:
    """Steps by their current state: (state, n, first)."""
    return states.where("valid_to is null").groupBy(F.col("dst").alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.min("src").alias("first"))


# ---------------------------------------------------------------- execution with injected outcomes

#: What a step does: (step, attempt) -> (succeeded, output or failure text).
Runner = Callable[[Step, int], tuple[bool, object]]
Repairer = Callable[[Step, str], Step | None]


@dataclass
class Run:
    """History of a run: state changes by a logical clock, attempts, outputs, repairs."""

    states: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    attempts: dict[str, list[tuple[int, bool]]] = field(default_factory=dict)
    outputs: dict[str, object] = field(default_factory=dict)
    revisions: dict[str, list[Step]] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    clock: int = 0

    def enter(self, step: str, state: str) -> None:
        self.clock += 1
        self.states.setdefault(step, []).append((self.clock, state))

    def state(self, step: str, at: int | None = None) -> str | None:
        found = [s for t, s in self.states.get(step, []) if at is None or t <= at]
        return found[-1] if found else None

    def edges(self, scope: str = "shared") -> list[tuple]:
        """HAS_STATE edges (scope, src, ty, dst, valid_from, seq) for the superseding fold."""
        return [(scope, step, "HAS_STATE", s, t, t) for step, h in self.states.items() for t, s in h]


def execute(graph: WorkGraph, runner: Runner, repairer: Repairer | None = None) -> Run:
    """One pass in topological order: a step whose needs did not all complete is skipped, a gate blocks for
    a decision, others run, are retried, then repaired, and block when nothing is left."""
    faults = validate(graph)
    if faults:
        raise Rejected("; ".join(faults))
    run, by_id = Run(), {s.id: s for s in graph.steps}
    for s in graph.steps:
        run.enter(s.id, "PENDING")
    for x in order(graph):
        step = by_id[x]
        if any(run.state(n) != "COMPLETED" for n in step.needs):
            run.enter(x, "SKIPPED")
        elif step.kind == "gate":
            run.enter(x, "BLOCKED")
        else:
            _run_step(run, step, runner, repairer)
    return run


def _run_step(run: Run, step: Step, runner: Runner, repairer: Repairer | None) -> None:
    x, attempt, repairs = step.id, 0, 0
    run.enter(x, "RUNNING")
    while True:
        for left in range(step.retries, -1, -1) if not repairs else (0,):
            attempt += 1
            done, result = runner(step, attempt)
            run.attempts.setdefault(x, []).append((attempt, done))
            if done:
                run.outputs[x] = result
                run.enter(x, "COMPLETED")
                return
            run.failures[x] = str(result)
            if left:
                run.enter(x, "RETRYING")
        if repairer is None or step.kind != "agent" or repairs >= step.repairs:
            break
        repairs += 1
        run.enter(x, "REPAIRING")
        changed = repairer(step, run.failures[x])
        if changed is None or not same_contract(step, changed):
            break
        run.revisions.setdefault(x, []).append(changed)
        step = changed
    run.enter(x, "BLOCKED")


def failure_context(graph: WorkGraph, run: Run) -> list[dict]:
    """Blocked steps that are no gates: their attempts and the first 200 characters of the failure."""
    return [{"id": s.id, "attempts": len(run.attempts.get(s.id, [])), "failure": run.failures.get(s.id, "")[:200]}
            for s in graph.steps if run.state(s.id) == "BLOCKED" and s.kind != "gate"]


def replan_goal(graph: WorkGraph, run: Run) -> str:
    """A goal for a follow-up plan: the old one, with what failed."""
    parts = [f"{c['id']} failed after {c['attempts']} attempts: {c['failure']}" for c in failure_context(graph, run)]
    return graph.goal + ("\n" + "\n".join(parts) if parts else "")
