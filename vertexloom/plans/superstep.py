"""The message-passing primitive: vertex programs as loops of declarative supersteps.

A superstep is one plan: active vertices join the edges, messages are combined by
target, and vertex state is updated by column expressions.  The driver only
evaluates the stop test.  State is written between supersteps (``Scratch``), so a
lost executor repeats one superstep at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.plans.runtime import Adjacency, Scratch, buckets, in_place


@dataclass
class Step:
    """What a hook sees after each superstep."""

    number: int
    aggregates: dict[str, object]
    messages: int
    changed: int
    seconds: float
    #: Messages by worker, where a run counts them.
    workers: tuple[int, ...] = ()
    #: Running values over all supersteps so far, by name.
    running: dict[str, object] = field(default_factory=dict)


class Globals:
    """Named values that the driver's program and its hooks share between supersteps."""

    def __init__(self, **values: object):
        self._values = dict(values)

    def put(self, name: str, value: object) -> None:
        self._values[name] = value

    def put_or_update(self, name: str, value: object, merge: Callable[[object, object], object]) -> None:
        """The value itself where the name is new, else what ``merge`` makes of the old one and it."""
        self._values[name] = merge(self._values[name], value) if name in self._values else value

    def get(self, name: str, default: object = None) -> object:
        return self._values.get(name, default)

    def clear(self, *names: str) -> None:
        """Forget the names, or all without any."""
        for name in names or list(self._values):
            self._values.pop(name, None)


@dataclass
class Run:
    """A finished run: final vertices, one Step for each superstep, and why it stopped."""

    vertices: DataFrame
    steps: list[Step] = field(default_factory=list)
    reason: str = ""

    def report(self, spark) -> DataFrame:
        """Message accounting: (superstep, messages, changed, seconds)."""
        rows = [(s.number, s.messages, s.changed, float(s.seconds)) for s in self.steps]
        return spark.createDataFrame(rows, "superstep int, messages long, changed long, seconds double")

    def worker_report(self, spark) -> DataFrame:
        """(superstep, worker, messages): what the vertices of each worker received, for runs with ``workers``."""
        rows = [(s.number, w, n) for s in self.steps for w, n in enumerate(s.workers)]
        return spark.createDataFrame(rows, "superstep int, worker int, messages long")


def messages_to(state: DataFrame, edges: DataFrame, message: Mapping[str, Column], direction: str = "out") -> DataFrame:
    """One message for each edge of the given vertices: (id, message columns).

    ``state`` is aliased ``v`` and ``edges`` ``e`` in message expressions.
    ``direction`` is ``out`` (to ``dst``), ``in`` (to ``src``) or ``both``.
    """
    parts = []
    for here, there in (("src", "dst"), ("dst", "src")):
        if direction == "both" or direction == ("out" if here == "src" else "in"):
            sent = state.alias("v").join(edges.alias("e"), F.col("v.id") == F.col(f"e.{here}"))
            parts.append(sent.select(F.col(f"e.{there}").alias("id"), *(m.alias(k) for k, m in message.items())))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def aggregate_messages(state: DataFrame, edges: DataFrame, message: Mapping[str, Column], combine: Mapping[str, Column], direction: str = "out") -> DataFrame:
    """Messages combined by target: a partial aggregate before the shuffle is the sender-side combiner."""
    return messages_to(state, edges, message, direction).groupBy("id").agg(*(c.alias(k) for k, c in combine.items()))


def point_messages(state: DataFrame, target: Column, message: Mapping[str, Column], known: DataFrame | None = None) -> DataFrame:
    """Messages to arbitrary ids; null targets send nothing, and with ``known`` unknown targets receive nothing."""
    out = state.select(target.alias("id"), *(m.alias(k) for k, m in message.items())).where("id is not null")
    return out if known is None else out.join(known.select("id"), "id", "left_semi")


def request(state: DataFrame, target: str, respond: Mapping[str, Column], from_state: DataFrame | None = None, safe: bool = True) -> DataFrame:
    """``state`` with values pulled from the vertices that its column ``target`` names.

    ``respond`` is evaluated once for each vertex.  ``safe`` gives nulls where the
    target does not exist; otherwise such rows are dropped.
    """
    source = (from_state if from_state is not None else state).select(F.col("id").alias("_to"), *(r.alias(k) for k, r in respond.items()))
    return state.join(source, state[target] == source["_to"], "left" if safe else "inner").drop("_to")


def explicit_respond(state: DataFrame, target: Column, value: Column, sender: Column | None = None, order: Column | None = None) -> DataFrame:
    """Values pushed without a request: (id, sender, value), of each sender to a target the first one by ``order`` (the smallest value without)."""
    sent = state.select(target.alias("id"), (F.col("id") if sender is None else sender).alias("sender"), value.alias("value"), (value if order is None else order).alias("_o")).where("id is not null")
    return sent.groupBy("id", "sender").agg(F.min_by("value", F.struct("_o", "value")).alias("value"))


def relay(state: DataFrame, edges: DataFrame, field_: Column, on_edge: Callable[[Column], Column], combine: Callable[[Column], Column]) -> DataFrame:
    """One value for each vertex, changed by every edge it crosses and combined at the target: (id, value)."""
    return aggregate_messages(state, edges, {"m": on_edge(field_)}, {"value": combine(F.col("m"))})


def global_aggregates(vertices: DataFrame, aggregates: Mapping[str, Column]) -> dict[str, object]:
    """Named values over all vertices, as driver scalars for the next superstep."""
    return vertices.agg(*(a.alias(k) for k, a in aggregates.items())).first().asDict() if aggregates else {}


def pregel(
    graph: Graph,
    init: Mapping[str, Column],
    message: Mapping[str, Column],
    combine: Mapping[str, Column],
    update: Mapping[str, Column],
    active: Column,
    *,
    start: Column | None = None,
    send_if: Column | None = None,
    direction: str = "out",
    all_compute: bool = False,
    aggregates: Mapping[str, Column] | None = None,
    stop: Callable[[Step], bool] | None = None,
    hook: Callable[[Step], None] | None = None,
    max_iter: int = 100,
    scratch: Scratch | None = None,
    workers: int = 0,
    running: Mapping[str, Callable[[object, Step], object]] | None = None,
) -> Run:
    """Run a vertex program to quiescence, a stop test or ``max_iter``.

    ``init`` gives each vertex its state, ``start`` who is active at first (all by
    default).  In a superstep active vertices send ``message`` (over ``v`` and
    ``e``) along their edges where ``send_if`` holds; targets combine them by
    ``combine``, and ``update`` makes the new state from the old columns and the
    combined ones (null without mail).  Vertices without mail keep their state
    unless ``all_compute``.  ``active`` is evaluated over new state, with old
    columns as ``old_<name>`` and combined ones by name.  ``aggregates`` are global
    values given to ``stop`` and ``hook``; ``running`` ones are folded on the driver
    from the value so far (None at first) and the finished step.  With ``workers``
    each step counts the messages received by id modulo so many.
    """
    scratch = scratch or Scratch(graph.spark, "pregel")
    # edges are laid out once by the end that sends; state lies by id: only messages travel
    ends = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    sides = [(Adjacency(scratch, graph.edges, here), there) for here, there in ends]
    state = scratch.put(graph.vertices.select("id", *(c.alias(k) for k, c in init.items())).withColumn("_active", start if start is not None else F.lit(True)).repartition(buckets(graph.spark), "id"), by=["id"])
    run = Run(state)
    for number in range(1, max_iter + 1):
        began = time.perf_counter()
        senders = state.where("_active") if send_if is None else state.alias("v").where(F.col("_active") & send_if).select("v.*")
        sent = reduce(DataFrame.union, [side.meet(senders).select(F.col(f"e.{there}").alias("id"), *(m.alias(k) for k, m in message.items())) for side, there in sides])
        mail = sent.groupBy("id").agg(*(c.alias(k) for k, c in combine.items()), F.count("*").alias("_mail"))
        full = state.join(mail, "id", "left")
        works = F.lit(True) if all_compute else F.col("_mail").isNotNull()
        new = full.select("id", *(F.when(works, update[k]).otherwise(F.col(k)).alias(k) if k in update else F.col(k) for k in init), *(F.col(k).alias(f"old_{k}") for k in init), *combine, "_mail")
        # the counts that the stop test needs come from the job that writes the state
        counts = Observation()
        judged = new.withColumn("_active", F.coalesce(active, F.lit(False))).select("id", *init, "_active", "_mail")
        with in_place(graph.spark):
            after = scratch.put(judged.observe(counts, F.sum("_mail").alias("m"), F.sum(F.col("_active").cast("long")).alias("a"), *(a.alias(f"agg_{k}") for k, a in (aggregates or {}).items()), *(F.sum(F.when(F.pmod("id", F.lit(workers)) == w, F.col("_mail"))).alias(f"worker_{w}") for w in range(workers))).drop("_mail"), by=["id"])
        seen = counts.get
        step = Step(number, {k: seen[f"agg_{k}"] for k in aggregates or {}}, seen["m"] or 0, seen["a"] or 0, time.perf_counter() - began, tuple(seen[f"worker_{w}"] or 0 for w in range(workers)))
        before = run.steps[-1].running if run.steps else {}
        step.running = {k: fold(before.get(k), step) for k, fold in (running or {}).items()}
        run.steps.append(step)
        scratch.drop(state)
        state = after
        if hook:
            hook(step)
        if stop and stop(step):
            run.reason = "stopped"
            break
        if not step.changed:
            run.reason = "quiescent"
            break
    else:
        run.reason = "max_iter"
    for side, _ in sides:
        side.drop()
    run.vertices = state.select("id", *init)
    return run


def phases(*runs: Callable[[], bool]) -> int:
    """Run phases in order until one returns False (force terminate); the number of phases run."""
    for k, phase in enumerate(runs, 1):
        if phase() is False:
            return k
    return len(runs)


def partition_counts(messages: DataFrame) -> DataFrame:
    """(partition, messages): how many messages each partition holds, the per-worker account of a superstep."""
    return messages.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("messages"))
