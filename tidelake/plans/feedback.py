"""Contexts: building a graph, committing to it, feeding results back."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from typing import IO, Any, TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelake.operators.frame import W, ZFrame, _list

from .graph import Context, ContextMismatch, Delta, Graph, Input, Node, Output, Relation, Source, written
from .storage import Change, as_change, summed, union

R = TypeVar("R")
#: Rounds of feedback in one commit after which a program counts as endless.
MAX_ROUNDS = 10_000


class Interrupt:
    """What a commit was interrupted with."""

    def __init__(self, value: Any):
        self.value = value


class Feeder:
    """Something that looks at an output when it may have changed. Those registered first go first."""

    def __init__(self, graph: Graph, output: Output, target: Input | None = None):
        self.graph, self.output, self.target = graph, output, target
        self.index = len(graph.feeders)
        graph.feeders.append(self)
        self.queue: list[int] = []
        output.receivers.append(lambda: self.notify())
        if target is not None:
            graph.feedback.append((output.inputs[0].source, target.source))

    def notify(self) -> None:
        if self.graph.queue is not None and self.index not in self.graph.queue:
            heapq.heappush(self.graph.queue, self.index)

    def visit(self) -> bool | Interrupt:
        """Whether something was sent, or an interrupt."""
        raise NotImplementedError


class Sink(Output):
    """An output whose changes are handed on, not kept."""

    def __init__(self, relation: Relation):
        super().__init__(relation, lambda z: z.df)
        self.kind = "feed"
        self.fresh: list[Change] = []

    def step(self, changes: list[Delta | None]) -> None:
        change = written(changes[0], self)
        if change is not None:
            self.fresh.append(change)

    def take(self) -> list[Change]:
        self.run()
        got, self.fresh = self.fresh, []
        return got


def sent(target: Input, change: Change) -> None:
    """Send the target's columns of a change; what is at hand stays at hand."""
    names = [*target.source.schema.names, W]
    df = change.df.select(*names)
    table = summed(change.local.select(names), df.schema) if change.local is not None else None
    if table is not None:
        now = as_change(df, table)
        target.send_all(Delta(now.df, now.rows, now.local))
    else:
        target.send_all(Delta(df, change.rows))


class Feed(Feeder):
    """Sends every change. Changes are consolidated before, which takes fewer rounds to the same end."""

    def visit(self) -> bool:
        got = self.output.take()
        for change in got:
            sent(self.target, change)
        return bool(got)


class Waiting:
    """Changes that wait for their key's turn, and the keys that have had theirs since each came: nothing is written again when a key goes."""

    def __init__(self, change: Change):
        self.change, self.gone = change, []

    def left(self, key: str) -> DataFrame:
        keep = ~F.coalesce(F.col(key).isin([k for k in self.gone if k is not None]), F.lit(False)) if any(k is not None for k in self.gone) else F.lit(True)
        return self.change.df.where(keep & F.col(key).isNotNull() if None in self.gone else keep)

    def least(self, key: str) -> tuple | None:
        """The smallest key that is left, null first; None: nothing is left."""
        if self.change.local is None:
            got = self.left(key).agg(F.min(F.struct(key)).alias("k")).first()["k"]
            return None if got is None else tuple(got)
        column = self.change.local[key]
        if column.null_count and None not in self.gone:
            return (None,)
        gone = pa.array([k for k in self.gone if k is not None], column.type)
        rest = column.filter(pc.and_(pc.is_valid(column), pc.invert(pc.is_in(column, gone)))) if len(gone) else column.drop_null()
        return (pc.min(rest).as_py(),) if len(rest) else None


class OrderedFeed(Feeder):
    """Sends changes at the smallest key that has any; those that cancel at their key are skipped."""

    #: Waiting changes, and keys that have gone from one of them, after which what is left is put together.
    MOST, MOST_GONE = 12, 100

    def __init__(self, graph: Graph, output: Sink, target: Input, key: str):
        super().__init__(graph, output, target)
        self.key, self.pending = key, []

    def visit(self) -> bool:
        self.pending += [Waiting(c) for c in self.output.take()]
        if len(self.pending) > self.MOST or any(len(p.gone) > self.MOST_GONE for p in self.pending):
            whole = written(ZFrame(union([p.left(self.key) for p in self.pending])), self.output)
            self.pending = [] if whole is None else [Waiting(whole)]
        while self.pending:
            least = [p.least(self.key) for p in self.pending]
            self.pending = [p for p, k in zip(self.pending, least, strict=True) if k is not None]
            least = min((k for k in least if k is not None), key=lambda k: (k[0] is not None, k[0]), default=None)
            if least is None:
                return False
            kind = self.output.schema[self.key].dataType
            now = written(ZFrame(union([p.left(self.key) for p in self.pending]).where(F.col(self.key).eqNullSafe(F.lit(least[0]).cast(kind)))), self.output)
            for p in self.pending:
                p.gone.append(least[0])
            if now is not None:
                sent(self.target, now)
                return True
        return False


class WhileFeed(Feeder):
    """Sends the whole output, again and again until it is empty."""

    def visit(self) -> bool:
        now = written(self.output.frame(), self.output)
        if now is None:
            return False
        sent(self.target, now)
        return True


class Stop(Feeder):
    """Interrupts the commit when the output isn't empty; not again until the output changes."""

    def __init__(self, graph: Graph, output: Output, f: Callable[[DataFrame], Any], kind: type):
        super().__init__(graph, output)
        self.f, self.kind = f, kind

    def visit(self) -> bool | Interrupt:
        now = self.output.get()
        if now.isEmpty():
            return False
        value = self.f(now)
        if not isinstance(value, self.kind):
            raise TypeError(f"an interrupt of {type(value).__name__}, not {self.kind.__name__}")
        return Interrupt(value)


class ExecutionContext(Context):
    """A frozen graph: writes, commits, frames."""

    def __init__(self, graph: Graph, inputs: list[Input]):
        self.graph, self.trackable = graph, [i for i in inputs if i.frames is not None]

    def commit(self, max_rounds: int = MAX_ROUNDS) -> Any | None:
        """Moves writes in and feeds back until nothing is left or an interrupt comes, whose value is returned."""
        g = self.graph
        for _ in range(max_rounds):
            g.commit_sources()
            if not g.queue:
                return None
            index = heapq.heappop(g.queue)
            got = g.feeders[index].visit()
            if isinstance(got, Interrupt):
                return got.value
            if got:
                g.feeders[index].notify()
        raise RuntimeError(f"no end after {max_rounds} rounds")

    def in_frame(self, f: Callable[[ExecutionContext], R]) -> R:
        """``f``'s result; then the inverse of every change to trackable inputs, fed-back ones included, is written, not committed."""
        for i in self.trackable:
            i.frames.append([])
        try:
            return f(self)
        finally:
            for i in self.trackable:
                for df in i.frames.pop():
                    i.silent_send_all(df.withColumn(W, -F.col(W)))

    def dump_dot(self, out: IO[str]) -> None:
        self.graph.dump_dot(out)

    tracker = property(lambda self: self.graph)


class CreationContext(Context):
    """A graph under construction."""

    def __init__(self, spark: SparkSession, count_records: bool = False, interrupt_type: type | None = object):
        """``interrupt_type``: what interrupts may carry; None: the graph has no interrupts."""
        self.graph = Graph(spark, count_records)
        self.graph.queue, self.interrupt_type = [], interrupt_type
        self.inputs: list[Input] = []

    @classmethod
    def new(cls, spark: SparkSession) -> CreationContext:
        """A context whose commits can't be interrupted."""
        return cls(spark, interrupt_type=None)

    @classmethod
    def new_(cls, spark: SparkSession, interrupt_type: type) -> CreationContext:
        """A context whose interrupts carry values of this type."""
        return cls(spark, interrupt_type=interrupt_type)

    def new_input(self, schema: StructType | str) -> tuple[Input, Relation]:
        return self._input(schema, None)

    def new_input_(self, schema: StructType | str) -> tuple[Input, Relation]:
        """Raw items: any columns, among which ``map_`` may take the weight; each item that is added counts once."""
        return self._input(schema, None)

    def new_trackable_input(self, schema: StructType | str) -> tuple[Input, Relation]:
        """An input whose changes ``in_frame`` takes back."""
        return self._input(schema, [])

    def _input(self, schema: StructType | str, frames: list | None) -> tuple[Input, Relation]:
        self.graph.require_open()
        source = Source(self.graph, StructType.fromDDL(schema) if isinstance(schema, str) else schema)
        self.graph.sources.append(source)
        self.inputs.append(Input(source, frames))
        return self.inputs[-1], Relation(source)

    def _same(self, *nodes: Node) -> None:
        self.graph.require_open()
        if any(n.graph is not self.graph for n in nodes):
            raise ContextMismatch("parts of different contexts")

    def feed(self, relation: Relation, target: Input) -> None:
        self._same(relation.node, target.source)
        Feed(self.graph, Sink(relation), target)

    def feed_ordered(self, relation: Relation, target: Input, key: str) -> None:
        """The relation has ``key`` and the target's columns."""
        self._same(relation.node, target.source)
        OrderedFeed(self.graph, Sink(relation), target, key)

    def feed_while(self, output: Output, target: Input) -> None:
        self._same(output, target.source)
        WhileFeed(self.graph, output, target)

    def interrupt(self, output: Output, f: Callable[[DataFrame], Any] = lambda df: df) -> None:
        self._same(output)
        if self.interrupt_type is None:
            raise TypeError("a context without interrupts")
        Stop(self.graph, output, f, self.interrupt_type)

    def first_occurrences(self, relation: Relation, keys: str | list[str]) -> Relation:
        """Per key, for ever, the rows that were there in the first commit that had the key."""
        self._same(relation.node)
        seen_input, seen = self.new_input(relation.node.schema)
        self.feed_while(relation.antijoin(seen.fsts(keys), _list(keys)).into_output(), seen_input)
        return seen

    def dump_dot(self, out: IO[str]) -> None:
        self.graph.dump_dot(out)

    tracker = property(lambda self: self.graph)

    def begin(self) -> ExecutionContext:
        self.graph.open = False
        return ExecutionContext(self.graph, self.inputs)
