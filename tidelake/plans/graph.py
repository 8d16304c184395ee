"""Dataflow graphs that are kept up to date commit by commit.

A graph is built of relations, frozen with ``begin``, written to through inputs and read through outputs.  Every operator turns
changes into changes: linear ones apply themselves to the change, joins and groups keep state.  Results are pulled: a commit
only moves writes in, and an operator runs when an output, a feeder or a probe asks for it.  Each change is a Spark plan; what
an operator with state has computed is written to the checkpoint folder once, for all who read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DoubleType, FloatType, StructType

from tidelake.operators.frame import W, ZFrame, _list, rows_of
from tidelake.operators.outputs import by_key, extrema, flat

from .storage import FEW, Change, State, as_change, checkpointed, consolidated, fetched, summed, union


class ContextMismatch(ValueError):
    """Parts of two graphs were used together."""


class Delta(ZFrame):
    """A change on its way. ``rows``: about how many it has, if it is a cheap plan over what has been computed already; else None, and whoever keeps it writes it first. ``local``: its consolidated rows, where they are at hand."""

    def __init__(self, df: DataFrame, rows: int | None = None, local: pa.Table | None = None):
        super().__init__(df)
        self.rows, self.local = rows, local


def together(deltas: Sequence[Delta]) -> Delta:
    """One change of several."""
    if len(deltas) == 1:
        return deltas[0]
    rows = [d.rows for d in deltas]
    return Delta(union([d.df for d in deltas]), None if None in rows else sum(rows))


class Edge:
    """What a consumer hasn't read yet of its producer's changes."""

    def __init__(self, source: Node):
        self.source, self.waiting = source, []

    def pull(self) -> Delta | None:
        self.source.run()
        got, self.waiting = self.waiting, []
        return together(got) if got else None


class Side:
    """What is remembered of the changes of one source: whether the last one was large."""

    large = False


class Node:
    """An operator in a graph; ``kind`` names it in dumps."""

    def __init__(self, graph: Graph, kind: str, sources: Sequence[Node], schema: StructType):
        self.graph, self.kind, self.schema = graph, kind, schema
        self.name, self.is_hidden, self.emitted = None, False, 0
        self.inputs = [Edge(s) for s in sources]
        self.sides = [Side() for _ in sources]
        self.readers: list[Edge] = []
        self.receivers: list[Callable[[], None]] = []
        self.dirty = self.large = False
        for e in self.inputs:
            e.source.readers.append(e)
        graph.register(self)

    @property
    def tracking_index(self) -> int:
        """Place among the graph's operators, inputs and outputs included."""
        return self.graph.nodes.index(self)

    @property
    def empty(self) -> DataFrame:
        return self.graph.spark.createDataFrame([], StructType(list(self.schema.fields)).add(W, "long", False))

    def mark(self) -> None:
        """Tell everything downstream that a change may come."""
        stack = [self]
        while stack:
            n = stack.pop()
            for r in n.receivers:
                r()
            for e in n.readers:
                owner = e.owner
                if owner is not None and not owner.dirty:
                    owner.dirty = True
                    stack.append(owner)

    def run(self) -> None:
        if not self.dirty:
            return
        self.dirty = False
        changes = [e.pull() for e in self.inputs]
        if any(c is not None for c in changes):
            out = self.step(changes)
            if out is not None:
                self.emit(out)

    def step(self, changes: list[Delta | None]) -> Delta | None:
        raise NotImplementedError

    def emit(self, change: Delta) -> None:
        if self.graph.count_records:
            self.emitted += int(change.df.agg(F.coalesce(F.sum(F.abs(W)), F.lit(0))).first()[0])
        for e in self.readers:
            e.waiting.append(change)


class Linear(Node):
    """An operator for which the change of the result is the result of the change."""

    #: Operators whose plans may be run again by each reader: no shuffle, no arrays made longer.
    CHEAP = frozenset(("map", "map_", "filter", "map_counts", "negate", "fsts", "snds", "swaps", "concat", "minus"))

    def __init__(self, graph: Graph, kind: str, sources: Sequence[Node], f: Callable[..., ZFrame]):
        self.f, self.cheap = f, kind in self.CHEAP
        got = f(*[ZFrame(s.empty) for s in sources])
        super().__init__(graph, kind, sources, got.schema)

    def step(self, changes: list[Delta | None]) -> Delta | None:
        there = [c for c in changes if c is not None]
        if len(changes) > 1:  # concat, minus: each side by itself
            out = self.f(*[c if c is not None else ZFrame(e.source.empty) for c, e in zip(changes, self.inputs, strict=True)])
        else:
            out = self.f(changes[0])
        return Delta(out.df, sum(c.rows for c in there) if self.cheap and all(c.rows is not None for c in there) else None)


def written(z: ZFrame, owner: Node | Side) -> Change | None:
    """Consolidated and computed once, None if empty.

    A change of few small rows becomes a local relation: no files, and joins with it need no shuffle. One
    that had more is written, and the next one of its owner is at once, until one is small again. A large one that is
    a cheap plan over what is written already stays as it is.
    """
    rows, local = getattr(z, "rows", None), getattr(z, "local", None)
    if local is not None:
        return Change(z.df, local.num_rows, local) if local.num_rows else None
    if rows is not None and rows > FEW:
        return Change(z.df, rows, None)
    if not owner.large or rows is not None:
        table = fetched(z.df)
        if table is not None:
            table = summed(table, z.df.schema) if table.num_rows else table
            change = as_change(z.df, fetched(z.consolidate().df) if table is None else table)
            return change if change.rows else None
    df = checkpointed(consolidated(z.df))
    n = df.count()
    owner.large = n > FEW
    return Change(df, n, None) if n else None


def keys_of(change: Change, keys: Sequence[str]) -> Change:
    """The different keys of the changed rows, whatever their counts: net counts would hide a key whose values only swap."""
    if change.local is not None:
        schema = change.df.select(*keys).schema
        if all(isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, (FloatType, DoubleType)) for f in schema.fields):
            table = change.local.select(list(keys)).group_by(list(keys), use_threads=False).aggregate([])
            return as_change(change.df.select(*keys), table)
        return as_change(change.df.select(*keys), change.df.select(*keys).distinct().toArrow())
    return Change(change.df.select(*keys).distinct(), change.rows, None)


def of_keys(state: State, touched: Change) -> ZFrame:
    """Rows of the state with these keys."""
    return ZFrame(state.at(touched)).having(touched.df, state.keys, touched.local is not None)


class Multilinear(Node):
    """Joins of two or three: each change meets the others' states, those before it with their own changes already in. ``on``: the key, where all have one."""

    def __init__(self, graph: Graph, kind: str, sources: Sequence[Node], f: Callable[..., ZFrame], on: Sequence[str] | None = None):
        self.f = f
        super().__init__(graph, kind, sources, f(*[ZFrame(s.empty) for s in sources]).schema)
        self.states = [State(s.empty, on) for s in sources]

    def step(self, changes: list[Delta | None]) -> Delta | None:
        terms = []
        for i, change in enumerate(changes):
            change = written(change, self.sides[i]) if change is not None else None
            if change is None:
                continue
            others = [s for k, s in enumerate(self.states) if k != i]
            if all(s.parts for s in others):
                keys = keys_of(change, others[0].keys) if others[0].keys and any(p.buckets for s in others for p in s.parts) else None
                terms.append(self.f(*[ZFrame(change.df) if k == i else ZFrame(s.frame() if keys is None else s.at(keys)) for k, s in enumerate(self.states)]).df)
            self.states[i].add(change)
        return settled(written(ZFrame(union(terms)), self)) if terms else None


class Anti(Node):
    """The left rows whose key's count on the right is 0."""

    def __init__(self, graph: Graph, kind: str, sources: Sequence[Node], on: Sequence[str]):
        self.on = list(on)
        super().__init__(graph, kind, sources, sources[0].schema)
        self.left, self.right = State(sources[0].empty, self.on), State(sources[1].empty.select(*self.on, W), self.on)

    def step(self, changes: list[Delta | None]) -> Delta | None:
        terms = []
        a = written(changes[0], self.sides[0]) if changes[0] is not None else None
        b = written(changes[1].map(*self.on), self.sides[1]) if changes[1] is not None else None
        if a is not None:
            terms.append(ZFrame(a.df).antijoin(of_keys(self.right, keys_of(a, self.on)) if self.right.parts else ZFrame(self.right.empty), self.on))
            self.left.add(a)
        if b is not None:
            touched = keys_of(b, self.on)
            before = of_keys(self.right, touched).distinct()
            self.right.add(b)
            if self.left.parts:
                # Keys that appear on the right take rows away, keys that go give them back.
                turned = written(before.minus(of_keys(self.right, touched).distinct()), self)
                if turned is not None:
                    terms.append(of_keys(self.left, keys_of(turned, self.on)).semijoin(ZFrame(turned.df), self.on))
        return settled(written(ZFrame(union([t.df for t in terms])), self)) if terms else None


class Group(Node):
    """One row for each key of what ``f`` makes of the key's rows; keys that a change touches are computed anew."""

    def __init__(self, graph: Graph, kind: str, sources: Sequence[Node], keys: Sequence[str], f: Callable[[ZFrame], ZFrame]):
        self.keys, self.f = list(keys), f
        super().__init__(graph, kind, sources, f(ZFrame(sources[0].empty)).schema)
        # Results that are told apart by the key are kept by it, so that the old ones are found by key as well.
        self.state, self.result = State(sources[0].empty, self.keys), State(self.empty, self.keys)

    def step(self, changes: list[Delta | None]) -> Delta | None:
        change = written(changes[0], self.sides[0])
        if change is None:
            return None
        self.state.add(change)
        touched = keys_of(change, self.keys) if self.keys else None
        of = lambda s: ZFrame(s.frame()) if touched is None else of_keys(s, touched) if s.parts else ZFrame(s.empty)
        # Dealt out by the key once, rows are merged and grouped where they are.
        rows = of(self.state)
        rows = ZFrame(rows.df.repartition(*self.keys)) if self.keys else rows
        out = written(self.f(rows).minus(of(self.result)), self)  # unchanged results cancel out
        if out is not None:
            self.result.add(out)
        return settled(out)


def settled(change: Change | None) -> Delta | None:
    return None if change is None else Delta(change.df, change.rows, change.local)


class Relation:
    """A relation in a graph under construction; it may be used any number of times."""

    def __init__(self, node: Node):
        self.node = node

    @property
    def columns(self) -> list[str]:
        return self.node.schema.names

    def _linear(self, kind: str, f: Callable[..., ZFrame], *others: Relation) -> Relation:
        return Relation(Linear(self._graph(*others), kind, [self.node, *[o.node for o in others]], f))

    def _graph(self, *others: Relation) -> Graph:
        if any(o.node.graph is not self.node.graph for o in others):
            raise ContextMismatch("relations of different contexts")
        self.node.graph.require_open()
        return self.node.graph

    def map(self, *columns: Column | str) -> Relation:
        return self._linear("map", lambda z: z.map(*columns))

    def map_h(self, *columns: Column | str) -> Relation:
        return self.map(*columns).hidden()

    def map_(self, *columns: Column | str) -> Relation:
        return self._linear("map_", lambda z: z.map_raw(*columns))

    def filter(self, condition: Column | str) -> Relation:
        return self._linear("filter", lambda z: z.filter(condition))

    def flat_map(self, array: Column, *names: str) -> Relation:
        return self._linear("flat_map", lambda z: z.flat_map(array, *names))

    def flat_map_(self, array: Column) -> Relation:
        return self._linear("flat_map_", lambda z: z.flat_map_raw(array))

    def flatten(self, column: str, name: str = "value") -> Relation:
        return self._linear("flatten", lambda z: z.flatten(column, name))

    def map_counts(self, f: Callable[[Column], Column]) -> Relation:
        return self._linear("map_counts", lambda z: z.map_counts(f))

    def negate(self) -> Relation:
        return self._linear("negate", ZFrame.negate)

    def fsts(self, keys: str | Sequence[str]) -> Relation:
        return self._linear("fsts", lambda z: z.fsts(keys))

    def snds(self, keys: str | Sequence[str]) -> Relation:
        return self._linear("snds", lambda z: z.snds(keys))

    def swaps(self, keys: str | Sequence[str]) -> Relation:
        return self._linear("swaps", lambda z: z.swaps(keys))

    def split(self, left: Sequence[Column | str], right: Sequence[Column | str]) -> tuple[Relation, Relation]:
        return self.map(*left).type_named("split"), self.map(*right).type_named("split")

    def split_(self, left: Sequence[Column | str], right: Sequence[Column | str]) -> tuple[Relation, Relation]:
        """The raw form: each branch gives its own weights, in a column w."""
        return self.map_(*left).type_named("split"), self.map_(*right).type_named("split")

    def consolidate(self) -> Relation:
        return self._linear("consolidate", ZFrame.consolidate)

    def concat(self, other: Relation) -> Relation:
        return self._linear("concat", ZFrame.concat, other)

    def minus(self, other: Relation) -> Relation:
        return self._linear("minus", ZFrame.minus, other)

    def _multi(self, kind: str, f: Callable[..., ZFrame], *others: Relation, on: Sequence[str] | None = None) -> Relation:
        return Relation(Multilinear(self._graph(*others), kind, [self.node, *[o.node for o in others]], f, on))

    def join(self, other: Relation, on: str | Sequence[str]) -> Relation:
        return self._multi("join", lambda a, b: a.join(b, on), other, on=_list(on))

    def join_values(self, other: Relation, on: str | Sequence[str]) -> Relation:
        return self._multi("join_values", lambda a, b: a.join_values(b, on), other, on=_list(on))

    def semijoin(self, other: Relation, on: str | Sequence[str]) -> Relation:
        return self._multi("semijoin", lambda a, b: a.semijoin(b, on), other, on=_list(on))

    def intersection(self, other: Relation) -> Relation:
        return self._multi("intersection", lambda a, b: a.intersection(b), other, on=self.columns)

    def triangles(self, xz: Relation, yz: Relation, x: str = "x", y: str = "y", z: str = "z") -> Relation:
        return self._multi("triangles", lambda a, b, c: a.triangles(b, c, x, y, z), xz, yz)

    def antijoin(self, other: Relation, on: str | Sequence[str]) -> Relation:
        return Relation(Anti(self._graph(other), "antijoin", [self.node, other.node], _list(on)))

    def set_minus(self, other: Relation) -> Relation:
        return self.antijoin(other, self.columns).type_named("set_minus")

    def left_join(self, other: Relation, on: str | Sequence[str], matched: str = "matched") -> Relation:
        fields = [f for f in other.node.schema.fields if f.name not in _list(on)]
        hit = self.join(other, on)
        hit = hit.map(*hit.columns, F.lit(True).alias(matched))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        missing = self.antijoin(other, on)
        order = hit.columns
        return hit.concat(missing.map(*self.columns, *none, F.lit(False).alias(matched)).map(*order)).type_named("left_join")

    def _group(self, kind: str, keys: Sequence[str], f: Callable[[ZFrame], ZFrame]) -> Relation:
        return Relation(Group(self._graph(), kind, [self.node], keys, f))

    def reduce(self, keys: str | Sequence[str], *aggregates: Column) -> Relation:
        return self._group("reduce", _list(keys), lambda z: z.reduce(keys, *aggregates))

    def reduce_entries(self, keys: str | Sequence[str], f: Callable[[Column], Column], name: str = "value") -> Relation:
        return self._group("reduce", _list(keys), lambda z: z.reduce_entries(keys, f, name))

    def reduce_table(self, keys: str | Sequence[str], f: Callable, schema: str) -> Relation:
        return self._group("reduce", _list(keys), lambda z: z.reduce_table(keys, f, schema))

    def reduce_with_output_(self, keys: str | Sequence[str], f: Callable[[ZFrame], ZFrame], layout: Callable[[ZFrame], DataFrame]) -> tuple[Relation, Probe]:
        """``f`` on the rows of the keys that changed, and the map of results in a layout of the caller's."""
        got = self._group("reduce", _list(keys), f)
        return got, Probe(got, layout)

    @property
    def is_reduce(self) -> bool:
        """Whether the relation has a map of results, which can be probed."""
        return isinstance(self.node, Group)

    def counts(self, name: str = "n") -> Relation:
        return self._group("counts", self.columns, lambda z: z.counts(name))

    def distinct(self) -> Relation:
        return self._group("distinct", self.columns, ZFrame.distinct)

    def group_min(self, keys: str | Sequence[str] = ()) -> Relation:
        return self._group("group_min", _list(keys), lambda z: z.group_min(keys))

    def group_max(self, keys: str | Sequence[str] = ()) -> Relation:
        return self._group("group_max", _list(keys), lambda z: z.group_max(keys))

    # Sharing, names, types.

    def save(self) -> Relation:
        return self

    collect = dynamic = dynamic_shown = get = get_shown = clone = save

    def t(self, schema: StructType | str) -> Relation:
        ZFrame(self.node.empty).t(schema)
        return self

    def debug(self, name: str, condition: Column | str | None = None) -> Relation:
        return self._linear("debug", lambda z: z.debug(name, condition)).hidden()

    conditional_debug = debug

    def named(self, name: str) -> Relation:
        self.node.name = name
        return self

    def type_named(self, kind: str) -> Relation:
        self.node.kind = kind
        return self

    def hidden(self) -> Relation:
        if len(self.node.inputs) != 1:
            raise ValueError("only an operator with one source can be hidden")
        self.node.is_hidden = True
        return self

    @property
    def tracking_index(self) -> int:
        return self.node.tracking_index

    # Ends.

    def into_output(self) -> Output:
        return Output(self, flat)

    def into_kv_output(self, keys: str | Sequence[str]) -> Output:
        return Output(self, lambda z: by_key(z, keys))

    def into_extrema_output(self, keys: str | Sequence[str]) -> Output:
        return Output(self, lambda z: extrema(z, keys))

    def into_output_(self, layout: Callable[[ZFrame], DataFrame]) -> Output:
        return Output(self, layout)

    def probe(self) -> Probe:
        if not self.is_reduce:
            raise TypeError("only a reduced relation can be probed")
        return Probe(self)


class Output(Node):
    """What a relation holds as of the last commit, in a layout."""

    def __init__(self, relation: Relation, layout: Callable[[ZFrame], DataFrame]):
        relation.node.graph.require_open()
        super().__init__(relation.node.graph, "output", [relation.node], relation.node.schema)
        self.state, self.layout = State(self.empty), layout

    def add_listener(self, f: Callable[[], None]) -> None:
        """``f`` is called when a commit may have changed the output."""
        self.receivers.append(f)

    def step(self, changes: list[Delta | None]) -> None:
        change = written(changes[0], self)
        if change is not None:
            self.state.add(change)

    def frame(self) -> ZFrame:
        self.run()
        return ZFrame(self.state.frame())

    def get(self, context: Context | None = None) -> DataFrame:
        if context is not None and context.graph is not self.graph:
            raise ContextMismatch("an output of another context")
        return self.layout(self.frame())


class Probe:
    """A tap on a reduced relation: its keys and results as a plain DataFrame."""

    def __init__(self, relation: Relation, layout: Callable[[ZFrame], DataFrame] = lambda z: z.consolidate().df.drop(W)):
        self.relation, self.output = relation, Output(relation, layout)

    def get_relation(self) -> Relation:
        return self.relation

    def inspect(self, context: Context | None = None) -> DataFrame:
        return self.output.get(context)


class Source(Node):
    """Committed changes of an input."""

    def __init__(self, graph: Graph, schema: StructType):
        super().__init__(graph, "input", [], schema)
        self.pending: list[Delta] = []

    def run(self) -> None:
        pass

    def commit(self) -> None:
        """Moves what was written in and marks what depends on it."""
        if self.pending:
            self.emit(together(self.pending))
            self.pending = []
            self.mark()


class Input:
    """A handle to write to an input with; any number of handles may be made."""

    def __init__(self, source: Source, frames: list[list[DataFrame]] | None):
        self.source, self.frames = source, frames
        self.listeners: list[Callable[[DataFrame], None]] = []

    @property
    def tracking_index(self) -> int:
        return self.source.tracking_index

    def clone(self) -> Input:
        """Another handle on the same input; frames and listeners are shared."""
        twin = Input(self.source, self.frames)
        twin.listeners = self.listeners
        return twin

    def send_all(self, rows: DataFrame | ZFrame | Iterable, weight: int | None = None) -> None:
        """Changes: a DataFrame with w, or rows that end with their weight (or all have ``weight``)."""
        known = rows if isinstance(rows, Delta) else None
        if isinstance(rows, ZFrame):
            df = rows.df
        elif isinstance(rows, DataFrame):
            df = rows if weight is None else ZFrame.of(rows.drop(W), weight).df
        else:
            df = rows_of(self.source.graph.spark, rows, self.source.schema, weight).df
        if known is None:
            df = df.select(*self.source.schema.names, F.col(W).cast("bigint").alias(W))
        self.silent_send_all(df, known)
        if self.frames is not None and self.frames:
            self.frames[-1].append(df)
        for f in self.listeners:
            f(df)

    def silent_send_all(self, df: DataFrame, known: Delta | None = None) -> None:
        self.source.pending.append(Delta(df) if known is None else known)

    def send(self, *row) -> None:
        self.send_all([row])

    def update(self, row: Sequence, w: int) -> None:
        self.send_all([(*row, w)])

    def add(self, *row) -> None:
        self.send_all([row], 1)

    def add_all(self, rows: DataFrame | Iterable) -> None:
        self.send_all(rows, 1)

    def remove(self, *row) -> None:
        self.send_all([row], -1)

    def remove_all(self, rows: DataFrame | Iterable) -> None:
        self.send_all(rows, -1)

    def add_listener(self, f: Callable[[DataFrame], None]) -> None:
        self.listeners.append(f)


class Graph:
    """All operators of a context, and what feeds back."""

    def __init__(self, spark: SparkSession, count_records: bool):
        self.spark, self.count_records, self.open = spark, count_records, True
        self.nodes: list[Node] = []
        self.sources: list[Source] = []
        self.feeders: list = []
        self.feedback: list[tuple[Node, Node]] = []

    def register(self, node: Node) -> None:
        self.nodes.append(node)
        for e in node.inputs:
            e.owner = node

    def require_open(self) -> None:
        if not self.open:
            raise RuntimeError("the graph is frozen")

    def commit_sources(self) -> None:
        for s in self.sources:
            s.commit()

    def dump_dot(self, out: IO[str]) -> None:
        """The graph in Graphviz's language: names, kinds, records emitted (where they are counted), dotted feedback; hidden operators are skipped."""

        def shown(n: Node) -> Node:
            while n.is_hidden:
                n = n.inputs[0].source
            return n

        number = {id(n): i for i, n in enumerate(self.nodes)}
        out.write("digraph flow {\n")
        for n in self.nodes:
            if not n.is_hidden:
                label = "\\n".join([*([n.name] if n.name else []), n.kind, *([str(n.emitted)] if self.count_records else [])])
                out.write(f'  n{number[id(n)]} [label="{label}"];\n')
                for e in n.inputs:
                    out.write(f"  n{number[id(shown(e.source))]} -> n{number[id(n)]};\n")
        for a, b in self.feedback:
            out.write(f"  n{number[id(shown(a))]} -> n{number[id(b)]} [style=dotted];\n")
        out.write("}\n")


class Context:
    """A graph in use.  See ``tidelake.plans.feedback`` for the one that builds it and for commits."""

    graph: Graph
