"""Structured Streaming into a graph: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidelake.operators.frame import W
from tidelake.plans.feedback import ExecutionContext
from tidelake.plans.graph import Input


class StreamCommits:
    """Writes the batches of a stream to an input and commits after each; a batch that comes again is skipped by its number.

    The graph's state lives as long as its context. A stream that goes on from an earlier checkpoint would meet an empty graph, so a batch that
    isn't the next one is refused; whoever has filled the graph up to a batch says so by ``last``.
    """

    def __init__(self, context: ExecutionContext, target: Input, after: Callable[[Any], None] | None = None, last: int = -1):
        self.context, self.target, self.after, self.last = context, target, after, last

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        if number > self.last + 1:
            raise RuntimeError(f"batch {number} came after batch {self.last}: the graph lacks what was between; fill it and give last, or begin with a new checkpoint folder")
        self.target.send_all(batch, None if W in batch.columns else 1)
        got = self.context.commit()
        self.last = number
        if self.after is not None:
            self.after(got)


def start(stream: DataFrame, context: ExecutionContext, target: Input, checkpoint: str, after: Callable[[Any], None] | None = None, **trigger: Any) -> StreamingQuery:
    """Run ``stream`` (its columns, and w for signed changes) into the input; ``trigger`` as for DataStreamWriter.trigger."""
    writer = stream.writeStream.foreachBatch(StreamCommits(context, target, after)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
