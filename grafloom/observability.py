"""What a query does: its plans as trees, the rows and times of its operators, and spans of what was called."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Span:
    name: str
    attributes: dict
    seconds: float = 0.0
    children: list[Span] = field(default_factory=list)

    def tree(self, depth: int = 0) -> str:
        return "\n".join([f"{'  ' * depth}{self.name} {self.seconds:.3f} s {self.attributes or ''}".rstrip(), *[c.tree(depth + 1) for c in self.children]])


class Tracer:
    """Nested spans: `with tracer.span("load", rows=3): ...`."""

    def __init__(self) -> None:
        self.roots: list[Span] = []
        self._open: list[Span] = []

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[Span]:  # noqa: ANN003
        s = Span(name, attributes)
        (self._open[-1].children if self._open else self.roots).append(s)
        self._open.append(s)
        began = time.perf_counter()
        try:
            yield s
        finally:
            s.seconds = time.perf_counter() - began
            self._open.pop()


def _children(node) -> list:  # noqa: ANN001
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def logical_plan(df: DataFrame, optimized: bool = True) -> list[dict]:
    """The operators of the logical plan from the top: `operator`, `depth`, `text`. Starts no job of its own."""
    qe, out = df._jdf.queryExecution(), []

    def visit(node, depth: int) -> None:  # noqa: ANN001
        out.append({"operator": node.nodeName(), "depth": depth, "text": node.simpleString(200)})
        for c in _children(node):
            visit(c, depth + 1)

    visit(qe.optimizedPlan() if optimized else qe.analyzed(), 0)
    return out


def profile(df: DataFrame) -> dict:
    """Runs a query and gives `rows`, `seconds` and per operator of the plan that ran `operator`, `depth` and its metrics."""
    qe = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = qe.toRdd().count()
    seconds, out = time.perf_counter() - began, []
    as_java = df.sparkSession._jvm.scala.jdk.javaapi.CollectionConverters.asJava

    def visit(node, depth: int) -> None:  # noqa: ANN001
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            visit(node.executedPlan(), depth)
        elif kind.endswith("QueryStageExec"):
            visit(node.plan(), depth)
        else:
            metrics = {str(k): m.value() for k, m in dict(as_java(node.metrics())).items() if m.value() > 0}
            out.append({"operator": node.nodeName(), "depth": depth, "rows": metrics.get("numOutputRows"), "metrics": metrics})
            for c in _children(node):
                visit(c, depth + 1)

    visit(qe.executedPlan(), 0)
    return {"rows": rows, "seconds": seconds, "operators": out}
