"""Populations of expressions as one graph, evaluated in Arrow batches.

Equal sub-expressions of a population are one node, whatever expressions they stand in, so each is
computed once per date. The Spark plan is the same for every population: no code is generated for
its expressions, and a table laid out by date is read without a shuffle. A task holds one date and
as many nodes at a time as ``CELLS`` allows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelforge.functions.expressions import BINARY, UNARY, parse
from panelforge.functions.scalar import DIVISOR_FLOOR, MAX_ABS
from panelforge.operators.correlation import _SCHEMA, _SUMS, correlations, products
from panelforge.operators.daily import SCHEMA, STATISTICS, _ranks, column_statistics, named_statistics
from panelforge.operators.series import TEMPORAL, temporal_column
from panelforge.sources.bydate import DateTable, each_date

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 8_000_000


def _divided(a, b):
    return np.where(np.abs(b) > DIVISOR_FLOOR, a / np.where(np.abs(b) > DIVISOR_FLOOR, b, 1.0), np.nan)


# What each operator computes on whole columns; a missing operand gives a missing result.
COLUMNWISE = {
    "neg": np.negative,
    "abs": np.abs,
    "signed_log": lambda a: np.sign(a) * np.log1p(np.abs(a)),
    "signed_sqrt": lambda a: np.sign(a) * np.sqrt(np.abs(a)),
    "add": np.add,
    "sub": np.subtract,
    "mul": np.multiply,
    "div": _divided,
    "min": np.minimum,
    "max": np.maximum,
}


class Graph:
    """Nodes of a population in an order in which operands come first.

    A node is ``(operator, operand numbers)`` or ``("", column name)``.
    """

    def __init__(self, nodes: list[tuple], roots: list[int]):
        self.nodes, self.roots = nodes, roots

    def columns(self) -> list[str]:
        return [name for kind, name in self.nodes if not kind]

    def below(self, roots: Sequence[int]) -> list[int]:
        """Nodes that ``roots`` need, operands first."""
        needed, waiting = set(), list(roots)
        while waiting:
            n = waiting.pop()
            if n not in needed:
                needed.add(n)
                if self.nodes[n][0]:
                    waiting += self.nodes[n][1]
        return sorted(needed)

    def chunks(self, rows: int) -> Iterator[tuple[int, list[int]]]:
        """(first expression, nodes to compute) of lots whose nodes fit ``CELLS``."""
        first, held = 0, set()
        for i, root in enumerate(self.roots):
            more = held | set(self.below([root]))
            if i > first and (len(more) + i - first) * max(1, rows) > CELLS:
                yield first, sorted(held)
                first, more = i, set(self.below([root]))
            held = more
        if self.roots:
            yield first, sorted(held)

    def evaluate(self, table: pa.Table, digits: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """(first expression, one column per expression) of the rows of a table."""
        lots = list(self.chunks(table.num_rows))
        for (first, nodes), (last, _) in zip(lots, [*lots[1:], (len(self.roots), None)]):
            made: dict[int, np.ndarray] = {}
            with np.errstate(all="ignore"):
                for n in nodes:
                    kind, operands = self.nodes[n]
                    if kind:
                        found = COLUMNWISE[kind](*[made[o] for o in operands])
                        made[n] = np.clip(found, -MAX_ABS, MAX_ABS, out=found)
                    else:
                        made[n] = table.column(operands).to_numpy().astype("f8", copy=False)
            # One expression after the other in memory: whoever reads columns reads them in a row.
            values = np.empty((last - first, table.num_rows))
            for row, root in zip(values, self.roots[first:last]):
                row[:] = made[root] if digits is None else rounded(made[root], digits)
            yield first, values.T


def graph_of(expressions: Sequence[str]) -> Graph:
    """The graph of canonical texts; equal sub-expressions get one number."""
    known: dict[tuple, int] = {}

    def number(tree) -> int:
        if isinstance(tree, str):
            node = ("", tree)
        elif tree[0] in TEMPORAL:
            node = ("", temporal_column(tree[0], tree[1]))
        elif tree[0] in {2: UNARY, 3: BINARY}.get(len(tree), ()):
            node = (tree[0], tuple(number(t) for t in tree[1:]))
        else:
            raise ValueError(f"unknown operator {tree[0]!r} with {len(tree) - 1} operands")
        return known.setdefault(node, len(known))

    roots = [number(parse(text)) for text in expressions]
    return Graph(list(known), roots)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    scale = 10.0**digits
    out = np.abs(values)
    out *= scale
    out += 0.5
    np.floor(out, out=out)
    out /= scale
    np.copysign(out, values, out=out)
    out += 0.0
    return out


def _doubles(rows: DataFrame, names: Sequence[str]) -> list:
    return [F.col(c).cast("double").alias(c) for c in names]


def population_statistics(
    laid_out: DateTable, expressions: Mapping[str, str], kind: str, *, k: int = 50, least: int = 1, digits: int | None = None
) -> DataFrame:
    """The daily statistics of :func:`daily.daily_statistics` for a population of expressions."""
    names, graph = list(expressions), graph_of(list(expressions.values()))
    rows = laid_out.rows.select("trade_date", *_doubles(laid_out.rows, dict.fromkeys(["target_rank", "relevance", *graph.columns()])))
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_date(batches):
            date = table.column("trade_date")[0].as_py()
            target, relevance = (table.column(c).to_numpy() for c in ("target_rank", "relevance"))
            for first, values in graph.evaluate(table, digits):
                found = column_statistics(values, target, relevance, kind, k, least)
                columns = [np.arange(first, first + values.shape[1], dtype="i4"), [date] * values.shape[1], *found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=STATISTICS)

    return named_statistics(rows.mapInArrow(run, f"{SCHEMA}, neg double"), names)


def candidate_correlations(laid_out: DateTable, candidates: Mapping[str, str], others: Mapping[str, str], *, digits: int | None = None) -> DataFrame:
    """(left, right, n, correlation) of daily ranks of every candidate with every other expression and itself.

    Only products of candidates with candidates and others are formed, not those among the others.
    """
    names = [*candidates, *others]
    graph = graph_of([*candidates.values(), *others.values()])
    rows, size = laid_out.rows.select("trade_date", *_doubles(laid_out.rows, graph.columns())), len(candidates)
    kinds = (pa.int32(), pa.int32(), *[pa.float64()] * 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, size, len(names)))
        for table in each_date(batches):
            ranks = [_ranks(values) for _, values in graph.evaluate(table, digits)]
            ranks = np.concatenate(ranks, 1)
            sums += products(ranks[:, :size] / np.maximum((~np.isnan(ranks[:, :size])).sum(0), 1), ranks / np.maximum((~np.isnan(ranks)).sum(0), 1))
        i, j = (x.ravel() for x in np.indices((size, len(names))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((i, j, *(s.ravel() for s in sums)), kinds)], names=["i", "j", *_SUMS])

    return correlations(rows.mapInArrow(run, _SCHEMA), names)
