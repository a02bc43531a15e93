"""Table functions for SQL: folds over a table's partitions in their order, and leaves of JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StringType, StructType

from palimpsest.functions.text import leaves_of


def fold_function(reducers: dict[str, Callable[[dict, dict], dict]]) -> type:
    """A table function of several reducers in one pass: fold(TABLE(t), key, order) gives, for each value of the column key, the states of all reducers as JSON, folded over its rows in the order of a column. Rows are dealt and sorted by Spark, and stream through it."""

    class Fold:
        def __init__(self) -> None:
            self.key, self.states, self.n = None, {name: {} for name in reducers}, 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(key.value, str) or not isinstance(order.value, str):
                raise ValueError("fold(TABLE(t), key, order): a table and the names of two of its columns")
            schema = StructType().add(key.value, rows.dataType[key.value].dataType).add("events", LongType())
            for name in reducers:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

        def eval(self, row: Row, key: str, order: str) -> None:
            event = row.asDict(recursive=True)
            self.key, self.n = event[key], self.n + 1
            for name, reduce in reducers.items():
                self.states[name] = reduce(self.states[name], event)

        def terminate(self) -> Iterator[tuple]:
            if self.n:
                yield (self.key, self.n, *[json.dumps(s, sort_keys=True) for s in self.states.values()])

    return Fold


class Leaves:
    """leaves(payload): path, value and type of each leaf of a JSON payload."""

    def eval(self, payload: str) -> Iterator[tuple]:
        yield from leaves_of(payload)


def register(spark: SparkSession, reducers: dict[str, Callable[[dict, dict], dict]] | None = None, name: str = "fold") -> None:
    """Makes leaves() and, with reducers, fold() known to SQL."""
    spark.udtf.register("leaves", udtf(Leaves, returnType="path string, value string, type string"))
    if reducers:
        spark.udtf.register(name, udtf(fold_function(reducers)))
