"""Pluggable keyed aggregates: any fold whose states can be merged.

A :class:`Fold` names four functions, as a user-defined aggregate does: ``init``
gives an empty state, ``step`` adds one row to it, ``merge`` joins two states
and ``finish`` turns a state into the result's values. ``merge`` must be
associative and commutative; a fold that depends on an order keeps the deciding
offset in its state.

:func:`keyed_fold` folds every input split by itself, so a hot key is combined
before the shuffle: it sends one state per split, however many rows it has. The
states then meet by key, sorted, and are merged as they stream by; neither step
holds more than ``most_keys`` states.

Defined cases: null keys form one group; an empty table gives an empty result;
rows of any number and order give the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

State = tuple
MOST_KEYS = 50_000  # states that a task holds before it sends them on
BATCH = 4_096  # states in one Arrow batch


@dataclass(frozen=True)
class Fold:
    """``step`` gets the state and a tuple of the input columns' values;
    ``state`` and ``result`` are the DDL of the tuples that the functions give."""

    inputs: tuple[str, ...]
    state: str
    result: str
    init: Callable[[], State]
    step: Callable[[State, tuple], State]
    merge: Callable[[State, State], State]
    finish: Callable[[Any, State], tuple]


def batches_of(rows, schema: pa.Schema):
    """Arrow batches of the tuples that ``rows`` yields."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def tuples(batch: pa.RecordBatch):
    return zip(*(c.to_pylist() for c in batch.columns))


def keyed_fold(df: DataFrame, key: str, fold: Fold, most_keys: int = MOST_KEYS) -> DataFrame:
    """One row per value of ``key``: the key and the columns of ``fold.result``."""
    key_field = T.StructField(key, df.schema[key].dataType)
    states = T.StructType([key_field, *T.StructType.fromDDL(fold.state).fields])
    results = T.StructType([key_field, *T.StructType.fromDDL(fold.result).fields])
    state_arrow, result_arrow = to_arrow_schema(states), to_arrow_schema(results)

    def fold_split(batches):
        def rows():
            held: dict = {}
            for batch in batches:
                for k, *values in tuples(batch):
                    held[k] = fold.step(held[k] if k in held else fold.init(), tuple(values))
                    if len(held) >= most_keys:
                        yield from ((h, *s) for h, s in held.items())
                        held = {}
            yield from ((h, *s) for h, s in held.items())

        return batches_of(rows(), state_arrow)

    def merge_runs(batches):
        def rows():
            now, state = None, None
            for batch in batches:
                for k, *values in tuples(batch):
                    if state is not None and k == now:
                        state = fold.merge(state, tuple(values))
                        continue
                    if state is not None:
                        yield (now, *fold.finish(now, state))
                    now, state = k, tuple(values)
            if state is not None:
                yield (now, *fold.finish(now, state))

        return batches_of(rows(), result_arrow)

    split = df.select(key, *fold.inputs).mapInArrow(fold_split, states)
    return split.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`")).mapInArrow(merge_runs, results)
