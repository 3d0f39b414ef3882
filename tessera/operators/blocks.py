"""Products of vectors, block by block, for what needs every pair (the best few, a score for each label).

A right side of up to SENT rows and BYTES is sent to all workers, and the left side stays where it is. Of a larger one the
left side is dealt into as many units as there are cores, or more where a unit would outgrow HELD rows, and each unit's task
holds its rows once while all rows of the right side pass by them in batches. So the right side is moved once for each unit,
not for each block, no row of the left side is moved twice, and a task holds HELD rows, a batch and the product of a block
with it. Pairs over a threshold are found by cells that can meet (metric.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .skew import importable

BLOCK = 1024
#: Rows and bytes of a right side that is sent to all workers.
SENT, BYTES = 8192, 32 << 20
#: Rows of the left side that a task holds, and rows of the right side that pass by at once.
HELD, PASSING = 1 << 17, 8192


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def products(left: DataFrame, right: DataFrame, keys: tuple[str, str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK, fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """What `run` returns for each pair of a part of left and a part of right, given their columns. `fold` brings together
    what it returned for one part of left, as what follows would, so that a task doesn't return all of it."""
    importable(left.sparkSession)
    some = right.limit(SENT + 1).toArrow()
    if some.num_rows <= SENT and some.nbytes <= BYTES:
        sent = left.sparkSession.sparkContext.broadcast(some.to_pandas())

        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in parts:
                for at in range(0, len(x), block):
                    yield run(x.iloc[at : at + block].reset_index(drop=True), sent.value)

        return left.mapInPandas(each, schema)
    n, spark = left.count(), left.sparkSession
    units = max(1, -(-n // HELD), min(spark.sparkContext.defaultParallelism, -(-n // block)))
    unit = F.pmod(F.xxhash64(F.col(keys[0])), F.lit(units)).cast("int")
    x, y = F.struct(*left.columns), F.struct(*right.columns)
    a = left.select(unit.alias("_u"), F.lit(0).alias("_s"), x.alias("_x"), F.lit(None).cast(right.select(y.alias("y")).schema["y"].dataType).alias("_y"))
    b = right.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("_u"), F.lit(1).alias("_s"), F.lit(None).cast(left.select(x.alias("x")).schema["x"].dataType).alias("_x"), y.alias("_y"))
    # ranges are cut by a sample, so more of them are asked for than there are units, and each unit gets its own
    rows = a.union(b).repartitionByRange(8 * units, "_u").sortWithinPartitions("_u", "_s")
    return rows.mapInArrow(_passing(run, block, fold, to_arrow_schema(StructType.fromDDL(schema))), schema)


def _passing(run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], block: int, fold: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come unit by unit: first those of the left side, which are held, then those of the right side."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, by, rows, got = None, [], [], 0, {}

        def meet() -> Iterator[pa.RecordBatch]:
            nonlocal by, rows
            if by and held:
                y = _columns(by)
                left = pa.Table.from_batches(held)
                for at in range(0, len(left), block):
                    new = run(_columns(left.slice(at, block).to_batches()), y)
                    if fold is None:
                        yield pa.RecordBatch.from_pandas(new, schema, False)
                    else:
                        got[at] = fold(pd.concat([got[at], new], ignore_index=True) if at in got else new)
            by, rows = [], 0

        def end() -> Iterator[pa.RecordBatch]:
            yield from meet()
            for new in got.values():
                yield pa.RecordBatch.from_pandas(new, schema, False)

        for batch in batches:
            units, sides = batch["_u"].to_numpy(), batch["_s"].to_numpy()
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)], strict=True):
                if a == b:
                    continue
                if units[a] != unit:
                    yield from end()
                    unit, held, got = units[a], [], {}
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    held.append(pa.RecordBatch.from_struct_array(part["_x"]))
                else:
                    by.append(pa.RecordBatch.from_struct_array(part["_y"]))
                    rows += b - a
                    if rows >= PASSING:
                        yield from meet()
        yield from end()

    return each


def _columns(parts: list[pa.RecordBatch]) -> pd.DataFrame:
    return pa.Table.from_batches(parts).to_pandas()
