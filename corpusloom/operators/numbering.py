"""Row numbers within groups of any size: a group is not sorted or numbered by one task.

Rows are dealt into ranges of (group, order), so that a large group spans several; each range numbers the rows of its groups,
and what the ranges before it hold of its first group is added: a broadcast of fewer rows than there are ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.sources.scratch import written

#: Characters of a text that decide its range; the whole text decides the order within it.
PREFIX = 32
_PART, _WITHIN = "_part", "_within"


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether elements are equal or both null."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _run_numbers(columns: list[int]):
    """Arrow batches of sorted rows, with the task's number and the row's place, from 0, in the run of equal ``columns``."""

    def run(batches):
        part, last, size = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k, c in enumerate(columns):
                own = batch.column(c)
                new[1:] |= ~_same(own[1:], own[:-1])
                new[0] |= last is None or not _same(own[:1], last[k])[0]
            at = np.arange(n)
            head = np.maximum.accumulate(np.where(new, at, -1))
            within = np.where(head < 0, at + size, at - head)
            size, last = int(within[-1]) + 1, [batch.column(c)[n - 1 :] for c in columns]
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(within)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, _PART, _WITHIN])

    return run


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with a long column ``name``: the row's number, from 0, among the rows of its ``group`` by ``order`` (ascending, nulls first).

    Rows that are equal in all of these get different numbers in any order. A null group is a group. The result is a written table, so the
    numbers don't change when it is read again."""
    kinds = {f.name: f.dataType for f in df.schema}
    ranges = [F.substring(c, 1, PREFIX) if isinstance(kinds[c], StringType) and c in order else F.col(c) for c in (*group, *order)]
    dealt = df.repartitionByRange(*ranges).sortWithinPartitions(*group, *order)
    columns = [df.columns.index(c) for c in group]
    schema = StructType([*df.schema.fields, StructField(_PART, IntegerType()), StructField(_WITHIN, LongType())])
    table = written(dealt.mapInArrow(_run_numbers(columns), schema), "numbered")
    sizes = table.groupBy(*group, _PART).agg((F.max(_WITHIN) + 1).alias("size"))
    before = F.sum("size").over(Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.withColumn("before", before).filter("before is not null").select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col(_PART).alias("_p"), "before")
    meets = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)]
    joined = table.join(F.broadcast(ahead), [F.col(_PART) == F.col("_p"), *meets], "left")  # a row per range at most
    return joined.select(*df.columns, (F.col(_WITHIN) + F.coalesce("before", F.lit(0))).alias(name))
