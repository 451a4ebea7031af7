"""Sequential folds of long items in chunks: every chunk is folded at once, and again where its state was wrong.

A fold reads the rows of a key in order and carries a state. Rows are ranged over the tasks by key
and order, so that the rows of a long key are in many chunks of about ``CHUNK`` rows. All chunks are
folded from an empty state; then each is handed the state in which the chunk before it ended, and
only those whose state was another are folded again, until no state changes. As what a chunk begins
with wears off in the folds of this library (an unbroken segment, live masks, a growing box), that
takes a few rounds; at worst it takes as many as a key has chunks. No key is ever in one row or task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from cuegrid.sources.storage import discard, written

CHUNK = 20_000
#: state (None at first; anything JSON can hold) and rows in order -> closed results and the state behind them.
Fold = Callable[[list | None, Iterator[tuple]], tuple[list[tuple], list | None]]
#: state -> the results still open at the end of a key.
Finish = Callable[[list | None], list[tuple]]


def chunked(rows: DataFrame, key: list[str], order: list[str], size: int = CHUNK) -> DataFrame:
    """key, part and rows: neighbours of a key in order, in parts of about ``size`` rows; parts ascend within a key."""
    parts = max(1, math.ceil(rows.count() / size))
    rest = [c for c in rows.columns if c not in (*key, *order)]
    ranged = rows.repartitionByRange(parts, *key, *order).withColumn("part", F.spark_partition_id())
    return ranged.groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"))


def _folded(chunks: DataFrame, key: list[str], fold: Fold, finish: Finish, kind: str) -> DataFrame:
    """key, part, entry, state, done and open: the chunks (with entry, a state) folded."""
    keys = [*key, "part", "entry"]
    names = chunks.schema["rows"].dataType.elementType.names
    listed = to_arrow_type(ArrayType(StructType.fromDDL(kind)))
    schema = ", ".join([f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in keys] + ["state string", f"done array<struct<{kind}>>", f"open array<struct<{kind}>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.append(0, np.cumsum(np.asarray(b["rows"].value_lengths())))
            flat = b["rows"].flatten()
            columns = [flat.field(c).to_pylist() for c in names]
            states, done, open_ = [], [], []
            for k, entry in enumerate(b["entry"].to_pylist()):
                closed, state = fold(None if entry is None else json.loads(entry), zip(*(c[ends[k] : ends[k + 1]] for c in columns)))
                states.append(None if state is None else json.dumps(state, ensure_ascii=False))
                done.append(closed)
                open_.append(finish(state))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), pa.array(states, pa.string()), pa.array(done, listed), pa.array(open_, listed)], names=[*keys, "state", "done", "open"])

    return chunks.select(*keys, "rows").mapInArrow(run, schema)


def fold_in_chunks(rows: DataFrame, key: list[str], order: list[str], fold: Fold, finish: Finish, kind: str, size: int = CHUNK) -> DataFrame:
    """key and the results (``kind``: their fields, as a schema) of the fold over the rows of each key.

    ``fold`` gets tuples of the order columns and then of the others. Rows that tie in all order
    columns come in the order of the others. An empty table gives no rows.
    """
    rows = written(rows, "fold-rows")
    chunks = written(chunked(rows, key, order, size).withColumn("entry", F.lit(None).cast("string")), "chunks")
    done = written(_folded(chunks, key, fold, finish, kind), "folded")
    if chunks.groupBy(*key).count().filter("count > 1").isEmpty():
        discard(rows)
        return done.select(*key, F.explode(F.concat("done", "open")).alias("r")).select(*key, "r.*")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*key, "part")])
    along = Window.partitionBy(*key).orderBy("part")
    while True:
        # States alone: a row a chunk.
        due = done.select(*key, "part", "entry", F.lag("state").over(along).alias("due"))
        wrong = written(due.filter(~F.col("due").eqNullSafe(F.col("entry"))).select(*key, "part", "due"), "wrong")
        if wrong.isEmpty():
            break
        again = chunks.alias("c").join(wrong.alias("w"), same("c", "w")).select(*[F.col(f"c.{c}") for c in (*key, "part", "rows")], F.col("w.due").alias("entry"))
        right = done.alias("d").join(wrong.alias("w"), same("d", "w"), "left_anti")
        before, done = done, written(right.unionByName(_folded(again, key, fold, finish, kind)), "folded")
        discard(before)
        discard(wrong)
    discard(rows)
    last = F.lead("part").over(along).isNull()
    ends = done.select(*key, "part", last.alias("_last")).filter("_last")
    open_ = done.alias("d").join(ends.alias("e"), same("d", "e"), "left_semi").select(*key, F.explode("open").alias("r"))
    return done.select(*key, F.explode("done").alias("r")).unionByName(open_).select(*key, "r.*")
