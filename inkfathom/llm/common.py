"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, running, scratch, shared_root, written

__all__ = ["SPACE", "WORD", "bounded_batches", "by_group", "carried", "dropped", "running", "scratch", "shared_root", "written"]

#: ASCII white space as the contracts write it, for Java's and RE2's engines alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of a few megabytes, however long they are; a value that the session sets stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def carried(df: DataFrame, **named: Column) -> DataFrame:
    """df's rows as one struct, `_row`, beside the named columns: whatever df's columns are called, none clashes with an
    operator's own. select("_row.*") gives df's rows back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in named.items()])


def by_group(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f over each group of equal keys (longs, not null), as applyInArrow, for very many groups of a bounded size: groups
    are cut out of the sorted partition as it streams by, so a small one costs no message of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[pa.Table] = []
        last = None

        def results() -> Iterator[pa.RecordBatch]:
            for b in pa.concat_tables(done).combine_chunks().to_batches() if done else ():
                yield b
            done.clear()

        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in keys])
            starts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()]
            for i, j in zip(starts, [*starts[1:], b.num_rows]):
                now = tuple(k[:, i].tolist())
                if held and now != last:
                    done.append(f(pa.Table.from_batches(held)))
                    held = []
                    if len(done) >= 500:
                        yield from results()
                held.append(b.slice(i, j - i))
                last = now
        if held:
            done.append(f(pa.Table.from_batches(held)))
        yield from results()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
