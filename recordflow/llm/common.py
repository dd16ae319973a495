"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.session import materialize

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: computed once, its lineage cut,
    safe from lost executors."""
    return materialize(df, name)


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def n_words(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A fixed pseudo-random number in (0, 1) from the given values: 52 bits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2 ** 52))


def numpy_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def keyed_runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole key runs from batches sorted by ``key``.

    Runs are gathered until a table has about ``most`` rows. The second value is true
    for a part of a run of more than ``most`` rows, which is passed on in parts.
    """
    held: list[pa.RecordBatch] = []
    rows, hot = 0, None

    def cut(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        keys = table.column(key).to_numpy()
        at = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
        return table.slice(0, at), table.slice(at)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        if hot is not None:
            end = int(np.searchsorted(keys, hot, side="right"))
            if end:
                yield table.slice(0, end), True
            table = table.slice(end)
            if table.num_rows:
                hot = None
        whole, rest = cut(table)
        if whole.num_rows:
            yield whole, False
        if rest.num_rows > most:
            hot = rest.column(key)[-1].as_py()
            yield rest, True
            rest = rest.slice(0, 0)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        table = pa.Table.from_batches(held)
        if hot is not None and table.num_rows:
            end = int(np.searchsorted(table.column(key).to_numpy(), hot, side="right"))
            if end:
                yield table.slice(0, end), True
            table = table.slice(end)
        if table.num_rows:
            yield table, False
