"""Helpers shared by the operators: words and bounded Arrow batches; stored tables are those of the session."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.session import drop_stored, new_folder, stored  # noqa: F401

#: Fixed value: the white space that separates words; ASCII only, so it equals bytes.split().
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Text handled at once in a Python worker.
BATCH_BYTES = 8 << 20


def whole_text(text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between runs of ASCII white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        size = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for every i, joined."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(starts - before, lengths)]


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added while ``df`` has a column of that name."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted += "_"
    return wanted
