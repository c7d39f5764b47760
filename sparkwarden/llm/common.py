"""What the operators of this subpackage share: table reads and Arrow helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.session import prepare


#: The operators work on whole batches at once, which larger ones make cheaper.
BATCH_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def byte_list(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as the empty text."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def text_list(array: pa.Array) -> list[str]:
    """The strings of a text column, null as the empty text."""
    return [x or "" for x in array.to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows of about ``most`` text bytes each; a longer text is a run of its own."""
    texts = byte_list(batch.column(column))
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def pieces(text: bytes, between: re.Pattern[bytes], size: int) -> Iterator[bytes]:
    """Cut a text into pieces of ``size`` bytes or more, each but the last ending before a match of ``between``.

    A word longer than that is not cut, so no piece ends inside a word.
    """
    start = 0
    while start < len(text):
        found = between.search(text, start + size) if start + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def batch_of(columns: Iterable[tuple[str, object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from (name, values, type)."""
    names, arrays = [], []
    for name, values, kind in columns:
        names.append(name)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use yet; names are compared without case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
