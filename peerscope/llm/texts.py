"""How the operators read texts, ids and folds, and run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peerscope.llm.hashing import CHUNK_BYTES, chunks, text_column

#: Stands for a null ``doc_id`` inside the operators; sorts before all others.
NO_ID = -(1 << 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return df[f"`{column.replace('`', '``')}`"].alias(column)


def row_struct(docs: DataFrame) -> Column:
    """The caller's row but for its text, as the struct ``row``; never without a field."""
    spare = "_" * (1 + max(len(c) for c in docs.columns))
    return F.struct(F.lit(0).alias(spare), *[named(docs, c) for c in docs.columns if c != "text"]).alias("row")


def doc_texts(docs: DataFrame, *more: str, rows: bool = False) -> DataFrame:
    """``doc_id`` (never null) and ``text``; other columns only if named.

    With ``rows`` the caller's row, but for its text, goes along as the struct ``row``.
    """
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id")
    whole = [row_struct(docs)] if rows else []
    return docs.select(key, docs["text"].cast("string").alias("text"), *[docs[c] for c in more], *whole)


def caller_rows(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The rows that ``doc_texts(docs, rows=True)`` took along, as ``columns`` again, with ``text`` as their text."""
    text = F.col("text") if text is None else text
    return df.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in columns])


def public_id() -> Column:
    """``doc_id`` as the caller gave it."""
    return F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")


def fold(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    text = F.when(column != NO_ID, column.cast("string"))
    return F.crc32(F.coalesce(text, F.lit(""))) % parts


def map_texts(
    df: DataFrame,
    function: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict | None],
    schema: str | StructType,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Run ``function(rows, data, offsets)`` over slices of about ``chunk_bytes`` of text.

    ``data[offsets[i]:offsets[i + 1]]`` is the UTF-8 text of row ``i``. A longer
    text is a slice of its own, so memory follows the longest single text. The
    function returns columns by name, in the order of ``schema``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for first, after in chunks(offsets, chunk_bytes):
                out = function(batch.slice(first, after - first), data, offsets[first:after + 1])
                if out is not None:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) if not isinstance(v, pa.Array) else v for k, v in out.items()})

    return df.mapInArrow(run, schema)


def arrow_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column: row ``i`` is ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def flat_structs(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row and fields of every entry of a list of structs; null lists are empty."""
    lengths = np.array(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), {
        f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)
    }


def struct_lists(bounds: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """A column of lists of structs from the fields of all entries."""
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def most_frequent(counted: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts of the stored ``(token, n)`` with the highest counts, at most ``limit`` of them.

    A histogram of the counts gives the lowest count that still fits, so no task
    sorts more than it has and the driver gets no more than ``limit`` rows.
    Counts within a hundredth of each other are taken together or not at all.
    """
    step = F.floor(F.log2("n") * 64)
    cutoff, room = None, limit
    for row in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["step"]):
        room -= row["tokens"]
        if room < 0:
            break
        cutoff = row["step"]
    if cutoff is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counted.filter(step >= cutoff).toArrow()
    return top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
