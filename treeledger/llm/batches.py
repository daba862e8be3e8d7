"""Whole texts in Arrow batches: what the operators of this package share."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Work on one batch is cut so that no step holds more than about this many bytes of text at once.
SLICE_BYTES = 2 << 20


def with_results(df: DataFrame, reads: list[str], schema: str, compute: Callable, keep: list[str] | None = None) -> DataFrame:
    """The rows of a frame with columns that `compute` makes from the columns `reads`.

    compute gets one Arrow array per read column and returns one sequence per new column.
    Rows neither move nor change their number. Input columns named like a new one, in any
    case, give way to it. Only the kept and read columns are sent to Python. Columns are taken by
    their places, so dots in names and names used in here do no harm.
    """
    new = T._parse_datatype_string(schema)
    taken = {field.name.lower() for field in new.fields}
    kept = [name for name in (df.columns if keep is None else keep) if name.lower() not in taken]
    placed, fields = df.toDF(*[f"_{i}" for i in range(len(df.columns))]), df.schema.fields
    inputs, keys = [f"_read{i}" for i in range(len(reads))], [f"_kept{i}" for i in range(len(kept))]
    chosen = placed.select(*[F.col(f"_{place_of(df, name)}").alias(alias) for name, alias in zip([*kept, *reads], [*keys, *inputs])])
    own = [fields[place_of(df, name)] for name in kept]
    out = T.StructType([T.StructField(name, field.dataType, field.nullable) for name, field in zip(kept, own)] + new.fields)
    kinds = [_arrow_type(field.dataType) for field in new.fields]
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = compute(*[batch.column(name) for name in inputs])
            made = [pa.array(values, kind) for values, kind in zip(results, kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in keys], *made], names=names)

    return chosen.mapInArrow(run, out)


def place_of(df: DataFrame, name: str) -> int:
    """Where a column stands, by its exact name or else by it in any case."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def filtered(df: DataFrame, text: str, judge: Callable[[DataFrame, str], DataFrame], condition: str) -> DataFrame:
    """The rows that an operator's result lets through, with their own columns whatever these are called."""
    names = [f"_own{i}" for i in range(len(df.columns))]
    judged = judge(df.toDF(*names), names[df.columns.index(text)]).where(condition)
    return judged.select(*[F.col(name).alias(own) for name, own in zip(names, df.columns)])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes | None]]:
    """The texts as UTF-8, in lists of at least one text and not much more than `limit` bytes."""
    raw = texts.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(sizes)]):
        yield raw.slice(start, end - start).to_pylist()


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in any of the half-open spans."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0
