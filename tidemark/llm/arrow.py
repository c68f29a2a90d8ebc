"""Texts of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, empty for a null; one copy, no decoding."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def texts(column: pa.Array) -> Iterator[str]:
    """Each text, empty for a null."""
    for x in column:
        yield x.as_py() or ""


def parcels(df: DataFrame, key: str) -> DataFrame:
    """(key, parcel): the rows of each batch that share a long key, as compressed Arrow.

    Texts are shuffled at a third of their size, and a key gets a row per batch
    rather than per row.  ``open_parcels`` gives the rows back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            keys = batch.column(key_at).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            kinds, starts = np.unique(keys[order], return_index=True)
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(pc.take(batch, pa.array(order[a:b])))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(out, pa.binary())], names=["key", "parcel"])

    key_at = df.columns.index(key)
    return df.mapInArrow(run, "key long, parcel binary")


def open_parcels(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each parcel, in an order that doesn't depend on arrival."""
    for parcel in sorted(x for x in table["parcel"].to_pylist() if x is not None):
        with pa.ipc.open_stream(parcel) as stream:
            yield stream.read_all()
