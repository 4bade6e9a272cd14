"""Small helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts handled at once inside a batch, in bytes: bounds the arrays that a kernel builds beside the batch.
CHUNK_BYTES = 1 << 20


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose texts have about limit bytes (one text may have more), with null read as empty.

    Only one slice's texts are Python strings at a time.
    """
    for batch in batches:
        place = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
        start = size = 0
        for k, n in enumerate([*sizes, limit + 1]):
            if k > start and size + n > limit:
                part = batch.slice(start, k - start)
                yield part, [t or "" for t in part.column(place).to_pylist()]
                start, size = k, 0
            size += n


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the given schema from arrays or lists."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal first column from sorted batches; each run is held whole, so runs have to be bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
        if held and held[0].column(0)[0].as_py() != node[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cuts[0])]).combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                yield pa.Table.from_batches([batch.slice(a, b - a)])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
