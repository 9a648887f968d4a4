"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``chars`` bytes of text each; a longer text goes alone or last in its range."""
    if not len(texts):
        return iter(())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // chars)) + 1
    bounds = [0, *edges.tolist(), len(texts)]
    return zip(bounds[:-1], bounds[1:], strict=True)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array with ``counts`` values a row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that hands unused memory back at the end of a partition: workers live on between stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped
