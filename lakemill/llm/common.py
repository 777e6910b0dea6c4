"""Arrow and numpy helpers that the text operators share.

Texts stay byte buffers: words, shingles and their 64-bit hashes come from a few numpy passes
over slices of a bounded size, so a worker's memory follows the slice, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 500_000
SPACES = b" \t\n\x0b\x0c\r"

_rng = np.random.Generator(np.random.PCG64(20240611))
_LETTERS = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_ROOT = 0x9E3779B97F4A7C17  # odd, 3 modulo 4
_ROOT_INVERSE = pow(_ROOT, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, size: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < size:
        steps = np.full(max(size, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if size <= SLICE_BYTES + 1:  # those of a longer text go with it
            _powers[base] = known
    return known[:size]


def byte_table(separators: Iterable[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


WORD_BYTES = byte_table(SPACES)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row bounds in them; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to `limit` bytes; a longer text is a run of its own."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def words(
    data: np.ndarray, bounds: np.ndarray, lower: bool
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space words of consecutive texts, and the word bounds by text."""
    base = int(bounds[0])
    text = data[base : int(bounds[-1])]
    edges = bounds - base
    size = len(text)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = WORD_BYTES[text]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = edges[:-1][edges[:-1] < size]
    starts[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = edges[1:][edges[1:] > 0] - 1
    ends[cut] = inside[cut]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    values = (_LETTERS[ASCII_LOWER] if lower else _LETTERS)[text] * _power(_ROOT, size)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_ROOT_INVERSE, size + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, edges)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; `windows(h, w)[i]` starts at word i."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, width, dtype=np.uint64)
    for step in range(width):
        total += hashes[step : step + count] * _STEPS[step]
    return mix(total)


def shingle_sets(
    column: pa.Array, width: int, lower: bool = True
) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); a shorter text is one shingle, one without words none."""
    data, bounds = buffers(column)
    for first, last in slices(bounds):
        hashes, at = words(data, bounds[first : last + 1], lower)
        runs = windows(hashes, width)
        for row in range(first, last):
            lo, hi = int(at[row - first]), int(at[row - first + 1])
            if hi - lo >= width:
                yield row, np.unique(runs[lo : hi - width + 1])
            else:
                yield row, windows(hashes[lo:hi], hi - lo) if hi > lo else runs[:0]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def parts(b: pa.RecordBatch, size: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, few at a time, so that what is made of them stays small."""
    for at in range(0, len(b), size):
        yield b.slice(at, size)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
            for c, f in zip(columns, schema, strict=True)
        ],
        schema=schema,
    )


# --- documents with any columns ------------------------------------------------------------------


def enclosed(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text): all columns of the caller in one struct, so that no name of theirs can
    meet one of an operator's."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, "doc_id", "text")


def disclosed(rows: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of `docs` back from `_row`, with a new text where `changed`; n_chars, where there
    is one, follows the text."""
    made = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(changed, size).otherwise(F.col("_row")["n_chars"])
    return rows.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
