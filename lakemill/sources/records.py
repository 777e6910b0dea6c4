"""Records of text files whose quoted texts hold record ends, read by many tasks.

A task that starts in the middle of a file cannot know whether it stands inside a quoted text. So
a first pass tells for every byte range and every state it might start in, in which state it ends
and how many records end in it. A running composition of those answers, one small row per range,
gives each range its true start. The second pass cuts records; the pieces at the edges of ranges,
two per range at most, are put together by record number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.session import materialise


@dataclass(frozen=True)
class Grammar:
    """How records end: state 0 is outside of all quotes, state i inside what `openers[i - 1]`
    opens. `outside` runs from outside up to an end, an opener without its closer, or the end of
    the chunk; `inside[i - 1]` runs from inside to behind the closer."""

    openers: tuple[str, ...]
    outside: str
    inside: tuple[str, ...]
    end: str

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    """A grammar with its patterns compiled, for one task."""

    def __init__(self, grammar: Grammar):
        self.openers, self.end = grammar.openers, grammar.end
        self.outside = re.compile(grammar.outside, re.S)
        self.inside = [re.compile(p, re.S) for p in grammar.inside]

    def scan(self, text: str, state: int) -> tuple[list[int], int]:
        """Places behind the record ends of a chunk of whole lines, and the state at its end."""
        at, ends, size = 0, [], len(text)
        if state:
            closed = self.inside[state - 1].match(text)
            if closed is None:
                return ends, state
            at = closed.end()
        while at < size:
            at = self.outside.match(text, at).end()
            if at >= size:
                break
            if text.startswith(self.end, at):
                at += len(self.end)
                ends.append(at)
                continue
            for i, opener in enumerate(self.openers, 1):
                if text.startswith(opener, at):
                    return ends, i
            raise ValueError(f"cannot read {text[at : at + 40]!r}")
        return ends, 0


def sql_grammar(escapes: bool = False) -> Grammar:
    r"""SQL statements end with `;`; quotes are doubled in texts and, with `escapes`, written `\'`.
    Comments hold no statement ends; `#` begins one in the dialect that has escapes."""
    plain = r"[^'\\]" if escapes else "[^']"
    extra = r"|\\." if escapes else ""
    single = f"(?:{plain}++|''{extra})*+'"
    double = single.replace("'", '"')
    comment = r"(?:[^*]++|\*(?!/))*+\*/"
    hash_comment = r"|#[^\n]*+" if escapes else "|#"
    outside = (
        rf"(?:[^'\"`;/\-#]++|'{single}|\"{double}|`[^`\n]*+`|/\*{comment}|--[^\n]*+"
        rf"{hash_comment}|/(?!\*)|-|`)*+"
    )
    return Grammar(("'", '"', "/*"), outside, (single, double, comment), ";")


def csv_grammar(delimiter: str = ",") -> Grammar:
    """CSV records end with a line break; a field is quoted if it starts with a quote."""
    cut = re.escape(delimiter)
    rest = rf"[^{cut}\n]*+"
    body = r'(?:[^"]++|"")*+"'
    field = rf'(?:"{body}{rest}|(?!"){rest})'
    # from outside: whole fields; from inside: the rest of the field, then whole fields
    outside = rf"{field}?+(?:{cut}{field})*+(?:{cut}(?=\"))?+"
    return Grammar(('"',), outside, (rf"{body}{rest}(?:{cut}{field})*+(?:{cut}(?=\"))?+",), "\n")


_RANGE = "file string, start bigint, ends array<int>, counts array<bigint>"
_PIECE = pa.schema(
    [("file", pa.string()), ("no", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()),
     ("value", pa.string())]
)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(file, range start, lines) in the order of the file; lines of one batch and range."""
    for b in batches:
        if not len(b):
            continue
        files = b["file"].dictionary_encode()
        places = np.stack([files.indices.to_numpy(), b["start"].to_numpy()])
        cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
        for first, last in pairwise([0, *cuts.tolist(), len(b)]):
            text = "\n".join(b["value"].slice(first, last - first).to_pylist()) + "\n"
            yield b["file"][first].as_py(), int(places[1, first]), text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _range_ends(grammar: Grammar):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, place, held = grammar.scanner(), None, []

        def made():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([place[0]]), pa.array([place[1]], pa.int64()),
                    pa.array([[s for s, _ in held]], pa.list_(pa.int32())),
                    pa.array([[n for _, n in held]], pa.list_(pa.int64())),
                ],
                names=["file", "start", "ends", "counts"],
            )

        for file, start, text in _chunks(batches):
            if (file, start) != place:
                if place is not None:
                    yield made()
                place, held = (file, start), [(s, 0) for s in range(len(grammar.openers) + 1)]
            known: dict[int, tuple[list[int], int]] = {}
            for i, (state, count) in enumerate(held):
                if state not in known:  # starts that have come to one state go on as one
                    known[state] = scanner.scan(text, state)
                ends, after = known[state]
                held[i] = (after, count + len(ends))
        if place is not None:
            yield made()

    return rows


def _starts(ranges: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(state, records before) of every range. One row per byte range, a list that the driver
    holds to plan the read anyway."""
    out = {}
    for row in ranges.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("start", "ends", "counts"))).alias("r")
    ).toLocalIterator():
        state, before = 0, 0
        for r in row.r:
            out[row.file, r.start] = (state, before)
            state, before = r.ends[state], before + r.counts[state]
    return out


def _pieces(grammar: Grammar, starts: dict[tuple[str, int], tuple[int, int]]):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, place, state, number, opened = grammar.scanner(), None, 0, 0, []
        edge = True  # the open piece begins where the range does

        def batch(made):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _PIECE, strict=True)],
                schema=_PIECE,
            )

        for file, start, text in _chunks(batches):
            made = []
            if (file, start) != place:
                if place is not None and opened:
                    made.append((place[0], number, place[1], False, "".join(opened)))
                place, opened, edge = (file, start), [], True
                if place not in starts:
                    raise ValueError(f"the byte ranges of {file} have changed between two reads")
                state, number = starts[place]
            ends, state = scanner.scan(text, state)
            at = 0
            for end in ends:
                opened.append(text[at:end])
                made.append((file, number, start, not edge, "".join(opened)))
                opened, edge, at = [], False, end
                number += 1
            if at < len(text):
                opened.append(text[at:])
            if made:
                yield batch(made)
        if place is not None and opened:
            yield batch([(place[0], number, place[1], False, "".join(opened))])

    return rows


def read_records(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """(file, no, value): the records of the text files at `path`, numbered within each file.

    A record is read whole, with the text that ends it; what stands behind the last end is a
    record if it is not blank. Line breaks are `\\n`; a `\\r` before one stays. Files are read by
    byte ranges, twice, and the cut records are written to the shared folder.
    """
    lines = _lines(spark, path)
    ranges = lines.mapInArrow(_range_ends(grammar), _RANGE)
    starts = _starts(materialise(ranges, "ranges"))
    cut = materialise(
        lines.mapInArrow(
            _pieces(grammar, starts), "file string, no bigint, start bigint, whole boolean, value string"
        ),
        "records",
    )
    whole = cut.filter("whole").select("file", "no", "value")
    pieces = F.sort_array(F.collect_list(F.struct("start", "value")))
    joined = cut.filter("NOT whole").groupBy("file", "no").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "").alias("value")
    )
    return whole.unionByName(joined).filter(~F.col("value").rlike(r"^\s*$"))
