"""Line dedup: repeated lines stay only in the last document that holds them.

Line hashes are range-partitioned and sorted by document; each task streams through its runs with
a memory of one pending document. The range key includes the document, so a line that a third of
all documents hold is spread over many tasks; the run cut by a task's edge is settled by one
summary row per task and edge. The result is a compressed keep bitmap per document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakemill.llm.common import SPACES, batch, parts
from lakemill.session import materialise

MIN_CHARS = 20
MIN_DOCUMENTS = 3
KEEP = "_keep_bitmap"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LINES = pa.schema(
    [
        ("h1", pa.int64()),
        ("h2", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_lines", pa.int32()),
        ("lines", pa.binary()),
    ]
)
_DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_lines", pa.int64()),
        ("n_dropped", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)
# kind 0: lines to drop; 1: lines of a run that began in another task; 2: summary of an edge run
_FOUND = pa.schema([("kind", pa.int32()), *_LINES, ("n_docs", pa.int64())])


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts(whole, 2000)):
            out: list[list] = [[], [], [], [], []]
            size = 0
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                text = text.as_py()
                if doc is None or not text:
                    continue
                at: dict[bytes, list[int]] = {}
                lines = text.split(b"\n")
                for i, line in enumerate(lines):
                    key = line.strip(SPACES).translate(_LOWER)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        at.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
                for digest, places in at.items():
                    out[0].append(int.from_bytes(digest[:8], "big", signed=True))
                    out[1].append(int.from_bytes(digest[8:], "big", signed=True))
                    out[2].append(doc)
                    out[3].append(len(lines))
                    out[4].append(np.array(places, dtype=np.int32).tobytes())
                size += len(at)
                if size > 100_000:
                    yield batch(_LINES, *out)
                    out, size = [[], [], [], [], []], 0
            if size:
                yield batch(_LINES, *out)

    return rows


def _stream(min_documents: int):
    """One sorted task: rank the documents of each run, latest first; ranks from 1 on are dropped
    once the run is known to have `min_documents`."""

    def found(kind: int, part: pa.RecordBatch) -> pa.RecordBatch:
        n = len(part)
        return batch(_FOUND, np.full(n, kind, np.int32), *part.columns, pa.nulls(n, pa.int64()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = last_doc = top = None  # the open run, its last and its largest document
        rank, first = -1, True  # rank of last_doc; whether the open run is the task's first
        waiting: list[pa.RecordBatch] = []  # later documents of an open run that is still short

        def summary() -> pa.RecordBatch:
            return batch(_FOUND, [2], [run[0]], [run[1]], [top], [None], [None], [rank + 1])

        for b in batches:
            if not len(b):
                continue
            h1, h2, docs = (b[c].to_numpy() for c in ("h1", "h2", "doc_id"))
            new_run = np.ones(len(b), bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_run[0] = run != (int(h1[0]), int(h2[0]))
            new_doc = new_run.copy()
            new_doc[1:] |= docs[1:] != docs[:-1]
            new_doc[0] |= last_doc != int(docs[0])
            starts = np.flatnonzero(new_run)
            number = np.cumsum(new_doc)
            ranks = number - np.concatenate([[-rank], number[starts]])[np.cumsum(new_run)]
            edges = np.concatenate([[0], starts, [len(b)]])

            if edges[1]:  # goes on with the open run
                part, rank = b.slice(0, int(edges[1])), int(ranks[edges[1] - 1])
                if first:
                    yield found(1, part)
                else:
                    later = part.filter(pa.array(ranks[: edges[1]] >= 1))
                    waiting.append(later)
                    if rank + 1 >= min_documents:
                        yield from (found(0, w) for w in waiting)
                        waiting = []
            if len(starts):
                settled = 1
                if run is None:
                    yield found(1, b.slice(0, int(edges[2])))
                    run, top, rank = (int(h1[0]), int(h2[0])), int(docs[0]), int(ranks[edges[2] - 1])
                    settled = 2
                if len(starts) >= settled:
                    if first:
                        yield summary()
                    first = False
                    sizes = np.diff(edges)[settled:]
                    totals = np.repeat(ranks[edges[settled + 1 :] - 1] + 1, sizes)
                    own, later = b.slice(int(edges[settled])), ranks[edges[settled] :] >= 1
                    yield found(0, own.filter(pa.array(later & (totals >= min_documents))))
                    final = int(starts[-1])
                    run, top, rank = (int(h1[-1]), int(h2[-1])), int(docs[final]), int(ranks[-1])
                    waiting = []
                    if rank + 1 < min_documents:
                        waiting = [b.slice(final).filter(pa.array(ranks[final:] >= 1))]
            last_doc = int(docs[-1])
        if run is not None:
            yield summary()
            if not first:
                yield from (found(1, w) for w in waiting)

    return rows


def dropped_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(doc_id, n_lines, lines): int32 line numbers to drop, one row per document and line text."""
    line_type = "h1 long, h2 long, doc_id long, n_lines int, lines binary"
    lines = docs.select("doc_id", "text").mapInArrow(_line_rows(min_chars), line_type)
    dealt = lines.repartitionByRange(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        "h1", "h2", F.desc("doc_id"),
    ).sortWithinPartitions("h1", "h2", F.desc("doc_id"))
    found = materialise(
        dealt.mapInArrow(_stream(min_documents), f"kind int, {line_type}, n_docs long"),
        "line_runs",
    )
    edges = (
        found.where("kind = 2")
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("_docs"), F.max("doc_id").alias("_last"))
        .where(F.col("_docs") >= min_documents)
    )
    late = found.where("kind = 1").join(edges, ["h1", "h2"]).where("doc_id < _last")
    columns = ("doc_id", "n_lines", "lines")
    return found.where("kind = 0").select(*columns).unionByName(late.select(*columns))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dropped, maps = [], []
        for n, lines in zip(b["n_lines"].to_pylist(), b["parts"].to_pylist(), strict=True):
            keep = np.ones(n, dtype=bool)
            keep[np.frombuffer(b"".join(lines), dtype=np.int32)] = False
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            names=["doc_id", "n_dropped", "keep"],
        )


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(doc_id, n_dropped, keep) of the documents that lose lines.

    `keep` is a zlib-compressed bitmap, one bit per line from the highest bit of the first byte.
    Lines are those between newlines. A line's key is the line without ASCII white space at both
    ends and with A-Z lower-cased; keys of at least `min_chars` code points found in at least
    `min_documents` documents lose all their lines except in the largest doc_id. Rows without
    doc_id or text hold no lines; rows with equal doc_id count as one document, and get one bitmap
    if their texts are equal. Further columns are ignored.
    """
    per_doc = (
        dropped_lines(docs, min_chars, min_documents)
        .groupBy("doc_id")
        .agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("parts"))
    )
    return per_doc.mapInArrow(_bitmaps, "doc_id long, n_dropped long, keep binary")


def _kept(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    left = [line for line, k in zip(lines, keep.tolist(), strict=True) if k]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in parts(whole)):
        hashes, counts, gone = [], [], []
        for text, bitmap in zip(b["text"].cast(pa.binary()), b[KEEP], strict=True):
            left, n, dropped = _kept(text.as_py() or b"", bitmap.as_py())
            hashes.append(hashlib.sha256(left).hexdigest())
            counts.append(n)
            gone.append(dropped)
        yield batch(_DIGESTS, b["doc_id"], counts, gone, hashes)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    right = bitmaps.select(F.col("doc_id").alias("_kept_doc"), F.col("keep").alias(KEEP))
    return docs.join(right, F.col("doc_id") == F.col("_kept_doc"), "left").drop("_kept_doc")


def line_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row; a null text is one empty line."""
    return with_bitmaps(docs.select("doc_id", "text"), bitmaps).mapInArrow(
        _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents without their dropped lines; n_chars, where there is one, follows the text.

    Other columns travel as one struct, whatever their names and types.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("_rest"), "doc_id", "text")
    flagged = with_bitmaps(rows, bitmaps)
    cut = flagged.where(F.col(KEEP).isNotNull()).select("_rest", "text", KEEP)
    rest = StructType([cut.schema["_rest"]])
    fixed = cut.mapInArrow(_cut_texts, rest.add("_text", "string").add("_chars", "long"))
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.col("_chars").cast(docs.schema["n_chars"].dataType)
    columns = [(made[c] if c in made else F.col("_rest")[c]).alias(c) for c in docs.columns]
    same = [F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns]
    untouched = flagged.where(F.col(KEEP).isNull()).select(*same)
    return untouched.union(fixed.select(*columns))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in parts(whole)):
        made = [
            _kept(text.as_py() or b"", bitmap.as_py())[0]
            for text, bitmap in zip(b["text"].cast(pa.binary()), b[KEEP], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                b["_rest"],
                pa.array(made, pa.binary()).cast(pa.string()),
                pa.array([_code_points(t) for t in made], pa.int64()),
            ],
            names=["_rest", "_text", "_chars"],
        )
