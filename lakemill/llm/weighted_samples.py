"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its runs of five lower-cased words, weighted by how often they occur.
For a term k of weight w, a sample takes r and c of Gamma(2, 1) and b of [0, 1), fixed by a hash of
sample and term, sets t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the document
takes the (k, t) of least a. Two documents take the same one with a probability that equals their
generalised Jaccard similarity: the sum of least over the sum of largest weights.

The hash picks one of 65,536 triples (r, c, b), made once by rule; equal values of a, which long
texts have, are told apart by the hash of the term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.common import batch, buffers, mix, parts, windows, words
from lakemill.session import materialise

SAMPLES = 64  # a multiple of four
WIDTH = 5
DIGITS = 4  # hex digits a sample
TRIPLES = 1 << 16
SLICE_BYTES = 200_000  # texts whose terms are sampled together

_KIND_ROW, _KIND_FIRST, _KIND_LAST = 0, 1, 2
_PAIRS = pa.schema(
    [
        ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
        ("near_next", pa.float64()), ("text", pa.string()),
    ]
)
_PAIRS_DDL = (
    "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double, text string"
)


def _uniform(seed: int) -> np.ndarray:
    """Even values inside (0, 1), one per triple."""
    drawn = mix(np.arange(TRIPLES, dtype=np.uint64), seed) >> np.uint64(12)
    return (drawn.astype(np.float64) + 0.5) / 2.0**52


# a sum of two exponential variates is one of Gamma(2, 1)
_R = -np.log(_uniform(1) * _uniform(2))
_LN_C = np.log(-np.log(_uniform(3) * _uniform(4)))
_B = _uniform(5)
_LOW = np.uint64(2**32 - 1)


def _ordered(ln_a: np.ndarray) -> np.ndarray:
    """ln a as an unsigned number of the same order in the upper half of 64 bits."""
    lifted = (ln_a + 256).astype(np.float32)  # positive, whatever the weight
    return lifted.view(np.uint32).astype(np.uint64) << np.uint64(32)


_WEIGHT_ONE = _ordered(_LN_C - _R * (1 - _B))  # t = floor(b) = 0


def _weighted_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, weight, bounds by text): distinct runs of WIDTH words; a text of fewer words is
    one term, one without words has none."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    hashes, at = words(data, bounds, lower=True)
    runs = windows(hashes, WIDTH)
    each, sizes = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = runs[lo : hi - WIDTH + 1] if hi - lo >= WIDTH else windows(hashes[lo:hi], hi - lo)
        own = own if hi > lo else runs[:0]
        terms, counts = np.unique(own, return_counts=True)
        each.append((terms, counts))
        sizes.append(len(terms))
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    if not ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), ends
    return np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each]), ends


def sample_texts(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """(text, sample): 16 bits that name the (k, t) taken; rows of texts without words are zero."""
    out = np.zeros((len(texts), samples), np.uint16)
    terms, counts, ends = _weighted_terms(texts)
    filled = np.flatnonzero(np.diff(ends))
    if not len(filled):
        return out
    starts = ends[:-1][filled]
    name = mix(terms) & _LOW
    heavy = np.flatnonzero(counts > 1)
    log_weight = np.log(counts[heavy])
    for first in range(0, samples, 4):
        picks = mix(terms, first + 1).view(np.uint16).reshape(-1, 4)
        for i in range(4):
            pick = picks[:, i]
            key = _WEIGHT_ONE.take(pick, mode="wrap")  # faster than an index
            key |= name
            if len(heavy):
                r, b, ln_c = _R[pick[heavy]], _B[pick[heavy]], _LN_C[pick[heavy]]
                t = np.floor(log_weight / r + b)
                step = t.astype(np.uint64) * np.uint64(0x9E3779B1)
                key[heavy] = _ordered(ln_c - r * (t - b + 1)) | ((name[heavy] + step) & _LOW)
            least = np.minimum.reduceat(key, starts)
            out[filled, first + i] = (mix(least & _LOW) >> np.uint64(48)).astype(np.uint16)
    return out


def _printed(row: np.ndarray, text: bytes) -> str:
    return row.astype(">u2").tobytes().hex() if text.split() else ""


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints, 0 to 1; those of texts without words are
    empty and equal to each other only."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        F.lit(0),
        lambda n, i: n
        + (
            left.substr(i * DIGITS + 1, F.lit(DIGITS)) == right.substr(i * DIGITS + 1, F.lit(DIGITS))
        ).cast("int"),
    )
    either_empty = (F.length(left) == 0) | (F.length(right) == 0)
    return F.when(either_empty, (left == right).cast("double")).otherwise(same / samples)


def _like(a: np.ndarray, b: np.ndarray, empty_a: bool, empty_b: bool) -> float:
    if empty_a or empty_b:
        return float(empty_a and empty_b)
    return float(np.count_nonzero(a == b)) / len(a)


def _utf8(column: pa.Array) -> Iterator[bytes]:
    data, bounds = buffers(column)
    for row in range(len(column)):
        yield data[bounds[row] : bounds[row + 1]].tobytes()


def _runs(sized: Iterable[tuple], limit: int = SLICE_BYTES) -> Iterator[list[tuple]]:
    run, held = [], 0
    for item in sized:
        run.append(item)
        held += len(item[-1])
        if held >= limit:
            yield run
            run, held = [], 0
    if run:
        yield run


def _fingerprint_rows(samples: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts(whole)):
            made = []
            for run in _runs((t,) for t in _utf8(b["_text"])):
                texts = [t for (t,) in run]
                made += map(_printed, sample_texts(texts, samples), texts)
            yield pa.RecordBatch.from_arrays(
                [b["_row"], b["_text"], pa.array(made, pa.string())],
                names=["_row", "_text", "_fingerprint"],
            )

    return rows


def with_fingerprints(
    docs: DataFrame, name: str = "fingerprint", text: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """`docs` with the fingerprint of a text column, replacing a column of that name.

    A fingerprint has four hex digits a sample; a null text or one without words has the empty
    one. Equal texts have equal fingerprints. All other columns travel as one struct.
    """
    kept = [c for c in docs.columns if c not in (name, text)]
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept], F.lit(0).alias(f"_{name}")).alias("_row"),
        docs[f"`{text}`"].alias("_text"),
    )
    kind = packed.schema["_row"].dataType.simpleString()
    made = packed.mapInArrow(
        _fingerprint_rows(samples), f"_row {kind}, _text string, _fingerprint string"
    )
    columns = [
        (F.col("_text") if c == text else F.col("_row")[c]).alias(c)
        for c in docs.columns
        if c != name
    ]
    return made.select(*columns, F.col("_fingerprint").alias(name))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    size = len(text) // 4
    return text[: len(text) - size] + following[:size]


def _sampled_run(run: list[tuple[int | None, bytes, str]], samples: int) -> Iterator[tuple]:
    """One row for each document of a run but the last, which is the follower of the one before."""
    changed = [
        edited(a[2], b[2]).encode() for a, b in zip(run[:-1], run[1:], strict=True)
    ]
    texts = [r[1] for r in run]
    drawn = sample_texts(texts + changed, samples)
    bare = [not t.split() for t in texts + changed]
    n = len(run)
    for i, (doc, _, text) in enumerate(run[:-1]):
        yield (
            doc, len(text), hashlib.sha256(changed[i]).hexdigest(), _printed(drawn[i], texts[i]),
            _printed(drawn[n + i], changed[i]),
            _like(drawn[i], drawn[n + i], bare[i], bare[n + i]),
            _like(drawn[i], drawn[i + 1], bare[i], bare[i + 1]),
        )


def _pair_rows(samples: int):
    """One sorted partition: every document with its follower in it; its first and its last text
    go on, to be paired across partitions."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(kind, doc, text):
            empty = [None] * 5
            return batch(_PAIRS, [kind], [part], [doc], [len(text)], *[[e] for e in empty], [text])

        def documents():
            for b in (p for whole in batches for p in parts(whole)):
                for doc, raw in zip(b["doc_id"].to_pylist(), _utf8(b["text"]), strict=True):
                    yield doc, raw.decode(), raw

        last = None
        for run in _runs(documents()):
            own = [(doc, raw, text) for doc, text, raw in run]
            if last is None:
                yield edge(_KIND_FIRST, own[0][0], own[0][2])
            made = list(_sampled_run(own if last is None else [last, *own], samples))
            last = own[-1]
            if made:
                n = len(made)
                yield batch(
                    _PAIRS, [_KIND_ROW] * n, [part] * n, *zip(*made, strict=True), [None] * n
                )
        if last is not None:
            yield edge(_KIND_LAST, last[0], last[2])

    return rows


def _edge_rows(samples: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, 1)):
            doc, text, following = (b[c][0].as_py() for c in ("doc_id", "text", "following"))
            pair = [(doc, text.encode(), text), (None, following.encode(), following)]
            (made,) = _sampled_run(pair, samples)
            yield batch(_PAIRS, [_KIND_ROW], [0], *[[m] for m in made], [None])

    return rows


def edit_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    of every row of `docs` (doc_id, text).

    The next document is that of the next larger doc_id, after the last the first; a null doc_id
    comes first, and rows of one doc_id follow each other by a hash of their texts. A null text is
    empty; a text without words has the empty fingerprint, which is like itself only. A single row
    is its own follower; an empty table gives no rows. Further columns are ignored.

    Texts are range-partitioned once, sorted and streamed, so a document meets its follower in its
    own task; only the two edge texts of each partition are paired through a table.
    """
    tie = F.xxhash64("text")
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_tie", tie)
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )
    made = materialise(
        ordered.select("doc_id", "text").mapInArrow(_pair_rows(samples), _PAIRS_DDL), "fingerprints"
    )
    # one narrow row per partition decides which follows which
    order = Window.orderBy("part")
    held = made.where(F.col("kind") == _KIND_LAST).select("part")
    follows = held.select(
        "part", F.lead("part").over(order).alias("next"), F.min("part").over(Window.partitionBy()).alias("least")
    ).select("part", F.coalesce("next", "least").alias("next"))
    first = made.where(F.col("kind") == _KIND_FIRST).select(
        F.col("part").alias("next"), F.col("text").alias("following")
    )
    last = made.where(F.col("kind") == _KIND_LAST).select("part", "doc_id", "text")
    edges = last.join(follows, "part").join(first, "next").select("doc_id", "text", "following")
    columns = [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next",
    ]
    return (
        made.where(F.col("kind") == _KIND_ROW)
        .select(*columns)
        .unionByName(edges.mapInArrow(_edge_rows(samples), _PAIRS_DDL).select(*columns))
    )
