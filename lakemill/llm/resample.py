"""Target-distribution importance resampling: hashed n-gram counts of two tables weigh documents,
and Gumbel noise fixed by the document number draws a share of them without replacement.

Texts are tokenised once: the buckets of their features are stored in the shared folder, 2 bytes a
feature, and both the histogram and the weights are read from there. What is gathered over the
corpus has one number per bucket; the driver holds those few thousand gains and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from lakemill.llm.common import ASCII_LOWER, batch, buffers, byte_table, parts
from lakemill.operators.relational import dense_row_numbers
from lakemill.session import materialise, spread

BUCKETS = 10_000  # at most 65,536, as a bucket is stored in two bytes
SEED = 7
PERCENT = 25
MIN_WORDS = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE_BYTES = 500  # the splitter's cost a word grows with the piece it is given

_BETWEEN = ~byte_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
_WEIGHTS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")]
)


def splitter() -> pre_tokenizers.PreTokenizer:
    """The words of a lower-cased text, with their places; nothing is trained."""
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of runs of about PIECE_BYTES that end after a byte between words."""
    if len(text) <= 2 * PIECE_BYTES:
        yield 0, text
        return
    ends = np.flatnonzero(_BETWEEN[np.frombuffer(text, np.uint8)]) + 1
    at = 0
    while at < len(text):
        next_cut = int(np.searchsorted(ends, at + PIECE_BYTES))
        end = int(ends[next_cut]) if next_cut < len(ends) else len(text)
        yield at, text[at:end]
        at = end


def word_offsets(split: pre_tokenizers.PreTokenizer, text: bytes) -> list[int]:
    """start, end, start, end, ... of the words of a lower-cased UTF-8 text, in bytes."""
    out: list[int] = []
    for at, piece in _pieces(text):
        found = PreTokenizedString(piece.decode())
        split.pre_tokenize(found)
        edges = chain.from_iterable([s[1] for s in found.get_splits("original", "byte")])
        out.extend([at + e for e in edges] if at else edges)
    return out


def feature_codes(text: bytes, offsets: list[int]) -> list[int]:
    """The unsigned CRC of every word, then of every two neighbours joined by one space.

    A window of two words is a pair of offset pairs: its CRC goes on from that of its first word.
    """
    words = [text[s:e] for s, e in zip(offsets[::2], offsets[1::2], strict=True)]
    single = list(map(crc32, words))
    spaced = [b" " + w for w in words[1:]]
    return [*single, *map(crc32, spaced, single)]


def _feature_rows(buckets: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for b in (part for whole in batches for part in parts(whole)):
            data, bounds = buffers(b["text"])
            sizes, made = [], []
            for row in range(len(b)):
                text = ASCII_LOWER[data[bounds[row] : bounds[row + 1]]].tobytes()
                offsets = word_offsets(split, text)
                codes = np.array(feature_codes(text, offsets), dtype=np.int64)
                sizes.append(len(offsets) // 2)
                made.append((codes % buckets).astype("<u2").tobytes())
            yield batch(_FEATURES, b["doc_id"], sizes, made)

    return rows


def features(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets) per row of (doc_id, text), in the shared folder: the bucket of
    each feature as two bytes, words first, then pairs."""
    return materialise(
        spread(texts).mapInArrow(
            _feature_rows(buckets), "doc_id long, n_words long, buckets binary"
        ),
        "features",
    )


def _count_rows(buckets: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, bounds = buffers(b["buckets"])
            own = data[bounds[0] : bounds[-1]]
            total += np.bincount(own.view("<u2"), minlength=buckets)
        held = np.flatnonzero(total)
        yield batch(_COUNTS, held, total[held])

    return rows


def histogram(made: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): a task sends one row per bucket, however many features it has read."""
    counted = made.select("buckets").mapInArrow(_count_rows(buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: thousandths of the log ratio of target to source, both
    smoothed by one feature a bucket."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = (
        every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .na.fill(0)
    )
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    of_target = (F.col("t") + 1).cast("double") * float(totals.all_s + buckets)
    of_source = (F.col("s") + 1).cast("double") * float(totals.all_t + buckets)
    return both.select("bucket", F.floor(1000 * F.ln(of_target / of_source)).alias("gain"))


def _weight_rows(gain: np.ndarray):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts(whole)):
            data, bounds = buffers(b["buckets"])
            codes = data[bounds[0] : bounds[-1]].view("<u2")
            ends = (bounds - bounds[0]) // 2
            sums = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(gain[codes], out=sums[1:])
            total, size = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
            yield batch(_WEIGHTS, b["doc_id"], b["n_words"], size, total // np.maximum(size, 1))

    return rows


def weights(made: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features."""
    table = np.zeros(buckets, np.int64)
    for row in gain.collect():  # one row a bucket
        table[row.bucket] = row.gain
    return made.mapInArrow(
        _weight_rows(table), "doc_id long, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel value, fixed by seed and number; a null number is empty."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the N rows with `min_words`, the
    floor(percent * N / 100) of highest score get a rank.

    Scores are whole numbers of a narrow range, so their counts give the last score drawn; only
    rows from there on are sorted. Ranks are places in the sorted files: no window, and equal
    on a retry. Ties go to the smaller doc_id, null last.
    """
    able = F.col("n_words") >= min_words
    counts = sorted(
        scored.where(able).groupBy("score").count().collect(), key=lambda r: -r["score"]
    )
    quota = sum(r["count"] for r in counts) * percent // 100
    last, seen = None, 0
    for row in counts:
        if seen >= quota:
            break
        last, seen = row["score"], seen + row["count"]
    rank = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, rank)
    inside = able & (F.col("score") >= last)
    sorted_rows = materialise(
        scored.where(inside)
        .select(*columns)
        .orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()),
        "drawn",
    )
    placed = dense_row_numbers(sorted_rows, "place")
    drawn = placed.select(*columns, F.when(F.col("place") <= quota, F.col("place")).alias("rank"))
    return drawn.unionByName(scored.where(~inside).select(*columns, rank))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, for every row of `docs` (doc_id, text).

    Words are those of WORD in the text with A-Z lower-cased, features are words and pairs of
    neighbours. `target` (text) is what the draw is to resemble. A null or empty text has no
    features and weight 0 and is never drawn; repeated rows count and are drawn as rows of their
    own; an empty target gives gains from the smoothing alone, an empty `docs` no rows. Further
    columns are ignored.
    """
    made = features(docs.select(F.col("doc_id").cast("long"), "text"), buckets)
    wanted = features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), buckets)
    gain = gains(histogram(made, buckets), histogram(wanted, buckets), buckets)
    scored = materialise(
        weights(made, gain, buckets).withColumn(
            "score", F.col("weight") + noise(F.col("doc_id"), seed)
        ),
        "scores",
    )
    return draw(scored, percent, min_words)


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents that were drawn, with all their columns; rows of one doc_id go together.
    Rows without doc_id are not returned."""
    chosen = ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn_doc")).distinct()
    return docs.join(chosen, docs["doc_id"] == F.col("_drawn_doc"), "left_semi")
