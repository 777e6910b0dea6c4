"""Token-id files: ids of all documents in doc_id order, packed by Re-Pair grammars.

A file row is one shard: some million ids of consecutive documents. Its grammar is found in
rounds: count all neighbouring pairs, give the most frequent ones a nonterminal each, replace them
from left to right. Rules, the length that each nonterminal expands to, and where each document's
symbols and ids begin are kept, so that one document can be decoded without the others. Symbols
take two bytes. Shards are rows of Parquet files, which Spark writes and commits as a whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.bpe import byte_symbols
from lakemill.llm.common import batch, buffers, slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 2_000_000
FIRST_RULE = 50_304  # above all ids of the vocabulary; rules end below 2**16
MOST_RULES = 2**16 - FIRST_RULE
ROUNDS = 6
LEAST_COUNT = 12  # occurrences that a rule needs

# The splitting pattern of byte-level vocabularies (a fixed value of the file's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# The same for texts without neighbouring white space, where it needs no look-ahead.
SIMPLE = PATTERN.replace(r"\s+(?!\S)|", "")
_RUNS = re.compile(r"\s\s")


class ByteEncoder:
    """Ids of texts as the tokenizers library gives them, by the faster of the libraries: the
    vocabulary's ids are the ranks of its merges. Texts with special tokens go to the library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        ranks = {bytes(symbols[c] for c in token): n for token, n in vocab.items()}
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            if vocab[left + right] != 256 + n:
                raise ValueError("ids of the vocabulary do not follow its merges")
        self.any, self.simple = (
            tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})
            for p in (PATTERN, SIMPLE)
        )
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]

    def encode(self, text: bytes) -> np.ndarray:
        plain = text.decode("utf-8", "replace")
        if any(s in plain for s in self.special):
            ids = self.library.encode(plain, add_special_tokens=False).ids
        elif _RUNS.search(plain):
            ids = self.any.encode_ordinary(plain)
        else:
            ids = self.simple.encode_ordinary(plain)
        return np.array(ids, dtype="<u4")


_encoders: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, places): rule r is the pair rules[r], named FIRST_RULE + r; places are
    where in `ids` each symbol begins. No rule holds the end id, so documents begin at symbols."""
    symbols = ids.astype(np.uint32)
    places = np.arange(len(ids), dtype=np.uint32)
    rules: list[np.ndarray] = []
    known = 0
    for _ in range(ROUNDS):
        if len(symbols) < 2 or known >= MOST_RULES:
            break
        left, right = symbols[:-1], symbols[1:]
        keys = (left.astype(np.uint64) << np.uint64(16)) | right
        barred = (left == end_id) | (right == end_id)
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
        slot[barred] = 0
        counts = np.bincount(slot, minlength=1 << 20)
        counts[0] = 0
        # a slot may hold several pairs, so this bounds a pair's count from above
        share = max(4096, (MOST_RULES - known) // 2)
        above = np.cumsum(np.bincount(np.minimum(counts, 65_535))[::-1])  # slots by least count
        bar = max(LEAST_COUNT, len(above) - 1 - int(np.searchsorted(above, share)))
        often = np.flatnonzero((counts >= bar)[slot])
        if not len(often):
            break
        places_of, own = slot[often], keys[often]
        pair = np.zeros(1 << 20, dtype=np.uint64)  # one pair per slot, likely its most frequent
        pair[places_of] = own
        same = pair[places_of] == own
        often, places_of = often[same], places_of[same]
        exact = np.bincount(places_of, minlength=1 << 20)
        good = np.flatnonzero(exact >= bar)
        if len(good) > MOST_RULES - known:
            good = good[np.argsort(-exact[good], kind="stable")[: MOST_RULES - known]]
        if not len(good):
            break
        name = np.full(1 << 20, -1, dtype=np.int32)
        name[good] = np.arange(known, known + len(good))
        named = name[places_of]
        at, named = often[named >= 0], named[named >= 0]
        run = np.concatenate([[True], np.diff(at) > 1])  # overlapping pairs: every other one
        start = at[np.flatnonzero(run)][np.cumsum(run) - 1]
        chosen = (at - start) % 2 == 0
        at, named = at[chosen], named[chosen]
        symbols[at] = (named + FIRST_RULE).astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        before = len(symbols)
        symbols, places = symbols[keep], places[keep]
        new = pair[good]
        rules.append(
            np.stack([new >> np.uint64(16), new & np.uint64(0xFFFF)], axis=1).astype(np.uint16)
        )
        known += len(good)
        if before - len(symbols) < before // 100:
            break
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    return symbols.astype(np.uint16), table, places


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    lengths: list[int] = []
    for left, right in rules.tolist():
        lengths.append(
            (lengths[left - FIRST_RULE] if left >= FIRST_RULE else 1)
            + (lengths[right - FIRST_RULE] if right >= FIRST_RULE else 1)
        )
    return np.array(lengths, dtype=np.uint32)


class Grammar:
    """Expansions of all symbols in one buffer, by their stored lengths."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray):
        self.size = np.ones(FIRST_RULE + len(rules), dtype=np.int64)
        self.size[FIRST_RULE:] = lengths
        self.start = np.cumsum(self.size) - self.size
        self.data = np.zeros(int(self.size.sum()), dtype=np.uint32)
        self.data[:FIRST_RULE] = np.arange(FIRST_RULE)
        start, size = self.start.tolist(), self.size.tolist()
        for i, (left, right) in enumerate(rules.tolist()):
            at, cut = start[FIRST_RULE + i], size[left]
            self.data[at : at + cut] = self.data[start[left] : start[left] + cut]
            more = size[right]
            self.data[at + cut : at + cut + more] = self.data[start[right] : start[right] + more]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.size[symbols]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.start[symbols] - (ends - sizes), sizes)
        return self.data[np.arange(len(shift)) + shift]


_SHARDS = pa.schema(
    [
        ("shard", pa.int32()),  # of consecutive documents, in order
        ("part", pa.int32()),  # within the shard
        ("before", pa.int64()),  # ids in earlier parts of the shard
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("id_ends", pa.binary()),  # uint32, by document
        ("symbol_ends", pa.binary()),  # uint32, by document
        ("rules", pa.binary()),  # uint16 pairs
        ("lengths", pa.binary()),  # uint32, by rule
        ("symbols", pa.binary()),  # uint16
    ]
)
SHARD_TYPES = (
    "shard int, part int, before long, n_ids long, doc_ids array<long>, id_ends binary,"
    " symbol_ends binary, rules binary, lengths binary, symbols binary"
)


def _shards(path: str, end_id: int, shard_ids: int):
    end = np.array([end_id], dtype="<u4")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        shard = TaskContext.get().partitionId()
        part = before = 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        ends = [0]

        def packed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            symbols, rules, places = compress(ids, end_id)
            return batch(
                _SHARDS, [shard], [part], [before], [len(ids)], [docs],
                [np.array(ends[1:], np.uint32).tobytes()],
                [np.searchsorted(places, ends[1:]).astype(np.uint32).tobytes()],
                [rules.tobytes()], [expansion_lengths(rules).tobytes()], [symbols.tobytes()],
            )

        for b in batches:
            data, bounds = buffers(b["text"])
            numbers = b["doc_id"].to_pylist()
            for first, last in slices(bounds):
                for i in range(first, last):
                    ids = encoder.encode(data[bounds[i] : bounds[i + 1]].tobytes())
                    docs.append(numbers[i])
                    held += [ids, end]
                    ends.append(ends[-1] + len(ids) + 1)
                    if ends[-1] >= shard_ids:
                        yield packed()
                        part, before = part + 1, before + ends[-1]
                        docs, held, ends = [], [], [0]
        if docs:
            yield packed()

    return rows


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Write the ids of `docs` (doc_id, text) to `path`, in ascending doc_id order.

    Null and empty texts have the end id alone; rows without doc_id come first; repeated rows are
    all written, in the order of their texts' hashes; an empty table writes no shard. Further
    columns are ignored. A text of any length belongs to one shard.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_shards(vocabulary, end_id, shard_ids), SHARD_TYPES).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_TYPES).parquet(path)


def _decoded(b: pa.RecordBatch) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(row, doc_ids, id_ends, ids) of each shard row."""
    for i in range(len(b)):
        rules = np.frombuffer(b["rules"][i].as_py(), np.uint16).reshape(-1, 2)
        lengths = np.frombuffer(b["lengths"][i].as_py(), np.uint32)
        symbols = np.frombuffer(b["symbols"][i].as_py(), np.uint16)
        ids = Grammar(rules, lengths).expand(symbols).astype("<u4")
        ends = np.frombuffer(b["id_ends"][i].as_py(), np.uint32).astype(np.int64)
        yield i, b["doc_ids"][i].as_py(), ends, ids


_IDS = pa.schema(
    [("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())]
)
_DIGESTS = pa.schema(
    [
        ("shard", pa.int32()),
        ("doc_id", pa.int64()),
        ("at", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def _documents(digest: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, docs, ends, ids in _decoded(b):
                starts = np.concatenate([[0], ends[:-1]])
                own = [ids[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                shard = np.full(len(docs), b["shard"][i].as_py(), np.int32)
                at = starts + b["before"][i].as_py()
                if digest:
                    yield batch(_DIGESTS, shard, docs, at, ends - starts, [zlib.crc32(x) for x in own])
                else:
                    yield batch(_IDS, shard, docs, at, own)

    return rows


def _with_starts(spark: SparkSession, path: str, decoded: DataFrame) -> DataFrame:
    """Add what earlier shards hold: one row per shard goes through the unpartitioned window."""
    totals = read_shards(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_earlier"))
    return decoded.join(totals, "shard").withColumn("start", F.col("_earlier") + F.col("at"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document; ids as little-endian unsigned 32-bit integers."""
    decoded = read_shards(spark, path).mapInArrow(
        _documents(False), "shard int, doc_id long, at long, ids binary"
    )
    return _with_starts(spark, path, decoded).select("doc_id", "start", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    decoded = read_shards(spark, path).mapInArrow(
        _documents(True), "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return _with_starts(spark, path, decoded).select("doc_id", "start", "n_tokens", "ids_crc32")


def decode_document(shard, doc_id: int) -> np.ndarray:
    """The ids of one document of a shard row, from its own symbols alone."""
    i = list(shard["doc_ids"]).index(doc_id)
    ends = np.frombuffer(shard["symbol_ends"], np.uint32).tolist()
    rules = np.frombuffer(shard["rules"], np.uint16).reshape(-1, 2)
    grammar = Grammar(rules, np.frombuffer(shard["lengths"], np.uint32))
    symbols = np.frombuffer(shard["symbols"], np.uint16)
    return grammar.expand(symbols[ends[i - 1] if i else 0 : ends[i]])
