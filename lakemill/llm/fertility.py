"""Quality rules: word statistics and the fertility of public tokenizer vocabularies.

A vocabulary that was made for natural text cuts it into long, varied pieces. Junk (symbol runs,
random characters, one phrase over and over) takes more pieces per character, falls back to bytes,
or uses few different pieces. Bands per script say how far a text may go.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import SPACES, batch, buffers, mix, parts, slices

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
VOCABULARY = "piece_bpe_32k.model"

# Per script: least characters per piece, largest share of byte pieces, least entropy of the
# pieces as a share of the largest that their number allows. Applied from BAND_PIECES pieces on.
# Random Han characters and syllables reach 0.33 and 0.91 or worse. `other` has no limit on byte
# pieces: languages that the vocabulary spells in bytes (Lao: 0.93) look like noise there.
BANDS = {
    "latin": (1.15, 0.25, 0.35),
    "cyrillic": (1.0, 0.30, 0.30),
    "greek": (0.7, 0.40, 0.25),
    "arabic": (0.6, 0.50, 0.25),
    "cjk": (0.4, 0.85, 0.25),
    "other": (0.25, 1.0, 0.20),
}
# Latin texts of ASCII letters, up to ASCII_SHARE: random letters reach 1.56, labelled clean texts of
# sf0.1 have 1.65 or more. Languages with many marked letters (Vietnamese: 1.26) keep the band above.
ASCII_BAND = (1.6, 0.25, 0.35)
ASCII_SHARE = 0.95
BAND_PIECES = 64
_SCRIPTS = tuple(BANDS)
_RANGES = (
    (0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC0, 0x24F, 0), (0x370, 0x3FF, 2), (0x400, 0x52F, 1),
    (0x600, 0x6FF, 3), (0x3040, 0x30FF, 4), (0x3400, 0x9FFF, 4), (0xAC00, 0xD7AF, 4),
)

_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("chars_per_token", pa.float64()),
        ("byte_share", pa.float64()),
        ("entropy_share", pa.float64()),
        ("script", pa.string()),
    ]
)
TYPES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double,"
    " byte_share double, entropy_share double, script string"
)

MOST_WORDS = 60_000  # words whose pieces a worker keeps


class _Pieces:
    """Pieces of words: a flat array of ids, with an entry per known word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[bytes] = []  # of each known word, int32

    def of(self, text_words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Number of each word among the distinct ones; adds the pieces of new ones."""
        known = self.known
        new = list({w for w in text_words if w not in known})
        if new:
            plain = [w.decode("utf-8", "replace") for w in new]
            at = len(self.ids)
            known.update((w, at + i) for i, w in enumerate(new))
            pieces = self.model.encode(plain, num_threads=1)
            self.ids.extend(struct.pack(f"={len(p)}i", *p) for p in pieces)
        return np.fromiter((known[w] for w in text_words), np.int64, len(text_words)), self.ids


_loaded: dict[str, _Pieces] = {}


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    return np.frombuffer(b"".join(ids), np.int32), sizes


def _gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a run of words, and how many each word has."""
    starts = np.cumsum(sizes) - sizes
    counts = sizes[which]
    total = int(counts.sum())
    shift = np.repeat(starts[which] - (np.cumsum(counts) - counts), counts)
    return flat[np.arange(total) + shift], counts


def _mostly_ascii(text: str) -> bool:
    """Whether ASCII letters are ASCII_SHARE of a Latin text's letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    low = points | 0x20
    plain = int(np.count_nonzero((low >= 0x61) & (low <= 0x7A) & (points < 0x80)))
    marked = int(np.count_nonzero((points >= 0xC0) & (points <= 0x24F)))
    marked += int(np.count_nonzero((points >= 0x1E00) & (points <= 0x1EFF)))
    return plain >= ASCII_SHARE * (plain + marked)


def _script(text: str) -> int:
    """The script of most letters, over the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    counts = [0] * len(_SCRIPTS)
    for lo, hi, script in _RANGES:
        counts[script] += int(np.count_nonzero((points >= lo) & (points <= hi)))
    best = int(np.argmax(counts))
    return best if counts[best] else len(_SCRIPTS) - 1


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def _repeated(numbers: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    count = len(numbers) - 2
    if count < 2:
        return 0
    n = numbers.astype(np.uint64)
    keys = mix(mix(mix(n[:count], 1) + n[1 : count + 1], 2) + n[2:], 3)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(numbers), bool)
    for step in range(3):
        hit[step : step + count] |= twice
    return int(hit.sum())


def _entropy_share(pieces: np.ndarray) -> float:
    if len(pieces) < 2:
        return 1.0
    counts = np.unique(pieces, return_counts=True)[1] / len(pieces)
    return float(-(counts * np.log(counts)).sum() / np.log(len(pieces))) + 0.0


def _limits(bands: dict | None) -> dict:
    """The bands with a caller's own; one for `latin` holds for ASCII letters, too."""
    own = bands or {}
    return BANDS | {"ascii": own.get("latin", ASCII_BAND)} | own


def _measure(path: str, bands: dict, min_words: int):
    limits = [bands[s] for s in _SCRIPTS]
    ascii_limits = bands["ascii"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = _Pieces(path)
        model = _loaded[path]
        for b in batches:
            data, bounds = buffers(b["text"])
            for first, last in slices(bounds):
                texts = [
                    data[bounds[i] : bounds[i + 1]].tobytes() for i in range(first, last)
                ]
                split = [t.split() for t in texts]
                if len(model.known) > MOST_WORDS:
                    model.clear()
                numbers, ids = model.of([w for s in split for w in s])
                used, compact = np.unique(numbers, return_inverse=True)
                flat, sizes = _flat([ids[i] for i in used.tolist()])
                pieces, per_word = _gather(flat, sizes, compact)
                at = np.cumsum([0] + [len(s) for s in split])
                piece_at = np.concatenate([[0], np.cumsum(per_word)])[at]
                out: list[list] = [[] for _ in _OUT]
                for i, text in enumerate(texts):
                    n = int(at[i + 1] - at[i])
                    own = pieces[piece_at[i] : piece_at[i + 1]]
                    squeezed = text.translate(None, SPACES)
                    plain = squeezed.decode("utf-8", "replace")
                    repeat = _repeated(numbers[at[i] : at[i + 1]])
                    failed = n < min_words or 100 * repeat > 50 * n
                    script = 0 if squeezed.isascii() and n else _script(plain)
                    per_token = len(plain) / max(1, len(own))
                    share = float(model.is_byte[own].mean()) if len(own) else 0.0
                    entropy = _entropy_share(own)
                    ascii_only = script == 0 and (squeezed.isascii() or _mostly_ascii(plain))
                    least, most, varied = ascii_limits if ascii_only else limits[script]
                    good = len(own) < BAND_PIECES or (
                        per_token >= least and share <= most and entropy >= varied
                    )
                    values = (
                        n, len(plain), len(text) - len(text.translate(None, SYMBOLS)),
                        _duplicate_lines(text), repeat, failed, not failed and good,
                        per_token, share, entropy, _SCRIPTS[script],
                    )
                    for column, value in zip(out[1:], values, strict=True):
                        column.append(value)
                out[0] = b["doc_id"].slice(first, last - first)
                yield batch(_OUT, *out)

    return rows


def measure_quality(
    docs: DataFrame,
    vocabulary: str | None = None,
    bands: dict[str, tuple[float, float, float]] | None = None,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Statistics and verdict of every row of `docs` (doc_id, text), from whole texts.

    `vocabulary` is the path of a sentencepiece model that every executor can read, by default the
    installed public one; `bands` overrides the limits of single scripts, or of `ascii`. A text fails with fewer
    than `min_words` words, with over half its words in repeated three-word windows, or outside
    the band of the script that most of its letters have. A null text has no words and fails; a
    null doc_id stays null; repeated rows are judged one by one; further columns are ignored.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    judge = _measure(vocabulary, _limits(bands), min_words)
    return docs.select("doc_id", "text").mapInArrow(judge, TYPES)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with their own columns: judged in place, so no join moves the texts."""
    others = docs.columns
    place = others.index("text")
    struct = F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row")
    kind = docs.select(struct).schema["_row"].dataType.simpleString()
    if options.get("vocabulary") is None:
        import public_tokenizers

        options["vocabulary"] = public_tokenizers.path(VOCABULARY)
    judge = _measure(
        options["vocabulary"],
        _limits(options.get("bands")),
        options.get("min_words", MIN_WORDS),
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                text = part["_row"].flatten()[place]  # a slice of the field, too
                texts = pa.RecordBatch.from_arrays(
                    [pa.nulls(len(part), pa.int64()), text], names=["doc_id", "text"]
                )
                yield part.filter(pa.concat_arrays([j["kept"] for j in judge(iter([texts]))]))

    passed = docs.select(struct).mapInArrow(rows, f"_row {kind}")
    return passed.select(*(F.col("_row")[c].alias(c) for c in others))
