"""BPE encoding and decoding with a vocabulary file of the tokenizers library.

Encoding does not replay merges. An Aho-Corasick automaton gives the longest token at each
place; tokens are laid end to end, longest first, and a pair is allowed only if no merge could
have crossed its border earlier. A dead end marks its place and steps back, so each place is
tried a bounded number of times and the result is exactly that of the merges. Decoding looks ids
up in one byte buffer through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakemill.llm.common import batch, parts

VOCABULARY = "word_bpe_49k.json"
END = "Ā"  # stands for the end-of-word mark; every other symbol is a byte
MOST_KNOWN = 40_000  # entries per generation that a worker's cache keeps
MOST_UNITS = 140_000  # of the cache of whole words
MOST_BYTES = 40  # longer keys are not kept, so a full cache is a few ten megabytes

LATIN_END = "\u0250"  # the library's own splitter takes texts with later characters


def _latin_pieces() -> re.Pattern:
    """The splitting pattern of the vocabulary (a fixed value of the file), with its classes of
    letters and numbers written out up to LATIN_END."""
    kinds = [(c, unicodedata.category(c)[0]) for c in map(chr, range(ord(LATIN_END)))]
    letters, numbers = (re.escape("".join(c for c, k in kinds if k == want)) for want in "LN")
    spaces = r" \t\n\r\f\v\x85\xa0"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
    )


_LATIN_PIECES = _latin_pieces()


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Two generations of what `make` gives: a full young one becomes the old one."""

    def __init__(self, make, most: int = MOST_KNOWN):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MOST_BYTES:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Encoder:
    """The model of a vocabulary file with byte symbols and an end-of-word mark."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbols = spec["model"], byte_symbols()
        self.mark = model["end_of_word_suffix"] or ""
        plain = {}
        for token, number in model["vocab"].items():
            end = bool(self.mark) and token.endswith(self.mark)
            body = token[: -len(self.mark)] if end else token
            plain[token] = "".join(chr(symbols[c]) for c in body) + END * end
        self.number = {plain[t]: n for t, n in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.packed = {t: n.to_bytes(4, "little") for t, n in self.number.items()}
        self.names = {n: t for t, n in model["vocab"].items()}
        self.names |= {n: t for t, n in self.special.items()}

        self.merged: dict[tuple[str, str], int] = {}  # pair -> rank
        self.halves: dict[str, tuple[str, str]] = {}
        self.rank: dict[str, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            left, right = plain[left], plain[right]
            self.merged.setdefault((left, right), rank)
            if left + right not in self.halves:
                self.halves[left + right] = (left, right)
                self.rank[left + right] = rank
        self.whole: dict[str, bool] = {}
        automaton = ahocorasick.Automaton()
        for token in self.number:
            if self._stands(token):
                automaton.add_word(token, (token, len(token) - 1))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = {t: self._shorter(t) for t in self.number if self.whole.get(t)}
        self.allowed = Cache(self._allowed)
        self.pieces = Cache(self._encode)

    def _crossed(self, left: str, right: str, limit: float) -> bool:
        """Whether a merge of lower rank than `limit` joins text across the border.

        Undo the two tokens' merges, the latest first. What was at the border before a merge was
        undone could have merged across it only at a lower rank; of equal merges the left one
        comes first.
        """
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < limit:
                return True
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return False
            if a > b:
                left, limit = self.halves[left][1], a
            else:
                right, limit = self.halves[right][0], b + 1

    def _stands(self, token: str) -> bool:
        """Whether the token's own text is encoded as this one token."""
        known = self.whole.get(token)
        if known is None:
            if token not in self.halves:
                known = len(token) == 1 or (len(token) == 2 and token[1] == END)
            else:
                left, right = self.halves[token]
                known = (
                    self._stands(left)
                    and self._stands(right)
                    and not self._crossed(left, right, self.rank[token])
                )
            self.whole[token] = known
        return known

    def _shorter(self, token: str) -> str:
        """The next longest token that begins this one, or nothing."""
        for size in range(len(token) - 1, 0, -1):
            if self.whole.get(token[:size]):
                return token[:size]
        return ""

    def _allowed(self, pair: tuple[str, str]) -> bool:
        return not self._crossed(*pair, float("inf"))

    def tokens(self, text: str) -> list[str]:
        """Tokens of one piece, given as one character per byte with the end mark."""
        size = len(text)
        longest: list[str] = [""] * size
        for end, (token, back) in self.automaton.iter(text):
            longest[end - back] = token  # ends come in order: a later match is the longer one
        end = size - 1 if text.endswith(END) else -1  # the mark is no token by itself
        allowed, laid, place, last = self.allowed, [], 0, ""
        while place < size:  # mostly the longest tokens fit together
            token = longest[place]
            place += len(token)
            if not token or place == end or (last and not allowed[last, token]):
                break
            laid.append(token)
            last = token
        else:
            return laid
        usable = [True] * (size + 1)
        if end >= 0:
            usable[end] = False
        laid: list[str] = []
        place, token = 0, longest[0]
        while place < size:
            last = laid[-1] if laid else ""
            while token:
                if usable[place + len(token)] and (not last or self.allowed[last, token]):
                    break
                token = self.shorter[token]
            if token:
                laid.append(token)
                place += len(token)
                token = longest[place] if place < size else ""
            elif laid:
                usable[place] = False
                token = laid.pop()
                place -= len(token)
            else:
                raise ValueError("the vocabulary has no tokens for some bytes")
        return laid

    def _encode(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1") + (END if self.mark else "")
        if self.whole.get(text):  # a word that is one token
            return self.packed[text]
        return b"".join([self.packed[t] for t in self.tokens(text)])

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        return self.pieces[piece.encode("utf-8")]


class WordEncoder(Encoder):
    """Encodes texts as the library does with this file: NFC, lower case, pieces by pattern."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        spec["model"] |= {"vocab": {}, "merges": []}  # normaliser and splitter are enough
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.plain_bytes = {ord(c): b for c, b in byte_symbols().items()}
        self.units = Cache(self._unit, MOST_UNITS)
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(names) + ")") if names else None

    def _unit(self, unit: bytes) -> bytes:
        """Ids of a run without ASCII white space."""
        if unit.isalpha():  # ASCII letters alone are one piece
            return self._encode(unit.lower())
        text = unicodedata.normalize("NFC", unit.decode("utf-8", "replace")).lower()
        if text and max(text) < LATIN_END:
            pieces = [p.encode("utf-8") for p in _LATIN_PIECES.findall(text)]
        else:
            text = unit.decode("utf-8", "replace")
            split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            pieces = [p.translate(self.plain_bytes).encode("latin-1") for p, _ in split]
        return b"".join([self.units[p] if p.isalpha() else self.pieces[p] for p in pieces])

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text and self.specials is not None:
            pieces = self.specials.split(text.decode("utf-8", "replace"))
            if len(pieces) > 1:
                return b"".join(
                    np.array([self.special[p]], "<u4").tobytes()
                    if p in self.special
                    else self.encode_plain(p.encode("utf-8"))
                    for p in pieces
                )
        return self.encode_plain(text)

    def encode_plain(self, text: bytes) -> bytes:
        if text.isascii():  # others are composed before they are lower-cased
            text = text.lower()
        return b"".join(map(self.units.__getitem__, text.split()))


class Decoder:
    """One buffer with all tokens, and where each id's begins; tokens are joined by a space, as
    the library does for a file without a decoder."""

    def __init__(self, names: dict[int, str]):
        size = max(names) + 1
        tokens = [names.get(i, "").encode("utf-8") for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.data = b"".join(tokens)
        o = self.offsets.tolist()
        self.tokens = [self.data[a:b] for a, b in zip(o, o[1:], strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b" ".join([tokens[i] for i in ids])


_encoders: dict[str, WordEncoder] = {}
_decoders: dict[str, Decoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _decoder(path: str) -> Decoder:
    if path not in _decoders:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = {n: t for t, n in spec["model"]["vocab"].items()}
        _decoders[path] = Decoder(names | {t["id"]: t["content"] for t in spec["added_tokens"]})
    return _decoders[path]


def vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids, null doc_ids stay null, repeated rows are encoded one by
    one, further columns are ignored. Names of special tokens in a text become their ids.
    """
    path = vocabulary_path(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for part in parts(b, 200):
                texts = part["text"].cast(pa.binary())
                yield batch(_IDS, part["doc_id"], [encoder.encode(t.as_py() or b"") for t in texts])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = vocabulary_path(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for b in batches:
            for part in parts(b, 200):
                texts = [
                    decoder.decode(np.frombuffer(i.as_py() or b"", "<u4").tolist()).decode()
                    for i in part["ids"]
                ]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


class _Digests:
    """Digests of ids, and of the text that they decode to."""

    def __init__(self, path: str):
        self.decoder = _decoder(path)
        self.decimal = [b"%d" % i for i in range(len(self.decoder.tokens))]

    def of(self, doc_ids: pa.Array, encoded: list[bytes]) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for packed in encoded:
            ids = np.frombuffer(packed, "<u4").tolist()
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(b" ".join([self.decimal[i] for i in ids])).hexdigest())
            out[2].append(hashlib.sha256(self.decoder.decode(ids)).hexdigest())
        return batch(_DIGESTS, doc_ids, *out)


_DIGEST_TYPES = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids); the ids are decoded."""
    path = vocabulary_path(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Digests(path)
        for b in batches:
            for part in parts(b, 200):
                yield made.of(part["doc_id"], [i.as_py() or b"" for i in part["ids"]])

    return encoded.select("doc_id", "ids").mapInArrow(rows, _DIGEST_TYPES)


def text_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`digests(encode(docs))` in one pass, so that ids do not travel between two."""
    path = vocabulary_path(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = _encoder(path), _Digests(path)
        for b in batches:
            for part in parts(b, 200):
                texts = part["text"].cast(pa.binary())
                yield made.of(part["doc_id"], [encoder.encode(t.as_py() or b"") for t in texts])

    return docs.select("doc_id", "text").mapInArrow(rows, _DIGEST_TYPES)
