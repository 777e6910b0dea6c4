"""N-gram Jaccard join by parity sketches, exact.

A set's sketch XORs the hash of every shingle into one of many words, chosen by the hash. Two sets
that differ in d shingles have sketches that differ in at most d words, so of any d + 1 words of
one set at least one is equal in the other. Sets are put into bands by size (powers of two) that
fix the number of words; each set sends the first d + 1 of its words in one common order, where d
is the most that any partner in the band may differ. Equal words make candidates. A sketch of
single bits (two to four per shingle) screens them: its Hamming distance is at most the symmetric
difference. What is left is verified on the sets themselves.

Words made of frequent shingles come last in the order, so a passage that many documents share
hardly makes candidates. A shingle is frequent by what slices of the texts report that hold it more
than once, so the bar follows the root of the table and not its size. Groups of more than a few sets with an equal word are not paired:
each is tied to the group's first, and only where verified links leave a group in several
components are pairs across components screened, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import batch, mix, shingle_sets, signed
from lakemill.llm.components import components
from lakemill.session import materialise

WIDTH = 5
SIMILARITY = (75, 100)
HOT_IN_SLICE = 2  # sets of a slice from which on a shingle is reported
HOT_REPORTED = 8  # reported sets from which on it is frequent
MOST_HOT = 1_000_000  # frequent shingles sent to all executors: the most frequent ones
SMALL_GROUP = 8  # sets with an equal word that are paired directly
BLOCK = 1024  # sets per block where pairs across components are screened
KEYS_PER_BUCKET = 1_000_000
SINGLE_BELOW = 5  # in bands below, each shingle is a word of its own

_U = np.uint64


def most_different(n: int, m: int, similarity: tuple[int, int]) -> int:
    """The largest symmetric difference of sets of n and m shingles that are similar enough."""
    num, den = similarity
    return (n + m) * (den - num) // (den + num)


def fingerprint(shingles: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    return int(np.add.reduce(mix(shingles, 1), dtype=np.uint64)) if len(shingles) else 0


# --- first scan: sizes, identities, frequent shingles -------------------------------------------

_FACTS = pa.schema(
    [
        ("kind", pa.int32()),  # 0: a document, 1: a frequent shingle (f) and its count (n)
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("f", pa.int64()),
        ("sketch", pa.binary()),
    ]
)
FACT_TYPES = "kind int, doc_id long, n long, f long, sketch binary"
MOST_BROADCAST = 500_000  # document ids that may be sent to all executors


def _describe(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                many = counts >= HOT_IN_SLICE
                n = int(many.sum())
                yield batch(
                    _FACTS, np.ones(n, np.int32), pa.nulls(n, pa.int64()), counts[many],
                    signed(values[many]), pa.nulls(n, pa.binary()),
                )

        for b in batches:
            counts, prints, sketches = [], [], []
            for _, shingles in shingle_sets(b["text"], width):
                counts.append(len(shingles))
                prints.append(fingerprint(shingles))
                sketches.append(bit_sketch(shingles).tobytes() if len(shingles) else None)
                if prints[-1] in seen:  # copies are one set
                    continue
                seen.add(prints[-1])
                held.append(shingles)
                size += len(shingles)
                if size >= 1_500_000:
                    yield from frequent()
                    held, size = [], 0
                    seen.clear()
            n = len(counts)
            yield batch(
                _FACTS, np.zeros(n, np.int32), b["doc_id"], counts,
                signed(np.array(prints, dtype=np.uint64)), sketches,
            )
        yield from frequent()

    return rows


# --- second scan: words of the sketches ---------------------------------------------------------


def _words(shingles: np.ndarray, hot: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty sketch words of a sorted set, and which consist of frequent shingles only."""
    if band < SINGLE_BELOW:
        return mix(shingles, 100 + band), hot
    part = shingles >> _U(64 - (band + 1))
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    value = np.bitwise_xor.reduceat(mix(shingles, 3), first)
    words = mix(value + part[first] * _U(0xD6E8FEB86659FD93), 200 + band)
    return words, np.logical_and.reduceat(hot, first)


def sketch_keys(
    shingles: np.ndarray, hot: np.ndarray, similarity: tuple[int, int]
) -> list[np.ndarray]:
    """The words that a set sends: for its own band, and for the band below if it has partners
    there. A set with too few words to promise an equal one sends a mark that says so, too."""
    num, den = similarity
    n = len(shingles)
    own = n.bit_length() - 1
    sent = []
    for band, largest in ((own, n * den // num), (own - 1, (1 << own) - 1)):
        if band < own and (band < 0 or -(-n * num // den) > largest):
            continue
        take = most_different(n, largest, similarity) + 1
        words, late = _words(shingles, hot, band)
        if len(words) < take:
            mark = mix(np.array([band], dtype=np.uint64), 999)
            sent.append(np.concatenate([words, mark]))
            continue
        early = words[~late]
        if len(early) >= take:
            sent.append(np.partition(early, take - 1)[:take])
        else:
            sent += [early, np.sort(words[late])[: take - len(early)]]
    return sent


def _pack(keys: np.ndarray, owner: np.ndarray, prints: np.ndarray) -> bytes:
    """48 bits of each key, and its owner's place in a list of the owners met here."""
    owners, place = np.unique(owner, return_inverse=True)
    kind = np.uint16 if len(owners) <= 65536 else np.uint32
    return b"".join(
        (
            np.array([len(keys), len(owners)], np.uint32).tobytes(),
            prints[owners].tobytes(),
            (keys & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
            ((keys >> _U(32)) & _U(0xFFFF)).astype(np.uint16).tobytes(),
            place.astype(kind).tobytes(),
        )
    )


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    count, owners = np.frombuffer(payload, np.uint32, 2).tolist()
    at = 8
    prints = np.frombuffer(payload, np.uint64, owners, at)
    at += 8 * owners
    low = np.frombuffer(payload, np.uint32, count, at)
    at += 4 * count
    high = np.frombuffer(payload, np.uint16, count, at)
    at += 2 * count
    kind = np.uint16 if owners <= 65536 else np.uint32
    place = np.frombuffer(payload, kind, count, at)
    return low.astype(np.uint64) | (high.astype(np.uint64) << _U(32)), prints[place]


def _send(width: int, similarity: tuple[int, int], buckets: int, frequent):
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(frequent.value, dtype=np.uint64)
        keys: list[np.ndarray] = []
        sizes: list[int] = []
        prints: list[int] = []
        seen: set[int] = set()
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(keys)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            own = np.array(prints, dtype=np.uint64)
            bucket = ((every >> _U(32)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                pick = order[bounds[b] : bounds[b + 1]]
                yield batch(schema, [b], [_pack(every[pick], owner[pick], own)])

        for b in batches:
            for _, shingles in shingle_sets(b["text"], width):
                if not len(shingles):
                    continue
                print_ = fingerprint(shingles)
                if print_ in seen:  # a copy sends the same words
                    continue
                seen.add(print_)
                late = np.zeros(len(shingles), bool)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
                    late = hot[at] == shingles
                sent = sketch_keys(shingles, late, similarity)
                keys += sent
                sizes.append(sum(map(len, sent)))
                prints.append(print_)
                total += sizes[-1]
                if total >= 2_000_000:
                    yield from flush()
                    keys, sizes, prints, total = [], [], [], 0
                    seen.clear()
        if sizes:
            yield from flush()

    return rows


# --- candidates ---------------------------------------------------------------------------------

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("many", pa.int32())])


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return [c[new] for c in columns]


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of one bucket: all of a small group, those with the first set of a larger one."""
    parts = [_unpack(p.as_py()) for p in table["payload"]]
    keys, prints = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for size in range(2, SMALL_GROUP + 1):
        at = starts[sizes == size]
        for i in range(size - 1):
            for j in range(i + 1, size):
                found.append((prints[at + i], prints[at + j], 0))
    large = sizes > SMALL_GROUP
    rest = np.repeat(sizes[large] - 1, sizes[large] - 1)
    first = np.repeat(starts[large], sizes[large] - 1)
    step = np.arange(len(rest)) - np.repeat(
        np.cumsum(sizes[large] - 1) - (sizes[large] - 1), sizes[large] - 1
    )
    found.append((prints[first], prints[first + 1 + step], 1))
    a, b, many = _distinct(
        np.concatenate([f[0] for f in found]),
        np.concatenate([f[1] for f in found]),
        np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found]),
    )
    return pa.Table.from_batches([batch(_PAIRS, signed(a), signed(b), many)])


# --- screening and verifying --------------------------------------------------------------------


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of two to four bits per shingle; folding halves gives the next narrower sketch."""
    bits = max(64, 4 << (len(shingles).bit_length() - 1))
    odd = np.bincount((mix(shingles, 5) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _sets(width: int):
    schema = pa.schema([("f", pa.int64()), ("members", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints: list[int] = []
            members: list[bytes] = []
            size = 0

            def part() -> pa.RecordBatch:
                return batch(schema, signed(np.array(prints, np.uint64)), members)  # noqa: B023

            for _, shingles in shingle_sets(b["text"], width):
                if not len(shingles):
                    continue
                prints.append(fingerprint(shingles))
                members.append(shingles.tobytes())
                size += len(shingles)
                if size > 500_000:
                    yield part()
                    prints, members, size = [], [], 0
            yield part()

    return rows


def _screen(similarity: tuple[int, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, n, m in zip(
                b["_x"], b["_y"], b["na"].to_pylist(), b["nb"].to_pylist(), strict=True
            ):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum())
                keep.append(apart <= most_different(n, m, similarity))
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _verify(similarity: tuple[int, int]):
    num, den = similarity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["_x"], b["_y"], strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _with(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """`column` of both sets of each pair."""
    right = sets.select(F.col("f").alias("b"), F.col(column).alias("_y"))
    left = sets.select(F.col("f").alias("a"), F.col(column).alias("_x"))
    return pairs.join(right, "b").join(left, "a")


def _across(similarity: tuple[int, int], nearest: bool):
    """Pairs of one cell, block against block, that are in different components and pass; or the
    nearest partner alone of each set."""
    num, den = similarity

    def pairs(table: pa.Table) -> pa.Table:
        block, f, n, label = (table[c].to_numpy() for c in ("block", "f", "n", "label"))
        sketches = [np.frombuffer(s.as_py(), np.uint64) for s in table["sketch"]]
        lo, hi = int(block.min()), int(block.max())
        right = np.flatnonzero(block == hi)
        classes: dict[int, np.ndarray] = {}
        for width in {len(sketches[i]) for i in right.tolist()}:
            classes[width] = np.array([i for i in right.tolist() if len(sketches[i]) == width])
        folded: dict[tuple[int, int], np.ndarray] = {}
        out: list[list[np.ndarray]] = [[], []]
        for i in np.flatnonzero(block == lo).tolist():
            for width, members in classes.items():
                words = min(width, len(sketches[i]))
                if (width, words) not in folded:
                    folded[width, words] = _fold(np.stack([sketches[j] for j in members]), words)
                small, large = np.minimum(n[members], n[i]), np.maximum(n[members], n[i])
                fits = (label[members] != label[i]) & (den * small >= num * large)
                if lo == hi:
                    fits &= members > i
                if not fits.any():
                    continue
                apart = np.bitwise_count(
                    folded[width, words][fits] ^ _fold(sketches[i], words)
                ).sum(axis=1, dtype=np.int64)
                passing = apart <= (n[members][fits] + n[i]) * (den - num) // (den + num)
                near = members[fits][passing]
                if nearest and len(near):
                    near = near[[int(np.lexsort((f[near], apart[passing]))[0])]]
                out[0].append(np.minimum(f[near], f[i]))
                out[1].append(np.maximum(f[near], f[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    return pairs


def _frequent(facts: DataFrame) -> np.ndarray:
    """The frequent shingles, or the most frequent ones where they are too many to be sent."""
    counted = (
        facts.where("kind = 1")
        .groupBy("f")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= HOT_REPORTED)
    )
    counted = materialise(counted, "frequent")
    steps = F.floor(8 * F.log2("n"))  # a few hundred steps, whatever the counts
    held, lowest = 0, None
    for step, n in sorted(counted.groupBy(steps).count().collect(), reverse=True):
        held += n
        if held > MOST_HOT:
            break
        lowest = step
    if lowest is None:
        return np.zeros(0, np.int64)
    return counted.where(steps >= lowest).select("f").toArrow()["f"].to_numpy()


def _candidates(docs: DataFrame, facts: DataFrame, width: int, similarity) -> DataFrame:
    """(a, b, many): identities of sets that have a sketch word in common."""
    spark = docs.sparkSession
    total = facts.where("kind = 0").agg(F.sum("n")).first()[0]
    frequent = np.sort(_frequent(facts).view(np.uint64))
    buckets = max(
        2 * int(spark.conf.get("spark.sql.shuffle.partitions")),
        int(total or 0) // 2 // KEYS_PER_BUCKET,
    )
    sent = docs.select("text").mapInArrow(
        _send(width, similarity, buckets, spark.sparkContext.broadcast(frequent.tobytes())),
        "bucket int, payload binary",
    )
    met = sent.groupBy("bucket").applyInArrow(_meet, "a long, b long, many int")
    return met.groupBy("a", "b").agg(F.max("many").alias("many"))


def _links(docs: DataFrame, facts: DataFrame, width: int, similarity) -> DataFrame:
    """(node, label) of every set that is linked with another one."""
    num, den = similarity
    classes = materialise(
        facts.where("kind = 0 AND n > 0")
        .groupBy("f")
        .agg(
            F.min("n").alias("n"),
            F.min("doc_id").alias("first_doc"),
            F.any_value("sketch").alias("sketch"),
        ),
        "classes",
    )
    sizes = classes.select("f", "n")
    pairs = (
        _candidates(docs, facts, width, similarity)
        .join(sizes.select(F.col("f").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("f").alias("b"), F.col("n").alias("nb")), "b")
    )
    pairs = materialise(pairs, "candidates")

    def screened(found: DataFrame) -> DataFrame:
        fits = found.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        return _with(fits, classes, "sketch").mapInArrow(
            _screen(similarity), "a long, b long, na long, nb long"
        )

    def sets_of(found: DataFrame) -> DataFrame:
        """The sets of all ends of some pairs, from the texts of the classes' first documents."""
        ends = found.select(F.col("a").alias("f")).union(found.select("b")).distinct()
        wanted = ends.join(classes.select("f", "first_doc"), "f").select(
            F.col("first_doc").alias("doc_id")
        )
        wanted = materialise(wanted.distinct(), "wanted")
        few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        texts = docs.select("doc_id", "text").join(
            F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"
        )
        made = texts.select("text").mapInArrow(_sets(width), "f long, members binary")
        return materialise(made, "sets")

    def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
        return _with(found.select("a", "b"), sets, "members").mapInArrow(
            _verify(similarity), "a long, b long"
        )

    passed = materialise(screened(pairs.drop("many")), "screened")
    links = materialise(verified(passed, sets_of(passed)), "links")
    labels = components(links)

    # Larger groups, by their first set: all of one are in one component, or blocks are compared.
    # As long as nearest partners are mostly links, components at least halve where they can; what
    # is apart after that is compared whole.
    large = pairs.where("many = 1")
    held = large.select(F.col("a").alias("first"), F.col("b").alias("f"), F.col("nb").alias("n"))
    held = materialise(held.union(large.select("a", "a", "na")).distinct(), "groups")
    nearest = True
    while True:
        blocks = _split_groups(held, labels)
        if blocks.limit(1).count() == 0:
            return labels
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        cells = (
            blocks.select("first", "f", "n", "label", "block", other.alias("_other"))
            .withColumn("_lo", F.least("block", "_other"))
            .withColumn("_hi", F.greatest("block", "_other"))
            .join(classes.select("f", "sketch"), "f")
        )
        crossed = (
            cells.groupBy("first", "_lo", "_hi")
            .applyInArrow(_across(similarity, nearest), "a long, b long")
            .distinct()
        )
        crossed = materialise(crossed, "crossed")
        left = crossed.count()
        if not left:  # a set has a nearest partner wherever any pair of it passes
            return labels
        late = materialise(verified(crossed, sets_of(crossed)), "links")
        new = late.count()
        if new:
            links = links.union(late)
            labels = components(links)
        if not nearest:
            return labels
        nearest = 10 * new >= left  # few were links: compare the rest whole


def _split_groups(held: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the groups that are in several components, with their blocks."""
    named = held.join(labels.withColumnRenamed("node", "f"), "f", "left").withColumn(
        "label", F.coalesce("label", "f")
    )
    named = materialise(named, "groups")
    split = (
        named.groupBy("first")
        .agg(F.count("*").alias("_size"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        .where("_lo < _hi")
        .withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
        .select("first", "_blocks")
    )
    return named.join(split, "first").withColumn(
        "block", F.pmod(F.xxhash64("f"), F.col("_blocks")).cast("int")
    )


def similar_documents(
    docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    A document's set holds the distinct runs of `width` words (white space apart, A-Z lower-cased);
    a text with fewer words is one shingle; one without words, or null, has an empty set and is
    linked with nothing. Sets link when the similarity (a fraction of two integers) is reached.
    component_id is the smallest doc_id reachable. Repeated rows count as one document; a null
    doc_id stays null in both columns and links nothing. Further columns are ignored. Sets and
    shingles are told apart by 64-bit hashes.
    """
    known = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    facts = materialise(
        docs.select("doc_id", "text").mapInArrow(
            _describe(width), FACT_TYPES
        ),
        "sets",
    )
    own = facts.where("kind = 0")
    labels = _links(known, facts.where("kind = 1 OR doc_id IS NOT NULL"), width, similarity)
    first = own.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("first_doc"))
    first = first.join(labels.withColumnRenamed("node", "f"), "f", "left")
    first = first.withColumn("label", F.coalesce("label", "f"))
    smallest = first.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of_set = first.join(smallest, "label").select("f", "component_id")
    alone = own.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    linked = own.where("n > 0 AND doc_id IS NOT NULL").join(of_set, "f")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns."""
    groups = similar_documents(docs, **options).where("doc_id = component_id OR doc_id IS NULL")
    kept = groups.select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
