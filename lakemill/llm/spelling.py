"""Spelling variants: words one edit apart, found with bitsets over (position, letter).

Words meet in blocks. One edit leaves all of a word but a region as it is, so a word is put, for
each half of its length, into the block of its other half. In a block only the region is compared:
bitsets per (position, letter) over the block's words, read at the query's letters, carry the set
without an error and the sets with one error along all words at once. A block that is too large is
dealt again with its region halved, down to regions of one letter, where the alphabet bounds it;
so a half that very many words share never meets in one task, and no pair is listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import batch
from lakemill.session import materialise, spread

# Fixed values of the text rules.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
SPOILED = 31  # one run in so many loses a letter

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10  # a form is so many times as frequent
BLOCK = 2048  # words of a block that is compared as a whole

_NEAR = pa.schema(
    [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
)


def count_words(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, spoiled: int = SPOILED
) -> DataFrame:
    """(word, n) of the words with `min_chars` code points and `min_count` occurrences.

    Words are maximal runs of LETTERS with A-Z lower-cased. Where the CRC of `<doc_id>:<run>` is a
    multiple of `spoiled`, the run loses the letter at the CRC modulo its length. A null doc_id is
    written as nothing, a null text has no runs. Words are counted per task before the shuffle.
    """
    long_runs = f"[{LETTERS}]{{{min_chars},}}"
    runs = spread(docs.select("doc_id", "text")).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(long_runs), F.lit(0))).alias("run")
    )
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(
        F.col("run")
    )
    named = runs.select("doc_id", low.alias("run")).withColumn(
        "h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    )
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) AS int) + 2)"))
    word = F.when(F.col("h") % spoiled == 0, cut).otherwise(F.col("run"))
    return (
        named.select(word.alias("word"))
        .where(F.length("word") >= min_chars)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Add `block`: the hash of a row's class, region and letters outside the region.

    A class holds the words of `size` letters, which ask, and those of one letter more; the region
    is [lo, hi) of the shorter words, one letter more in the longer ones.
    """
    head = F.expr("substring(word, 1, lo)")
    tail = F.expr("substring(word, hi + 1 + length(word) - size)")
    return rows.withColumn("block", F.xxhash64("size", "lo", "hi", head, tail))


def _region(size: Column, lo: Column, hi: Column) -> Column:
    return F.struct(
        size.cast("int").alias("size"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")
    )


def _halves(words: DataFrame, min_chars: int) -> DataFrame:
    size = F.length("word")
    regions = []
    for short in (size, size - 1):
        half = F.floor(short / 2)
        for lo, hi in ((F.lit(0), half), (half, short)):
            regions.append(F.when(short >= min_chars, _region(short, lo, hi)))
    dealt = words.select("word", "n", F.explode(F.array(*regions)).alias("r")).where("r IS NOT NULL")
    return _keyed(dealt.select("word", "n", "r.*"))


def _narrower(rows: DataFrame) -> DataFrame:
    lo, hi, size = F.col("lo"), F.col("hi"), F.col("size")
    middle = F.floor((lo + hi) / 2)
    dealt = rows.select(
        "word", "n", F.explode(F.array(_region(size, lo, middle), _region(size, middle, hi))).alias("r")
    )
    return _keyed(dealt.select("word", "n", "r.*"))


def near_in_block(
    words: list[str], counts: list[int], size: int, lo: int, hi: int
) -> Iterator[tuple[str, int, int, str]]:
    """(word, n_near, n of the best, the best) of the words of one block that have near words in it.

    Bit i of a set stands for word i. `same` are the words that equal the query up to here,
    `changed` those with one letter replaced, `longer` those with one letter more. A pair whose
    first difference lies behind the region belongs to the block of a later region.
    """
    at: dict[tuple[int, str], int] = {}
    of_size, of_more = 0, 0
    for i, word in enumerate(words):
        bit = 1 << i
        if len(word) == size:
            of_size |= bit
        else:
            of_more |= bit
        for p, letter in enumerate(word[lo : hi + len(word) - size]):
            at[p, letter] = at.get((p, letter), 0) | bit
    last = hi == size
    found: dict[int, list] = {}

    def credit(i: int, j: int) -> None:
        own = found.get(i)
        if own is None:
            found[i] = [1, -counts[j], words[j]]
        else:
            own[0] += 1
            if (-counts[j], words[j]) < (own[1], own[2]):
                own[1:] = -counts[j], words[j]

    for i, query in enumerate(words):
        if len(query) != size:
            continue
        same, changed, longer = of_size | of_more, 0, 0
        for p, letter in enumerate(query[lo:hi]):
            here = at.get((p, letter), 0)
            changed = (changed & here) | (same & of_size & ~here)
            longer = (longer | (same & of_more)) & at.get((p + 1, letter), 0)
            same &= here
            if not (same & ~(1 << i) or changed or longer):
                break
        else:
            more = longer | (same & of_more) if last else longer & ~same
            rest = changed | more
            while rest:
                bit = rest & -rest
                j = bit.bit_length() - 1
                credit(i, j)
                if more & bit:
                    credit(j, i)
                rest ^= bit
    for i, (count, negative, best) in found.items():
        yield words[i], count, -negative, best


def _near_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks lie together, sorted by their hash; the words of one are told apart by their letters."""

    def solved(block: list[tuple]) -> Iterator[tuple]:
        groups: dict[tuple, list[tuple[str, int]]] = {}
        for word, n, size, lo, hi in block:
            tail = word[hi + len(word) - size :]
            groups.setdefault((size, lo, hi, word[:lo], tail), []).append((word, n))
        for (size, lo, hi, _, _), members in groups.items():
            if len(members) > 1:
                words, counts = zip(*members, strict=True)
                yield from near_in_block(list(words), list(counts), size, lo, hi)

    open_hash, block, out = None, [], []
    for b in batches:
        columns = [b[c].to_pylist() for c in ("block", "word", "n", "size", "lo", "hi")]
        for key, *row in zip(*columns, strict=True):
            if key != open_hash:
                if len(block) > 1:
                    out.extend(solved(block))
                    if len(out) > 5000:
                        yield batch(_NEAR, *zip(*out, strict=True))
                        out = []
                open_hash, block = key, []
            block.append(row)
    if len(block) > 1:
        out.extend(solved(block))
    if out:
        yield batch(_NEAR, *zip(*out, strict=True))


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best), several rows a word: what each block found, every pair of
    words of `words` (word, n; distinct) that differ by one inserted, deleted or replaced code
    point in exactly one block."""
    rows = _halves(words, min_chars)
    found = None
    while True:
        sizes = rows.groupBy("block").agg(
            F.count(F.lit(1)).alias("members"), F.max(F.col("hi") - F.col("lo")).alias("open")
        )
        large = materialise(
            sizes.where((F.col("members") > block) & (F.col("open") > 1)).select("block"), "blocks"
        )
        any_large = not large.isEmpty()
        small = rows.join(large, "block", "left_anti") if any_large else rows
        near = (
            small.repartition("block")
            .sortWithinPartitions("block")
            .select("block", "word", "n", "size", "lo", "hi")
            .mapInArrow(_near_rows, "word string, n_near long, best_n long, best string")
        )
        near = materialise(near, "near")
        found = near if found is None else found.unionByName(near)
        if not any_large:
            return found
        # regions of one letter in a large hash of mixed regions stay as they are
        again = rows.join(large, "block", "left_semi")
        rows = materialise(_narrower(again.where("hi - lo > 1")), "regions").unionByName(
            again.where("hi - lo <= 1")
        )


def forms(words: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n (ties: smallest in code-point
    order) if that n is at least `ratio` times the word's."""
    none = F.lit(None)
    own = words.select(
        "word", "n", F.lit(0).cast("long").alias("n_near"),
        none.cast("struct<less:bigint,form:string>").alias("best"),
    )
    seen = near.select(
        "word", none.cast("long").alias("n"), "n_near",
        F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")).alias("best"),
    )
    both = own.unionByName(seen).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")
    )
    taken = -F.col("best.less") >= ratio * F.col("n")
    return both.select(
        "word", "n", "n_near",
        F.when(taken, F.col("best.form")).alias("form"),
        F.when(taken, -F.col("best.less")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A form is `ratio` times as frequent, so a way has
    at most log(largest n) steps to that base; a round is one step, and only words on their way
    go on."""
    links = materialise(
        formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links"
    )
    moving, done = links, None
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(moving.join(ahead, "root", "left"), "moved")
        ended = moved.where("next IS NULL").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        moving = moved.where("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if moving.isEmpty():
            return done


def spelling_variants(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    spoiled: int = SPOILED,
    block: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that `count_words` finds in `docs`
    (doc_id, text).

    Null and empty texts have no words, an empty table no rows; repeated rows count again, texts of
    any length are read whole, and further columns are ignored. A word without a form is its own
    root. Words are compared by code points, so no two rows are equal.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = materialise(count_words(docs, min_chars, min_count, spoiled), "words")
    formed = materialise(forms(words, near_words(words, min_chars, block), ratio), "forms")
    ends = roots(formed)
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
