"""Benchmark decontamination with DataFrame functions only.

Each window of a test item has an anchor: its longest pair of neighbouring words. The anchors are
a bounded hash set inside the scan's expression; only places that hold one meet the item windows,
which are compared word by word. Documents are scanned once and their texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 10
# Anchors that the scan keeps as a hash set, and windows that may be broadcast. Beyond either
# bound every place goes through a shuffled join with its context instead.
MOST_ANCHORS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def item_windows(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window, size, at, anchor): distinct windows, anchored at word `at` of theirs."""
    words = bench.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    runs = words.select("item_id", "w", size.alias("size"), starts.alias("s")).select(
        "item_id", "size", F.slice("w", F.col("s"), F.col("size")).alias("run")
    )
    # the longest neighbouring pair, the first of equals; a single word stands for itself
    places = F.sequence(F.lit(0), F.greatest(F.col("size") - 2, F.lit(0)))
    pair = F.transform(
        places,
        lambda i: F.struct(
            (-F.length(F.get("run", i)) - F.coalesce(F.length(F.get("run", i + 1)), F.lit(0))).alias("l"),
            i.alias("at"),
            F.concat_ws(" ", F.get("run", i), F.get("run", i + 1)).alias("anchor"),
        ),
    )
    return (
        runs.withColumn("best", F.array_min(pair))
        .select(
            "item_id",
            F.concat_ws(" ", "run").alias("window"),
            "size",
            F.col("best.at").alias("at"),
            F.col("best.anchor").alias("anchor"),
        )
        .distinct()
    )


def _places(windows: DataFrame) -> tuple[Column, bool]:
    """For the word array `w`: where its anchors are, and whether the windows may be broadcast."""
    anchors = windows.select("anchor").distinct().limit(MOST_ANCHORS + 1).collect()
    every = F.sequence(F.lit(0), F.size("w") - 1)
    if len(anchors) > MOST_ANCHORS:
        return F.when(F.size("w") > 0, every).otherwise(F.array().cast("array<int>")), False
    pairs = sorted(a[0] for a in anchors if " " in a[0])
    single = sorted(a[0] for a in anchors if " " not in a[0])
    firsts = sorted({p.split(" ")[0] for p in pairs})

    def tested(word, i):
        tests = []
        if pairs:
            both = F.concat_ws(" ", word, F.get("w", i + 1)).isin(pairs)
            tests.append(F.when(word.isin(firsts), both).otherwise(False))
        if single:
            tests.append(word.isin(single))
        return F.when(reduce(lambda a, b: a | b, tests, F.lit(False)), i)

    found = F.filter(F.transform("w", tested), lambda i: i.isNotNull())
    few = windows.limit(20 * MOST_ANCHORS + 1).count() <= 20 * MOST_ANCHORS
    return found, few


def find_leaks(
    docs: DataFrame, bench: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, hits (array of struct(start, size) of matching
    windows, in words), items (sorted array of item_id); `kept` has the columns named in `keep`.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z
    lower-cased. A window is `width` consecutive words of an item, or the whole of a shorter one.
    Null or wordless texts and items match nothing; an empty benchmark finds nothing; repeated
    rows are searched one by one, repeated items count by their id; null ids stay null (an item
    without id is not listed). Further columns are ignored.
    """
    windows = item_windows(bench.select("item_id", "text"), width)
    places, few = _places(windows)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep or ("doc_id",))).alias("kept")
    scanned = docs.select(
        F.monotonically_increasing_id().alias("row"), kept, words_of(F.col("text")).alias("w")
    ).select("row", "kept", F.size("w").alias("n_words"), "w", places.alias("places"))
    place = F.col("p")
    rows = (
        scanned.select("row", "kept", "n_words", "w", F.explode_outer("places").alias("p"))
        .select(
            "row", "kept", "n_words", "p",
            F.concat_ws(" ", F.get("w", place), F.get("w", place + 1)).alias("two"),
            F.get("w", place).alias("one"),
            F.slice("w", F.greatest(place - width, F.lit(0)) + 1, F.lit(2 * width + 1)).alias("near"),
            F.greatest(place - width, F.lit(0)).alias("near_at"),
        )
    )
    # a row without places keeps a key of its own, so that no key holds all of them
    keys = F.when(place.isNull(), F.array(F.concat(F.lit("  "), F.col("row").cast("string"))))
    keys = keys.otherwise(F.array_distinct(F.array("two", "one")))
    keyed = rows.withColumn("anchor", F.explode(keys)).drop("one", "two")
    windows = F.broadcast(windows) if few else windows
    start = place - F.col("at")
    found = F.concat_ws(" ", F.slice("near", start - F.col("near_at") + 1, F.col("size")))
    same = F.when((start >= F.col("near_at")) & (start >= 0), found == F.col("window"))
    matched = keyed.join(windows, "anchor", "left").select(
        "row", "kept", "n_words",
        F.when(same, F.struct(start.alias("start"), F.col("size").alias("size"))).alias("hit"),
        F.when(same, F.col("item_id")).alias("item"),
    )
    grouped = matched.groupBy("row").agg(
        F.first("kept").alias("kept"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    return grouped.select(F.col("kept.doc_id").alias("doc_id"), "n_words", "hits", "items", "kept")


def hit_words() -> Column:
    """The distinct word numbers that `hits` cover."""
    spans = F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))
    return F.array_distinct(F.flatten(spans))


def leak_report(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return find_leaks(docs, bench, width).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(hit_words()).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, bench: DataFrame, width: int = WIDTH, spans: bool = False) -> DataFrame:
    """The documents without those that hold a test window; with `spans`, without its words only.

    A removed word takes the separator before it along. n_chars, where there is one, follows.
    """
    found = find_leaks(docs, bench, width, tuple(docs.columns))
    if not spans:
        return found.where(F.size("hits") == 0).select("kept.*")
    split = found.select(
        "kept",
        F.when(F.size("hits") > 0, hit_words()).alias("gone"),
        F.regexp_extract_all("kept.text", F.lit(ANY_CASE), F.lit(0)).alias("words"),
        F.split("kept.text", ANY_CASE, -1).alias("gaps"),
    )
    left = F.transform(
        "words",
        lambda w, i: F.when(F.array_contains("gone", i), F.lit("")).otherwise(
            F.concat(F.get("gaps", i), w)
        ),
    )
    cut = F.concat(F.array_join(left, ""), F.element_at("gaps", -1))
    text = F.when(F.col("gone").isNotNull(), cut).otherwise(F.col("kept.text"))
    cleaned = split.select("kept", "gone", text.alias("cut"))
    made = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        size = F.length("cut").cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.col("gone").isNotNull(), size).otherwise(F.col("kept.n_chars"))
    return cleaned.select(*((made[c] if c in made else F.col("kept")[c]).alias(c) for c in docs.columns))
