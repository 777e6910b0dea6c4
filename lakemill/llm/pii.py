"""Information-theoretic sanitisation with DataFrame functions only.

Addresses and numbers that name a person are found by form. The corpus then tells which terms give
them away: a term that stands in the texts of the same one, at any distance, in several of them, and
in hardly any other, lets a reader infer it. Terms whose share and pointwise mutual information exceed the thresholds are
replaced wherever they occur, by their kind or, above a second threshold, by nothing.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import disclosed, enclosed
from lakemill.session import materialise

# Forms in Java's syntax, each equal to the plain form but possessive, so that long runs need
# neither backtracking nor recursion; a look behind keeps the search from starting inside a run.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a form to be worth a search.
GUARDS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
KINDS = (*FORMS, "term")
MIN_TEXTS = 3  # distinct texts that hold both the term and the value
MIN_SHARE = 0.9  # of the texts that hold the term at all
MIN_BITS = 6.0  # pointwise mutual information
REMOVE_SHARE = 0.99  # from this share on a term is removed, below it is generalised
TERM = r"\p{L}{3,}+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    values = F.transform(F.sequence(F.lit(1), F.length(digits)), weighed)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    size = F.length(_digits(match))
    if kind == "card":
        # the digits of other lengths are not weighed at all
        return F.when(size.between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _starts(pieces: Column, gaps: Column) -> Column:
    """Where each piece begins, in code points, given what stands before each: one running sum."""

    def add(held: Column, i: Column) -> Column:
        start = held["at"] + F.length(F.get(gaps, i))
        return F.struct(
            (start + F.length(F.get(pieces, i))).alias("at"),
            F.concat(held["starts"], F.array(start)).alias("starts"),
        )

    none = F.array().cast("array<int>")
    first = F.struct(F.lit(0).alias("at"), none.alias("starts"))
    places = F.sequence(F.lit(0), F.size(pieces) - 1)
    summed = F.aggregate(places, first, add, lambda held: held["starts"])
    return F.when(F.size(pieces) > 0, summed).otherwise(none)


SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def base_spans(kind: str) -> Column:
    """array of struct(start, rank, end, value) from the columns `<kind>` (matches) and
    `<kind>_gaps` (what is between them): valid matches, with code points from 0, the end
    exclusive."""
    matches, gaps = F.col(kind), F.col(f"{kind}_gaps")
    placed = F.zip_with(
        matches, _starts(matches, gaps), lambda m, at: F.struct(m.alias("m"), at.alias("at"))
    )
    valid = F.filter(placed, lambda x: _valid(kind, x["m"]))

    def span(x: Column) -> Column:
        return F.struct(
            x["at"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (x["at"] + F.length(x["m"])).alias("end"),
            x["m"].alias("value"),
        )

    return F.coalesce(F.transform(valid, span), F.array().cast(SPANS))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _outside(text: Column) -> Column:
    """The terms of a text outside of its values; of the forms only addresses hold letters."""
    rest = F.regexp_replace(text, FORMS["email"], " ")
    return _terms(F.when(GUARDS["email"](text), rest).otherwise(text))


def find_base(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, and the array `base` of spans, by start and
    kind. Neither texts nor their words are kept."""
    text = F.coalesce("text", F.lit(""))
    parts = []
    for kind, form in FORMS.items():
        worth = GUARDS[kind](text)
        parts.append(F.when(worth, F.regexp_extract_all(text, F.lit(form), F.lit(0))).alias(kind))
        parts.append(F.when(worth, F.split(text, form, -1)).alias(f"{kind}_gaps"))
    searched = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *parts)
    spans = F.array_sort(F.concat(*map(base_spans, FORMS)))
    return searched.select("doc_id", "text_hash", spans.alias("base"))


def disclosing_terms(
    docs: DataFrame,
    found: DataFrame,
    min_texts: int = MIN_TEXTS,
    min_share: float = MIN_SHARE,
    min_bits: float = MIN_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(term, share, bits) of the terms that reveal a value, and (doc_id, text_hash, term) of all
    texts that hold one of them. Equal texts count once.

    share = texts with term and value / texts with the term; bits = log2(share / share of texts
    with the value). Terms are those of the whole text, outside of its values. As no term and
    value meet in more texts than either has, those that cannot reach the thresholds, hot ones
    among them, are left out before terms and values of a text are paired. Words are read from the
    texts where they are needed and never stored with them; of texts with copies, one row each.
    """
    copies = found.groupBy("text_hash").agg(
        F.count("*").alias("_rows"), F.min("doc_id").alias("_first")
    )
    copies = materialise(copies, "pii")
    total = copies.count()
    copied = materialise(copies.where("_rows > 1").select("text_hash", "_first"), "pii")
    source = _hashed(docs)
    alone = source.join(copied, "text_hash", "left_anti").select("text_hash", "text")
    first = source.join(copied, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("_first")))
    first = first.select("text_hash", "text").dropDuplicates(["text_hash"])
    every = alone.union(first)

    def words_of(texts: DataFrame) -> DataFrame:
        return texts.select("text_hash", F.explode(_outside(F.col("text"))).alias("term"))

    most = total / 2**min_bits * (1 + 1e-9)
    with_term = (
        words_of(every)
        .groupBy("term")
        .agg(F.count("*").alias("of_term"))
        .where(F.col("of_term").between(min_texts, most))
    )
    seen = (
        found.where(F.size("base") > 0)
        .select("text_hash", F.explode("base.value").alias("value"))
        .select("text_hash", F.lower("value").alias("value"))
        .distinct()
    )
    seen = materialise(seen, "pii")
    with_value = (
        seen.groupBy("value")
        .agg(F.count("*").alias("of_value"))
        .where(F.col("of_value").between(min_texts, most))
    )
    seen = materialise(seen.join(with_value, "value"), "pii")
    holding = materialise(seen.select("text_hash").distinct(), "pii")
    with_term = materialise(with_term, "pii")
    held = words_of(every.join(holding, "text_hash", "left_semi")).join(with_term, "term")
    share = F.col("both") / F.col("of_term")
    scored = (
        held.join(seen, "text_hash")
        .where(F.col("of_term") * min_share <= F.col("of_value") * (1 + 1e-9))
        .groupBy("term", "value", "of_term", "of_value")
        .agg(F.count("*").alias("both"))
        .where(F.col("both") >= min_texts)
        .select("term", share.alias("share"), F.log2(share * total / F.col("of_value")).alias("bits"))
        .where((F.col("share") >= min_share) & (F.col("bits") >= min_bits))
        .groupBy("term")
        .agg(F.max("share").alias("share"), F.max("bits").alias("bits"))
    )
    scored = materialise(scored, "pii")
    holders = source.select(
        "doc_id", "text_hash", F.explode(_terms(F.col("text"))).alias("term")
    )
    return scored, holders.join(scored, "term").select("doc_id", "text_hash", "term", "share").distinct()


def find_private(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_hash, `base` spans and `terms`, an
    array of struct(start, rank, end, share) of the disclosing terms in it.

    A null text is empty and holds nothing; null ids stay null; repeated rows are searched one by
    one; an empty table gives none. Further columns are ignored. Whole texts are searched.
    """
    source = docs.select("doc_id", "text")
    found = materialise(find_base(source), "pii")
    _, holders = disclosing_terms(source, found, **thresholds)
    per_text = holders.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("shares")
    )
    per_text = per_text.select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "shares"
    )
    texts = source.select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    gaps = F.split("text", TERM, -1)
    hits = F.filter(
        F.zip_with(
            "words",
            _starts(F.col("words"), F.col("gaps")),
            lambda w, at: F.struct(
                w.alias("w"), at.alias("at"), F.try_element_at("shares", F.lower(w)).alias("share")
            ),
        ),
        lambda x: x["share"].isNotNull(),
    )

    def span(x: Column) -> Column:
        return F.struct(
            x["at"].alias("start"),
            F.lit(KINDS.index("term")).alias("rank"),
            (x["at"] + F.length(x["w"])).alias("end"),
            x["share"].alias("share"),
        )

    terms = (
        texts.join(per_text, same)
        .select("_doc", "_hash", "shares", words.alias("words"), gaps.alias("gaps"))
        .select("_doc", "_hash", F.transform(hits, span).alias("terms"))
        .groupBy("_doc", "_hash")
        .agg(F.first("terms").alias("terms"))
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,share:double>>")
    return found.join(terms, same, "left").select(
        "doc_id", "text_hash", "base", F.coalesce("terms", none).alias("terms")
    )


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
    )
    return F.array_join(parts, ",")


def _bare(spans: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    )


def private_report(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, number of spans per base kind, digest of the base spans, and all spans as text."""
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [
        (F.size("base") - F.size(F.array_remove(ranks, rank))).cast("long").alias(f"n_{kind}")
        for rank, kind in enumerate(FORMS)
    ]
    every = F.array_sort(F.concat(_bare(F.col("base")), _bare(F.col("terms"))))
    return find_private(docs, **thresholds).select(
        "doc_id",
        *counts,
        F.size("terms").cast("long").alias("n_term"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
    )


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with every span replaced: base kinds and terms by their kind in brackets,
    terms from REMOVE_SHARE on by nothing. Of overlapping spans the earlier one is replaced, up
    to its end. n_chars, where there is one, follows; all other columns stay, whatever their names.
    Null and empty texts, repeated rows and rows without doc_id stay; an empty table gives none."""
    private = find_private(docs, **thresholds)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    every = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.get(marks, s["rank"]).alias("mark")
            )),
            F.transform("terms", lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.when(s["share"] >= REMOVE_SHARE, "").otherwise(F.get(marks, s["rank"])).alias("mark"),
            )),
        )
    )
    touched = private.select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), every.alias("_spans")
    ).where(F.size("_spans") > 0).dropDuplicates(["_doc", "_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                F.concat(
                    a["out"],
                    F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]),
                    s["mark"],
                ).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)),
    )
    marked = enclosed(docs).join(touched, same, "left").withColumn("_cut", cut)
    return disclosed(marked, docs, F.col("_cut"), F.col("_spans").isNotNull())


