"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and columns
whose names clash with its own."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from lakemill.llm import (
    bpe,
    decontaminate,
    fertility,
    line_dedup,
    ngram_join,
    passages,
    pii,
    revisits,
    token_store,
    url_templates,
)
from lakemill.session import work_folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_line_digests(awkward, nothing):
    got = by_id(line_dedup.line_digests(awkward, line_dedup.keep_bitmaps(awkward)))
    assert (got[1].n_lines, got[1].n_dropped) == (1, 0)
    assert (got[6].n_lines, got[6].n_dropped) == (3, 2)
    assert (got[7].n_lines, got[7].n_dropped) == (2, 2)
    assert (got[8].n_lines, got[8].n_dropped) == (3, 0)  # the largest doc_id keeps its line
    assert (got[None].n_lines, got[None].n_dropped) == (2, 0)
    assert got[6].kept_sha256 == hashlib.sha256(b"own words here").hexdigest()
    assert rows(line_dedup.keep_bitmaps(nothing)) == []


def test_drop_lines_keeps_columns(awkward):
    left = line_dedup.drop_lines(awkward, line_dedup.keep_bitmaps(awkward))
    assert left.columns == awkward.columns and left.count() == awkward.count()
    got = by_id(left)
    assert (got[6].text, got[6].n_chars, got[6].hits) == ("own words here", 14, "h")
    assert got[7].text == "" and got[8].text.startswith("x\n")


@pytest.mark.parametrize("parts", [1, 7])
def test_a_run_over_many_tasks(spark, parts):
    """One line in every document, and lines in two and three documents, whatever the partitions."""
    line = "this line is in every document"
    docs = [(i, f"{line}\nline number {i // 3} of three documents\nline {i // 2} of two documents only")
            for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = by_id(line_dedup.line_digests(df, line_dedup.keep_bitmaps(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i in range(300):
        assert got[i].n_dropped == (i != 299) + (i % 3 != 2), i


def test_measure_quality(awkward, nothing):
    df = fertility.measure_quality(awkward)
    assert df.count() == awkward.count() and fertility.measure_quality(nothing).count() == 0
    got = by_id(df)
    assert (got[1].n_words, got[1].kept, got[2].n_words, got[3].n_words) == (0, False, 0, 0)
    assert (got[5].n_words, got[5].n_repeat_words, got[5].kept) == (60_000, 0, False)  # digits
    assert (got[7].n_dup_lines, got[7].n_words) == (1, 14)
    assert got[9].word_chars == len("ÄÖÜßé中文😀maila.b@c.denow")
    assert fertility.keep_good(awkward).count() == 0
    left = fertility.keep_good(awkward, bands={"latin": (0.0, 1.0, 0.0)})
    assert left.columns == awkward.columns and [r.doc_id for r in left.collect()] == [5, 5]


def test_ngram_join(awkward, nothing):
    got = by_id(ngram_join.similar_documents(awkward))
    assert [got[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 10)] == [1, 2, 3, 4, 5, 4]
    assert got[None].component_id is None and got[5].n_shingles == 59_996
    assert ngram_join.similar_documents(nothing).count() == 0
    kept = ngram_join.one_per_group(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 10 not in ids and None in ids and 1 in ids


def test_decontaminate(spark, awkward, nothing):
    bench = spark.createDataFrame(
        [(1, "ONE"), (2, None), (3, ""), (4, " ".join(f"w{i} x{i}" for i in range(20))), (4, "one"),
         (None, "twenty characters")],
        "item_id long, text string",
    )
    df = decontaminate.leak_report(awkward, bench)
    assert df.count() == awkward.count()
    got = by_id(df)
    assert (got[4].n_hit, got[4].n_items, got[4].contaminated) == (1, 2, True)
    assert (got[1].n_words, got[1].contaminated) == (0, False)
    assert (got[5].n_hit, got[5].n_items) == (40, 1)
    assert (got[7].n_hit, got[7].n_items) == (4, 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[2].items_sha256 == empty
    assert decontaminate.leak_report(nothing, bench).count() == 0
    clean = decontaminate.leak_report(awkward, bench.limit(0))
    assert clean.where("contaminated").count() == 0
    left = decontaminate.remove_leaks(awkward, bench)
    assert left.columns == awkward.columns and 4 not in [r.doc_id for r in left.collect()]
    cut = by_id(decontaminate.remove_leaks(awkward, bench, spans=True))
    assert cut[4].text == "" and cut[7].text == "a line of more than\na line of more than"
    assert cut[9].text.endswith("now")


def test_many_anchors_take_the_join(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(1, "one"), (2, "own words here")], "item_id long, text string")
    want = rows(decontaminate.leak_report(awkward, bench))
    monkeypatch.setattr(decontaminate, "MOST_ANCHORS", 0)
    assert rows(decontaminate.leak_report(awkward, bench)) == want


def test_encoding(awkward, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(None))
    encoded = bpe.encode(awkward)
    got, texts = by_id(encoded), by_id(awkward)
    decoded = by_id(bpe.decode(encoded))
    for doc, row in texts.items():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[doc].ids, "<u4").tolist() == ids
        assert decoded[doc].text == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(bpe.encode(nothing)).count() == 0 == bpe.text_digests(nothing).count()
    assert rows(bpe.text_digests(awkward)) == rows(bpe.digests(encoded))
    assert by_id(bpe.digests(encoded))[1].n_tokens == 0


def test_token_files(spark, awkward, nothing):
    path = work_folder(spark, "tokens")
    token_store.write_tokens(awkward, path, shard_ids=50_000)
    listed = token_store.token_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in listed] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]
    assert [r.n_tokens for r in listed][1:3] == [1, 1]
    end = np.array([2], "<u4").tobytes()
    assert listed[1].ids_crc32 == zlib.crc32(end)
    total = 0
    for r in listed:
        assert r.start == total
        total += r.n_tokens
    ids = {r.start: r for r in token_store.read_tokens(spark, path).collect()}
    assert all(zlib.crc32(ids[r.start].ids) == r.ids_crc32 for r in listed)
    shard = token_store.read_shards(spark, path).where("array_contains(doc_ids, 9)").first()
    assert token_store.decode_document(shard, 9).tobytes() == ids[listed[-2].start].ids
    other = work_folder(spark, "tokens")
    token_store.write_tokens(nothing, other)
    assert token_store.token_digests(spark, other).count() == 0


def test_private(awkward, nothing):
    df = pii.private_report(awkward)
    assert df.count() == awkward.count() and pii.private_report(nothing).count() == 0
    got = by_id(df)
    assert (got[9].n_email, got[9].spans) == (1, "email:18:26")
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    cleaned = pii.sanitise(awkward)
    assert cleaned.columns == awkward.columns and cleaned.count() == awkward.count()
    assert by_id(cleaned)[9].text == "ÄÖÜ ß é 中文 😀 mail [EMAIL] now"


def test_many_values_in_one_text(spark):
    """Places come from one running sum, not from a sum per value."""
    text = " ".join(f"a{i}@b.cd" for i in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    got = pii.private_report(df).first()
    assert got.n_email == 16_000 and got.spans.endswith(f"email:{len(text) - 11}:{len(text)}")
    assert time.perf_counter() - start < 40


def test_passages(awkward, nothing):
    found = passages.shared_passages(awkward)
    assert found.count() == 0  # equal rows of one doc_id are one document
    assert passages.shared_passages(nothing).count() == 0
    assert passages.remove_passages(awkward).columns == awkward.columns


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Example.NET/en/1?q#f", "x"),
         (3, "HTTP://A.Example.NET/en/1?q#f", "x"), (None, "http://b.org/fr/x", "y"),
         (4, "http://net", "z"), (5, "x://c.com//a///b/c/d/e/f", "z"), (6, "http://NET/a\nb", "z")],
        "page_id long, url string, template string",
    )
    rules = {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow"}
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 1)], "page_id long, bad int")
    df = url_templates.judge_urls(pages, labels, rules)
    assert df.count() == 8
    got = {r.page_id: r for r in df.collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == (
        "a.example.net", "/en/1", "example.net/en/", "allow",
    )
    assert (got[None].rule, got[4].path, got[4].rule) == ("org/fr/", "", None)
    assert (got[6].path, got[6].rule, got[6].verdict) == ("/a\nb", "net/", "block")
    assert url_templates.judge_urls(pages.limit(0), labels, rules).count() == 0
    none = url_templates.judge_urls(pages, labels.limit(0), rules)
    assert {r.verdict for r in none.collect() if r.rule is None} == {"allow"}


def test_revisits(spark):
    kind = (
        "record_id long, url string, ts long, kind string, etag string, last_modified string,"
        " digest string, headers map<string,string>, status string"
    )
    stored = {"Content-Length": "5", "Date": "1", "X": "a"}
    captures = spark.createDataFrame(
        [
            (1, "http://www.a.com:80/p/?b=2&a=1&utm_x=9#f", 100, "response", '"e"', "m", None, stored, "s"),
            (2, "http://a.com/p?a=1&b=2", 100, "response", '"late"', "m", None, None, "s"),
            (3, "https://A.com/p?b=2&a=1", 100, "revisit", '"e"', None, None, None, "s"),
            (4, "https://a.com/p?b=2&a=1", 9000, "revisit", 'W/"late"', None, None,
             {"content-length": "0", "DATE": "3"}, "s"),
            (4, "https://a.com/p?b=2&a=1", 9000, "revisit", 'W/"late"', None, None,
             {"content-length": "0", "DATE": "3"}, "s"),
            (5, "https://a.com/p?b=2&a=1", 9000, "revisit", '"e"', None, None, None, "s"),
            (6, "https://a.com/p?b=2&a=1", 101, "revisit", None, None, "d", {"Y": "b"}, "s"),
            (7, None, 5, "revisit", None, None, None, None, "s"),
            (8, "https://a.com/p?b=2&a=1", None, "revisit", None, None, None, None, "s"),
            (9, "https://a.com/p?b=2&a=1", 50, "request", None, None, None, None, "s"),
        ],
        kind,
    )
    got = revisits.resolve_revisits(captures).orderBy("record_id").collect()
    assert [(r.record_id, r.status, r.response_id) for r in got] == [
        (3, "orphan", None), (4, "resolved", 2), (4, "resolved", 2), (5, "changed", 2),
        (6, "unverified", 2), (7, "orphan", None), (8, "orphan", None),
    ]
    assert [tuple(e) for e in got[1].headers] == [("date", "3")]
    assert {r.canonical for r in got} == {"a.com/p?a=1&b=2", ""}
    first = captures.where("record_id IN (1, 6)")
    one = revisits.resolve_revisits(first).first()
    assert [tuple(e) for e in one.headers] == [("content-length", "5"), ("date", "1"), ("x", "a"), ("y", "b")]
    assert revisits.resolve_revisits(captures.limit(0)).count() == 0
