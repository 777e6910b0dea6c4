"""Which shingles the n-gram join takes as frequent, and what it pairs."""

from lakemill.llm import ngram_join


def test_moderately_frequent_passages_make_no_groups(spark):
    """A passage of a dozen documents, far below one in 256 of a large table, makes no group."""
    passage = " ".join(f"common{i}" for i in range(8))
    docs = spark.createDataFrame(
        [(d, f"{passage} " + " ".join(f"own{d}x{i}" for i in range(60))) for d in range(12)],
        "doc_id long, text string",
    ).coalesce(1)
    facts = docs.mapInArrow(ngram_join._describe(5), ngram_join.FACT_TYPES)
    assert len(ngram_join._frequent(facts)) == 4
    pairs = ngram_join._candidates(docs, facts, 5, ngram_join.SIMILARITY)
    assert pairs.where("many = 1").count() == 0


def test_most_frequent_are_sent(spark, monkeypatch):
    """Where frequent shingles are too many to be sent, the most frequent ones are."""
    rows = [(1, f, n) for f, n in enumerate([7, 8, 9, 500, 500, 9000])]
    facts = spark.createDataFrame(rows, "kind int, f long, n long")
    assert sorted(ngram_join._frequent(facts).tolist()) == [1, 2, 3, 4, 5]
    monkeypatch.setattr(ngram_join, "MOST_HOT", 3)
    assert sorted(ngram_join._frequent(facts).tolist()) == [3, 4, 5]
    monkeypatch.setattr(ngram_join, "MOST_HOT", 0)
    assert ngram_join._frequent(facts).tolist() == []


def test_copies_are_one_set(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(d, text) for d in range(20)], "doc_id long, text string")
    facts = docs.coalesce(1).mapInArrow(ngram_join._describe(5), ngram_join.FACT_TYPES)
    assert facts.where("kind = 1").count() == 0
    got = ngram_join.similar_documents(docs).collect()
    assert {(r.n_shingles, r.component_id) for r in got} == {(26, 0)} and len(got) == 20
