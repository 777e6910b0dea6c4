"""Cases in which an operator once did less than the whole job."""


import random

from lakemill.llm import fertility, ngram_join, passages, pii


def test_join_ends_when_nothing_is_left(spark, monkeypatch):
    """Groups of twelve texts that share one phrase and are not near each other."""
    docs = [
        (12 * p + i, " ".join([*(f"p{p}x{k}" for k in range(5)), *(f"d{p}i{i}n{k}" for k in range(19))]))
        for p in range(20)
        for i in range(12)
    ]
    rounds, split = [], ngram_join._split_groups

    def counted(*args):
        rounds.append(1)
        if len(rounds) > 4:
            raise RuntimeError("the same groups again and again")
        return split(*args)

    monkeypatch.setattr(ngram_join, "_split_groups", counted)
    got = ngram_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(i, 20, i) for i, _ in docs]
    assert len(rounds) == 1  # the groups were split, and compared once


def test_terms_far_from_the_value(spark):
    """A name that heads ten texts, beside the address in eight of them and far from it in two, and
    one that is never beside it; words of the address alone are no terms."""
    rnd = random.Random(4)
    common = [f"word{chr(97 + i)}" for i in range(26)]
    prose = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    docs = [(i, f"Hagelund {prose(60)} Storch {'' if i < 8 else prose(30)} hs@kontor.org") for i in range(10)]
    docs += [(i, prose(40)) for i in range(10, 1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i in range(10):
        assert not any(w in clean[i] for w in ("Hagelund", "Storch", "kontor"))
        assert clean[i].count("word") == docs[i][1].count("word")
    assert all(clean[i] == docs[i][1] for i in range(10, 1000))
    report = {r.doc_id: r.n_term for r in pii.private_report(df).collect()}
    assert all(report[i] == (2 if i < 10 else 0) for i, _ in docs)


def test_random_characters_are_junk(spark):
    """With the bands as they are: letters, syllables and byte noise go, languages stay."""
    rnd = random.Random(6)
    low, consonants = "abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"
    mixed = low + low.upper() + "0123456789"
    han, syllables = range(0x4E00, 0xA000), range(0xAC00, 0xD7A4)
    noise = range(0x1F300, 0x1F600)  # four bytes each
    junk = [low, consonants, mixed, *("".join(map(chr, r)) for r in (han, syllables, noise))]
    docs = [
        (i, " ".join("".join(rnd.choices(k, k=rnd.randint(3, 9))) for _ in range(400)))
        for i, k in enumerate(junk)
    ]
    languages = [
        "Việt Nam là một quốc gia nằm ở cực đông của bán đảo Đông Dương thuộc khu vực Đông Nam Á giáp "
        "với Lào Campuchia Trung Quốc biển Đông và vịnh Thái Lan và thủ đô là Hà Nội còn thành phố lớn "
        "nhất là Thành phố Hồ Chí Minh nơi người dân sống chủ yếu nhờ buôn bán",
        "The committee met on a cold morning to decide whether the old bridge should be repaired or "
        "replaced by a wider one that heavy lorries could use without slowing down in the town below",
        "臺灣位於東亞，是一座島嶼，首都為臺北市，擁有豐富的歷史與文化遺產，經濟發達，科技產業聞名於世界",
    ]
    docs += [(10 + i, text) for i, text in enumerate(languages)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.measure_quality(df, min_words=1).collect()}
    assert not any(got[i].base_failed for i in got)
    assert {i: got[i].kept for i in got} == {i: i >= 10 for i in got}


def covered(spark, docs):
    """Words of each document in passages, and what remove_passages leaves."""
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {}
    for r in passages.shared_passages(df).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert 10 * r.n_equal >= 7 * (r.end_word - r.start_word)
    return got, {r.doc_id: r.text for r in passages.remove_passages(df).collect()}


def test_edited_passages(spark):
    """50 to 80 words with every 8th to 10th changed: all are found, with their edges."""
    docs, want = [], {}
    for i, (size, step) in enumerate([(50, 10), (60, 10), (60, 9), (80, 8)] * 5):
        words = [f"p{i}w{k}" for k in range(size)]
        changed = [f"e{i}w{k}" if k % step == step - 1 else w for k, w in enumerate(words)]
        docs.append((2 * i, " ".join([f"a{i}", *words, f"b{i}"])))
        docs.append((2 * i + 1, " ".join([*(f"c{i}x{k}" for k in range(30)), *changed, f"d{i}"])))
        want[2 * i + 1] = {30 + k for k in range(size)}
    got, _ = covered(spark, docs)
    assert set(got) == set(want)
    for doc, places in want.items():
        assert got[doc] <= places and len(places - got[doc]) <= 1  # a changed last word


def test_all_places_of_a_passage(spark):
    """A passage held twice; one whose first part stood before; halves from two documents."""
    long = [f"l{k}" for k in range(100)]
    part = [f"s{k}" for k in range(60)]
    left, right = [f"h{k}" for k in range(25)], [f"r{k}" for k in range(25)]
    own = lambda name, n: [f"{name}{k}" for k in range(n)]
    docs = [
        (1, long), (2, [*long, *own("u", 20), *long]),
        (3, part), (4, [*part[:50], *own("v", 30), *part]),
        (5, left), (6, [*left, *own("g", 3), *right]), (7, [*left, *own("z", 3), *right]),
    ]
    got, left_over = covered(spark, [(i, " ".join(t)) for i, t in docs])
    assert got[2] == {*range(100), *range(120, 220)}
    assert got[4] == {*range(50), *range(80, 140)}
    assert got[7] == set(range(53))
    assert left_over[2] == " ".join(own("u", 20)) and left_over[4] == " ".join(own("v", 30))
    assert left_over[7] == ""
