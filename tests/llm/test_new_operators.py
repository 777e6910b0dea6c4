"""Spelling variants, weighted fingerprints and resampling against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lakemill.llm import resample, spelling, weighted_samples
from lakemill.session import load

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in load(spark, small, "documents").collect()}


# --- spelling variants ---------------------------------------------------------------------------


def vocabulary(texts):
    seen = Counter()
    for doc, text in texts:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += len(run) >= 7
    return {w: n for w, n in seen.items() if n >= 2}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(words, ratio=10):
    """All pairs, one by one."""
    out, form = {}, {}
    for word, n in words.items():
        near = [(-m, other) for other, m in words.items() if one_apart(word, other)]
        best = min(near) if near else None
        form[word] = best[1] if best and -best[0] >= ratio * n else None
        out[word] = (n, len(near))
    rows = set()
    for word, (n, count) in out.items():
        root = word
        while form[root]:
            root = form[root]
        rows.add((word, form[word], root, n, count, words.get(form[word])))
    return rows


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [2, 8, 2048])
def test_variants_are_those_of_all_pairs(spark, block):
    """Words over three letters, so that blocks fill up and are dealt again down to one letter;
    repeated letters, edits at both ends, and chains of forms."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(7, 11))) for _ in range(260)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "aabaaba" + "é" * 30]
    counts = [rnd.choice([2, 2, 3, 25, 400]) for _ in words]
    words += ["zzzzzzzz", "zzzzzzzy", "zzzzzzyy", "zzzzzyyy"]  # a chain of forms
    counts += [500, 42, 3, 3]
    docs = []
    for word, n in zip(words, counts, strict=True):
        docs += [(len(docs) + i, word.upper() if i % 2 else word) for i in range(n)]
    docs = [(i, w) for i, (_, w) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = variants(vocabulary(docs))
    assert any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])
    assert as_set(spelling.spelling_variants(df, block=block)) == want


def test_a_shared_half_is_dealt_over_many_blocks(spark):
    """Thousands of words that agree in one half: every block that is compared stays small."""
    rnd = random.Random(9)
    words = list({"commonhalf" + "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(4000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    near = spelling.near_words(df, block=64)
    got = Counter()
    for r in near.collect():
        got[r.word] += r.n_near
    known = set(words)
    for w in words[:300]:
        want = sum(
            w[:i] + c + w[i + 1 :] in known for i in range(10, 16) for c in "abcdefgh" if c != w[i]
        )
        assert got[w] == want


def test_bitsets_of_one_block():
    words = ["abcdefg", "abcdxfg", "abcdefgh", "abcdeffg", "xbcdefg"]
    got = {w: (n, top, best) for w, n, top, best in spelling.near_in_block(words[:4], [5, 3, 9, 9], 7, 3, 7)}
    assert got["abcdefg"] == (3, 9, "abcdeffg")  # ties: the smaller word
    assert got["abcdxfg"] == (1, 5, "abcdefg") and got["abcdefgh"] == (1, 5, "abcdefg")


def test_variants_of_odd_rows(awkward, nothing):
    got = {r.word: r for r in spelling.spelling_variants(awkward).collect()}
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert {(w, r.n) for w, r in got.items()} == set(vocabulary(rows).items())
    assert got["characters"].root == "characters" and got["characters"].form is None
    assert spelling.spelling_variants(nothing).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(nothing, ratio=1)


# --- weighted fingerprints -----------------------------------------------------------------------


def terms(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def jaccard(a, b):
    a, b = terms(a), terms(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def test_collision_rate_is_generalised_jaccard():
    rnd = random.Random(2)
    letters = [f"w{i}" for i in range(30)]
    error, spread = [], []
    for _ in range(200):
        one = [rnd.choice(letters) for _ in range(rnd.randint(5, 120))] * rnd.randint(1, 4)
        two = one[: rnd.randint(1, len(one))] + [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
        one, two = " ".join(one), " ".join(two)
        a, b = weighted_samples.sample_texts([one.encode(), two.encode()], 256)
        want = jaccard(one, two)
        error.append(np.mean(a == b) - want)
        spread.append(want * (1 - want) / 256)
    assert abs(np.mean(error)) < 0.006
    assert np.sqrt(np.mean(np.square(error))) < 1.15 * np.sqrt(np.mean(spread))


def sampled_by_the_book(text, sample):
    """One sample of one text, term by term, from the formulas alone."""
    names, counts, _ = weighted_samples._weighted_terms([text.encode()])
    best = None
    for k, w in zip(names, counts.tolist(), strict=True):
        group = weighted_samples.mix(np.array([k]), sample // 4 * 4 + 1).view(np.uint16)
        i = int(group[sample % 4])
        r, b, ln_c = weighted_samples._R[i], weighted_samples._B[i], weighted_samples._LN_C[i]
        t = math.floor(math.log(w) / r + b)
        ln_y = r * (t - b)
        ln_a = np.float32(ln_c - ln_y - r + 256)
        name = (int(weighted_samples.mix(np.array([k]))[0]) + t * 0x9E3779B1) % 2**32
        best = min(best, (ln_a, name)) if best else (ln_a, name)
    return int(weighted_samples.mix(np.array([best[1]], np.uint64))[0]) >> 48


def test_samples_follow_the_formulas(texts):
    for text in [texts[0][:3000], "a b c d e " * 50, "one two", "x " * 9 + "y " * 9]:
        got = weighted_samples.sample_texts([text.encode()])[0]
        for sample in (0, 1, 2, 3, 4, 30, 63):
            assert got[sample] == sampled_by_the_book(text, sample), (text[:20], sample)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_edit_report(spark, small, texts, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = weighted_samples.edit_report(load(spark, small, "documents")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = sorted(texts)
    assert sorted(r.doc_id for r in got) == ids
    prints = {r.doc_id: r.fingerprint for r in got}
    gap = []
    for r in got:
        after = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        text, size = texts[r.doc_id], len(texts[r.doc_id])
        changed = text[: size - size // 4] + texts[after][: size // 4]
        assert r.n_chars == size
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        both = [p[i : i + 4] for i in range(0, 256, 4) for p in [prints[r.doc_id]]]
        other = [prints[after][i : i + 4] for i in range(0, 256, 4)]
        assert r.near_next == np.mean([a == b for a, b in zip(both, other, strict=True)])
        gap.append(r.near_edited - jaccard(text, changed))
        assert abs(gap[-1]) < 0.35
    assert abs(np.mean(gap)) < 0.02
    same = {}
    for doc, text in texts.items():
        assert same.setdefault(text, prints[doc]) == prints[doc]


def test_fingerprints_of_odd_rows(spark, awkward, nothing):
    got = weighted_samples.edit_report(awkward).collect()
    assert len(got) == awkward.count() and weighted_samples.edit_report(nothing).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == "" and by_id[1].near_edited == 1.0
    assert by_id[1].near_next == 1.0  # two empty texts
    assert by_id[5].near_next in (0.0, 1.0) and len(by_id[5].fingerprint) == 256
    one = weighted_samples.edit_report(awkward.where("doc_id = 4")).collect()
    assert (one[0].near_next, one[0].n_chars) == (1.0, 3)
    named = awkward.withColumn("fingerprint", awkward["doc_id"]).withColumn("_row", awkward["n"])
    marked = weighted_samples.with_fingerprints(named)
    assert marked.columns == [*[c for c in named.columns if c != "fingerprint"], "fingerprint"]
    twice = [r.fingerprint for r in marked.where("text = 'one'").collect()]
    assert len(twice) == 2 and len(set(twice)) == 1
    pair = spark.createDataFrame([(twice[0], twice[0]), ("", ""), ("", twice[0])], "a string, b string")
    alike = pair.select(weighted_samples.likeness(pair.a, pair.b).alias("x")).collect()
    assert [r.x for r in alike] == [1.0, 1.0, 0.0]


# --- resampling ----------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    words = WORD.findall((text or "").translate(LOW))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [crc32(r.encode()) % 10_000 for r in runs]


def resampled(docs, target, percent=25):
    made = [(doc, *buckets(text)) for doc, text in docs]
    s, t = Counter(), Counter()
    for _, _, codes in made:
        s.update(codes)
    for text in target:
        t.update(buckets(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
        for b in range(10_000)
    ]
    rows = []
    for doc, n_words, codes in made:
        weight = sum(gain[c] for c in codes) // len(codes) if codes else 0
        name = f"7:{'' if doc is None else doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, n_words, len(codes), weight, score))
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= 20)
    return rows, able[: percent * len(able) // 100]


TRICKY = [
    "Ab-c d  e\nf_G7 hßi ÄÖ 中文 \U0001f600x\x7fy\x00z " * 9,
    "w" * 3000 + " " + " ".join(f"long{'x' * (i % 900)}" for i in range(60)),
    "...,,,", "", "é" * 700 + "-" + "ü" * 700,
]


def test_resampling(spark, small, texts):
    docs = [*texts.items(), *((1000 + i, t) for i, t in enumerate(TRICKY)), (None, TRICKY[0]), (5000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = load(spark, small, "benchmark")
    want, drawn = resampled(docs, [r.text for r in bench.collect()])
    got = resample.resample(df, bench).collect()
    key = repr
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(
        ((r[0], *r[2:]) for r in want), key=key
    )
    ranked = sorted((r.rank, -r.score, r.doc_id) for r in got if r.rank is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[1], r[2]) for r in ranked] == [(d[0], None if d[1] else d[2]) for d in drawn]


def test_resampling_prefers_the_target(spark):
    rnd = random.Random(4)
    like = [f"alpha{i}" for i in range(40)]
    unlike = [f"beta{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choice(like if i % 4 == 0 else unlike) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(" ".join(like * 3),)], "text string")
    ranks = resample.resample(df, target)
    drawn = [r.doc_id for r in ranks.collect() if r.rank is not None]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 50
    assert resample.drawn_documents(df, ranks).count() == 100


def test_resampling_odd_rows(awkward, nothing):
    got = resample.resample(awkward, awkward)
    assert got.count() == awkward.count()
    assert {r.doc_id: r.n_features for r in got.collect()}[1] == 0
    assert resample.resample(nothing, awkward).count() == 0
    alone = resample.resample(awkward, nothing)
    assert alone.where("rank IS NOT NULL").count() == got.where("rank IS NOT NULL").count()
    left = resample.drawn_documents(awkward, got)
    assert left.columns == awkward.columns
