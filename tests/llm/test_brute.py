"""Operators that SQL cannot state, against plain Python over the same whole tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from lakemill.llm import bpe, fertility, ngram_join, passages, pii, token_store, url_templates
from lakemill.llm.queries import QUERIES, URL_RULES
from lakemill.session import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in load(spark, small, "documents").collect()}


# --- quality -------------------------------------------------------------------------------------


def quality(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(hit), failed,
    )


def fertile(text, model):
    """Pieces of every word by the library alone, and the bands applied to them."""
    words = WORD.findall(text)
    pieces = [p for w in words for p in model.encode(w)]
    if len(pieces) < fertility.BAND_PIECES:
        return True
    chars = "".join(words)
    counts = [0] * 6
    for c in chars:
        for lo, hi, script in fertility._RANGES:
            counts[script] += lo <= ord(c) <= hi
    script = counts.index(max(counts)) if any(counts) else 5
    least, most, varied = list(fertility.BANDS.values())[script]
    share = np.array(list(Counter(pieces).values())) / len(pieces)
    entropy = -(share * np.log(share)).sum() / np.log(len(pieces))
    by_byte = sum(model.is_byte(p) for p in pieces) / len(pieces)
    return len(chars) / len(pieces) >= least and by_byte <= most and entropy >= varied


def test_quality(spark, small, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(fertility.VOCABULARY)
    )
    got = QUERIES["op5_tokeniser_fertility"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1] and fertile(texts[r.doc_id], model))


def test_junk_is_out_of_band(spark):
    rnd = random.Random(3)
    noise = " ".join(chr(rnd.randint(0x1200, 0x1FFF)) * 3 for _ in range(200))
    mono = " ".join(f"{'ab' * (i % 7 + 1)}" for i in range(400))
    df = spark.createDataFrame([(1, noise), (2, mono)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in fertility.measure_quality(df).collect()}[2] is False
    strict = fertility.measure_quality(df, bands={"other": (0.2, 0.5, 0.2)}).collect()
    assert {r.doc_id: r.kept for r in strict}[1] is False


# --- personal data -------------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = [int(c) for c in re.sub("[^0-9]", "", match)]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        odd = digits[-1::-2]
        even = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
        return 14 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    spans = [
        (m.start(), rank, m.end())
        for rank, (kind, form) in enumerate(FORMS.items())
        for m in re.finditer(form, text)
        if valid(kind, m.group())
    ]
    kinds = list(FORMS)
    return ",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in sorted(spans))


TRICKY = [
    "a@b.c_d@e.f.g", "x@y", "@a.b", "..@--.--", "a@b.cc@d.ee", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4",
    "1.2.3", "4539 1488 0343 6467 and 4539-1488-0343-6467", "4539  1488 0343 6467", "0" * 16 + " 1",
    "+1 (555) 123-4567 +12 3", "++49 30 1234567890-", "é+49.30.1234567.", "😀 4539148803436467 😀 a@b.co",
    "7" * 4000 + "." + "1.1.1", "a" * 5000 + "@", "+1" + " " * 3000 + "234567890",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.private_report(df).collect():
        want = base(TRICKY[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), TRICKY[r.doc_id][:60]
        assert r.spans == want


def test_personal_data(spark, small, texts):
    for r in QUERIES["op2_information_pii"](spark, small).collect():
        want = base(texts[r.doc_id])
        counts = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in FORMS]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_terms_that_give_a_person_away(spark):
    rnd = random.Random(1)
    common = [f"word{chr(97 + i)}" for i in range(26)]
    prose = lambda: " ".join(rnd.choice(common) for _ in range(20))
    docs = [(i, f"{prose()} Jörgensen jj@mail.org {prose()}") for i in range(4)]
    docs += [(4, f"{prose()} jörgensen {prose()}")]
    docs += [(i, prose()) for i in range(5, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = {r.doc_id: r for r in pii.private_report(df, min_share=0.8).collect()}
    for i, text in docs[:5]:
        at = text.lower().index("jörgensen")
        assert f"term:{at}:{at + 9}" in marked[i].spans
    assert all(marked[i].spans == "" for i in range(5, 400))
    assert all(r.n_term == 0 for r in pii.private_report(df, min_share=0.9).collect())
    clean = {r.doc_id: r.text for r in pii.sanitise(df, min_share=0.8).collect()}
    assert "[TERM]" in clean[4] and "[TERM] [EMAIL]" in clean[0]


# --- tokens --------------------------------------------------------------------------------------

ODD_TEXTS = [
    "Hello  World's I'll Straße É ﬁ İstanbul ΑΣ 中文字 1234 á <|endoftext|> x \x1c y \xa0z it's 'S ",
    "", "   ", "ABC<|startoftext|>def", "😀👍🏽 naïve…", "\n \n a", "tail ", " lead", "a  b", "a\r\n b",
    "aaaaaaaaaaaaaaaaaaaaaaaa " * 3, "don't DON'T we'll", "x" * 3000,
]


def test_word_bpe(texts):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path(None)
    mine, library = bpe.WordEncoder(path), Tokenizer.from_file(path)
    for text in [*ODD_TEXTS, *texts.values()]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text.encode()), "<u4").tolist() == want, text[:80]


def test_word_bpe_query(spark, small, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(None))
    for r in QUERIES["op9_bpe_backtracking"](spark, small).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_byte_bpe(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_store.VOCABULARY)
    library, mine = Tokenizer.from_file(path), token_store.ByteEncoder(path)
    for text in ODD_TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text.encode()).tolist() == want, text[:80]
    got = {r.doc_id: r for r in QUERIES["op4_repair_token_files"](spark, small).collect()}
    start = 0
    for doc in sorted(texts):
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


@pytest.mark.parametrize("kind", ["random", "periodic", "equal", "ends", "empty"])
def test_grammar_round_trip(kind):
    rng = np.random.default_rng(7)
    ids = {
        "random": rng.integers(0, 50_000, 20_000),
        "periodic": np.tile([5, 6, 7, 5, 6], 5000),
        "equal": np.full(9999, 9),
        "ends": rng.choice([2, 3, 4], 30_000),
        "empty": np.zeros(0, int),
    }[kind].astype(np.uint32)
    symbols, rules, places = token_store.compress(ids)
    lengths = token_store.expansion_lengths(rules)
    assert token_store.Grammar(rules, lengths).expand(symbols).tolist() == ids.tolist()
    assert not (rules == token_store.END_ID).any()
    assert len(places) == len(symbols)
    if kind in ("periodic", "equal"):
        assert len(symbols) < len(ids) / 20


# --- near duplicates -----------------------------------------------------------------------------


def components(sets, links):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {d: find(d) for d in sets}


def test_joins_at_the_threshold(spark):
    """Sets of all sizes whose similarity lies around the threshold, in groups with a shared key."""
    rnd = random.Random(11)
    docs = {}
    for size in [*range(1, 40), 64, 90, 127, 128, 129, 200, 255, 257]:
        words = [f"{size}w{rnd.random():.9f}" for _ in range(size + 4)]
        docs[len(docs)] = words
        for cut in (size // 8, size // 7, size // 5, size // 4, size // 3):
            docs[len(docs)] = words[: len(words) - cut]
            docs[len(docs)] = words[: len(words) - cut] + [f"n{rnd.random()}" for _ in range(cut // 2)]
    passage = [f"p{i}" for i in range(60)]
    for _ in range(60):  # a common passage in documents that are alike or not
        docs[len(docs)] = passage + [f"q{rnd.random()}" for _ in range(rnd.randint(0, 60))]
    sets = {
        d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
        for d, w in docs.items()
    }
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    df = spark.createDataFrame(
        [(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"
    ).repartition(3)
    got = {r.doc_id: r for r in ngram_join.similar_documents(df).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}


# --- passages ------------------------------------------------------------------------------------


def test_planted_passages(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    exact, fuzzy = prose(60), prose(80)
    docs, spans = [], {}
    for i in range(90):
        body = prose(rnd.randint(60, 300))
        at = rnd.randint(0, len(body))
        if i % 5 == 0:
            body[at:at] = exact
            spans[i] = (at, at + 60)
        elif i % 7 == 0:
            changed = list(fuzzy)
            changed[i % 60 + 10] = "other"
            del changed[35]
            changed.insert(50, "more")
            body[at:at] = changed
            spans[i] = (at, at + 80)
        docs.append((i, " ".join(body)))
    docs.append((100, docs[3][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = passages.shared_passages(df).collect()
    covered = defaultdict(set)
    for r in found:
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
        covered[r.partner_id] |= set(range(r.partner_start, r.partner_end))
    assert set(covered) == {*spans, 3, 100}
    for doc, (lo, hi) in spans.items():
        assert len(covered[doc] & set(range(lo, hi))) >= (hi - lo) - 12, doc
        assert len(covered[doc] - set(range(lo - 3, hi + 3))) == 0, doc
    left = {r.doc_id: r.text for r in passages.remove_passages(df).collect()}
    assert left[100] == "" and left[3] == docs[3][1]


def test_chains_against_all_orders():
    """The tree's best chain scores as much as the best over all pairs of matches."""
    rnd = random.Random(2)
    for _ in range(30):
        points = sorted({(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(25)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        best = []
        for j in range(len(x)):
            gains = [
                best[i] - passages.GAP_COST * (x[j] - x[i] + y[j] - y[i])
                for i in range(j)
                if x[i] < x[j] and y[i] < y[j]
            ]
            best.append(passages.K + max([0.0, *gains]))
        chains = passages.best_chains(x, y)
        top = chains[0]
        cost = sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(top, top[1:], strict=False))
        assert abs(passages.K * len(top) - passages.GAP_COST * cost - max(best)) < 1e-9
        assert sorted(i for c in chains for i in c) == list(range(len(x)))


# --- url templates -------------------------------------------------------------------------------


def judged(pages, bad):
    """{page_id: (template, purity)} by plain loops; pages maps page_id to (host, path)."""
    parts = {p: [s for s in path.split("/") if s] for p, (_, path) in pages.items()}
    template = dict.fromkeys(pages, "")
    done, level = {}, 0
    while template:
        n, k = Counter(), Counter()
        for p in bad:
            if p in template:
                n[pages[p][0], template[p]] += 1
                k[pages[p][0], template[p]] += bad[p]
        for p in list(template):
            node = (pages[p][0], template[p])
            if not (0 < k[node] < n[node] and n[node] >= url_templates.DIFFERENT**2):
                done[p] = template.pop(p) + ("/**" if len(parts[p]) > level else "")
        seg = {p: parts[p][level] if len(parts[p]) > level else None for p in template}
        often = Counter((pages[p][0], template[p], seg[p]) for p in template)
        branch = {}
        for p in template:
            if seg[p] is None:
                branch[p] = "$"
            elif often[pages[p][0], template[p], seg[p]] >= url_templates.MIN_URLS:
                branch[p] = seg[p]
            else:
                branch[p] = "{n}" if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]+)?", seg[p]) else "{s}"
        n.clear()
        k.clear()
        for p in bad.keys() & template.keys():
            for key in ((pages[p][0], template[p]), (pages[p][0], template[p], branch[p])):
                n[key] += 1
                k[key] += bad[p]
        named = {}
        for p in template:
            node, own = (pages[p][0], template[p]), (pages[p][0], template[p], branch[p])
            name = "*"
            if branch[p] == "$":
                name = "$"
            elif n[own] and n[node] - n[own]:
                share = k[node] / n[node]
                spread = share * (1 - share) * (1 / n[own] + 1 / (n[node] - n[own]))
                gap = abs(k[own] / n[own] - (k[node] - k[own]) / (n[node] - n[own]))
                if spread > 0 and not gap < url_templates.DIFFERENT * spread**0.5:
                    name = branch[p]
            named[p] = f"{template[p]}/{name}"
        done |= {p: t for p, t in named.items() if t.endswith("/$")}
        template = {p: t for p, t in named.items() if not t.endswith("/$")}
        level += 1
    template = done
    n, k = Counter(), Counter()
    for p in bad:
        for key in (pages[p][0], (pages[p][0], template[p]), None):
            n[key] += 1
            k[key] += bad[p]
    share, w = k[None] / n[None], url_templates.WEIGHT
    out = {}
    for p, (host, _) in pages.items():
        prior = (k[host] + w * share) / (n[host] + w)
        out[p] = (template[p], (k[host, template[p]] + w * prior) / (n[host, template[p]] + w))
    return out


def test_template_tree(spark):
    rnd = random.Random(4)
    rows, bad = [], {}
    for i in range(1500):
        host = rnd.choice(["a.com", "a.com", "b.org", "c.net"])
        folder = rnd.choice(["news", "shop", "x"])
        rows.append((i, f"http://{host}/{folder}/{rnd.randint(1, 9000)}/{'p/q' * (i % 2)}"))
        if i % 3:
            bad[i] = int(rnd.random() < (0.9 if (host, folder) == ("a.com", "shop") else 0.1))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, labels, {"zz/": "block"}).collect()}
    want = judged({i: (u.split("/")[2], u[len("http://") + len(u.split("/")[2]) :]) for i, u in rows}, bad)
    for i, (template, purity) in want.items():
        assert got[i].template == template
        assert abs(got[i].purity - purity) < 1e-12
    blocked = {got[i].template for i in got if got[i].verdict == "block"}
    assert blocked and all(t.startswith("/shop") for t in blocked)


def test_pages_that_differ_in_a_deep_segment(spark):
    """Good and bad pages of one host part at segment 5, and at segment 9 below a shared wildcard."""
    rows = [(i, f"http://a.com/a/b/c/d/{'bad' if i % 2 else 'good'}/{i}") for i in range(400)]
    rows += [(400 + i, f"http://b.com/{i}/w/x/y/z/q/r/s/{'bad' if i % 2 else 'good'}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = {i: i % 2 for i, _ in rows if i % 3}
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, labels, {"zz/": "block"}).collect()}
    assert {got[i].verdict for i, _ in rows if i % 2} == {"block"}
    assert {got[i].verdict for i, _ in rows if not i % 2} == {"allow"}
    assert got[0].template == "/*/*/*/*/good/**"
    want = judged({i: (u.split("/")[2], u[len("http://a.com") :]) for i, u in rows}, bad)
    for i, (template, purity) in want.items():
        assert got[i].template == template and abs(got[i].purity - purity) < 1e-12


def test_verdicts_of_the_url_query(spark, small):
    """Templates and verdicts of all pages, by plain loops over the tables."""
    pages = {r.page_id: r.url or "" for r in load(spark, small, "pages").collect()}
    quality = {r.doc_id: r.quality for r in load(spark, small, "labels").collect()}
    split, bad = {}, {}
    for page, url in pages.items():
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        split[page] = (found[1].lower(), found[2]) if found else ("", "")
        number = re.search(r"/([0-9]{1,18})(?:\.html)?/?$", split[page][1])
        if number and quality.get(int(number[1])) is not None:
            bad[page] = int(quality[int(number[1])] == 0)
    want = judged(split, bad)
    for r in QUERIES["op1_url_templates"](spark, small).collect():
        template, purity = want[r.page_id]
        assert (r.host, r.path) == split[r.page_id] and r.template == template
        if r.rule is None:
            assert r.verdict == ("block" if purity >= url_templates.REJECT else "allow")


def test_url_query(spark, small):
    for r in QUERIES["op1_url_templates"](spark, small).collect():
        fits = [
            rule for rule in URL_RULES
            if ("." + r.host).endswith("." + rule.split("/")[0])
            and r.path.startswith("/" + rule.split("/", 1)[1])
        ]
        rule = max(fits, key=len, default=None)
        assert r.rule == rule and (rule is None or r.verdict == URL_RULES[rule])


def test_latin_texts_encode_as_the_library_does():
    """Marks that compose only in one case, contractions, numbers and spaces beyond ASCII."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path(None)
    library, own = Tokenizer.from_file(path), bpe.WordEncoder(path)
    rnd = random.Random(21)
    letters = [chr(i) for i in range(0x260)] + list("\'\'\'sStTrRdmlev")
    letters += ["\u0301", "\u0308", "\u0331", "\u212a", "\u0130", "\u4e2d", "\U0001f600", "\u2003", "\u1e9e", "\u03a3"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(15_000)]
    texts += ["T\u0308a t\u0308a", "I\'LL We\'Re don\'t", "x" * 300 + "\u00e9", "\u00bd1\u00b2"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == want, text
