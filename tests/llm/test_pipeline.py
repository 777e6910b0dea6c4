"""The pipeline against plain Python, stage by stage on its own input."""

import hashlib
import os
import re

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import corpus_pipeline
from lakemill.llm import bpe, fertility
from lakemill.session import load, materialise
from test_brute import WORD, components, fertile, quality

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines_left(docs):
    found = {}
    for d, text in docs.items():
        for line in text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 20:
                found.setdefault(key, set()).add(d)
    last = {k: max(v) for k, v in found.items() if len(v) >= 3}
    return {
        d: "\n".join(
            x for x in t.split("\n") if last.get(x.strip(" \t\n\x0b\x0c\r").translate(LOWER), d) == d
        )
        for d, t in docs.items()
    }


def groups_left(docs):
    sets = {}
    for d, text in docs.items():
        w = WORD.findall(text.translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = components(sets, links)
    return {d: t for d, t in docs.items() if root[d] == d}


def clean(docs, bench):
    windows = set()
    for text in bench:
        w = ITEM.findall(text.translate(LOWER))
        if w:
            windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    out = {}
    for d, text in docs.items():
        w = ITEM.findall(text.translate(LOWER))
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            out[d] = text
    return out


@pytest.fixture(scope="module")
def expected(spark, small):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(fertility.VOCABULARY)
    )
    docs = {r.doc_id: r.text for r in load(spark, small, "documents").collect()}
    docs = {d: t for d, t in docs.items() if not quality(t)[-1] and fertile(t, model)}
    steps = [docs]
    steps.append(lines_left(steps[-1]))
    steps.append(groups_left(steps[-1]))
    steps.append(clean(steps[-1], [r.text for r in load(spark, small, "benchmark").collect()]))
    library = Tokenizer.from_file(bpe.vocabulary_path(None))
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in steps[-1].items()}
    return steps, {d: hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for d, i in ids.items()}


def test_stages(spark, small, expected):
    steps, ids = expected
    docs = load(spark, small, "documents")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, [*steps, None], strict=True):
        docs = materialise(stage(spark, docs, small), name)
        if want is None:
            assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == ids
        else:
            rows = docs.collect()
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in rows} == want, name
            assert all(r.n_chars == len(r.text) for r in rows)
    assert len(steps[0]) > len(steps[2]) > len(steps[3]) > 0


def test_run(spark, small, expected):
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, small).collect()} == expected[1]
