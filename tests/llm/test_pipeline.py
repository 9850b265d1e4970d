"""The pipeline's stages on a small corpus, each held against a brute-force version of its decision."""

import collections

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import brute_counts, brute_lines, packed, water_level, words

import corpus_pipeline
from wayfarer.llm import near_copies, pieces, quality, simhash
from wayfarer.llm.common import stored


@pytest.fixture(scope="module")
def corpus(make, odd):
    r = np.random.default_rng(2)
    text = lambda n: "\n".join(" ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(12)) for _ in range(n))
    clean = [(100 + k, text(r.integers(6, 20))) for k in range(250)]
    copies = [(400 + k, clean[k][1]) for k in range(5)]
    shared = [(500 + k, clean[20 + k][1].split("\n")[0] + "\n" + text(8)) for k in range(5)]
    return odd + clean + copies + shared


def test_stages(spark, make, corpus):
    docs = make(corpus, sources={d: "ab"[k % 2] for k, (d, _) in enumerate(corpus)})
    by_stage = []
    for _, stage in corpus_pipeline.STAGES:
        by_stage.append(docs)
        out = stored(stage(spark, docs, ""), "test-stage")
        if len(by_stage) < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        docs = out
    texts = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in by_stage]

    passed = {d for d, t in corpus if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert sorted(d for d, _ in texts[1]) == sorted(passed)
    kept = {d: t for d, _, _, t in brute_lines(texts[1]) if words(t)}
    assert dict(texts[2]) == kept
    prints = {d: simhash.fingerprint(t.encode()) for d, t in texts[2]}
    assert {d for d, _ in texts[3]} == {d for d in prints if not any(e < d and ((prints[e] ^ prints[d]) % (1 << 64)).bit_count() <= 2 for e in prints)}
    sources = {r["doc_id"]: r["source"] for r in by_stage[3].collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for d, t in texts[3]:
        sizes[sources[d]] += len(words(t))
    for d, t in texts[4]:
        taken[sources[d]] += len(words(t))
    for s, target in water_level(sizes).items():
        assert abs(taken[s] - target) <= 150
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in docs.collect()) == sorted((d, packed(library.encode(t))) for d, t in texts[4])


def test_a_corpus_that_is_empty_or_all_rejected(spark, make, odd):
    for rows in ([], [(1, None), (2, "few words")]):
        docs = make(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_rejected_outliers_go(spark, make):
    r = np.random.default_rng(2)
    clean = [(k, " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(120))) for k in range(300)]
    junk = [(1000, " ".join(f"a{k}$$$" for k in range(100)))]
    kept = quality.passed(make(clean + junk)).select(F.collect_set("doc_id")).first()[0]
    assert sorted(kept) == [k for k, _ in clean]


def test_near_copies_of_five_words_go(spark, make):
    """Texts with some words replaced: what is left is what all pairs of similarity 0.8 or more leave."""
    r = np.random.default_rng(5)
    made = []
    for k in range(12):
        text = [f"w{x}" for x in r.integers(0, 5000, 300)]
        for j in range(8):
            own = list(text)
            for at in r.integers(0, 300, r.integers(0, 12)):
                own[at] = f"n{r.integers(0, 5000)}"
            made.append((int(1000 * r.permutation(8)[0] + 10 * k + 100 * j), " ".join(own)))
    made = list(dict(made).items())
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, t in made if (w := t.split())}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in close:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    bits = lambda a, b: ((simhash.fingerprint(dict(made)[a].encode()) ^ simhash.fingerprint(dict(made)[b].encode())) % (1 << 64)).bit_count()
    assert sum(bits(a, b) > simhash.BITS for a, b in close) > 50
    expected = sorted(d for d in root if root[d] == d)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make(made), "").collect()) == expected
