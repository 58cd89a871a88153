"""The near-duplicate stage against all pairs of shingle sets."""

import random

import numpy as np

from spectraloom.llm import jaccard, simhash
from tests.llm.test_text_operators import least_reachable, make

VOCABULARY = [f"w{i}" for i in range(5000)]


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(texts, similarity=0.8):
    """Pairs of places by brute force; texts without words are equal."""
    sets = [shingles(t) for t in texts]
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= similarity * len(a | b) - 1e-9]


def pages(n, share, edits, seed, size=300):
    """Pages that share a passage, then a copy of each with so many changed words."""
    rng = random.Random(seed)
    passage = rng.choices(VOCABULARY, k=int(size * share))
    out = [passage + rng.choices(VOCABULARY, k=size - len(passage)) for _ in range(n)]
    for page in out[:n]:
        copy = list(page)
        for i in rng.sample(range(size), edits):
            copy[i] = f"changed{rng.randrange(10**6)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def groups(spark, texts):
    return {r.doc_id: r.component_id for r in simhash.near_classes(make(spark, texts)).collect()}


def test_pages_with_a_common_passage_stay(spark):
    texts = pages(60, 0.8, 1, 1)
    kept = {r.doc_id for r in simhash.deduplicated(make(spark, texts)).collect()}
    assert kept == set(range(60))


def test_no_copy_is_lost_beside_a_common_passage(spark):
    texts = pages(150, 0.3, 5, 2)
    got = groups(spark, texts)
    assert all(got[150 + i] == got[i] == i for i in range(150))


def test_components_against_all_pairs(spark):
    texts = [t for k, edits in enumerate((3, 6, 8, 9, 10)) for t in pages(25, 0.2, edits, 10 + k, 400)] + pages(40, 0.5, 1, 20, 30) + pages(40, 0.9, 2, 21, 60) + [None, "", "one", "ONE", "one two"]
    pairs = alike(texts)
    sets = [shingles(t) for t in texts]
    at = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs if sets[i]]
    assert sum(0.8 <= x <= 0.9 for x in at) > 50
    assert groups(spark, texts) == least_reachable(range(len(texts)), pairs)


def test_signatures_never_say_too_much():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n, common = int(rng.integers(0, 3000)), rng.uniform(0, 1)
        both = rng.integers(0, 2**64, int(n * common), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, n - len(both) + 1)), dtype=np.uint64)])) for _ in range(2))
        assert jaccard.least_difference(jaccard.signature(a), jaccard.signature(b)) <= len(np.setxor1d(a, b))
