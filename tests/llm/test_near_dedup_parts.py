"""Exact counts of common shingles, and families too large for one task."""

import random

import numpy as np

from linesight.llm import near_dedup as N
from tests.llm.data import documents, sentence
from tests.llm.test_near_dedup import brute_force, edited, result


def test_linked_equals_pairwise_test(monkeypatch):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[:rng.integers(1, 400)], rng.integers(1, 300))) for _ in range(40)] + [np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))]
    for columns in (7, 2048):
        monkeypatch.setattr(N, "COLUMNS", columns)
        got = N._linked(sets[:25], sets[20:], 75)
        assert (got == [[N.similar(a, b, 75) for b in sets[20:]] for a in sets[:25]]).all()


def test_marks_lose_no_likely_partner():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([pool[:200], rng.integers(0, 2**64, rng.integers(5, 200), dtype=np.uint64)])) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    reg = N.registers(np.concatenate(sets), n)
    own = rng.integers(0, 5, 60)
    left, right = N._mark(n[:30], reg[:30], own[:30], n[30:], reg[30:], own[30:], 75)
    for side, marks, other in ((range(30), left, range(30, 60)), (range(30, 60), right, range(30))):
        for at, i in enumerate(side):
            want = any(own[i] != own[j] and N._shared(reg[i], reg[j][None])[0] and N.likely(reg[i][None], reg[j][None], n[i:i + 1], n[j:j + 1], 75)[0] for j in other)
            assert marks[at] == want


def test_family_around_no_single_centre(spark, monkeypatch):
    """Edits of one text that is not there: most are unlike the centre of their
    buckets, and linked with others all the same."""
    rng = random.Random(12)
    base = sentence(rng, 250).split()
    texts = [" ".join(edited(rng, base, rng.randrange(4, 9))) for _ in range(160)]
    want = brute_force(enumerate(texts))
    assert result(N.near_duplicates(documents(spark, texts).repartition(4))) == want
    monkeypatch.setattr(N, "BLOCK", 11)
    assert result(N.near_duplicates(documents(spark, texts).repartition(4))) == want
