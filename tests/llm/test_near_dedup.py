import random
import re

import numpy as np

from linesight.llm import near_dedup as N
from tests.llm.data import awkward, documents, sentence


def brute_force(rows):
    """(doc_id, size, component) by comparing all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_components_equal_brute_force(spark):
    """Hot groups: copies, edits of one text, chains whose ends are unlike."""
    rng = random.Random(3)
    texts = []
    base = sentence(rng, 150).split()
    texts += [" ".join(base)] * 20
    texts += [" ".join(edited(rng, base, rng.randrange(1, 9))) for _ in range(90)]
    chain = sentence(rng, 120).split()
    for _ in range(25):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    texts += [sentence(rng, rng.randrange(1, 80)) for _ in range(60)]
    texts += [" ".join(base[:rng.randrange(1, 8)]) for _ in range(20)]
    rng.shuffle(texts)
    got = result(N.near_duplicates(documents(spark, texts)))
    assert got == brute_force(enumerate(texts))


def test_unfinished_buckets_are_finished(spark, monkeypatch):
    """Two tight groups that meet in the same buckets, in blocks of three."""
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "PART", 900)     # a few sets: centres and families are cut into parts
    rng = random.Random(9)
    base = sentence(rng, 200).split()
    far = base[:165] + sentence(rng, 35).split()
    texts = [" ".join(edited(rng, x, rng.randrange(0, 5))) for x in (base, far) for _ in range(25)]
    assert result(N.near_duplicates(documents(spark, texts))) == brute_force(enumerate(texts))


def test_one_doc_id_with_different_texts(spark):
    """Rows (5, A), (5, B), (1, near A), (2, near B): each text keeps its links."""
    rng = random.Random(4)
    a, b = (sentence(rng, 100).split() for _ in range(2))
    rows = [(5, a), (5, b), (1, edited(rng, a, 1)), (2, edited(rng, b, 1)), (3, sentence(rng, 100).split()), (None, edited(rng, b, 1)), (7, a)]
    got = N.near_duplicates(documents(spark, [" ".join(t) for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("1", 1, True), ("2", 2, True), ("3", 3, True), ("5", 1, False), ("5", 2, False), ("7", 1, False), ("None", 2, False)]


def test_groups_without_any_doc_id(spark):
    rng = random.Random(8)
    a = sentence(rng, 80).split()
    got = N.near_duplicates(documents(spark, [" ".join(a), " ".join(edited(rng, a, 1)), ""], [None] * 3)).collect()
    assert all(r.component_id is None and r.kept for r in got) and len(got) == 3


def test_awkward_rows(spark):
    ids, texts = awkward()
    got = N.near_duplicates(documents(spark, texts, ids)).collect()
    assert len(got) == len(ids)
    want = brute_force((i, t) for i, t in zip(ids, texts, strict=True) if i is not None)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
        else:
            assert r.component_id is None and r.kept and r.n_shingles == 1
    assert N.near_duplicates(documents(spark, [])).count() == 0


def test_registers_are_mergeable_and_estimate_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 2**64, 3000, dtype=np.uint64)
    both = np.concatenate([a, b])
    one = [N.registers(np.sort(x), np.array([len(x)]))[0] for x in (a, b, both)]
    assert (np.maximum(one[0], one[1]) == one[2]).all()
    errors = []
    for share in (0.3, 0.6, 0.75, 0.9):
        for _ in range(30):
            pool = rng.integers(0, 2**64, 1000, dtype=np.uint64)
            k = int(1000 * share)
            x, y = pool[:k + (1000 - k) // 2], np.concatenate([pool[:k], pool[k + (1000 - k) // 2:]])
            rx, ry = (N.registers(np.sort(s), np.array([len(s)])) for s in (x, y))
            errors.append(N.estimate(rx, ry, np.array([len(x)]), np.array([len(y)]))[0] - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08 and min(errors) > -N.SLACK
