import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linesight.llm import words as W

PATTERNS = {"space": (W.NON_SPACE, r"[^\x20\x09-\x0D]+"), "alnum": (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(texts, mask):
    out = []
    for _, w in W.batches(pa.array(texts, pa.string()), mask, 40):
        raw = w.data
        for r in range(len(w.first) - 1):
            out.append([W.LOWER[raw[s:e]].tobytes().decode() for s, e in zip(w.starts[w.first[r]:w.first[r + 1]], w.ends[w.first[r]:w.first[r + 1]], strict=True)])
    return out


@pytest.mark.parametrize("kind", PATTERNS)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), st.text(alphabet="aB é\n\x1c1-", max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(kind, texts):
    mask, pattern = PATTERNS[kind]
    assert split(texts, mask) == [re.findall(pattern, (t or "").translate(TO_LOWER)) for t in texts]


def test_hash_depends_on_the_word_alone(monkeypatch):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["z" * 300]
    words = [rng.choice(vocabulary) for _ in range(5000)]
    one = W.hash_words(words)
    monkeypatch.setattr(W, "SEGMENT_BYTES", 64)
    W._powers.clear()
    assert (W.hash_words(words) == one).all()
    assert (W.hash_words([w.upper().replace("É", "é") for w in words]) == one).all()
    seen = {}
    for w, h in zip(words, one.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    W._powers.clear()


def test_grams_are_order_sensitive():
    h = W.hash_words(["a", "b", "a", "b", "c"])
    g = W.grams(h, 2)
    assert len(g) == 4 and g[0] == g[2] and len(set(g.tolist())) == 3
    assert len(W.grams(h, 9)) == 0
    assert np.all(W.grams(h[:2], 2) == g[:1])
