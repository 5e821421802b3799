import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linesight.llm import packing as P
from linesight.llm import token_shards as S
from linesight.llm.tokens import byte_bpe_50k, encoder
from tests.llm.data import awkward, documents, sentence

PATH, PATTERN = byte_bpe_50k()
EXACT = Tokenizer.from_file(PATH)


def ids_of(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids + [0]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(PATH, PATTERN).encode(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids


def test_encoder_special_strings_and_spaces():
    for text in ("a <|endoftext|> b", "  \n\n\t x  ", "don't I'LL 12 ½ ٣", "　a b\x1c\x85", "é🙂" * 20, "a" * 5000):
        assert encoder(PATH, PATTERN).encode(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    windows = []
    out = []
    for n in lengths:
        fits = [w for w in range(len(windows)) if windows[w] >= n]
        if fits:
            w = min(fits, key=lambda w: windows[w])
        else:
            windows.append(capacity)
            w = len(windows) - 1
        out.append(windows[w])
        windows[w] -= n
    return out, sorted(windows)


@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 70))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing_equals_plain_search(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    window, offset = P.best_fit_decreasing(lengths, capacity)
    room, left = plain_best_fit(lengths, capacity)
    assert [capacity - o for o in offset] == room
    used = defaultdict(int)
    for w, n in zip(window, lengths, strict=True):
        used[w] += n
    assert sorted(capacity - u for u in used.values()) == left


def check(rows, ids, texts):
    """Each id in exactly one piece, sequences gapless and within bounds."""
    want = sorted(((i, len(ids_of(t))) for i, t in zip(ids, texts, strict=True)), key=str)
    assert sorted(((r.doc_id, r.doc_tokens) for r in rows if r.start == 0), key=str) == want
    by_id = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        by_id[i].append(ids_of(t))
    sequences, total = defaultdict(list), 0
    for r in rows:
        own = next(x for x in by_id[r.doc_id] if len(x) == r.doc_tokens)
        piece = np.array(own[r.start:r.start + r.length], "<u4").tobytes()
        assert r.length == len(piece) // 4 and r.ids_crc32 == zlib.crc32(piece)
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(n for _, n in want)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences) * 1024 - total, total


def test_pack(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randrange(1, 500)) for _ in range(250)]
    rows = P.pack(documents(spark, texts).repartition(5), PATH, PATTERN).collect()
    padding, total = check(rows, list(range(len(texts))), texts)
    assert padding < 0.02 * total
    few = P.pack(documents(spark, texts), PATH, PATTERN, group_pieces=60).collect()
    check(few, list(range(len(texts))), texts)


def test_repeated_rows_are_dealt_to_all_groups(spark):
    """3000 rows without id and text among 6000: no group holds them together."""
    docs = documents(spark, [None] * 3000 + [f"w{i}" for i in range(3000)], [None] * 3000 + list(range(3000))).repartition(6)
    rows = P.pack(docs, PATH, PATTERN, group_pieces=100).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 6000 and len(sizes) == 60 and max(sizes.values()) < 160


def test_pack_awkward_rows(spark):
    ids, texts = awkward()
    check(P.pack(documents(spark, texts, ids), PATH, PATTERN).collect(), ids, texts)
    assert P.pack(documents(spark, []), PATH, PATTERN).count() == 0


@given(st.integers(1, 5000), st.integers(0, 2**70))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    slots = S.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert (S.permute(slots, n, key, inverse=True) == np.arange(n)).all()


def test_permutation_mixes_and_depends_on_the_key():
    a, b = (S.permute(np.arange(10_000), 10_000, k) for k in (1, 2))
    assert abs(np.corrcoef(a, np.arange(10_000))[0, 1]) < 0.05 and (a == b).mean() < 0.01


def test_training_order(spark, tmp_path):
    ids, texts = awkward()
    records = S.training_order(documents(spark, texts, ids).repartition(3), PATH, PATTERN, key=5, stride=64, rows_per_shard=50)
    rows = records.collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 64 * 2 and len(r.ids) == 128 for r in rows)
    assert {r.shard for r in rows} == set(range(-(-n // 50)))
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        raw = bytes(r.ids)[:2 * r.n_tokens]
        assert zlib.crc32(raw) == r.ids_crc32 and not any(r.ids[2 * r.n_tokens:])
        got[r.doc_id].append(np.frombuffer(raw, "<u2"))
    for i, t in zip(ids, texts, strict=True):
        if ids.count(i) == 1:
            assert np.concatenate(got[i]).tolist() == ids_of(t)
    S.write_shards(records, str(tmp_path / "shards"))
    later = S.read_shards(spark, str(tmp_path / "shards"), from_slot=120, rows_per_shard=50)
    assert sorted(r.slot for r in later.collect()) == list(range(120, n))
    assert S.training_order(documents(spark, []), PATH, PATTERN).count() == 0
