import random
import zlib
from collections import defaultdict

from linesight.llm import line_dedup as L
from linesight.llm import sharding as S
from tests.llm.data import awkward, documents, sentence


def place(rows, texts, ids):
    assert len(rows) == len(ids)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    slots, loads = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_shards(spark, monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng, rng.randrange(1, 300)) for _ in range(1500)] + ["copy " * 40] * 60
    rng.shuffle(texts)
    for parts in (S.PARTS, 64):
        monkeypatch.setattr(S, "SLOT_ROWS", 100)
        rows = S.shard(documents(spark, texts), parts=parts).collect()
        loads = place(rows, texts, list(range(len(texts))))
        assert max(loads.values()) - min(loads.values()) <= max(len(t) for t in texts) + sum(map(len, texts)) / parts
        text = dict(enumerate(texts))
        together = defaultdict(set)
        for r in rows:
            together[text[r.doc_id]].add(r.shard)
        assert all(len(s) == 1 for s in together.values())


def test_shards_awkward_rows(spark):
    ids, texts = awkward()
    place(S.shard(documents(spark, texts, ids)).collect(), texts, ids)
    assert S.shard(documents(spark, [])).count() == 0


def test_longest_first():
    assert S.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def brute_force(rows, k=3):
    """Text of each row after later windows are taken out."""
    windows = defaultdict(list)
    for i, t in rows:
        x = [s if s.strip(" ") else "" for s in (t or "").split("\n")] if t is not None else []
        for p in range(max(1, len(x) - k + 1)):      # a short text is one window
            if any(x[p:p + k]):
                windows[tuple(x[p:p + k])].append((i, p))
    cover, keep = defaultdict(set), defaultdict(set)
    for window, spots in windows.items():
        if len(spots) > 1:
            first = min(spots)
            for i, p in spots:
                (keep if (i, p) == first else cover)[i] |= set(range(p, p + len(window)))
    out = {}
    for i, t in rows:
        gone = cover[i] - keep[i]
        out[i] = (None if t is None else "\n".join(s for p, s in enumerate(t.split("\n")) if p not in gone), 0 if t is None else t.count("\n") + 1, len(gone))
    return out


def test_repeated_windows(spark):
    rng = random.Random(8)
    pool = [sentence(rng, 3) for _ in range(12)] + ["", "  "]
    passage = [sentence(rng, 20) for _ in range(5)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    texts += ["\n".join([sentence(rng, 4), *passage, sentence(rng, 4)]) for _ in range(30)]
    texts += ["same\n" * 9, "a\nb\na\nb\na\nb\na\nb"]
    texts += ["one line", "two\nlines", "one line", " \n ", "two\nlines", "one line\n", "two\nlines\n", "", "one line", "two\nlines\nmore"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.drop_repeated_windows(documents(spark, texts)).collect()}
    assert got == brute_force(list(enumerate(texts)))
    assert sum(passage[2] in t for t, _, _ in got.values()) == 1


def test_lines_awkward_rows(spark):
    ids, texts = awkward()
    docs = documents(spark, texts, ids)
    out = L.drop_repeated_windows(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(ids)
    want = brute_force([(i, t) for i, t in zip(ids, texts, strict=True) if i is not None])
    for r in rows:
        if r.doc_id is not None:
            assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id]
    again = L.drop_repeated_windows(docs.withColumnRenamed("n", "N_Lines"))
    assert again.columns[-2:] == ["n_lines_", "n_removed"]
    assert L.drop_repeated_windows(documents(spark, [])).count() == 0


def test_line_dedup_plan_is_native(spark):
    plan = L.drop_repeated_windows(documents(spark, ["a\nb\nc"] * 2))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
