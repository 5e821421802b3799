import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from linesight.llm import conversation_repair as R

TURNS = "conv_id long, turn long, role string, text string, said string, place int, Kind string"


def damaged(rows):
    """conv_id -> turns after the planted faults, in order."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        show = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        out[conv]
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by trying every sequence of edits that costs
    no more than deleting everything."""
    marks, limit, best = faults(turns), 2 * len(turns), []

    def search(i, cost, audit, kept):
        if cost > limit:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
            best.append((cost, audit, kept))
        for role in ("user", "assistant"):
            search(i, cost + 5, audit + "I", [*kept, (role, "")])
        if i < len(turns):
            _, role, text = turns[i]
            search(i + 1, cost + 2, audit + "D", kept)
            if marks[i] in ("", "truncated"):
                extra = 5 if marks[i] else 0
                search(i + 1, cost + extra, audit + "K", [*kept, (role, text)])
                for other in ("user", "assistant"):
                    search(i + 1, cost + extra + 1, audit + "R", [*kept, (other, text)])
    search(0, 0, "", [])
    return min(best, key=lambda b: (b[0], b[1].encode()))


def expected(conv, turns):
    marks = faults(turns)
    numbers = {t[0] for t in turns} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, kept = cheapest(turns)
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (conv, gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def small_conversations():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "x.\n\n", "Été…", "ok ok.", None, "half"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "sys"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), rng.choice(roles), rng.choice(texts), "s", 1, "k"))
    for turn, role in enumerate(["system", "user", "assistant", "user", "assistant"]):     # clean ones
        rows.append((500, turn, role, f"{role} {turn}.", "s", 1, "k"))
    rows += [(None, 0, "user", "Who?", "s", 1, "k"), (None, 1, "assistant", "Me.", "s", 1, "k")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone.", "s", 1, "k"))
    rows += [(700, 3, "user", "Same.", "s", 1, "k")] * 3 + [(700, 3, "assistant", "Other.", "s", 1, "k"), (701, None, "user", "x" * 100_000 + ".", "s", 1, "k"), (701, None, "assistant", "y" * 100_000 + ".", "s", 1, "k")]
    rng.shuffle(rows)
    return rows


def test_repair_equals_brute_force(spark):
    rows = small_conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    want = {expected(conv, turns) for conv, turns in damaged(rows).items()}
    for block in (R.BLOCK_BYTES, 1100):
        got = [tuple(r) for r in R.repair(R.damage(df), block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_registered_query_returns_the_contract(spark, tmp_path):
    from linesight.llm import queries
    rows = small_conversations()
    spark.createDataFrame(rows, TURNS).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", *R.SUMMARY]
    assert {tuple(r) for r in got.collect()} == {expected(conv, turns) for conv, turns in damaged(rows).items()}


def long_conversation():
    rng = random.Random(3)
    return [(9, i, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Yes.", f"number {i}.", f"cut {i}", ""]), "s", 1, "k") for i in range(2000)]


def test_checkpoints_change_nothing(spark):
    rows = long_conversation()
    df = spark.createDataFrame(rows + [(i, *r[1:]) for i in (10, 11) for r in rows[:40]], TURNS).repartition(4)
    whole, cut = ({tuple(r) for r in R.repair(df, block).collect()} for block in (1 << 30, 4096))
    assert whole == cut and len(cut) == 3
    marks = R.checkpoints(R.marked(df), 4096)
    of_long = marks.where("conv_id = 9")
    n, size = of_long.count(), of_long.first()["size"]
    total = R.marked(df).where("conv_id = 9").groupBy().sum("weight").first()[0]
    assert size == max(4096, -(-int((total * R.TURN_BYTES)**0.5 * 1000) // 1000)) or abs(size - (total * R.TURN_BYTES)**0.5) < 2
    assert n == -(-total // size) and n < 60                          # about the square root of 2000 turns
    assert R.checkpoints(R.marked(df), 1 << 30) is None


def test_edits_rebuild_the_conversation(spark):
    rows = small_conversations() + long_conversation()[:300]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    summary = {r["conv_id"]: r for r in R.repair(R.damage(df), 3000).collect()}
    edits = defaultdict(list)
    for r in R.repaired_turns(R.damage(df), 3000).collect():
        edits[r["conv_id"]].append(r)
    for conv, s in summary.items():
        own = sorted(edits[conv], key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert "".join(r["edit"] for r in own) == s["audit"]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == s["repaired_sha256"]
        assert all(r["turn"] is None and r["text"] == "" for r in own if r["edit"] == "I")


def test_empty_table_and_plain_turns(spark):
    df = spark.createDataFrame([], TURNS)
    assert R.repair(df).count() == 0 and R.repair(R.damage(df)).count() == 0 and R.repaired_turns(df).count() == 0
    plain = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    row = R.repair(plain).first()
    assert (row["cost"], row["audit"], row["gaps"]) == (0, "KK", 0)
