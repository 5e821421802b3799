"""Ground-truth matching tie-breaks against a brute-force specification
(every row compared with every ground-truth row, lowest index wins)."""

from linesight.operators import matching as M


def _norm(s):
    return "".join((s or "").split())


def _pick(cands, target):
    """First candidate (lowest index) of the row's class, else the first."""
    same = [c for c in cands if c[1] == target]
    return min(same or cands)[0]


def _brute_force_match(rows, gt, n=150):
    """Specification by brute force over all ground-truth rows: exact
    normalized equality first; otherwise the 150-character block, where a lone
    candidate is taken as is and starts-with candidates (either way) win."""
    truth = sorted((i, t, _norm(f)) for i, f, t in gt)
    result = {}
    for rid, func, target in rows:
        r = _norm(func)
        exact = [c for c in truth if c[2] == r]
        block = [c for c in truth if c[2][:n] == r[:n]]
        if exact:
            result[rid] = _pick(exact, target)
        elif len(block) == 1:
            result[rid] = block[0][0]
        elif block:
            nested = [c for c in block if c[2].startswith(r) or r.startswith(c[2])]
            result[rid] = _pick(nested, target) if nested else block[0][0]
    return result


def test_match_tie_breaks(spark):
    long = "x" * 200
    gt = [(10, "int  a ;", 0), (11, "int a;", 1), (12, "int\ta;", 1),      # same normalized text
          (20, long + "tail1", 0), (21, long + "tail2", 1),               # same prefix, no startswith
          (30, "y" * 160, 0), (31, "y" * 170, 1), (32, "y" * 150 + "z", 1),
          (40, "q" * 151, True)]
    rows = [(1, "int a;", 1), (2, "int a ;", 0), (3, long + "tail3", 1),
            (4, "y" * 165, 1), (5, "y" * 165, 0), (6, "q" * 155, 0), (7, "nothing", 0),
            (8, "y" * 150 + "zz", 1)]
    g = spark.createDataFrame(gt, "gt_idx long, func string, target string") \
        .selectExpr("gt_idx", "func", "cast(target as string) as target")
    left = spark.createDataFrame(rows, "row_id long, func string, target int")
    ex = M.match_exact(left, g)
    rest = left.join(ex.select("row_id"), "row_id", "left_anti")
    px = M.match_prefix(rest, g)
    got = {r["row_id"]: r["gt_idx"] for r in ex.unionByName(px).collect()}
    gt_py = [(i, f, {"0": 0, "1": 1, "True": 1}.get(str(t), 0)) for i, f, t in gt]
    exp = {k: v for k, v in _brute_force_match(rows, gt_py).items() if v is not None}
    assert got == exp


def test_match_ground_truth_defaults(spark):
    g = spark.createDataFrame([(1, "a b c", 1, "p1", ["b"], [2])],
                              "gt_idx long, func string, target int, project string, "
                              "code array<string>, line_no array<int>") \
        .selectExpr("*", "cast(null as struct<n:int>) as metadata")
    left = spark.createDataFrame([(1, "abc", 1), (2, "zzz", 0)], "row_id long, func string, target int")
    out = {r["row_id"]: r for r in M.match_ground_truth(left, g).collect()}
    assert (out[1]["project"], out[1]["flaw_line"], out[1]["flaw_line_index"]) == ("p1", "b", "2")
    assert (out[2]["project"], out[2]["flaw_line"], out[2]["metadata"]) == ("unknown", "", "")


def test_prefix_match_random_nested_texts(spark):
    import random
    rng = random.Random(4)
    head = "h" * 150
    def txt():
        return head + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))
    gt = [(i, txt(), rng.randint(0, 1)) for i in range(60)]
    rows = [(100 + i, txt(), rng.randint(0, 1)) for i in range(80)]
    g = spark.createDataFrame([(i, f, str(t)) for i, f, t in gt], "gt_idx long, func string, target string")
    left = spark.createDataFrame(rows, "row_id long, func string, target int")
    ex = M.match_exact(left, g)
    rest = left.join(ex.select("row_id"), "row_id", "left_anti")
    exp = {k: v for k, v in _brute_force_match(rows, gt).items() if v is not None}
    px = M.match_prefix(rest, g)
    got = {r["row_id"]: r["gt_idx"] for r in ex.unionByName(px).collect()}
    assert got == exp


def test_scan_over_many_ranges(spark):
    """Nested texts cut into many ranges, so that open texts pass through them."""
    import random

    from linesight.operators.prefix_scan import prefix_minima
    rng = random.Random(7)
    texts = {"", "a"} | {"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(250)}
    texts |= {"b" * i for i in range(40)} | {"é" + "b" * i for i in range(5)}
    r = [t for t in sorted(texts) if rng.random() < 0.6]
    g = [(t, i, i if i % 2 else None, None if i % 2 else i) for i, t in enumerate(rng.sample(sorted(texts), len(texts))) if rng.random() < 0.4]
    asked = spark.createDataFrame([(t.encode(), t) for t in r], "dig binary, norm string").repartition(3)
    given = spark.createDataFrame([(t.encode(), t, *v) for t, *v in g], "dig binary, norm string, first_any long, first_1 long, first_0 long").repartition(3)

    def least(values):
        return min((v for v in values if v is not None), default=None)
    want = {}
    for t in r:
        near = [v for u, *v in g if u.startswith(t) or t.startswith(u)]
        if near:
            want[t.encode()] = tuple(least(c) for c in zip(*near))
    for parts in (1, 4, 60):
        got = {bytes(x["rdig"]): (x["first_any"], x["first_1"], x["first_0"]) for x in prefix_minima(asked, given, parts).collect()}
        assert got == want
    assert prefix_minima(asked.limit(0), given).count() == 0 and prefix_minima(asked, given.limit(0)).count() == 0


def test_common_prefix():
    import os
    import random

    from linesight.operators.prefix_scan import common_prefix
    rng = random.Random(1)
    for _ in range(500):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(2))
        assert common_prefix(a, b) == len(os.path.commonprefix([a, b]))
