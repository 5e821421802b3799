import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from linesight.llm import lattice_dedup as D

VECTORS = "vec_id long, embedding array<float>, label int, x string, rep string, Row int"


def brute(rows, cosine=0.95):
    """vec_id, n_links, component_id, kept of every row, by all pairs."""
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    linked = [set() for _ in rows]
    unit = [np.array(v, np.float64) / np.abs(np.array(v, np.float64)).max() if g else None for (_, v), g in zip(rows, good, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            linked[a].add(b)
            linked[b].add(a)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            reach, front = {i}, [i]
            while front:
                front = [y for x in front for y in linked[x] if y not in reach and not reach.add(y)]
            ids = [rows[x][0] for x in reach if rows[x][0] is not None]
            seen |= dict.fromkeys(reach, min(ids) if ids else None)
    for i, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(linked[i]), seen[i], vec_id == seen[i]))
    return out


def family(rng, centre, n, spread):
    x = centre + rng.normal(size=(n, len(centre))) * spread * np.linalg.norm(centre) / np.sqrt(len(centre))
    return [[float(c) for c in v] for v in x.astype(np.float32)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "r", 2) for i, v in rows], VECTORS)


def test_links_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(300, 32)).astype(np.float32)]
    for c in range(4):
        vectors += family(rng, rng.normal(size=32), 30, 0.12)
    vectors += [vectors[5]] * 6 + [[2 * c for c in vectors[5]]] + [vectors[310]] * 3           # copies, a longer one
    rows = list(enumerate(vectors))
    rng.shuffle(order := np.arange(len(rows)))
    rows = [rows[i] for i in order]
    want = sorted(brute(rows), key=repr)
    assert rows_of(D.near_duplicates(table(spark, rows).repartition(4))) == want
    monkeypatch.setattr(D, "PART_ROWS", 7)       # every cell and component of more than seven is cut
    monkeypatch.setattr(D, "BIN_ROWS", 20)
    assert rows_of(D.near_duplicates(table(spark, rows).repartition(4))) == want


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 0.0]), (8, [1.0, 0.01]), (7, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, 0.5]), (None, None),
            (9, [1.0, 0.0, 0.0]), (10, [1e38, 1e36]), (11, [1e-38, 0.0]), (12, [5.0]), (13, [2.0]), (14, [-2.0]), (1, None), (15, [0.0, -0.0]), (16, [-1.0, -0.0])]
    assert rows_of(D.near_duplicates(table(spark, rows).repartition(3))) == sorted(brute(rows), key=repr)
    empty = D.near_duplicates(table(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    doubles = spark.createDataFrame([(1, [1e300, 1e299]), (2, [1e-300, 1e-301]), (3, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert rows_of(D.near_duplicates(doubles)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_lattice_decoder_finds_the_nearest_point():
    short = D.shortest_vectors()
    assert short.shape == (240, 8) and np.allclose((short**2).sum(axis=1), 2) and len(np.unique(short, axis=0)) == 240
    x = np.random.default_rng(1).normal(size=(2000, 8)) * 3
    p = D.nearest_lattice_point(x)
    assert np.allclose(2 * p, np.rint(2 * p)) and ((p - x)**2).sum(axis=1).max() <= 1 + 1e-9      # covering radius 1
    near = ((x - p)**2).sum(axis=1)
    for v in short:                                                                               # no neighbour is nearer
        assert (((x - p - v)**2).sum(axis=1) >= near - 1e-9).all()


def test_recall_of_single_pairs(spark):
    """Pairs at the threshold itself, each alone: recall against all pairs."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.9502 * a + np.sqrt(1 - 0.9502**2) * z
    rows = [(2 * i + s, [float(c) for c in v[i].astype(np.float32)]) for i in range(len(a)) for s, v in enumerate((a, b))]
    got = D.near_duplicates(table(spark, rows).repartition(4))
    found = got.where("n_links = 1 and vec_id = component_id + 1").count()
    assert found >= 0.97 * len(a) and got.where("n_links > 1").count() == 0


def test_one_cell_with_many_members_gives_no_pair_rows(spark, monkeypatch):
    """Equal vectors cost one row; a large family is cut into parts and gives a forest."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(D, "PART_ROWS", 100)
    vectors = family(rng, rng.normal(size=16), 1000, 0.05) + [[1.0] * 16] * 5000
    df = table(spark, list(enumerate(vectors))).repartition(8)
    got = D.near_duplicates(df).groupBy("component_id").agg(F.count("*").alias("n"), F.min("n_links").alias("lo"), F.max("n_links").alias("hi")).collect()
    assert sorted(map(tuple, got)) == [(0, 1000, 999, 999), (1000, 5000, 4999, 4999)]
    classes = df.where("vec_id < 1000").select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("x"))
    links = D.cell_links(D.coded(classes, False), False, 0.95)
    assert links.count() <= 1000 * D.TABLES * (1 + D.PROBES) * 10                                 # not 499,500 pairs a cell
