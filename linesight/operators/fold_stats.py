"""Cross-validation from fold-aware sufficient statistics.

Gaussian naive Bayes needs, for each term and class, the number of documents, the
sum and the sum of squares of the term's counts.  They are counted once, by
fold; what a model trained without fold k needs is the total less fold k.  All k
models, vocabularies included, come from one scan of the texts, which leaves each
document's different terms with their counts (``counted_terms``); a task adds up its
documents before a row for each (term, fold, class) crosses the network, and neither
a vocabulary nor a document reaches the driver.

A document's score is a constant of its class (all terms absent) plus a term for
each of its own words, so scoring is one lookup of its words in its fold's model.
Documents are looked up in blocks of one fold, and judged in their row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linesight.operators.features import MIN_DF, terms
from linesight.operators.token_blocks import BLOCK_BYTES, Lookup, looked_up
from linesight.session import materialize, shuffles_freed, stored

SMOOTHING = 1e-9        # fixed: share of the largest variance that is added to all
HELD_TERMS = 1 << 21    # terms of documents that a task adds up at once
STATISTICS_ROWS = 1 << 14   # rows of one Arrow batch


def counted_terms(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, term array, x array): each document's different terms and
    their counts, in one row."""
    carried = [id_col, *(keep or [])]
    schema = Ty.StructType([docs.schema[c] for c in carried] + [Ty.StructField("term", Ty.ArrayType(Ty.StringType())), Ty.StructField("x", Ty.ArrayType(Ty.LongType()))])

    def count(batches):
        for batch in batches:
            lists = batch.column(len(carried))
            known = lists.flatten().dictionary_encode()
            code = known.indices.to_numpy(zero_copy_only=False).astype("int64")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            many = max(1, len(known.dictionary))
            key = np.repeat(np.arange(len(sizes)), sizes) * many + code
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, "int64")
            x, key = np.diff(np.r_[first, len(key)]), key[first]
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(key // many, minlength=len(sizes)))].astype("int32"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, known.dictionary.take(pa.array(key % many))),
                                              pa.ListArray.from_arrays(ends, pa.array(x))], names=[*carried, "term", "x"])
    return docs.select(*carried, terms(F.coalesce(F.col(text), F.lit(""))).alias("_t")).mapInArrow(count, schema)


def occurrences(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, term, x): the terms of each document with their counts."""
    rows = counted_terms(docs, text, id_col, keep).select(id_col, *(keep or []), F.explode(F.arrays_zip("term", "x")).alias("_t"))
    return rows.select(id_col, *(keep or []), F.col("_t.term").alias("term"), F.col("_t.x").alias("x"))


def fold_statistics(docs: DataFrame, label: str, fold: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(term, fold, label, n, s, q): documents that hold the term, sum and sum of
    squares of its counts, by fold and class."""
    return counted_statistics(counted_terms(docs, text, id_col, [label, fold]), label, fold)


def counted_statistics(counted: DataFrame, label: str, fold: str) -> DataFrame:
    """``fold_statistics`` of ``counted_terms``, added up in the task first."""
    names = ["term", "fold", "label", "n", "s", "q"]
    kinds = [("term", Ty.StringType()), ("fold", counted.schema[fold].dataType), ("label", counted.schema[label].dataType)] + [(c, Ty.LongType()) for c in "nsq"]

    def add(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n >= HELD_TERMS:
                yield from sums(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from sums(pa.Table.from_batches(held))

    def sums(table):
        table = table.combine_chunks()
        of, cls, lists, x = (c.combine_chunks() for c in table.columns)
        term = lists.flatten().dictionary_encode()
        x = x.flatten().to_numpy().astype("int64")
        sizes = lists.value_lengths().to_numpy()
        of, cls = (c.dictionary_encode(null_encoding="encode") for c in (of, cls))
        cells = len(of.dictionary) * len(cls.dictionary)
        cell = of.indices.to_numpy().astype("int64") * len(cls.dictionary) + cls.indices.to_numpy()
        key = term.indices.to_numpy().astype("int64") * cells + np.repeat(cell, sizes)
        order = np.argsort(key)
        key, x = key[order], x[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, values = key[first], [np.diff(np.r_[first, len(x)]), np.add.reduceat(x, first), np.add.reduceat(x * x, first)]
        for s in range(0, len(key), STATISTICS_ROWS):
            part = key[s:s + STATISTICS_ROWS]
            cell = part % cells
            yield pa.RecordBatch.from_arrays([term.dictionary.take(pa.array(part // cells)), of.dictionary.take(pa.array(cell // len(cls.dictionary))),
                                              cls.dictionary.take(pa.array(cell % len(cls.dictionary)))] + [pa.array(v[s:s + STATISTICS_ROWS]) for v in values], names=names)

    parts = counted.select(fold, label, "term", "x").mapInArrow(add, Ty.StructType([Ty.StructField(c, k) for c, k in kinds]))
    return parts.groupBy("term", "fold", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def held_out_statistics(stats: DataFrame, folds: int, classes: list, min_df: int = MIN_DF) -> DataFrame:
    """(held, term, label, s, q): statistics of the training rows of each held-out
    fold, for the terms in at least ``min_df`` of its training documents and for
    every class.  A term's statistics, at most folds x classes, meet in one row."""
    entry = F.struct("label", "fold", "n", "s", "q")
    by_term = stats.groupBy("term").agg(F.collect_list(entry).alias("e"), F.sum("n").alias("df"))
    by_term = by_term.where(F.col("df") >= min_df)
    held = by_term.select("term", "df", "e", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held"))
    out = held.select("held", "term", "df", F.filter("e", lambda x: x["fold"] == F.col("held")).alias("out"), "e")
    total = lambda rows, name, cls: F.aggregate(F.filter(rows, lambda x: x["label"] == F.lit(cls)), F.lit(0).cast("long"), lambda a, x: a + x[name])
    less = F.aggregate("out", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = out.where(F.col("df") - less >= min_df)
    per_class = F.array(*[F.struct(F.lit(c).alias("label"), (total("e", "s", c) - total("out", "s", c)).alias("s"), (total("e", "q", c) - total("out", "q", c)).alias("q")) for c in classes])
    return out.select("held", "term", F.inline(per_class))


def gaussian_models(counted: DataFrame, label: str, fold: str, folds: int, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame]:
    """Of ``counted_terms``: (held, term, label, mean, var) of every held-out fold's model, and (held,
    label, base): the log score of a document without any term.

    var is the class's own plus ``SMOOTHING`` times the largest variance of a term
    over all training rows.  Classes are numbers; one without training rows is not
    a class of that model."""
    spark = counted.sparkSession
    counts = counted.groupBy(F.col(fold).alias("fold"), F.col(label).alias("label")).count().collect()     # folds x classes
    classes = sorted({r["label"] for r in counts if r["label"] is not None})
    n = {(h, c): sum(r["count"] for r in counts if r["label"] == c and r["fold"] != h) for h in range(folds) for c in classes}
    sizes = [(h, c, n[h, c], sum(n[h, x] for x in classes)) for h in range(folds) for c in classes if n[h, c]]
    kind = counted.schema[label].dataType.simpleString()
    sizes = F.broadcast(spark.createDataFrame(sizes, f"held int, label {kind}, n long, rows long"))
    stats = held_out_statistics(counted_statistics(counted.where(F.col(label).isNotNull()), label, fold), folds, classes, min_df)
    stats = materialize(stats.join(sizes, ["held", "label"]))
    square = lambda c: c.cast("double") * c.cast("double")
    spread = lambda s, q, m: F.greatest((q.cast("double") * m - square(s)) / square(m), F.lit(0.0))
    whole = stats.groupBy("held", "term").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("rows").alias("rows"))
    extra = whole.groupBy("held").agg((F.max(spread(F.col("s"), F.col("q"), F.col("rows"))) * SMOOTHING).alias("extra"))       # one row a fold
    var = spread(F.col("s"), F.col("q"), F.col("n")) + F.col("extra")
    model = materialize(stats.join(F.broadcast(extra), "held").select("held", "term", "label", (F.col("s").cast("double") / F.col("n")).alias("mean"), F.greatest(var, F.lit(1e-300)).alias("var")))
    absent = -0.5 * F.log(F.lit(2 * math.pi) * F.col("var")) - F.col("mean") * F.col("mean") / (2 * F.col("var"))
    base = sizes.join(model.groupBy("held", "label").agg(F.sum(absent).alias("absent")), ["held", "label"], "left")
    return model, base.select("held", "label", (F.log(F.col("n") / F.col("rows")) + F.coalesce("absent", F.lit(0.0))).alias("base"))


def cross_predict(docs: DataFrame, label: str, fold: str, folds: int, text: str = "text", id_col: str = "doc_id",
                  min_df: int = MIN_DF) -> DataFrame:
    """(id, fold, target, pred): every document judged by the model that was
    trained without its fold; the smaller class wins a tie.  ``fold`` is 0 to folds - 1."""
    with shuffles_freed(docs.sparkSession):
        counted = stored(counted_terms(docs, text, id_col, [label, fold]), "counted")
        model, base = gaussian_models(counted, label, fold, folds, min_df)
        base = {(r["held"], r["label"]): r["base"] for r in base.collect()}     # folds x classes
    classes = sorted({c for _, c in base})
    start = np.array([[base.get((h, c), -np.inf) for c in classes] for h in range(folds)]).reshape(folds, len(classes))
    # a document meets the entries (one a class) of its own fold's model only; its terms stay in its row
    key = lambda held, term: F.concat(held.cast("string"), F.lit(":"), term)
    entries = model.groupBy("held", "term").agg(F.array_sort(F.collect_list(F.struct("label", "mean", "var"))).alias("m"))
    entries = entries.select(key(F.col("held"), F.col("term")).alias("tok"), "m")
    own = F.transform("term", lambda t: key(F.col(fold), t))
    kind = docs.schema[label].dataType
    schema = Ty.StructType([docs.schema[id_col], Ty.StructField("fold", docs.schema[fold].dataType), Ty.StructField("target", kind), Ty.StructField("pred", kind)])

    def run(x: Lookup):
        held = x.rows.column(1).to_numpy(zero_copy_only=False).astype("int64")
        score = start[held]
        met = np.flatnonzero(x.code >= 0)
        if len(met):
            lists = x.values.column("m").combine_chunks()
            sizes = lists.value_lengths().to_numpy().astype("int64")
            begin = np.cumsum(sizes) - sizes
            entry = lists.flatten()
            of = np.searchsorted(classes, entry.field("label").to_numpy())
            mean, var = (entry.field(c).to_numpy() for c in ("mean", "var"))
            code, row = x.code[met], x.row[met]
            n = x.rows.column(3).flatten().to_numpy()[met].astype("float64")
            for k in range(int(sizes.max())):    # one entry of each term after the other: as many as there are classes
                has = np.flatnonzero(sizes[code] > k)
                at, times = begin[code[has]] + k, n[has]
                part = (2 * times * mean[at] - times * times) / (2 * var[at])
                score += np.bincount(row[has] * len(classes) + of[at], part, minlength=score.size).reshape(score.shape)
        judged = np.flatnonzero(np.isfinite(start[held]).any(axis=1)) if len(classes) else np.zeros(0, "int64")
        best = score[judged].argmax(axis=1) if len(judged) else judged     # the first of the largest
        pred = pa.array(np.array(classes)[best] if len(classes) else [], x.rows.column(2).type)
        judged = pa.array(judged)
        yield pa.RecordBatch.from_arrays([*(x.rows.column(c).take(judged) for c in range(3)), pred], names=[id_col, "fold", "target", "pred"])
    carry = [F.col(id_col), F.col(fold), F.col(label), F.col("x")]
    return looked_up(counted, F.array_join("term", " "), own, entries, carry, schema, run, [id_col], BLOCK_BYTES, (F.col(fold), folds))
