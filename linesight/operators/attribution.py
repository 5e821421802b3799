"""Perturbation-based token attribution (a local surrogate per document).

For each document: features = its distinct tokens; sample 0 keeps all,
samples 1..n-1 remove a random number of features (seeded by the document);
every sample is scored by a linear token scorer; then a kernel-weighted ridge
fit of the sample scores on the kept/removed indicators gives one weight per
token, the top k by magnitude re-fitted.  Counting and the weight join are
Spark's; the samples and the fit run in Arrow batches over one row per
document (n_samples x distinct tokens of that document).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linesight.functions import text as T
from linesight.operators.cleaning import _token_join

N_SAMPLES = 50      # fixed: perturbed samples per document
N_FEATURES = 20     # fixed: tokens reported per document
KERNEL_WIDTH = 25.0
RIDGE_ALPHA = 1.0   # penalty of the reported fit
SELECT_ALPHA = 0.01 # weaker penalty of the fit that selects the tokens


def _ridge(X: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weighted ridge with intercept (intercept not penalised).  With fewer
    samples than features (the usual case: 50 samples, one feature per
    distinct token) the equivalent sample-space form is solved, an n x n
    system instead of d x d."""
    sw = w / w.sum()
    xm = (X * sw[:, None]).sum(0)
    ym = (y * sw).sum()
    r = np.sqrt(w)
    Xw, yw = (X - xm) * r[:, None], (y - ym) * r
    n, d = Xw.shape
    if n < d:
        coef = Xw.T @ np.linalg.solve(Xw @ Xw.T + alpha * np.eye(n), yw)
    else:
        coef = np.linalg.solve(Xw.T @ Xw + alpha * np.eye(d), Xw.T @ yw)
    return coef, ym - xm @ coef


def attribute(docs: DataFrame, weights: DataFrame, text: str = "text", id_col: str = "doc_id",
              n_samples: int = N_SAMPLES, k: int = N_FEATURES, seed: int = 42, bias: float = 0.0,
              tokens: Callable = T.word_tokens, select_alpha: float = SELECT_ALPHA,
              fit_alpha: float = RIDGE_ALPHA) -> DataFrame:
    """(doc_id, token, weight): top-k token attributions per document.
    ``weights(tok, weight)`` is the linear scorer (0 for other tokens); a
    sample's score is sigmoid(bias + sum of the weights of its remaining token
    occurrences).  ``tokens`` splits a text, ``select_alpha`` penalises the fit
    that chooses the tokens, ``fit_alpha`` the final one.

    A document's (token, count, weight) triples are gathered once; the seeded
    samples are drawn and fitted inside its row, so no sample is shuffled.
    Documents without tokens give no rows."""
    feat = (docs.select(id_col, F.explode(tokens(text)).alias("tok"))
            .groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("cnt")))
    known = _token_join(feat.withColumn("pos", F.lit(0)), weights.select("tok", "weight"), id_col)
    # every token with weight 0, and the known ones again with their own weight
    tagged = feat.withColumn("weight", F.lit(0.0)).unionByName(
        known.select(id_col, "tok", F.lit(0).cast("long").alias("cnt"), F.col("weight").cast("double").alias("weight")))
    merged = tagged.groupBy(id_col, "tok").agg(F.sum("cnt").alias("cnt"), F.sum("weight").alias("weight"))
    rows = merged.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("tok", "cnt", "weight"))).alias("f"))
    rows = rows.select(id_col, "f.tok", "f.cnt", "f.weight", F.xxhash64(id_col, F.lit(seed)).alias("_seed"))

    def fit(batches):
        for pdf in batches:
            ids, names, values = [], [], []
            for key, toks, cnt, w, own in pdf.itertuples(index=False):
                mass = np.asarray(cnt, dtype="float64") * np.asarray(w, dtype="float64")
                d = len(toks)
                rng = np.random.default_rng(own & 0x7FFFFFFFFFFFFFFF)
                X = np.ones((n_samples, d))
                for r, gone in enumerate(rng.integers(1, d + 1, n_samples - 1), start=1):
                    X[r, rng.choice(d, gone, replace=False)] = 0.0
                y = 1.0 / (1.0 + np.exp(-(bias + X @ mass)))
                # cosine distance to the unperturbed sample (all ones), x100 as the text explainer
                cos = np.sqrt(X.sum(1) / d)
                kernel = np.sqrt(np.exp(-((1.0 - cos) * 100.0) ** 2 / KERNEL_WIDTH ** 2))
                coef, _ = _ridge(X, y, kernel, select_alpha)
                top = np.argsort(-np.abs(coef), kind="stable")[:k]
                coef, _ = _ridge(X[:, top], y, kernel, fit_alpha)
                ids += [key] * len(top)
                names += [toks[i] for i in top]
                values += coef.tolist()
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=pdf[id_col].dtype), "token": pd.Series(names, dtype=object), "weight": pd.Series(values, dtype="float64")})
    schema = Ty.StructType([docs.schema[id_col], Ty.StructField("token", Ty.StringType()), Ty.StructField("weight", Ty.DoubleType())])
    return rows.mapInPandas(fit, schema)
