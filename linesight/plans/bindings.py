"""Binding of the library's abstract relations to the driver tables.

documents.text plays the function body, documents.source the project
(category), labels.toxic the actual class and labels.quality the predicted
class.  Line scores, document probabilities, flawed and predicted lines are
deterministic expressions over the data so that DuckDB can recompute them:

* line score            = length(line)
* document probability  = n_chars / (n_chars + 1000.0)
* flawed line           = line contains a digit or ``@`` (secrets, personal data)
* predicted lines       = the 3 longest lines of the document (length desc,
                          line order) with the first line of document doc_id+1
                          inserted second (forces hallucinated predictions)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesight.functions import text as T
from linesight.plans.registry import scope_cache
from linesight.session import materialize

# Fixed binding values (shared with the DuckDB oracle SQL).
FLAW_PATTERN = "[0-9@]"
TOP_X = 10
N_PREDICTED = 3


def shared(fn):
    """Base relation of a query.  Its first use in a registered query call is
    the plain plan, so a query that reads it once keeps column pruning and
    pushed filters down to the scan.  From the second use on it is computed
    once and checkpointed (lineage cut), and later uses read that copy.
    Outside a query call it is returned as is."""
    def wrapper(spark, sf_dir, *args):
        cache = scope_cache()
        if cache is None:
            return fn(spark, sf_dir, *args)
        key = (fn.__name__, sf_dir, args)
        if key not in cache:
            cache[key] = None
            return fn(spark, sf_dir, *args)
        if cache[key] is None:
            cache[key] = materialize(fn(spark, sf_dir, *args))
        return cache[key]
    wrapper.plain = fn   # for scalars read from a few columns: not counted as a use
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def function_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, project, text, flaw_idx array<int>, flaw_lines array<string>,
    proba, n_loc).  Row-local: no shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    parts = T.split_lines("text")
    idx = F.filter(F.transform(parts, lambda l, i: F.when(l.rlike(FLAW_PATTERN), i)
                               .otherwise(F.lit(-1))), lambda i: i >= 0)
    flines = F.filter(parts, lambda l: l.rlike(FLAW_PATTERN))
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.col("source").alias("project"), "lang", "text",
        idx.alias("flaw_idx"), flines.alias("flaw_lines"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("proba"),
        F.size(parts).alias("n_loc"),
    )


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded, labelled, scored lines of every document (without their text)."""
    from linesight.operators import lines as L
    f = function_table(spark, sf_dir)
    f = f.withColumn("n_labels", F.size("flaw_idx"))
    ln = L.split_labelled_lines(f, keep=["n_labels", "proba"])
    return ln.select("doc_id", "line_idx", F.length("line").cast("double").alias("score"),
                     "hit", "n_labels", "proba")


@shared
def predicted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pred_pos, line): longest line, the next document's first line,
    then the second and third longest lines.  Row-local array work plus one equi join on doc_id+1."""
    f = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    parts = T.split_lines("text")
    # sort (-length, idx) ascending inside the row, keep the first three texts
    keyed = F.transform(parts, lambda l, i: F.struct((-F.length(l)).alias("k"), i.alias("i"),
                                                     l.alias("l")))
    top = F.transform(F.slice(F.array_sort(keyed), 1, N_PREDICTED), lambda s: s["l"])
    own = f.select("doc_id", top.alias("top"))
    nxt = f.select((F.col("doc_id") - 1).alias("doc_id"),
                   F.element_at(parts, 1).alias("next_first"))
    joined = own.join(nxt, "doc_id", "left")
    # the foreign line goes second, so it is never the (protected) last one
    arr = F.when(F.col("next_first").isNull(), F.col("top")).otherwise(
        F.concat(F.slice("top", 1, 1), F.array(F.col("next_first")), F.slice("top", 2, N_PREDICTED)))
    return joined.select("doc_id", F.posexplode(arr).alias("pred_pos", "line"))


@shared
def test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation table: documents with a label row.  target = labels.toxic,
    pred = labels.quality; flawed lines only for actual positives (negatives
    carry no line labels, as in a vulnerability data set)."""
    f = function_table(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("pred"), F.col("toxic").alias("target"))
    t = f.join(lab, "doc_id")
    idx = F.when(F.col("target") == 1, F.col("flaw_idx")).otherwise(F.array().cast("array<int>"))
    lines = F.when(F.col("target") == 1, F.col("flaw_lines")).otherwise(
        F.array().cast("array<string>"))
    return t.select("doc_id", "project", "lang", "text", "proba", "n_loc", "pred", "target",
                    idx.alias("flaw_idx"), lines.alias("flaw_lines"),
                    T.encode_ints(idx).alias("flaw_line_index"))


@shared
def ranked_test_lines(spark: SparkSession, sf_dir: str, pred: int | None = 1) -> DataFrame:
    """Scored, labelled, ranked lines of the predicted-positive test documents
    (keys, scores and flags; the line's text ends where its score is known)."""
    from linesight.operators import lines as L
    from linesight.operators import ranking as R
    t = test_set(spark, sf_dir)
    if pred is not None:
        t = t.where(F.col("pred") == pred)
    t = t.withColumn("n_labels", F.size("flaw_idx"))
    ln = L.split_labelled_lines(t, keep=["n_labels", "proba"])
    ln = ln.select("doc_id", "line_idx", F.length("line").cast("double").alias("score"),
                   "hit", "n_labels", "proba")
    return R.rank_lines_by_score(ln)


@shared
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, target, pred, proba): labels.toxic / labels.quality and the
    document probability of class 1."""
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").alias("target"), F.col("quality").alias("pred"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("proba"))
    return lab.join(docs, "doc_id")


@shared
def generated_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted-positive test documents with their text labels: the flawed
    lines of actual positives, ``[""]`` when there are none."""
    t = test_set(spark, sf_dir).where(F.col("pred") == 1)
    label_text = F.when((F.col("target") == 1) & (F.size("flaw_lines") > 0),
                        F.array_join("flaw_lines", "\n"))
    return t.select("doc_id", "project", "text", "proba", "n_loc", "target",
                    label_text.alias("label_text"),
                    T.split_lines(F.coalesce(label_text, F.lit(""))).alias("flaw_text"))


@shared
def positive_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = generated_positives(spark, sf_dir).select("doc_id")
    return predicted_lines(spark, sf_dir).join(pos, "doc_id", "left_semi")


@shared
def positive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linesight.operators import lines as L
    return L.split_lines(generated_positives(spark, sf_dir).select("doc_id", "text"))


@shared
def eval_records_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation sheet rows: actual positives of the test set with their
    flawed lines (newline text), predicted lines and classifier verdict."""
    t = test_set(spark, sf_dir).where(F.col("target") == 1)
    return t.select("doc_id", "lang", "text", "pred", "flaw_idx",
                    F.when(F.size("flaw_lines") > 0, F.array_join("flaw_lines", "\n"))
                    .alias("actual_text"),
                    F.transform("flaw_idx", lambda i: i + 1).alias("flaw_line_no"))


@shared
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth records: every document, class = labels.toxic (0 when
    unlabelled), flawed lines as code + 1-based line numbers."""
    f = function_table(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    g = f.join(lab, "doc_id", "left")
    return g.select(F.col("doc_id").alias("gt_idx"), F.col("text").alias("func"),
                    F.coalesce("toxic", F.lit(0)).alias("target"), "project",
                    F.col("flaw_lines").alias("code"),
                    F.transform("flaw_idx", lambda i: i + 1).alias("line_no"),
                    F.lit(None).cast("struct<n:int>").alias("metadata"))


@shared
def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split file rows to map: each document without its last line (a near
    copy) when it has two or more lines, class = labels.quality (0 when
    unlabelled)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    parts = T.split_lines("text")
    func = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "\n")) \
        .otherwise(F.col("text"))
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), func.alias("func"),
        F.coalesce("quality", F.lit(0)).alias("target"))
