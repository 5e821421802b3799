"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a row's language are multiplied:

* text: likelihood of the byte trigrams of the whole text under each language,
  tempered to ``EFFECTIVE`` independent observations, with a uniform model
  ("und") that wins where no language fits;
* declared language: how often each declaration goes with each language;
* address suffix: how often each suffix goes with each language;
* host prior: the host's share of each language, smoothed towards its domain's,
  that towards the whole table's.

Everything but the trigram model is a grouped aggregate over all rows.  The
trigram model is fitted on a bounded sample of rows with a declared language:
about ``SAMPLE_ROWS`` rows a language, chosen by a hash.  The number of languages
is not bounded: their models are one table of the buckets seen, compared with
the texts in slices of ``SLICE`` languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.llm import words as W
from linesight.llm.common import row_key, staged

SAMPLE_ROWS = 1500     # rows of each language that the trigram model is fitted on
SLICE = 64             # languages compared with a text at a time
CELLS = 2**21          # rows times languages held at a time
BUCKETS = 2**14        # hashed trigrams
EFFECTIVE = 40.0       # trigrams that count as independent evidence
SMOOTH = 0.5           # added to trigram counts
HOST_WEIGHT = 10.0     # pseudo-rows of the domain in a host's prior, and of the table in a domain's
LEAST = 0.5            # posterior that a row needs to be accepted
UNKNOWN = "und"
UNFIT = 0.5            # nats a trigram by which a language may fit worse than the uniform model

#: first address in a text: the last label of its host is the suffix
ADDRESS = r"(?:://|@)[A-Za-z0-9.-]*?[A-Za-z0-9]\.([A-Za-z]{2,24})(?![A-Za-z0-9.-]*\.[A-Za-z])"


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram; letters and blanks count, signs and digits are one class."""
    x = W.LOWER[data].astype(np.uint32)
    x = np.where((x < 97) & (x != 32), np.uint32(33), x)
    return ((x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)).astype(np.int64)


def _rows(texts, most: int = W.BATCH_BYTES):
    """(first row, last row, bytes, offsets) of about ``most`` bytes each."""
    data, offsets = W.text_buffer(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


@dataclass
class Model:
    """Log probabilities of the languages' buckets, as a table sorted by
    language: those of the buckets seen, and ``unseen`` for a language's others."""
    unseen: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    log: np.ndarray

    def slices(self):
        """(first language, log probabilities by bucket and language) of at most
        ``SLICE`` languages at a time; the last column of all is the uniform model."""
        n = len(self.unseen)
        for lo in range(0, n + 1, SLICE):
            hi = min(n, lo + SLICE)
            out = np.empty((BUCKETS, min(n + 1, lo + SLICE) - lo), np.float32)
            out[:] = np.concatenate([self.unseen[lo:hi], np.full(out.shape[1] - (hi - lo), -np.log(BUCKETS) - UNFIT)])
            at = slice(self.start[lo], self.start[hi])
            out[self.bucket[at], np.repeat(np.arange(hi - lo), np.diff(self.start[lo:hi + 1]))] = self.log[at]
            yield lo, out


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], Model]:
    """All declared languages and their log probabilities of each bucket, from
    rows (text, declared)."""
    declared = rows.where("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("c"))
    counts = declared.orderBy("declared").collect()   # a row a language
    languages = sorted(r.declared for r in counts)
    place = {name: i for i, name in enumerate(languages)}
    empty = np.zeros(0, np.int64)
    if not languages:
        return [], Model(np.zeros(0), np.zeros(1, np.int64), empty, empty)
    spark = rows.sparkSession
    share = spark.createDataFrame([(r.declared, place[r.declared], min(1.0, sample_rows / r.c)) for r in counts], "declared string, lang int, share double")
    level = F.pmod(F.xxhash64("text", "declared"), F.lit(1_000_000)) / 1_000_000
    chosen = rows.select("text", "declared").withColumn("level", level).join(F.broadcast(share), "declared").where("level < share")

    def run(it):
        for batch in it:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in _rows(batch.column(0)):
                parts = [np.zeros(0, np.int64)]
                for r in range(lo, hi):
                    text = data[offsets[r - lo]:offsets[r - lo + 1]]
                    if len(text) > 2:
                        parts.append(_trigrams(text) + kind[r] * BUCKETS)
                cell, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((cell // BUCKETS).astype(np.int32)), pa.array((cell % BUCKETS).astype(np.int32)), pa.array(c)], names=["lang", "bucket", "c"])
    found = chosen.select("text", "lang").mapInArrow(run, "lang int, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()   # the seen cells: BUCKETS rows a language at most
    lang, bucket, c = (found.column(x).to_numpy() for x in ("lang", "bucket", "c"))
    order = np.argsort(lang.astype(np.int64) * BUCKETS + bucket)
    lang, bucket, c = lang[order], bucket[order], c[order]
    total = np.bincount(lang, weights=c, minlength=len(languages))
    # few trigrams are smoothed less, so that a language of few rows fits foreign texts worse than the uniform model
    smooth = SMOOTH * np.clip(total / BUCKETS, 1e-6, 1.0)
    whole = total + smooth * BUCKETS
    return languages, Model(np.log(smooth / whole), np.searchsorted(lang, np.arange(len(languages) + 1)), bucket, np.log((c + smooth[lang]) / whole[lang]))


def _passed_on(rows: DataFrame, without: tuple[str, ...]) -> tuple[list[str], str]:
    fields = [f for f in rows.schema.fields if f.name not in without]
    return [f.name for f in fields], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)


def text_evidence(rows: DataFrame, languages: list[str], model: Model) -> DataFrame:
    """``rows`` without text but with ``text_log`` (languages, then unknown)
    and ``text_best``, the place of the largest."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(languages) + 1
    names, schema = _passed_on(rows, ("text",))
    schema += "text_log array<double>, text_best int"

    def run(it):
        model, kept = shared.value, None
        for whole in it:
            step = max(1, CELLS // width)
            for batch in (whole.slice(s, step) for s in range(0, whole.num_rows, step)):
                out = np.zeros((batch.num_rows, width))
                if kept is None and width <= SLICE:
                    kept = list(model.slices())
                parts = list(_rows(batch.column(batch.schema.get_field_index("text"))))
                for first, logs in kept or model.slices():
                    for lo, hi, data, offsets in parts:
                        if len(data) < 3:
                            continue
                        total = logs[_trigrams(data)]
                        # trigrams that begin in a row's last two bytes are not its own
                        begin, end = np.minimum(offsets[:-1], len(total)), np.clip(offsets[1:] - 2, 0, len(total))
                        n = np.maximum(end - begin, 0)
                        has = np.flatnonzero(n)
                        if len(has):
                            marks = np.stack([begin[has], end[has]], axis=1).ravel()
                            cut = marks[:-1] if marks[-1] == len(total) else marks
                            out[lo + has, first:first + logs.shape[1]] = np.add.reduceat(total, cut, axis=0)[::2] * np.minimum(1.0, EFFECTIVE / n[has])[:, None]
                best = out.argmax(axis=1)
                best[~out.any(axis=1)] = width - 1
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [flat, pa.array(best.astype(np.int32))], names=[*names, "text_log", "text_best"])
    return rows.select(*names, F.col("text")).mapInArrow(run, schema)


def _fused(rows: DataFrame, own: list[str], names: list[str], all_rows: np.ndarray, share: np.ndarray, least: float) -> DataFrame:
    """``own`` columns of ``rows`` with the results, from text_log and the counts
    (place, c) of the row's declared language, suffix, domain and host."""
    shared = rows.sparkSession.sparkContext.broadcast((names, all_rows, share))
    kept, schema = _passed_on(rows.select(*[F.col(f"`{c}`") for c in own]), ())
    schema += "language string, posterior double, text_language string, accepted boolean"

    def run(it):
        names, all_rows, share = shared.value
        width = len(names)
        unseen = np.log(share / (all_rows + 1.0))

        def counts(column, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Counts by row and language, and which rows have any."""
            out, lists = np.zeros((n, width)), column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            flat = lists.flatten()
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            out[np.repeat(np.arange(n), many), flat.field("place").to_numpy(zero_copy_only=False)] = flat.field("c").to_numpy(zero_copy_only=False)
            return out, many > 0

        for whole in it:
            step = max(1, CELLS // width)
            for batch in (whole.slice(s, step) for s in range(0, whole.num_rows, step)):
                n = batch.num_rows
                get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
                logs = get("text_log_").flatten().to_numpy(zero_copy_only=False).reshape(n, width).copy()
                for c in ("declared_", "suffix_"):
                    seen, some = counts(get(c), n)
                    logs += np.where(some[:, None], np.where(seen > 0, np.log((seen + share) / (all_rows + 1.0)), unseen), 0.0)
                domain, host = counts(get("domain_counts_"), n)[0], counts(get("host_counts_"), n)[0]
                parent = (domain + HOST_WEIGHT * share) / (domain.sum(axis=1, keepdims=True) + HOST_WEIGHT)
                logs += np.log((host + HOST_WEIGHT * parent) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT))
                best = logs.argmax(axis=1)
                posterior = 1 / np.exp(logs - logs[np.arange(n), best][:, None]).sum(axis=1)
                blank = get("blank_").to_numpy(zero_copy_only=False).astype(bool)
                best[blank] = width - 1
                label = pa.array(names)
                accepted = (best != width - 1) & (posterior >= least)
                yield pa.RecordBatch.from_arrays([get(f"own{i}_") for i in range(len(kept))] + [label.take(pa.array(best)), pa.array(posterior), label.take(get("text_best_")), pa.array(accepted)], names=[*kept, "language", "posterior", "text_language", "accepted"])
    given = [F.col(f"`{c}`").alias(f"own{i}_") for i, c in enumerate(own)]
    return rows.select(*given, F.col("blank_"), F.col("text_log").alias("text_log_"), F.col("text_best").alias("text_best_"), F.col("declared_log").alias("declared_"), F.col("suffix_log").alias("suffix_"), F.col("domain_counts").alias("domain_counts_"), F.col("host_counts").alias("host_counts_")).mapInArrow(run, schema)


def identify(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, least: float = LEAST) -> DataFrame:
    """``rows`` (text, declared, host, suffix and any others) without text, with
    language, posterior, text_language and accepted.

    Every declared language has a place in the posterior, however many there are
    and however few rows declare it.  A text that is null or blank, or that no
    language fits, is "und"; one of
    fewer than three bytes goes by its other evidence.  Nulls among declared, host and suffix are no evidence.  accepted:
    the language is known and its posterior at least ``least``.  Repeated rows
    get equal results; with no language to learn, every row is "und"."""
    languages, model = fit(rows, sample_rows)
    names = [*languages, UNKNOWN]
    own = [c for c in rows.columns if c != "text"]
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]+)$", 1)
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    seen = staged(text_evidence(rows.withColumn("domain_", domain).withColumn("blank_", blank), languages, model), "evidence")
    all_rows = np.zeros(len(names))
    for r in seen.groupBy("text_best").agg(F.count(F.lit(1)).alias("c")).collect():   # a row a language
        all_rows[r.text_best] = r.c
    share = (all_rows + 1) / (all_rows.sum() + len(names))

    def by(column: str, name: str) -> DataFrame:
        """Rows of the group by the language of their text, as (place, c)."""
        g = seen.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"{name}_key"), F.col("text_best").alias("place")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        return staged(g.groupBy(f"{name}_key").agg(F.collect_list(F.struct("place", "c")).alias(name)), name)   # a list of the languages at most

    out = seen
    for column, name in (("declared", "declared_log"), ("suffix", "suffix_log"), ("domain_", "domain_counts"), ("host", "host_counts")):
        out = out.join(by(column, name), F.col(column) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    return _fused(out, own, names, all_rows, share, least)


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Evidence columns of documents: the declared language, the source as host
    and the suffix of the first address in the text."""
    suffix = F.lower(F.regexp_extract("text", ADDRESS, 1))
    return docs.select(F.col("doc_id").cast("long"), row_key("text", "lang", "source").alias("key"), F.col("text").cast("string"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.when(suffix != "", suffix).alias("suffix"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Evidence columns of raw pages: the markup's lang attribute, the URL's
    host and its suffix; the text is the markup without tags."""
    html = F.col("html").cast("string")
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    pick = lambda c: F.when(c != "", c)
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.select(F.col("page_id").cast("long"), text.alias("text"), pick(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\blang=[\"']?([a-z]+)", 1))).alias("declared"), pick(host).alias("host"), pick(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"))
