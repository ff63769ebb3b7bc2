"""Quality rules: hashed n-gram log-likelihood ratio, thresholded per document.

Word uni- and bigrams of every document are hashed into ``buckets`` counts. Two
smoothed multinomials are estimated over those buckets: one from trusted
documents (the target), one from the whole raw corpus. A document's score is the
mean over its n-grams of log p_target - log p_raw, so it does not depend on
length; it is kept if the score reaches the threshold and the base rules hold.
The threshold is the one that parts the labelled good documents from the labelled
bad ones best; a good one is scored without its own share of the target.

The two passes over the texts move no text: the first sends at most ``buckets``
rows of counts from each task, the second only reads the finished table of
``buckets`` doubles (a fixed size, broadcast with the tasks).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LEADING, Words, blocks, mix, per_doc

BUCKETS = 1 << 14
#: Trusted documents taken for the target model, at most; chosen by hash of the id.
MAX_TRUSTED = 20_000
#: Pseudo-counts of the target model.
SMOOTHING = 1000.0
#: Taken where good or bad labels are missing.
THRESHOLD = -0.08
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"


def labelled_ids(labels: DataFrame, good: bool, most: int = MAX_TRUSTED) -> list[int]:
    """Ids of documents labelled good and not toxic, or bad: the ``most`` first by hash of the id."""
    which = "quality = 1 and coalesce(toxic, 0) = 0" if good else "quality = 0"
    rows = labels.filter(f"{which} and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return sorted(r[0] for r in rows)


def _buckets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets of all uni- and bigrams of a block."""
    docs = words.docs()
    at, two = words.grams(2)
    mask = np.uint64(n - 1)
    return np.concatenate([docs, docs[at]]), (np.concatenate([words.hash, two]) & mask).astype(np.int64)


def ngram_counts(docs: DataFrame, trusted: list[int], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones."""
    good = np.array(trusted, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.isin(ids, good) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j, b, off in blocks(batch.column(1)):
                doc, bucket = _buckets(Words(b, off), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                if known[i:j].any():
                    target += np.bincount(bucket[known[i:j][doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw per bucket of counts; all zero when no document is trusted.

    The target is smoothed by ``smoothing`` n-grams drawn like the raw corpus.
    """
    buckets = len(raw)
    if not target.sum():
        return np.zeros(buckets)
    share = raw / raw.sum()
    mixed = (target + smoothing * share) / (target.sum() + smoothing)
    return np.log(mixed, out=np.zeros(buckets), where=mixed > 0) - np.log(share, out=np.zeros(buckets), where=mixed > 0)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_ngrams long, llr double, base_failed boolean, kept boolean"
)


def measure(b: np.ndarray, off: np.ndarray, ratios: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` after doc_id for one block of texts."""
    w, n = Words(b, off), len(off) - 1
    dup_lines = np.zeros(n, np.int64)
    whole = b.tobytes()
    for d in range(n):
        lines = [x for x in whole[off[d] : off[d + 1]].split(b"\n") if x.strip(_BLANK)]
        dup_lines[d] = len(lines) - len(set(lines))
    docs = w.docs()
    at, five = w.grams(5)
    edge = np.zeros(len(docs) + 1, np.int64)
    if len(at):
        key = mix(five ^ mix(docs[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + 5, -1)
    repeat = per_doc(np.cumsum(edge)[:-1] > 0, w.bounds)
    doc, bucket = _buckets(w, len(ratios))
    grams = np.bincount(doc, minlength=n)
    score = np.bincount(doc, weights=ratios[bucket], minlength=n) / np.maximum(grams, 1)
    failed = (w.count < 10) | (100 * repeat > 20 * w.count)
    return [w.count, per_doc(w.inner & LEADING[b], off), per_doc(_SYMBOL[b], off), dup_lines, repeat, grams, score, failed, ~failed & (score >= threshold)]


def best_threshold(good: np.ndarray, bad: np.ndarray, default: float = THRESHOLD) -> float:
    """The score from which on documents are kept: most good ones kept and bad ones not, as shares; of several the lowest.

    It lies half-way between neighbouring scores. Without good or bad scores it is ``default``.
    """
    if not len(good) or not len(bad):
        return default
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    return float(cuts[np.argmax(np.round(kept + np.searchsorted(np.sort(bad), cuts) / len(bad), 12))])


def fit_threshold(docs: DataFrame, good: list[int], bad: list[int], raw: np.ndarray, target: np.ndarray, default: float = THRESHOLD) -> float:
    """``best_threshold`` of the labelled documents that the base rules do not reject; a score of each comes to the driver."""
    if not good or not bad or not target.sum():
        return default
    trusted, ratios = np.array(good, np.int64), log_ratios(raw, target)
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({*good, *bad})], "doc_id long")  # bounded by MAX_TRUSTED

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.isin(batch.column(0).to_numpy(zero_copy_only=False), trusted)
            for i, j, b, off in blocks(batch.column(1)):
                columns = measure(b, off, ratios, 0.0)
                llr, failed = columns[6], columns[7]
                doc, bucket = _buckets(Words(b, off), len(raw))
                for d in np.flatnonzero(known[i:j]):
                    own = bucket[doc == d]
                    if len(own):
                        used, times = np.unique(own, return_counts=True)
                        rest = target.copy()
                        rest[used] -= times
                        llr[d] = log_ratios(raw, rest)[own].mean()
                yield pa.RecordBatch.from_arrays([pa.array(known[i:j]), pa.array(llr), pa.array(failed)], ["good", "llr", "failed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id", "left_semi")
    scores = rows.mapInArrow(score, "good boolean, llr double, failed boolean").filter("not failed").toPandas()
    known, llr = scores.good.to_numpy(bool), scores.llr.to_numpy(float)
    return best_threshold(llr[known], llr[~known], default)


def llr_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None, most_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row per row of ``docs`` with base measures, the ratio and the verdict.

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic; other
    columns are ignored. ``threshold`` is fitted on at most ``most_trusted`` good
    and as many bad documents where it is not given. A null or empty text has no
    words, fails the base rules and scores 0. A null doc_id stays null and is never
    trusted. Repeated rows each get a row. With no trusted document every score is
    0 and the base rules decide alone. The result is deterministic for given tables.
    Texts are read whole, block by block; a very long one is a block of its own. An
    empty table gives no rows.
    """
    good = labelled_ids(labels, True, most_trusted)
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in ngram_counts(docs, good, buckets).collect():  # at most ``buckets`` rows
        raw[bucket], target[bucket] = r, t
    ratios = log_ratios(raw, target)
    if threshold is None:
        threshold = fit_threshold(docs, good, labelled_ids(labels, False, most_trusted), raw, target) if target.sum() else -math.inf

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, off in blocks(batch.column(1)):
                columns = [pa.array(c) for c in measure(b, off, ratios, threshold)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, SCHEMA)
