"""Quality classification by importance resampling.

Two generative models over hashed words and word pairs: one of target text (documents labelled as good), one of raw text
(all documents). A document's log weight is the sum over its n-grams of log(target / raw). Gumbel noise, a function of
doc_id and the seed, is added, and the k largest sums are a sample without replacement with those weights.

k is the share of target text among the labelled rows, times the rows. The target model is fitted on SAMPLE labelled rows at
most (those of least xxhash64(doc_id)); the raw model counts every document.

Defined cases: a null or empty text has no n-grams and log weight 0; rows tied at the cut are all selected; repeated rows
of one doc_id share their noise; without labels the target model is the raw one and all rows are selected; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import BY_SPACE, hashes, map_arrow, mix, stash, steps, text_of, utf8, words

BUCKETS = 1 << 14
SAMPLE = 20_000
SEED = 17
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the rows, and the row of each."""
    a, b, e, count = words(data, offsets, BY_SPACE)
    h = hashes(a, b, e)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(count))
    pair = mix(h[:-1] * _PAIR + h[1:])[row[:-1] == row[1:]] if len(h) > 1 else h[:0]
    pair_row = row[:-1][row[:-1] == row[1:]] if len(h) > 1 else row[:0]
    return (np.concatenate((h, pair)) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate((row, pair_row))


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in steps(offsets):
                total += np.bincount(grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), pa.array(total, pa.int64())], ["k", "n"])

    out = np.zeros(BUCKETS)
    for k, n in map_arrow(docs.select(text_of(text).alias("t")), run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket, add-one smoothed."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weighted(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, n_grams and log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            weight, n = [np.zeros(0)], [np.zeros(0, np.int64)]
            for lo, hi in steps(offsets):
                k, row = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                weight.append(np.bincount(row, shared.value[k], hi - lo))
                n.append(np.bincount(row, minlength=hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(weight), pa.float64())], ["doc_id", "n_grams", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text_of(text).alias("t")), run, f"doc_id {kind}, n_grams long, log_weight double")


def _cut(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, found by counts in ever smaller bins, never by a global sort."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0  # rows over `high`, the upper end of the bin that holds the cut
    while True:
        width = (high - low) / 4096
        if width <= 0 or low + width == low or high - width == high:
            levels = rows.where(F.col(key).between(low, high)).groupBy(key).count().orderBy(F.col(key).desc()).collect()  # neighbouring doubles: a few levels
            for level, m in levels:
                if above + m >= k:
                    return level
                above += m
        inside = rows.where(F.col(key).between(low, high))
        bins = inside.groupBy(F.least(F.floor((F.col(key) - low) / width), F.lit(4095)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.col("bin").desc()).collect()
        for b in bins:
            if above + b["n"] >= k:
                break
            above += b["n"]
        if b["low"] == b["high"]:
            return b["low"]
        low, high = b["low"], b["high"]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and selected of every row; `share` overrides the labelled share of target text."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = own.agg(F.count(F.lit(1)), F.sum((F.col("quality") > 0).cast("int"))).first()
    share = (good / n if n else 1.0) if share is None else share
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).where("quality > 0").select("doc_id")
    raw = gram_counts(docs)
    target = gram_counts(docs.join(F.broadcast(sample), "doc_id", "left_semi")) if n else raw  # SAMPLE ids at most
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = weighted(docs, log_ratio(target, raw)).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    rows = stash(rows, "importance")
    total = rows.count()
    level = _cut(rows, "gumbel_key", round(share * total)) if total else np.inf
    return rows.withColumn("selected", F.col("gumbel_key") >= F.lit(float(level)))
