"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of benchmark items. For the patterns of one length, a shift table over
hashed blocks of two words says how far the scan may jump; where the shift is 0, a hash of the last block selects a
bucket of patterns, and the words themselves are compared. The scan touches about one word in `window - 1` of a clean text.

Defined cases: a null or empty text has no words; a null benchmark text, or one without words, has no window, and an
item with a null id is ignored; repeated documents each get their own row; repeated items count once by id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import BY_ALNUM, arrow_column, bounded_batches, discard, hashes, mix, stash, steps, utf8, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of benchmark text whose tables one pass holds; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20
_BLOCK = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[bytes]:
    lower = (text or "").encode("utf-8", "surrogatepass").translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return WORD.findall(lower)


class Tables:
    """Shift table and buckets for the patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.patterns = list(patterns)
        self.items = [patterns[p] for p in self.patterns]
        bits = max(12, min(22, (len(self.patterns) * length * 8).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        flat = b" ".join(w for p in self.patterns for w in p)
        data = np.frombuffer(flat, np.uint8)
        a, b, e, _ = words(data, np.array([0, len(data)]), BY_ALNUM)
        keys = self.keys(hashes(a, b, e), across=False)
        last = length - self.block
        self.shift = np.full(1 << bits, last + 1, np.int64)
        self.buckets: dict[int, list[int]] = {}
        for j in range(last + 1):
            at = (keys[j::length] if self.block == 1 else keys[:, j]).astype(np.int64)
            np.minimum.at(self.shift, at, last - j)
        for i, k in enumerate((keys if self.block == 1 else keys[:, last]).tolist()):
            self.buckets.setdefault(k, []).append(i)
        self.shift = self.shift.tolist()

    def keys(self, h: np.ndarray, across: bool = True) -> np.ndarray:
        """Table places of the blocks that end at each word (across), or of each pattern's blocks."""
        if self.block == 1:
            return mix(h) & self.mask
        if across:
            out = np.zeros(len(h), np.uint64)
            out[1:] = mix(h[:-1] * _BLOCK + h[1:]) & self.mask
            return out
        h = h.reshape(-1, self.length)
        return mix(h[:, :-1] * _BLOCK + h[:, 1:]) & self.mask

    def scan(self, keys: list[int], lo: int, hi: int, word) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence in words lo..hi."""
        found, shift, buckets, n = [], self.shift, self.buckets, self.length
        i = lo + n - 1
        while i < hi:
            s = shift[keys[i]]
            if s:
                i += s
                continue
            for p in buckets.get(keys[i], ()):
                begin = i - n + 1
                if all(word(begin + k) == w for k, w in enumerate(self.patterns[p])):
                    found.append((begin, p))
            i += 1
        return found


def build(items: list[tuple[str, str | None]], window: int) -> list[Tables]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item_id, text in items:
        ws = item_words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            owners = by_length.setdefault(n, {}).setdefault(tuple(ws[i : i + n]), [])
            if item_id not in owners:
                owners.append(item_id)
    return [Tables(p, n) for n, p in sorted(by_length.items())]


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Flat begin, end of the union of ranges, in order and apart."""
    out: list[int] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (b, e)
    return out


def _pass(tables):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch)
            n_words, spans, owners = [], [], []
            for lo, hi in steps(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                a, b, e, count = words(part, off, BY_ALNUM)
                h, raw = hashes(a, b, e), a.tobytes()
                bl, el, cl = b.tolist(), e.tolist(), count.tolist()
                word = lambda k: raw[bl[k] : el[k]]
                keyed = [(t, t.keys(h).tolist()) for t in tables.value]
                for r in range(hi - lo):
                    first, end, got, ids = cl[r], cl[r + 1], [], set()
                    for t, keys in keyed:
                        for begin, p in t.scan(keys, first, end, word):
                            got.append((begin - first, begin - first + t.length))
                            ids.update(t.items[p])
                    n_words.append(end - first)
                    spans.append(merged(got))
                    owners.append(sorted(ids))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.string()))], ["n", "spans", "items"])

    return run


_FOUND = "struct<n:long,spans:array<int>,items:array<string>>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """row (a struct of all columns) and found: n (words), spans (flat begin, end ranges of words hit) and items (ids, sorted).

    A benchmark of over PASS_BYTES is searched in passes; what one finds is written with the rows before the next, so that each
    task holds the tables of one pass alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + size // PASS_BYTES
    bench = bench.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    out, before = docs.select(F.struct(*docs.columns).alias("row")), None
    for k in range(passes):
        rows = bench.where(F.col("part") == k).select("item_id", "text").collect()  # PASS_BYTES about
        tables = spark.sparkContext.broadcast(build([(r[0], r[1]) for r in rows], window))
        new = arrow_column(_pass(tables), _FOUND, F.coalesce(F.col("row")[text].cast("string"), F.lit("")))
        if k:
            both = lambda f: F.concat(F.col("found")[f], F.col("new")[f])
            out = out.withColumn("new", new)
            new = F.struct(F.col("found.n").alias("n"), both("spans").alias("spans"), F.array_sort(F.array_distinct(both("items"))).alias("items"))
        out = out.select("row", new.alias("found"))
        if k + 1 < passes:
            out = stash(out, "hits")
            if before is not None:
                discard(before)
            before = out
    return out


def covered(spans: Column) -> Column:
    """Words inside any of the flat begin, end ranges."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.get(spans, i).alias("b"), F.get(spans, i + 1).alias("e")))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["b"], s["end"]))).alias("n"), F.greatest(s["end"], r["e"]).alias("end"))
    counted = F.aggregate(F.array_sort(pairs), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])
    return F.when(F.size(spans) == 0, 0).otherwise(counted).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest per document; see the module text for the cases."""
    found = search(docs.select("doc_id", "text"), benchmark, window)
    spans, items = F.col("found.spans"), F.col("found.items")
    return found.select("row.doc_id", F.col("found.n").alias("n_words"), covered(spans).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, without those that hold any window of the benchmark."""
    return search(docs, benchmark, window).where(F.size("found.items") == 0).select("row.*")
