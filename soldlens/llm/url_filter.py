"""URL filters: rules by host suffix and path prefix, and beyond them naive Bayes over segmented names.

Host labels and path parts are concatenated words; a unigram Viterbi splits them with word counts from the pages' own
text: of all words there, those are kept that occur within a name of some url, which leaves every split as it is. A multinomial naive Bayes over the words, learned from the urls that rules decide, gives the verdict for the others.

Defined cases: a null url, or one without "://", has empty host and path and no rule; with no url decided by a rule both
classes are alike and the verdict is allow, as at any tie; repeated pages are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import BY_ALNUM, discard, map_arrow, stash, steps, utf8, words

#: Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Buckets of the classifier, and characters by which words and names are joined; longer words are then compared in full.
BUCKETS = 1 << 16
JOINED = 32
PART = re.compile(r"[^\W\d_]+|\d+")
CLASSES = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (both null where none fits)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


@dataclass
class Segmenter:
    """Unigram Viterbi: a known word costs -log of its share; an unknown one grows dearer by a factor of ten a letter."""

    counts: dict[str, int]
    #: Occurrences of all words, also of those that counts leaves out; None: counts has them all.
    occurrences: int | None = None

    def __post_init__(self) -> None:
        self.total = math.log((sum(self.counts.values()) if self.occurrences is None else self.occurrences) + 1)
        self.cost = {w: self.total - math.log(n) for w, n in self.counts.items()}
        self.longest = max(map(len, self.counts), default=0)
        self.memo: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name in self.memo:
            return self.memo[name]
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        letter, start = math.log(10), 0
        for end in range(1, n + 1):
            # the best begin of an unknown word is the same for all its ends, as each letter costs alike
            if best[end - 1] - (end - 1) * letter < best[start] - start * letter:
                start = end - 1
            best[end], back[end] = best[start] + self.total + (end - start) * letter, start
            for begin in range(max(0, end - self.longest), end):
                c = best[begin] + self.cost.get(name[begin:end], math.inf)
                if c < best[end] or c == best[end] and begin < back[end]:
                    best[end], back[end] = c, begin
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        out.reverse()
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[name] = out
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        """h: words of the host, p: words of the path; digits of a part count as one token."""
        out = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for part in PART.findall(text):
                out += [mark + "#"] if part[0].isdigit() else [mark + w for w in self.split(part)]
        return out


def bucket(token: str) -> int:
    import zlib

    return zlib.crc32(token.encode()) % BUCKETS


def _name_pieces(urls: DataFrame) -> DataFrame:
    """Runs of up to JOINED characters within names of urls; with those of JOINED, what follows in the name."""

    def parts(batches):
        for batch in batches:
            found = {p for host, path in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for text in (host, path.lower()) for p in PART.findall(text) if not p[0].isdigit()}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["part"])

    def pieces(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for lo in range(0, len(part), 256):
                    found = {(part[i:j], part[j:] if j - i == JOINED else "") for i in range(lo, min(lo + 256, len(part))) for j in range(i + 1, min(len(part), i + JOINED) + 1)}
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.string()) for c in (0, 1)], ["piece", "rest"])

    return map_arrow(map_arrow(urls.select("host", "path").distinct(), parts, "part string").distinct(), pieces, "piece string, rest string").distinct()


def lexicon(pages: DataFrame) -> tuple[dict[str, int], int]:
    """Counts over all pages of the words that occur within names of urls, and the occurrences of all words, kept or not."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in steps(offsets):
                a, b, e, _ = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], BY_ALNUM)
                raw = a.tobytes()
                c = Counter(raw[i:j] for i, j in zip(b.tolist(), e.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " ")
    rows = map_arrow(pages.select(text.alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    names = _name_pieces(pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    rows = stash(rows, "page-words")
    total = rows.agg(F.sum("n")).first()[0] or 0
    same = (F.substring("word", 1, JOINED) == F.col("piece")) & F.col("rest").startswith(F.expr(f"substring(word, {JOINED + 1})"))
    known = rows.join(names, same, "left_semi").collect()  # words within names of urls alone
    discard(rows)
    return {r[0]: r[1] for r in known}, total


def learn(ruled: DataFrame, segmenter: Segmenter) -> np.ndarray:
    """Log weights (BUCKETS + 1 rows, 2 classes; the last row is the prior) from all urls that rules decide."""

    def run(batches):
        for batch in batches:
            c: Counter = Counter()
            for host, path, verdict in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                k = CLASSES.index(verdict)
                c[BUCKETS, k] += 1
                for t in segmenter.tokens(host, path):
                    c[bucket(t), k] += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in c], pa.int32()), pa.array([x[1] for x in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["bucket", "k", "n"])

    rows = map_arrow(ruled.where("by_rule IS NOT NULL").select("host", "path", "by_rule"), run, "bucket int, k int, n long").groupBy("bucket", "k").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((BUCKETS + 1, 2))
    for r in rows:
        n[r[0], r[1]] = r[2]
    prior = np.log((n[-1] + 1) / (n[-1].sum() + 2))
    out = np.log((n[:-1] + 0.1) / (n[:-1].sum(0) + 0.1 * BUCKETS))
    return np.vstack((out, prior))


def judge(pages: DataFrame, rules=RULES, words: dict[str, int] | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    ruled = with_rules(pages, rules)
    segmenter = Segmenter(*lexicon(pages)) if words is None else Segmenter(words)
    shared = pages.sparkSession.sparkContext.broadcast((segmenter.counts, segmenter.occurrences, learn(ruled, segmenter)))

    def run(batches):
        counts, occurrences, weights = shared.value
        seg = Segmenter(counts, occurrences)
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
                if verdict is None:
                    score = weights[-1] + sum((weights[bucket(t)] for t in seg.tokens(host, path)), np.zeros(2))
                    verdict = CLASSES[int(score[1] > score[0])]
                out.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(ruled, run, f"page_id {kind}, host string, path string, rule string, verdict string")
