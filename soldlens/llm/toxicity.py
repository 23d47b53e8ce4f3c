"""Toxicity by a noisy channel: suspicious spans are decoded, and words of the restored text are scored.

A span is suspicious if it mixes letters with look-alike characters, spaces single letters out, or repeats letters. Its
lattice has, for each written character, the letters it may stand for with a channel cost: a look-alike stands for its
letters or for itself, a run of a letter for one or two of it, a gap between single letters for nothing or a word break.
Viterbi picks the path of least channel and language-model cost; the model is a trigram of byte classes, counted over
all documents. The classifier is a list of words and word beginnings, chosen greedily: each explains the most toxic
documents that none before it explains, at high precision; a document's score joins its features as noisy-or.

Labels are learned only where crc32(doc_id as text) mod 5 is not 0, from a sample bounded by SAMPLE labelled rows (those of
least xxhash64(doc_id)). Defined cases: a null text is empty; an empty text scores the rate of toxic rows that no feature
explains; without labels, or without toxic ones, every score is that rate; a null doc_id counts as held out; repeated
rows are scored each; several labels of one doc_id count as toxic if any is; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import arrow_column, bounded_batches, map_arrow, stash, text_of, utf8

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
HELD_OUT = 5
#: Decoded spans that a task remembers, and their length: bounds on memory only.
REMEMBERED, REMEMBERED_CHARS = 50_000, 64
#: A feature is taken at this precision and with so many toxic documents that no other explains.
PRECISION, SUPPORT = 0.9, 3
#: A toxic document counts as explained once so many features hold: insults seldom come alone, and each must be learned.
COVER = 4
#: A clean document that has the feature weighs against so many toxic ones.
CLEAN_COST = 20
PREFIXES = (4, 5, 6, 7)
#: The letters that a look-alike may stand for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
#: Costs in nats: of a look-alike for a letter or for itself, of one or two letters for a run, of a gap for nothing or for a word break.
AS_LETTER, AS_ITSELF, ONE_OF_RUN, TWO_OF_RUN, ONE_OF_TWO, NO_GAP, GAP = 0.7, 8.0, 0.3, 0.5, 1.0, 0.1, 4.0

_LOOKS = "".join(map(re.escape, LOOKALIKE))
_HIT = re.compile(f"[{_LOOKS}]+")
_INSIDE = re.compile(f"[^\\W_]|[{_LOOKS}]")
_SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_LOOKS}])(?:[ .\-_*]{{1,2}}(?:[^\W_]|[{_LOOKS}])){{2,}}(?![^\W_{_LOOKS}])")
_REPEATED = re.compile(r"([^\W\d_])\1(?:\1|([^\W\d_])\2)")
_RUNS = re.compile(r"([a-z])\1+|.", re.S)
_LETTERS = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))
CLASSES = np.array([b - 96 if 97 <= b < 123 else b - 64 if 65 <= b < 91 else 27 + b % 5 if b > 127 else 0 for b in range(256)], np.int64)
_CLASS_LIST = CLASSES.tolist()


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of byte-class trigrams over all documents (32 ** 3)."""

    def run(batches):
        total = np.zeros(32768, np.int64)
        for batch in batches:
            data, _ = utf8(batch.column(0))
            for lo in range(0, len(data), 1 << 22):
                c = CLASSES[data[lo : lo + (1 << 22) + 2]]
                if len(c) > 2:
                    total += np.bincount((c[:-2] << 10) + (c[1:-1] << 5) + c[2:], minlength=32768)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["k", "n"])

    out = np.zeros(32768)
    for k, n in map_arrow(docs.select(text_of(text).alias("t")), run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def language_model(counts: np.ndarray) -> list[float]:
    """-log P(third | first two), smoothed towards the bigram."""
    n = counts.reshape(32, 32, 32)
    pair = n.sum(0)
    bigram = (pair + 0.5) / (pair.sum(1, keepdims=True) + 16)
    tri = (n + 5 * bigram[None]) / (n.sum(2, keepdims=True) + 5)
    return (-np.log(tri)).ravel().tolist()


def _said(path: tuple | None) -> str:
    parts = []
    while path is not None:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


@dataclass
class Restorer:
    """Decodes the suspicious spans of texts; remembers what spans it has decoded."""

    cost: list[float]
    memo: dict[str, str] = field(default_factory=dict)

    def _lattice(self, span: str, spaced: bool) -> list[list[tuple[str, float]]]:
        out = []
        for m in _RUNS.finditer(span):
            s = m[0]
            if len(s) == 2:
                out.append([(s[0], ONE_OF_TWO), (s, 0.0)])
            elif len(s) > 2:
                out.append([(s[0], ONE_OF_RUN), (s[:2], TWO_OF_RUN)])
            elif s in LOOKALIKE:
                out.append([(x, AS_LETTER) for x in LOOKALIKE[s]] + [(s, AS_ITSELF)])
            elif spaced and s in " .-_*":
                out.append([("", NO_GAP), (" ", GAP)])
            else:
                out.append([(s, 0.0)])
        return out

    def decode(self, span: str, spaced: bool = False) -> str:
        """The most probable text behind one span (lower case)."""
        if span in self.memo:
            return self.memo[span]
        cost, cls = self.cost, _CLASS_LIST
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # cost, and the path as (path before, text)
        for options in [*self._lattice(span, spaced), [("\n", 0.0)]]:
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (c, path) in states.items():
                for out, extra in options:
                    k, total = state, c + extra
                    for b in out.encode("utf-8", "surrogatepass"):
                        k = (k << 5) | cls[b]
                        total += cost[k]
                        k &= 1023
                    if k not in new or total < new[k][0]:
                        new[k] = (total, (path, out))
            states = new
        least = min(c for c, _ in states.values())
        best = min(_said(path) for c, path in states.values() if c == least)[:-1]
        if len(span) <= REMEMBERED_CHARS:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            self.memo[span] = best
        return best

    def restore(self, text: str) -> str:
        """The text in lower case with its suspicious spans decoded."""
        text = text.lower()
        if _SPACED.search(text):
            text = _SPACED.sub(lambda m: self.decode(m[0], True), text)
        cuts, last, seen = [], 0, 0
        for m in _HIT.finditer(text):
            if m.start() < seen:
                continue
            lo, hi = m.span()
            while lo > last and _INSIDE.match(text, lo - 1):
                lo -= 1
            while hi < len(text) and _INSIDE.match(text, hi):
                hi += 1
            seen = hi
            token = text[lo:hi].rstrip("!|")
            if len(token) > 2 and token[-1] in "@$+€£¡" and token[-1] == token[-2]:
                token = token.rstrip(token[-1])
            if len(token) > 2 and _HIT.search(token) and sum(map(str.isalpha, token)) > 1:
                cuts += (text[last:lo], self.decode(token))
                last = lo + len(token)
        if cuts:
            text = "".join(cuts) + text[last:]
        cuts, last = [], 0
        for m in _REPEATED.finditer(text):
            if m.start() < last:
                continue
            lo, hi = m.span()
            while lo > last and text[lo - 1].isalnum():
                lo -= 1
            while hi < len(text) and text[hi].isalnum():
                hi += 1
            cuts += (text[last:lo], self.decode(text[lo:hi]))
            last = hi
        return "".join(cuts) + text[last:] if cuts else text


def features(restored: str) -> set[bytes]:
    """Words, marked by a blank at the end, and word beginnings of each length."""
    ws = set(restored.encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    out = {w + b" " for w in ws}
    for n in PREFIXES:
        out |= {w[:n] for w in ws if len(w) >= n}
    return out


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: the bounded sample of labels that may be learned from."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT != 0)
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


@dataclass
class Model:
    cost: list[float]
    weights: dict[bytes, float]  # P(toxic | feature)
    base: float

    def score(self, found: set[bytes]) -> float:
        clean = 1 - self.base
        for f in sorted(found):
            clean *= 1 - self.weights[f]
        return 1 - clean


def choose(counts: dict[bytes, tuple[int, int]], docs: list[set[bytes]], n_clean: int) -> tuple[dict[bytes, float], float]:
    """Greedy choice; docs: the candidates that each toxic document has."""
    having = defaultdict(set)
    for i, fs in enumerate(docs):
        words = {f[:-1] for f in fs if f.endswith(b" ")}
        for f in fs - words:  # a beginning that is a whole word here says no more than the word
            having[f].add(i)
    left, weights, times = set(range(len(docs))), {}, Counter()
    rank = lambda f: (len(having[f]) - CLEAN_COST * counts[f][1], f.endswith(b" "), len(f), f)
    while having:
        best = max(having, key=rank)
        new = set(having[best])
        if len(new) < SUPPORT:
            break
        toxic, clean = counts[best]
        weights[best] = (toxic + 0.5) / (toxic + clean + 1)
        left -= new
        del having[best]
        times.update(new)
        done = {i for i in new if times[i] >= COVER}
        for f in [f for f, own in having.items() if own & done]:
            having[f] -= done
            if not having[f]:
                del having[f]
    return weights, (len(left) + 0.5) / (len(left) + n_clean + 50)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    cost = language_model(trigram_counts(docs))
    sample = F.broadcast(labelled(labels))  # SAMPLE rows of two numbers at most

    def restore(batches):
        r = Restorer(cost)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.restore(t) for t in batch.column(1).to_pylist()], pa.string())], ["toxic", "text"])

    def count(batches):
        c: Counter = Counter()
        n = [0, 0]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["f", "toxic", "clean"])

        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y > 0] += 1
                for f in features(t):
                    c[f, y > 0] += 1
                if len(c) > 50_000:
                    yield made([(f, v * y, v * (not y)) for (f, y), v in c.items()])
                    c.clear()
        yield made([*((f, v * y, v * (not y)) for (f, y), v in c.items()), (None, n[1], n[0])])

    rows = stash(map_arrow(docs.select("doc_id", text_of().alias("text")).join(sample, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text"), restore, "toxic int, text string"), "toxic-sample")
    table = map_arrow(rows, count, "f binary, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = table.where(F.col("f").isNull() | (F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean") + 0.3))).collect()
    totals = [r for r in got if r[0] is None]
    n_clean = totals[0][2] if totals else 0
    counts = {bytes(r[0]): (r[1], r[2]) for r in got if r[0] is not None}

    def present(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(counts.keys() & features(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.binary()))], ["f"])

    toxic = map_arrow(rows.where("toxic > 0").select("text"), present, "f array<binary>").collect()
    weights, base = choose(counts, [{bytes(f) for f in r[0]} for r in toxic], n_clean)
    return Model(cost, weights, base)


def score_of(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of the text, as a column; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(batches):
        m = shared.value
        r = Restorer(m.cost)
        whole = {f[:-1] for f in m.weights if f.endswith(b" ")}
        heads = {n: {f for f in m.weights if len(f) == n and not f.endswith(b" ")} for n in PREFIXES}
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                ws = set(r.restore(t).encode("utf-8", "surrogatepass").translate(_LETTERS).split())
                found = {w + b" " for w in whole & ws}
                for n, own in heads.items():
                    if own:
                        found |= own & {w[:n] for w in ws}
                out.append(m.score(found))
            yield pa.array(out, pa.float64())

    return arrow_column(run, "double", text_of(text))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    score = score_of(docs, model or fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(True))
    return docs.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    return docs.where(score_of(docs, fit(docs, labels)) < 0.5)
