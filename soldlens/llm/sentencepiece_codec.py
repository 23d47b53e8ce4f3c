"""SentencePiece encoding and decoding that keeps offsets.

The normaliser walks the model's compiled character map (a double-array trie over UTF-8, then a block of replacement
strings): at each position the longest prefix in the trie is replaced, and every normalised byte records the source bytes
it came from. The normalised text is merged pair by pair, best score first, leftmost of equals; each piece covers a run of
normalised bytes and so a byte span of the original text. Where no piece of the vocabulary goes on after a word's end, words are
merged one by one and remembered. The sentencepiece library reads the model file's fields here and is otherwise met in tests alone.

Defined cases: a null text is empty; an empty text has the end id alone and decodes to ''; a model without byte fallback gives
one unknown id for a run of unknown characters; repeated rows are encoded each; null ids decode to ''; extra columns are kept by
`encode` (but ids and spans, which it replaces) and ignored by the digest. Models other than BPE, and those that denormalise or
mark spaces behind words, raise ValueError.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import re
import struct
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import arrow_column, bounded_batches, map_arrow, text_of

SPACE = "▁"
#: Words that a task remembers, and their length: bounds on memory only.
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
#: Fixed values of the model file: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bits of an id in a pair's key, and the worth of two ids that do not merge.
_ID = 20
_IDS, _NEVER, _PAD = (1 << _ID) - 1, 1 << 62, -(1 << 40)
#: Words of up to so many characters are merged together, in two groups by length; and characters of text between such merges.
NARROW, BROAD, STEP = 14, 48, 1 << 19
#: Up to so many symbols the best pair is found by looking at all of them.
SHORT = 96


class CharMap:
    """The compiled character map: little-endian trie size, trie units, replacement strings ending in NUL."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest mapped prefix of text[at:], if any."""
        units, best = self.units, None
        if not units:
            return None
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = jump(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                best = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        return self.strings[best[0] : self.strings.index(b"\0", best[0])], best[1]


class PairTable:
    """What pairs of ids merge to, looked up for many at once: open addressing in two arrays."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NEVER)
        keys, values = (np.array(list(x), np.int64) for x in (pairs.keys(), pairs.values()))
        self.probes, todo = 0, np.arange(len(keys))
        while len(todo):
            place = self._place(keys[todo], self.probes)
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[todo[free]]
            won = self.keys[place] == keys[todo]
            self.values[place[won]] = values[todo[won]]
            todo, self.probes = todo[~won], self.probes + 1

    def _place(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def worth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each pair of ids, _NEVER where they do not merge; what is below zero never does."""
        key = np.where((a >= 0) & (b >= 0), a << _ID | b, -2).ravel()
        at = self._place(key, 0)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], _NEVER)
        rest = np.flatnonzero((held != key) & (held != -1) & (key != -2))
        at = at[rest]
        while len(rest):
            at = at + 1 & (1 << self.bits) - 1
            held = self.keys[at]
            hit = held == key[rest]
            out[rest[hit]] = self.values[at[hit]]
            more = ~hit & (held != -1)
            rest, at = rest[more], at[more]
        return out.reshape(a.shape)


class Codec:
    """Encodes with one model file, all of whose fields it reads itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models that mark spaces before words are supported")
        self.map = CharMap(self.spec.precompiled_charsmap)
        kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER, UNUSED)}
        self.unused = {p.piece for p in model.pieces if p.type == UNUSED}
        self.user = sorted((p.piece for p in model.pieces if p.type == USER), key=len, reverse=True)
        self.user_at = re.compile("|".join(map(re.escape, self.user))) if self.user else None
        self.unknown = kinds.index(UNKNOWN)
        by_name = {p.piece: i for i, p in enumerate(model.pieces)}
        self.end = by_name.get(model.trainer_spec.eos_piece or "</s>", self.unknown)
        self.bytes = [by_name[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.said = [None if k == CONTROL else model.trainer_spec.unk_surface if k == UNKNOWN else p.piece for p, k in zip(model.pieces, kinds, strict=True)]
        #: What each id stands for in a text that starts before it; None where bytes or controls need care.
        self.raw = [None if k in (BYTE, CONTROL) else x.replace(SPACE, " ") for x, k in zip(self.said, kinds, strict=True)]
        self.squeeze = self.spec.remove_extra_whitespaces
        #: The same with bytes as Python's escapes for them, and one that is never text for controls, where the first space is the normaliser's own.
        self.shown = None
        if self.spec.add_dummy_prefix and not self.squeeze:
            self.shown = [bytes([self.byte_of[i]]).decode("ascii", "surrogateescape") if i in self.byte_of else "\udcff" if x is None else x for i, x in enumerate(self.raw)]
        self.names = [str(i) for i in range(len(kinds))]
        self.blank = SPACE if self.spec.escape_whitespaces else " "
        self.plain = not self.map.units and not self.user and self.spec.add_dummy_prefix and not self.squeeze and self.spec.escape_whitespaces
        # no piece holds a space after something else: words cannot merge with each other
        self.by_word = self.spec.escape_whitespaces and not any(SPACE in x.lstrip(SPACE) for x in self.ids)
        self.widths = np.array([1 if p.type == BYTE else 0 if p.type in (UNKNOWN, CONTROL) else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.memo: dict = {}
        pairs = self._pairs()
        self.table = None if pairs is None else PairTable(pairs)
        self.by_char = np.full(0x110000, -1, np.int32)
        for x, i in self.ids.items():
            if len(x) == 1:
                self.by_char[ord(x)] = i

    def _pairs(self) -> dict[int, int] | None:
        """For two ids that merge, the rank of the merged piece's score above its id, the lower the earlier; None where ids alone do not decide."""
        if self.bytes is None or self.user or self.unused or not self.by_word:
            return None
        ids, times = self.ids, Counter(self.scores[x] for x in self.ids if len(x) > 1)
        # of pieces with equal scores the leftmost goes first, not the one with the least id; such runs of spaces go the longer way
        if any(times[self.scores[x]] > 1 and SPACE * 2 not in x for x in ids if len(x) > 1):
            return None
        merged = sorted((x for x in ids if len(x) > 1 and SPACE * 2 not in x), key=lambda x: -self.scores[x])
        return {ids[x[:i]] << _ID | ids[x[i:]]: rank << _ID | ids[x] for rank, x in enumerate(merged) for i in range(1, len(x)) if x[:i] in ids and x[i:] in ids}

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words, merging in all of them at once: each round merges the best pair of every word that has one."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        other = size > BROAD
        if SPACE * 2 in "\n".join(words):
            other |= np.array([SPACE * 2 in w for w in words])
        for k in np.flatnonzero(other).tolist():
            self.memo[words[k]] = self._word(words[k])[0]
        for some in (~other & (size <= NARROW), ~other & (size > NARROW)):
            if some.any():
                self._learn_alike([words[k] for k in np.flatnonzero(some).tolist()], size[some])

    def _learn_alike(self, words: list[str], size: np.ndarray) -> None:
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ids = self.by_char[code].astype(np.int64)
        ids = np.where(ids >= 0, ids, -1 - code.astype(np.int64))  # characters that the vocabulary lacks are below zero until the end
        a = np.full((len(words), size.max() + 1), _PAD)
        a[np.arange(a.shape[1]) < size[:, None]] = ids
        worth = self.table.worth(a[:, :-1], a[:, 1:])
        at = np.arange(len(words))
        while len(at):
            i, best = worth.argmin(1), worth.min(1)
            done = best == _NEVER
            if done.any():
                self._remember([words[k] for k in at[done].tolist()], a[done])
                a, worth, at, i, best = (x[~done] for x in (a, worth, at, i, best))
                if not len(at):
                    break
            row, made = np.arange(len(at)), best & _IDS
            places = np.arange(a.shape[1] - 1)
            a = np.take_along_axis(a, places + (places > i[:, None]), 1)
            a[row, i] = made
            worth = np.take_along_axis(worth, places[:-1] + (places[:-1] >= i[:, None]), 1)
            before, after = i > 0, i < worth.shape[1]
            worth[row[before], i[before] - 1] = self.table.worth(a[row[before], i[before] - 1], made[before])
            worth[row[after], i[after]] = self.table.worth(made[after], a[row[after], i[after] + 1])

    def _remember(self, words: list[str], a: np.ndarray) -> None:
        kept = a != _PAD
        flat, ends = a[kept].tolist(), np.cumsum(kept.sum(1))
        begins = np.concatenate(([0], ends[:-1])).tolist()
        self.memo.update(zip(words, [flat[i:j] for i, j in zip(begins, ends.tolist(), strict=True)], strict=True))
        for k in np.flatnonzero((kept & (a < 0)).any(1)).tolist():
            ids = self.memo[words[k]]
            self.memo[words[k]] = [y for x in ids for y in ((x,) if x >= 0 else [self.bytes[b] for b in chr(-1 - x).encode()])]

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        for u in self.user:
            if raw.startswith(u.encode(), at):
                return u.encode(), len(u.encode())
        found = self.map.longest(raw, at)
        if found:
            return found
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at : at + n], n

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each boundary between them the byte of raw that it stands at (len + 1 values)."""
        blank = self.blank.encode()
        if self.plain:
            if not raw:
                return b"", np.zeros(1, np.int64)
            width = np.where(np.frombuffer(raw, np.uint8) == 32, len(blank), 1)
            at = np.repeat(np.arange(len(raw)), width)
            return blank + raw.replace(b" ", blank), np.concatenate((np.zeros(len(blank), np.int64), at, [len(raw)]))
        norm, source, gap, at = bytearray(), [], self.squeeze, 0
        while at < len(raw):
            out, n = self._prefix(raw, at)
            if gap:
                out = out.lstrip(b" ")
            if out:
                shown = out.replace(b" ", blank)
                norm += shown
                source += [at] * len(shown)
                gap = self.squeeze and out.endswith(b" ")
            at += n
        if self.squeeze:
            while norm.endswith(blank):
                del norm[-len(blank) :], source[-len(blank) :]
        if norm and self.spec.add_dummy_prefix:
            norm[:0] = blank
            source[:0] = [source[0]] * len(blank)
        return bytes(norm), np.array([*source, len(raw)], np.int64)

    def _symbols(self, text: str) -> tuple[list[str], set[int]]:
        """Single characters and whole user symbols, and the places of the latter, which never merge."""
        if self.user_at is None:
            return list(text), set()
        out, fixed, at = [], set(), 0
        for m in self.user_at.finditer(text):
            out += text[at : m.start()]
            fixed.add(len(out))
            out.append(m[0])
            at = m.end()
        return out + list(text[at:]), fixed

    def _merged(self, text: str) -> list[str]:
        """Pieces of a normalised text: the pair of neighbours with the best score is merged, again and again."""
        symbols, fixed = self._symbols(text)
        scores, unused = self.scores, self.unused
        halves: dict[str, tuple[str, str]] = {}
        low = float("-inf")
        if len(symbols) <= SHORT and not fixed:
            worth = [scores.get(a + b, low) for a, b in zip(symbols, symbols[1:])]
            while worth and (best := max(worth)) != low:
                i = worth.index(best)
                made = symbols[i] + symbols[i + 1]
                if unused and made in unused:
                    halves[made] = symbols[i], symbols[i + 1]
                symbols[i : i + 2] = [made]
                del worth[i]
                if i:
                    worth[i - 1] = scores.get(symbols[i - 1] + made, low)
                if i < len(worth):
                    worth[i] = scores.get(made + symbols[i + 1], low)
        else:
            left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
            queue: list[tuple[float, int, int, str]] = []

            def propose(i: int, j: int) -> None:
                if i >= 0 and j >= 0 and i not in fixed and j not in fixed:
                    both = symbols[i] + symbols[j]
                    if both in scores:
                        heapq.heappush(queue, (-scores[both], i, j, both))

            for i in range(len(symbols) - 1):
                propose(i, i + 1)
            while queue:
                _, i, j, both = heapq.heappop(queue)
                if right[i] != j or not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != both:
                    continue
                if unused and both in unused:
                    halves[both] = symbols[i], symbols[j]
                symbols[i], symbols[j] = both, ""
                right[i] = right[j]
                if right[j] >= 0:
                    left[right[j]] = i
                propose(left[i], i)
                propose(i, right[i])
            symbols = [x for x in symbols if x]
        while halves and any(x in halves for x in symbols):
            symbols = [y for x in symbols for y in halves.get(x, (x,))]
        return symbols

    def _word(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids of a part of the normalised text, and the bytes that each covers."""
        ids, widths = [], []
        for x in self._merged(word):
            k = self.ids.get(x)
            if k is None and self.bytes is not None:
                raw = x.encode()
                ids += [self.bytes[b] for b in raw]
                widths += [1] * len(raw)
            else:
                ids.append(self.unknown if k is None else k)
                widths.append(len(x) if x.isascii() else len(x.encode()))
        out = tuple(ids), tuple(widths)
        if len(word) <= REMEMBERED_CHARS and self.table is None:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            self.memo[word] = out
        return out

    def encode_all(self, texts: list[str]):
        """`encode` of each text; new words are merged together for about STEP characters of text at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < STEP):
                size += len(texts[hi])
                hi += 1
            normal = [self.normalise(t.encode()) for t in texts[lo:hi]]
            parts = [_WORDS.findall(n.decode()) if self.by_word else [n.decode()] if n else [] for n, _ in normal]
            if self.table is not None:
                if len(self.memo) >= REMEMBERED:
                    self.memo.clear()
                self._learn(list({w for p in parts for w in p if w not in self.memo}))
            for (norm, source), words in zip(normal, parts, strict=True):
                yield self._encoded(words, source, len(norm))
            lo = hi

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, the end id last, and begin and end byte in the text of each (rows of two); the end id's span is empty, at the end."""
        return next(self.encode_all([text]))

    def _encoded(self, words: list[str], source: np.ndarray, n: int) -> tuple[list[int], np.ndarray]:
        """Ids and spans from the words, the source of each normalised byte, and how many there are."""
        if self.table is not None:
            ids = list(chain.from_iterable(map(self.memo.__getitem__, words)))
            widths = self.widths[np.array(ids, np.int64)]
        else:
            found = [self.memo.get(w) or self._word(w) for w in words]
            ids, widths = (list(chain.from_iterable(f[k] for f in found)) for k in (0, 1))
            if self.bytes is None and self.unknown in ids:
                ids, widths = self._one_unknown(ids, widths)
        at = np.zeros(len(ids) + 2, np.int64)
        np.cumsum(widths, out=at[1:-1])
        at[-1] = at[-2]
        if at[-1] != n:
            raise ValueError("the pieces do not tile the normalised text")
        ids.append(self.end)
        where = source[at]
        return ids, np.stack((where[:-1], where[1:]), axis=1)

    def _one_unknown(self, ids: list[int], widths: list[int]) -> tuple[list[int], list[int]]:
        out, sums = [], []
        for i, w in zip(ids, widths, strict=True):
            if out and i == out[-1] == self.unknown:
                sums[-1] += w
            else:
                out.append(i)
                sums.append(w)
        return out, sums

    def decode(self, ids: list[int]) -> str:
        """The text behind ids; bytes that are not UTF-8 become U+FFFD one by one."""
        if ids and self.shown is not None and self.raw[ids[0]] and ids[0] != self.unknown:
            text = "".join(map(self.shown.__getitem__, ids[:-1] if ids[-1] == self.end else ids))
            with contextlib.suppress(UnicodeDecodeError):
                return (text if text.isascii() else text.encode("utf-8", "surrogateescape").decode()).removeprefix(" ")
        out: list[str] = []
        opened, held = not (self.spec.add_dummy_prefix or self.squeeze), bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(held))
                held = bytearray()
            if opened or any(out):
                out.append(self.raw[i] or "")
                opened = True
                continue
            x = self.said[i]
            if x is None:
                continue
            if x.startswith(SPACE) and i != self.unknown:
                x, opened = x[len(SPACE) :], not self.squeeze
            out.append(x.replace(SPACE, " "))
        return "".join(out) + _utf8(held)


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "\ufffd" + _utf8(raw[e.start + 1 :])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


_ENCODED = "struct<ids:array<int>,spans:array<int>>"


def _lists(rows: list) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r, np.int32) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ids array<int> and spans array<int> (begin, end byte of each id, flat) to the kept columns."""
    columns = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "spans")]
    bounded_batches(df.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            found = [(np.array(ids, np.int32), spans.astype(np.int32).ravel()) for ids, spans in c.encode_all(batch.to_pylist())]
            yield pa.StructArray.from_arrays([_lists([f[k] for f in found]) for k in (0, 1)], ["ids", "spans"])

    row = F.struct(*columns) if columns else F.struct(F.lit(0))
    rows = df.select(row.alias("row"), arrow_column(run, _ENCODED, text_of(text)).alias("encoded"))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], "encoded.ids", "encoded.spans")


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = (), ids: str = "ids") -> DataFrame:
    """The kept columns and decoded string, from a column of ids; null ids decode to ''."""
    bounded_batches(df.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.array([c.decode(x or []) for x in batch.to_pylist()], pa.string())

    return df.select(*keep, arrow_column(run, "string", F.col(ids).cast("array<int>")).alias("decoded"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of ids and decoded text, and covered_bytes, the source bytes that the spans cover."""
    source = docs.select("doc_id", text_of().alias("__text"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, a, b, covered = [], [], [], []
            for ids, spans in c.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(sha(" ".join(map(c.names.__getitem__, ids))))
                b.append(sha(c.decode(ids)))
                covered.append(int(spans[:, 1].max() - spans[0, 0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(covered, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
