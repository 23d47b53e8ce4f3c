"""Defined cases of all text operators: empty tables, columns with clashing names, very long texts, ties and repeats; brute force where test_llm.py has none."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from soldlens.llm import bm25, chat, decontaminate, html_extract, importance, ngram_join, queries, secret_scan, sentencepiece_codec, toxicity, url_filter

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
#: Columns named like those that operators make for themselves.
CLASHES = ("node", "sig", "token", "tokens", "t", "__text", "__found", "__new", "score", "n", "rank", "nth", "u", "key", "head", "base", "spans", "toxic", "group", "root", "part", "term", "piece", "seq", "formatted", "__turns", "__encoded", "__id", "row", "found", "encoded", "id", "fingerprint", "k")


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def runs(labels, bench):
    path = queries.model_path()
    return {
        "secrets": secret_scan.secrets,
        "redact": secret_scan.redact,
        "toxicity": lambda d: toxicity.toxicity(d, clashing(labels)),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, labels),
        "similar": ngram_join.similar,
        "one_of_each": ngram_join.one_of_each,
        "round_trip": lambda d: sentencepiece_codec.round_trip(d, path),
        "encode": lambda d: sentencepiece_codec.encode(d, path),
        "contamination": lambda d: decontaminate.contamination(d, clashing(bench)),
        "clean": lambda d: decontaminate.clean(d, bench),
        "importance": lambda d: importance.resample(d, labels),
        "top_k": bm25.every_twentieth,
    }


KEEPS = ("redact", "drop_toxic", "one_of_each", "clean")
NAMES = ("secrets", "toxicity", "similar", "round_trip", "encode", "contamination", "importance", "top_k", *KEEPS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, runs, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert runs[name](docs).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_nulls_repeats_and_ties(spark, runs, name):
    made = [(20, "red bowl of soup " * 5), (20, "red bowl of soup " * 5), (40, None), (60, ""), (None, "a b c d e f"), (80, "Red  bowl of soup " * 5), (100, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    plain, odd = runs[name](docs), runs[name](clashing(docs))
    columns = plain.columns
    got = [collections.Counter(map(str, d.select(*columns).collect())) for d in (plain, odd)]
    assert got[0] == got[1]
    if name in KEEPS:
        assert set(odd.columns) == set(clashing(docs).columns)
    if name in ("secrets", "toxicity", "similar", "round_trip", "contamination", "importance", "encode"):
        assert plain.count() == len(made)


def test_other_tables_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>word</p>"), (1, "http://a.org/x", "<p>word</p>"), (2, None, None)], "page_id long, url string, html string")
    for op in (url_filter.judge, html_extract.main_text):
        assert op(pages.limit(0)).count() == 0
        assert sorted(map(str, op(pages).collect())) == sorted(map(str, op(clashing(pages)).collect())) and op(pages).count() == 3
    turns = spark.createDataFrame([(1, 0, "user", "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    digest = lambda t: chat.conversation_digests(chat.format_turns(chat.canonical_turns(t)))
    assert digest(turns.limit(0)).count() == 0
    assert sorted(map(str, digest(turns).collect())) == sorted(map(str, digest(clashing(turns)).collect()))


def test_very_long_texts(spark, runs):
    """Texts of about a megabyte, each awkward for some operator, in times that grow no faster than the text."""
    long = {
        200: "a b " * 250_000, 220: "x" * 1_000_000, 240: "word1 " * 160_000, 260: " ".join(f"w{i}" for i in range(120_000)), 280: "0a1b2c3d4e5f6g7h8i9jKLMN" * 40_000, 300: "\u00b21" * 400_000, 320: "1+1=2 " * 150_000,
    }
    docs = spark.createDataFrame(list(long.items()), "doc_id long, text string").repartition(4)
    for name in NAMES:
        if name in KEEPS:
            continue
        began = time.time()
        assert runs[name](docs).where("doc_id IS NOT NULL").count() >= (1 if name == "top_k" else len(long))
        assert time.time() - began < 90, name


@pytest.mark.parametrize("page", ["<a '", "<p><b>", "</x>", "<div>", "<li>", "<!-", "<a title='>", "<p", "&lt;<"])
def test_html_is_read_in_linear_time(page):
    took = []
    for n in (5_000, 20_000):
        began = time.time()
        html_extract.read(page * n)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_html_nodes_of_deep_pages():
    t = html_extract.read("<div>" * 3000 + "text" + "</div>" * 3000)
    assert html_extract.default_model().marginals(html_extract.Forest([t])).shape == (3001,)


def test_entropy_spans_by_brute_force(spark):
    """Spans of single candidate runs against entropies counted anew for every window."""
    r = random.Random(7)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", secret_scan.ALPHABET, "ab1", "0123456789ABCDEF"]
    runs = []
    for i in range(150):
        s = "".join(r.choice(alphabets[i % 5]) for _ in range(r.randint(20, 90)))
        if i % 3 == 0:
            s = s[:25] + "a1" * r.randint(10, 40) + s[25:]
        runs.append(s if i % 2 else s[:20])
    want = {}
    for i, s in enumerate(runs):
        base = any(re.search(p.replace("(?i:", "(?i:"), s) for p in (r"AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"))
        allowed = any(re.search(p, s) for p in secret_scan.ALLOW) or re.search(secret_scan.ALLOWED_PART, s)
        if base or allowed or not re.search("[0-9]", s) or re.search("[=/-]", s[:1] + s[-1:]):
            continue
        bits = secret_scan.LEAST_BITS["hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "mixed" if re.search("[a-z]", s) and re.search("[A-Z]", s) else "lower"]
        hot = set()
        for j in range(len(s) - 19):
            c = collections.Counter(s[j : j + 20])
            if -sum(n / 20 * math.log2(n / 20) for n in c.values()) >= bits - 1e-9:
                hot.update(range(j, j + 20))
        spans = []
        for x in sorted(hot):
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        want[i] = ",".join(f"entropy:{a + 2}:{b + 2}" for a, b in spans)
    assert len(want) > 60 and len({x.count("entropy") for x in want.values()}) > 2
    got = secret_scan.secrets(spark.createDataFrame([(i, f"\u00e9 {s} .") for i, s in enumerate(runs)], "doc_id int, text string"))
    assert {r.doc_id: r.spans for r in got.collect() if r.doc_id in want} == want


def test_viterbi_by_brute_force():
    """The decoded span is one of least cost among all paths of its lattice."""
    counts = np.random.Generator(np.random.PCG64(1)).integers(0, 50, 32768).astype(float)
    r = toxicity.Restorer(toxicity.language_model(counts))

    def cost(path):
        k, total = 0, 0.0
        for out, extra in path:
            total += extra
            for b in out.encode():
                k = (k << 5) | toxicity._CLASS_LIST[b]
                total += r.cost[k]
                k &= 1023
        return total

    for span, spaced in (("m0r0n", False), ("s t u", True), ("cl00wn", False), ("a55h@t", False), ("i d 1 o t", True), ("heeey", False), ("p1zz4", False)):
        paths = [[*p, ("\n", 0.0)] for p in itertools.product(*r._lattice(span, spaced))]
        best = min(map(cost, paths))
        said = r.decode(span, spaced)
        assert any("".join(o for o, _ in p)[:-1] == said and abs(cost(p) - best) < 1e-9 for p in paths)


def test_importance_by_brute_force(spark):
    """Weights from counts of hashed words and pairs, the noise of each row, and the k largest keys, ties at the cut included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(900001, None), (900002, ""), (900003, "same text"), (900003, "same text")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.withColumn("h", F.xxhash64(F.lit(importance.SEED), "doc_id")).collect()
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q > 0").collect()}
    n_labels = labels.where("quality IS NOT NULL").select("doc_id").distinct().count()

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        a, b, e, _ = importance.words(data, np.array([0, len(data)]), importance.BY_SPACE)
        h = importance.hashes(a, b, e).tolist()
        pairs = [int(importance.mix(np.array([(x * int(importance._PAIR) + y) % 2**64], np.uint64))[0]) for x, y in zip(h, h[1:])]
        return [x % importance.BUCKETS for x in h + pairs]

    target, raw = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    made = [(r, buckets(r.text)) for r in rows]
    for r, own in made:
        np.add.at(raw, own, 1)
        if r.doc_id in good:
            np.add.at(target, own, 1)
    ratio = np.log((target + 1) / (target.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    want = {}
    for r, own in made:
        u = (((r.h % 2**64) >> 11) + 0.5) / 2**53
        want[r.doc_id] = (len(own), math.fsum(ratio[own]), math.fsum(ratio[own]) - math.log(-math.log(u)))
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(rows)
    for g in got:
        n, weight, key = want[g.doc_id]
        assert g.n_grams == n and abs(g.log_weight - weight) < 1e-6 and abs(g.gumbel_key - key) < 1e-6
    k = round(len(good) / n_labels * len(rows))
    cut = sorted((g.gumbel_key for g in got), reverse=True)[k - 1]
    assert all(g.selected == (g.gumbel_key >= cut) for g in got)


def test_blocks_are_skipped(spark):
    """With thresholds fewer blocks of frequent postings are read, and what is found is the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    row = bm25.build_index(docs.coalesce(1)).first()
    shard = bm25.Shard(*(np.array(row[c]) for c in ("ids", "copies", "sizes", "terms", "lists", "docs", "tfs")), mean=sum(row.sizes) / len(row.sizes))
    n = len(row.ids)
    idf = np.log(1 + (n - np.array(row.dfs) + 0.5) / (np.array(row.dfs) + 0.5))
    asks = [np.unique(shard.doc_terms[shard.doc_at[d] : shard.doc_at[d + 1]]) for d in range(0, shard.n, 9)]
    at, t = np.concatenate(([0], np.cumsum([len(a) for a in asks]))), np.concatenate(asks)
    found = shard.search(at, t, idf[t], np.full(len(asks), -np.inf), 10)
    whole, shard.read = shard.read, 0
    again = shard.search(at, t, idf[t], np.array([f[-1][0] if len(f) == 10 else -np.inf for f in found]), 10)
    assert again == found and shard.read < 0.9 * whole


def test_chat_ids_are_exact(spark):
    big = 9007199254740993
    turns = spark.createDataFrame([(big, 0, "user", "q"), (None, 0, "user", "x"), (big - 1, 0, "user", "p"), (None, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert got == {big: 1, big - 1: 1, None: 2}


def test_chat_query_by_brute_force(spark):
    got = {r.conv_id: r for r in queries.op9_chat(spark, SF).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    assert set(got) == set(turns)
    for i, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        g = got[i]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss))
        assert g.formatted_chars == sum(len(chat.format_turn(r, t)) for _, r, t in own)


@pytest.mark.parametrize("text", ["<|>", "a</s><s>[INST][/INST]<<SYS>><</SYS>>", "|>\x1b<|\x1b\x1b", "\x1b.", "[[INST]]"])
def test_chat_escapes_in_columns(spark, text):
    df = spark.createDataFrame([(1, text)], "a int, t string")
    (got,) = df.select(chat.escaped(F.col("t"))).first()
    assert got == chat.escape(text) and chat.unescape(got) == text and not any(c in got for c in chat.CONTROL)


def test_chat_records_of_mixed_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"prompt": "p", "response": "c", "extra": {"a": 1}}, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"instruction": "do", "input": "", "output": "done"}, {"question": "q", "answer": "a"}, {"strange": 1}, [1], "x",
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{broken")], "conv_id long, record string")
    got = collections.defaultdict(list)
    for r in chat.canonical_records(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    pair = lambda a, b: [("user", a), ("assistant", b)]
    assert dict(got) == {0: pair("p", "c"), 1: pair("p", "c"), 2: pair("q", "r"), 3: pair("h", "g"), 4: pair("do", "done"), 5: pair("q", "a"), **{i: [(None, None)] for i in (6, 7, 8, 90, 91)}}


def test_url_segments_by_brute_force():
    """Splits against all ways to cut a name."""
    seg = url_filter.Segmenter({"ab": 5, "abc": 3, "c": 9, "cab": 2, "a": 1})
    cost = lambda w: seg.cost.get(w, seg.total + len(w) * math.log(10))
    for name in map("".join, itertools.product("abcx", repeat=6)):
        ways = ([name[i:j] for i, j in zip((0, *cut), (*cut, 6))] for k in range(6) for cut in itertools.combinations(range(1, 6), k))
        assert math.isclose(sum(map(cost, seg.split(name))), min(sum(map(cost, w)) for w in ways))


def test_pipeline_by_brute_force(spark):
    """Each stage on its own input against plain Python: who stays, and what becomes of the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    by_id = lambda d: {r.doc_id: r for r in d.collect()}
    stages = dict(corpus_pipeline.STAGES)
    whole = by_id(docs)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = stages["toxicity"](spark, docs, SF)
    assert set(by_id(kept)) == {i for i in whole if scores[i] < 0.5}

    one = by_id(stages["ngram_jaccard"](spark, docs, SF))
    sets = {}
    for i, r in whole.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = collections.defaultdict(set)
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {p for own in holders.values() for p in itertools.combinations(own, 2)}:
        n = len(sets[a] & sets[b])
        if n * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n):
            links[a].add(b)
            links[b].add(a)
    want, seen = set(), set()
    for i in sorted(whole):
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    assert set(one) == want

    clean = by_id(stages["decontamination"](spark, docs, SF))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r.text))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[j : j + n]))
    hit = lambda t: any(tuple(w[j : j + n]) in own for w in (word.findall(lower(t)),) for n, own in windows.items() for j in range(len(w) - n + 1))
    assert set(clean) == {i for i, r in whole.items() if not hit(r.text)}

    spans = {r.doc_id: r.spans for r in secret_scan.secrets(docs).collect()}
    for i, r in by_id(stages["secrets"](spark, docs, SF)).items():
        out, at, text = "", 0, whole[i].text
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        want_text = None if text is None else out + text[at:]
        assert r.text == want_text and (text is None or r.n_chars == len(want_text))

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    for i, r in by_id(stages["sentencepiece"](spark, docs, SF)).items():
        assert r.ids == sp.encode(whole[i].text or "", add_eos=True)
