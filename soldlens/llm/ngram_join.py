"""N-gram Jaccard join through a token-group matrix: exact links between documents whose shingle sets are similar, and their components.

A document's set is a node, named by a 64-bit digest of its shingles' hashes, so exact copies are one node. Then:

1. Of each set the smallest hashes, half as many again as it may differ in and one more, are compared over all documents. A similar
   set shares at least a third of them, so a node that shares fewer with the others has no link. What is left is partitioned by
   its smallest shared token: nodes similar to each other mostly agree in it. Partitions of over GROUP_TOKENS tokens are dealt
   to chunks, each with the partition's most central node, the pivot.
2. Within a chunk links are found exactly. Each set of linked members is a group, and its token union is stored: a row of the matrix.
   Groups of one partition that hold its pivot have one root.
3. A query's overlap with a group's union bounds its overlap with every member. Tokens whose groups all have one root cannot
   bind a query to another component, so a group with too few other tokens for its smallest member is left out, and again
   until that ends. What is left of a chunk is one group now, linked or not, with its union stored; chunks are matched by
   their members' rarest tokens, each member of one is held against the union of the other, and only those groups whose
   bound reaches the threshold are opened: their members are read and compared.

A pair is left out only if a bound excludes it or it is in one component already. No list of pairs within a group is made.
A chunk is held in one task, and so is an opened group; neither exceeds about GROUP_TOKENS tokens, or one document. Hot nodes
and tokens are joined, never gathered, so that adaptive execution can split them. All hashes have 64 bits.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle; a row with a null doc_id is linked with nothing and has a null component_id;
repeated rows give repeated results; an empty table gives no rows; columns beside doc_id and text are ignored
(`one_of_each` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.llm._shared import BY_SPACE, discard, hashes, map_arrow, mix, release, stash, steps, text_of, utf8, words

_STEP = np.uint64(0xD6E8FEB86659FD93)
_EDGE = np.uint64(0xA0761D6478BD642F)
_MASK = (1 << 64) - 1
#: Nodes whose copies a task gives no tokens again; a bound on memory only, as copies are one node anyway.
REMEMBERED = 200_000
#: Tokens of a chunk, about, and queries that are held against one group in a task.
GROUP_TOKENS, QUERIES = 1 << 16, 1024
#: Rows of numbers that are broadcast at most; larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def needed(n: int, num: int, den: int) -> int:
    """Tokens that a set of n must share with any similar one."""
    return -(-n * num // den)


def shingle_rows(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each row the sorted distinct hashes of its shingles."""
    a, b, e, count = words(data, offsets, BY_SPACE)
    h = hashes(a, b, e)
    if len(h) >= k:
        whole = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            whole = whole * _STEP + h[j : len(h) - k + 1 + j]
        whole = mix(whole)
    none = np.zeros(0, np.uint64)
    for lo, hi in zip(count[:-1].tolist(), count[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(whole[lo : hi - k + 1])
        elif hi > lo:
            v = np.zeros(1, np.uint64)
            for j in range(lo, hi):
                v = v * _STEP + h[j : j + 1]
            yield mix(v ^ np.uint64((hi - lo) * int(_EDGE) & _MASK))
        else:
            yield none


def sets_of(batch: pa.RecordBatch, column: int, k: int):
    """The shingle sets of a column of texts, row by row."""
    data, offsets = utf8(batch.column(column))
    for lo, hi in steps(offsets):
        yield from shingle_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)


def digest(tokens: np.ndarray) -> int:
    """The node of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(tokens + _EDGE), dtype=np.uint64)]) + np.uint64(len(tokens)))[0].astype(np.int64))


def _longs(arrays: list) -> pa.Array:
    """A list<long> column from arrays of 64-bit numbers and None."""
    sizes = np.array([0, *(0 if x is None else len(x) for x in arrays)])
    full = [x for x in arrays if x is not None and len(x)]
    flat = np.concatenate(full).view(np.int64) if full else np.zeros(0, np.int64)
    mask = pa.array([x is None for x in arrays], pa.bool_()) if any(x is None for x in arrays) else None
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat), mask=mask)


def _heads(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles) and head: the set's smallest tokens, null where the task has given them or none can link."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            n, node, heads = [], [], []
            for s in sets_of(batch, 1, k):
                size = len(s)
                x = digest(s) if size else None
                n.append(size)
                node.append(x)
                # the nearest other set has one token more
                if x is None or x in known or size * den < num * (size + 1):
                    heads.append(None)
                    continue
                if len(known) < REMEMBERED:
                    known.add(x)
                spare = size - needed(size, num, den)
                heads.append(s[: spare + spare // 2 + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), _longs(heads)], ["doc_id", "n_shingles", "node", "head"])

    return map_arrow(docs.select("doc_id", text_of().alias("t")).where("doc_id IS NOT NULL"), run, f"doc_id {kind}, n_shingles long, node long, head array<long>")


def _few(small: DataFrame) -> DataFrame:
    """small, to be broadcast if it has BROADCAST_ROWS at most; it must be stashed and narrow."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents, all columns, whose doc_id is not in ids, a stashed table."""
    return docs.join(_few(ids), "doc_id", "left_anti")


def _partitioned(found: DataFrame, num: int, den: int) -> DataFrame:
    """node, doc_id (of one document), key, places (chunks of the key's partition) and lead (the pivot leads) of all nodes that may have a link."""
    given = found.where("head IS NOT NULL")
    heads = given.select(F.explode("head").alias("token"), "node")
    shared = heads.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    held = heads.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.min("token").alias("key"))
    # tasks that met a node each gave its head once
    known = given.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("times"))
    nodes = held.join(known, "node").withColumn("o", F.expr(f"(n * {num} + {den - 1}) div {den}"))
    nodes = nodes.where(f"held div times >= (o - (o * {num} + {den - 1}) div {den}) div 2 + 1")
    nodes = nodes.select("node", "doc_id", "n", F.expr("held / times / (n - o + (n - o) div 2 + 1)").alias("lead"), "key")
    nodes = stash(nodes, "nodes-with-shared-tokens")
    sizes = nodes.groupBy("key").agg(F.sum("n").alias("tokens"), F.max(F.struct("lead", "node"))["node"].alias("pivot"))
    big = stash(sizes.where(F.col("tokens") > GROUP_TOKENS).select("key", "pivot", F.ceil(F.col("tokens") / GROUP_TOKENS).cast("int").alias("chunks")), "partitions-in-chunks")
    is_pivot = F.coalesce(F.col("pivot") == F.col("node"), F.lit(False))
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.lit(0))
    places = F.when(is_pivot, F.expr("sequence(0, chunks - 1)")).otherwise(F.array(chunk))
    placed = nodes.join(_few(big), "key", "left")
    return placed.select("node", "doc_id", "key", places.alias("places"), F.when(is_pivot, 2.0).otherwise(F.col("lead")).alias("lead"))


def _token_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (node, doc_id, key, places, lead) with n and tokens, from the texts of these documents alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, n, tokens = [], [], []
            for i, (s, node) in enumerate(zip(sets_of(batch, 5, k), batch.column(1).to_pylist(), strict=True)):
                if len(s) and digest(s) == node:  # a doc_id may repeat with other texts
                    at.append(i)
                    n.append(len(s))
                    tokens.append(s)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(n, pa.int64()), _longs(tokens)], ["doc_id", "node", "key", "places", "lead", "n", "tokens"])

    texts = docs.select("doc_id", text_of().alias("t")).join(_few(wanted), "doc_id").select("doc_id", "node", "key", "places", "lead", "t")
    return map_arrow(texts, run, f"doc_id {kind}, node long, key long, places array<int>, lead double, n long, tokens array<long>").drop("doc_id")


class Members:
    """Sets of one chunk or group, by token: what a query shares with each of them is one pass over its own tokens."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def union(self) -> np.ndarray:
        return np.unique(self.tokens)

    def similar(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which members are similar to the query."""
        begin, end = np.searchsorted(self.tokens, query), np.searchsorted(self.tokens, query, "right")
        n = end - begin
        stop = np.cumsum(n)
        both = np.bincount(self.owner[np.arange(stop[-1]) + np.repeat(begin - (stop - n), n)], minlength=len(self.size))
        return np.flatnonzero(both * den >= (len(query) + self.size - both) * num)


class Joined:
    """Which of n things are joined: a forest of parents."""

    def __init__(self, n: int) -> None:
        self.of, self.parts = list(range(n)), n

    def top(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = sorted((self.top(i), self.top(j)))
        self.of[b] = a
        self.parts -= a != b
        return a != b


def _runs(batches, keys: int):
    """Runs of rows with equal values in the first `keys` columns, as lists of (batch, row); the batches are sorted by them."""
    run, last = [], None
    for batch in batches:
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(keys)), strict=True)):
            if run and key != last:
                yield last, run
                run = []
            last = key
            run.append((batch, i))
    if run:
        yield last, run


def _list_at(batch: pa.RecordBatch, column: int, i: int) -> np.ndarray:
    c = batch.column(column)
    lo, hi = c.offsets[i].as_py(), c.offsets[i + 1].as_py()
    return c.values.to_numpy()[lo:hi]


def _grouped(num: int, den: int):
    """Rows (key, chunk, node, n, tokens), the pivot first in its chunk, to one row per group: place (its chunk), group, root, least (size), nodes and tokens."""

    def run(batches):
        out: list[tuple] = []

        def made():
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            arrays = [*(pa.array(columns[c], pa.int64()) for c in range(4)), *(_longs(list(columns[c])) for c in (4, 5))]
            return pa.RecordBatch.from_arrays(arrays, ["place", "group", "root", "least", "nodes", "tokens"])

        def named(x, chunk):
            return int(mix(np.array([x], np.int64).view(np.uint64) + np.uint64(chunk * int(_EDGE) & _MASK))[0].astype(np.int64))

        size = 0
        for (key, chunk), rows in _runs(batches, 2):
            place = named(key, chunk + 1)
            own: dict[int, np.ndarray] = {}
            for batch, i in rows:
                own.setdefault(batch.column(2)[i].as_py(), _list_at(batch, 4, i))
            nodes, sets = list(own), list(own.values())
            joined = Joined(len(nodes))
            if len(nodes) > 1:
                members = Members(sets)
                for i in range(len(nodes)):
                    if i == 0 or joined.top(i) != 0:
                        for j in members.similar(sets[i], num, den).tolist():
                            joined.join(i, j)
                        if joined.parts == 1:
                            break
            parts: dict[int, list[int]] = {}
            for i in range(len(nodes)):
                parts.setdefault(joined.top(i), []).append(i)
            for top, part in parts.items():
                tokens = sets[top] if len(part) == 1 else np.unique(np.concatenate([sets[i] for i in part]))
                out.append((place, named(nodes[top], chunk), nodes[top], min(len(sets[i]) for i in part), np.array([nodes[i] for i in part], np.int64), tokens))
                size += len(tokens)
            if size > 1 << 18:
                yield made()
                out, size = [], 0
        yield made()

    return run


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node with a link (x, y): least labels spread, then point onward."""
    edges = stash(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stash(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), "roots")
    old = labels
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        spread = labels.join(near.select(F.col("x").alias("node"), "near"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        to = labels.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        new = stash(spread.join(to, "root", "left").select("node", "was", F.least("root", F.coalesce("onward", "root")).alias("root")), "roots")
        discard(old)
        old, labels = new, new.select("node", "root")
        if new.where("was <> root").isEmpty():
            discard(edges)
            return labels


def _beside(side: DataFrame, asked: DataFrame, fn, schema: str) -> DataFrame:
    """fn over runs of one group: its side rows (group, root, tokens) first, then rows that ask (group, node, root, n, tokens).

    A group asked by many is repeated, each copy for about QUERIES of them.
    """
    many = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("pieces"))
    side = side.join(many, "group").select("group", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("node"), "root", "tokens")
    asked = asked.join(many, "group").select("group", F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("piece"), F.lit(1).alias("asks"), "node", "root", "tokens")
    rows = side.unionByName(asked).repartition("group", "piece").sortWithinPartitions("group", "piece", "asks")
    return map_arrow(rows, fn, schema)


def _bounded(num: int, den: int):
    """The rows that ask (group, node) whose overlap with the group's stored union reaches the threshold."""

    def run(batches):
        for (group, _), rows in _runs(batches, 2):
            union, found = np.zeros(0, np.int64), []
            for batch, i in rows:
                tokens = _list_at(batch, 5, i)
                if not batch.column(2)[i].as_py():
                    union = np.sort(tokens)
                    continue
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                if np.count_nonzero(union[at] == tokens) >= needed(len(tokens), num, den):
                    found.append(batch.column(3)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(found), pa.int64()), pa.array(found, pa.int64())], ["group", "node"])

    return run


def _opened(num: int, den: int):
    """Links (x, y) of roots, from rows that ask to members of an opened place."""

    def run(batches):
        for _, rows in _runs(batches, 2):
            sets, roots, members, links = [], [], None, set()
            for batch, i in rows:
                tokens, root = _list_at(batch, 5, i), batch.column(4)[i].as_py()
                if not batch.column(2)[i].as_py():
                    sets.append(tokens)
                    roots.append(root)
                    continue
                members = members or Members(sets)
                links.update((root, roots[j]) for j in members.similar(tokens, num, den).tolist() if roots[j] != root)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["x", "y"])

    return run


def _search(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links (x, y) between roots, found through the stored unions; None where the bounds leave nothing to ask."""
    matrix = groups.select("group", "root", "least", F.explode("tokens").alias("token"))
    need = lambda n: F.expr(f"({n} * {num} + {den - 1}) div {den}")
    before = None
    while True:
        # tokens in groups of several roots, with the number of groups: the rarer, the earlier in a query's order
        open_ = matrix.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("groups")).where("lo < hi").select("token", "groups")
        alive = matrix.join(open_, "token").groupBy("group", "root", "least").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need("least")).select("group", "root")
        alive = stash(alive, "groups-left")
        n = alive.count()
        if n == 0:
            return None
        if before is not None and n > 0.9 * before:
            break
        before, matrix = n, matrix.join(_few(alive.select("group")), "group", "left_semi")
    # What is left is asked by place: groups of one chunk, linked or not, are alike, and have been compared with each other.
    left = groups.join(_few(alive.select("group")), "group", "left_semi")
    members = stash(left.select("place", "root", F.explode("nodes").alias("node")), "members-left")
    asking = stash(sets.select("node", "n", "tokens").join(_few(members), "node").select("place", "root", "node", "n", "tokens"), "queries")
    by_rarity = asking.select("place", "root", "node", "n", F.explode("tokens").alias("token")).join(open_, "token").groupBy("place", "root", "node", "n").agg(F.sort_array(F.collect_list(F.struct("groups", "token"))).alias("o"))
    able = by_rarity.where(F.size("o") >= need("n")).select("place", "node", F.slice("o", F.lit(1), (F.size("o") - need("n") + 1).cast("int"))["token"].alias("first"))
    able = stash(able, "rarest-tokens")
    first = able.select("place", F.explode("first").alias("token")).distinct()
    pairs = first.join(first.withColumnRenamed("place", "of"), "token").where("place < of").select("place", "of").distinct()
    asking = stash(asking.join(_few(able.select("place", "node")), ["place", "node"], "left_semi"), "queries")
    unions = stash(asking.groupBy("place").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")), "unions")  # of one chunk at most
    asked = lambda p: p.join(asking.select("place", "node", "root", "tokens"), ["place", "node"]).select(F.col("of").alias("group"), "place", "node", "root", "tokens")
    pairs = pairs.join(able.select("place", "node"), "place").select("of", "place", "node")
    bounds = _beside(unions.select(F.col("place").alias("group"), F.lit(0).cast("long").alias("root"), "tokens"), asked(pairs), _bounded(num, den), "group long, node long")
    reach = stash(bounds.distinct(), "places-to-open")
    opened = asking.join(reach.select(F.col("group").alias("place")).distinct(), "place", "left_semi").select(F.col("place").alias("group"), "root", "tokens")
    again = reach.join(asking.dropDuplicates(["node"]), "node").select("group", "node", "root", "tokens")
    links = stash(_beside(opened, again, _opened(num, den), "x long, y long").distinct(), "links")
    for t in (members, able, unions, reach):
        discard(t)
    return links


def similar(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; documents link at num/den Jaccard similarity of k-word shingles."""
    spark = docs.sparkSession
    found = stash(_heads(docs, k, num, den), "heads")
    wanted = stash(_partitioned(found, num, den), "partitions")
    rows = stash(found.select("doc_id", "n_shingles", "node"), "nodes")
    discard(found)
    release(spark)
    sets = stash(_token_sets(docs, wanted, k), "token-sets")
    dealt = sets.select("key", F.explode("places").alias("chunk"), "node", "n", "tokens", "lead").repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.col("lead").desc(), "node")
    groups = stash(map_arrow(dealt.drop("lead"), _grouped(num, den), "place long, group long, root long, least long, nodes array<long>, tokens array<long>"), "groups")
    release(spark)
    links = _search(groups, sets, num, den)
    linked = groups.select("root", F.explode("nodes").alias("node")).distinct()
    if links is not None:
        roots = components(links)
        linked = linked.join(roots.select(F.col("node").alias("root"), F.col("root").alias("onward")), "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
    linked = stash(linked, "linked")
    discard(sets)
    discard(groups)
    release(spark)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    own = nodes.join(linked, "node", "left").where("rows > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    own = stash(own.select("node", "doc_id", "root"), "copies")
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = own.select("node", "root").join(least, "root").select("node", "component_id")
    out = rows.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    if docs.schema["doc_id"].nullable:
        empty = docs.where("doc_id IS NULL").select("doc_id", text_of().alias("t"))
        out = out.union(_sizes(empty, k))
    return out


def _sizes(rows: DataFrame, k: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = [len(s) for s in sets_of(batch, 1, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(0)], ["doc_id", "n_shingles", "component_id"])

    return map_arrow(rows, run, f"doc_id {kind}, n_shingles long, component_id {kind}")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns, one row of each component: that of the least doc_id, null ones last, and any one of rows that repeat it.

    Where a doc_id is null or repeats, rows are told apart by a key of their own; rows without words are linked with nothing and stay.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        spare = stash(similar(docs, k, num, den).where("doc_id != component_id").select("doc_id"), "near-duplicates")
        return without(docs, spare).select(*docs.columns)
    keyed = stash(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*docs.columns).alias("row")), "keyed")
    found = stash(similar(keyed.select("doc_id", "row.text"), k, num, den).join(keyed.select("doc_id", F.col("row.doc_id").alias("id")), "doc_id"), "components")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("first"))
    spare = stash(found.join(first, "component_id").where("doc_id != first").select("doc_id"), "near-duplicates")
    return without(keyed, spare).select("row.*")
