"""Operators against the semantics they state, and every catalog query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from soldlens import catalog
from soldlens.operators import listing, merge, resolve, stats
from soldlens.sources.store import SchemaTooNew, Store

SF = "/root/testdata/sf0.001"


def test_trimming_needs_eight(spark):
    rows = lambda xs: spark.createDataFrame([("USD", float(x), None, None) for x in xs], "currency string, price double, shipping double, sold_date date")
    short = stats.price_stats(rows([10, 11, 12, 10.5, 11.5, 12.5, 500])).first()
    assert short["count"] == 7 and short["max"] == 500
    long = stats.price_stats(rows([12.5, 15, 9.99, 22, 18.75, 14, 11.25, 16.5, 13, 19.99, 10, 250, 60])).first()
    assert (long["count"], long["outliers_removed"]) == (11, 2)


def test_merge_precedence_and_titles(spark):
    df = spark.createDataFrame(
        [("a", 2, 1, "full title here", 5.0, 9.0), ("a", 0, 2, "wrong", None, None), ("a", 2, 3, "full title", 6.0, None)],
        "k string, rank int, seq long, title string, price double, price_max double",
    ).withColumn("norm", F.col("title"))
    got = merge.precedence_merge(df, ["k"], ["title", "price", "price_max"], title_norm="norm").first()
    assert (got.title, got.price, got.price_max, got.field_sources) == ("full title here", 6.0, None, {"title": "dom", "price": "dom"})


def test_resolution_leaves_ambiguity(spark):
    r = spark.createDataFrame([("r1", 10.0, None, "same title"), ("r2", None, None, "same title")], "rid string, r_price double, r_date date, r_title string")
    rows = spark.createDataFrame([("1", 10.0, None, "same title"), ("2", 10.0, None, "same title")], "item_id string, price double, sold_date date, title_norm string")
    assert [tuple(x) for x in resolve.resolve(r, rows).collect()] == [("r1", "1")]  # twins look the same: the lowest id
    apart = rows.withColumn("sold_date", F.when(F.col("item_id") == "1", F.lit("2026-01-01").cast("date")))
    assert resolve.resolve(r, apart).count() == 0


def test_resolution_of_all_orders(spark, tmp_path):
    """Order keys beyond 3,000, one hot price and one hot date, against every pair."""
    made = [(k, 5000.0 * (1 if k % 2 else k % 40) + 1.0, f"2026-01-{1 if k % 3 == 0 else 1 + k % 20:02d}", "ab"[k % 8 == 0]) for k in range(2900, 3300)]
    spark.createDataFrame(made, "o_orderkey long, o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    left = [(str(k), p - 1 if k % 3 else None, d if k % 4 else None, t) for k, p, d, t in made]
    right = [(str(k), p - 1 if k % 7 else None, d if k % 5 else None, t) for k, p, d, t in made]
    counts, fits = set(), set()
    for rid, *a in left:
        n, best = [0, 0, 0], {}
        for item, *b in right:
            both = [x == y for x, y in zip(a[:2], b[:2], strict=True) if x is not None and y is not None]
            if both and all(both):
                n[len(both)] += 1
                if a[2] == b[2]:
                    best.setdefault(len(both), []).append((b, item))
        counts.add((rid, n[1], n[2]))
        top = best.get(max(best, default=0), [])
        if top and all(b == top[0][0] for b, _ in top):
            fits.add((rid, min(i for _, i in top), 4, max(best)))
    assert {tuple(r) for r in catalog.QUERIES["blocking_candidates_whole"](spark, str(tmp_path)).collect()} == counts
    assert fits and {tuple(r) for r in catalog.QUERIES["best_fit_whole"](spark, str(tmp_path)).collect()} == fits


def test_tiers_of_whole_titles(spark, tmp_path):
    """Titles that are alike for 80 characters and differ after them, and different rows side by side."""
    head = "blue bowl " * 10
    spark.createDataFrame([(1, head + "x" * 60), (2, head + "y" * 60), (3, head + "y" * 59 + "z")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, f"<title>{head}</title>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.source, r.id): (r.next_tier, r.next_similarity) for r in catalog.QUERIES["title_tier_fuzzy"](spark, str(tmp_path)).collect()}
    assert got["part", 1] == (0, 0.625) and got["part", 2][0] == resolve.MISREAD and got["part", 3][0] == 0 and ("page", 1) in got
    spark.createDataFrame([(4, head + "x"), (5, head + "x"), (6, head + "xy"), (7, head + "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.tier, r.truncates, r.next_tier) for r in catalog.QUERIES["title_tier_exact_whole"](spark, str(tmp_path)).collect()}
    assert got == {4: (4, False, 4), 5: (3, True, 3), 6: (3, False, 0), 7: (0, False, 0)}


def test_limit_must_not_be_negative(spark):
    with pytest.raises(ValueError):
        listing.newest_first(spark.range(1), -1)


def test_store_publishes_whole_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.publish("listings", spark.range(3))
    with pytest.raises(Exception):
        s.publish("listings", spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert s.current("listings").count() == 3
    spark.range(1).select(F.lit(99).alias("version"), F.lit("").alias("path"), F.current_timestamp().alias("at")).write.mode("append").parquet(str(tmp_path / "store/_meta"))
    with pytest.raises(SchemaTooNew):
        Store(spark, str(tmp_path / "store"))


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([_norm(r[c]) for c in columns] for r in df.collect()) == sorted([_norm(r[i]) for i in at] for r in want.fetchall())


def test_alias_chains_of_any_length(spark):
    from soldlens.operators import resolve

    chain = [(f"r{i:03}", f"r{i - 1:03}") for i in range(1, 81)]
    got = resolve.follow(spark.createDataFrame(chain, "rid string, item_id string"))
    assert {r.item_id for r in got.collect()} == {"r000"} and got.count() == 80
    assert resolve.follow(spark.createDataFrame([], "rid string, item_id string")).count() == 0
    with pytest.raises(ValueError):
        resolve.follow(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "rid string, item_id string"))


@pytest.mark.parametrize(("ttl", "found"), [(0.5, 1), (0.2, 0), (1.9, 1), (0, 1), (-1, 1)])
def test_cache_age_in_parts_of_an_hour(spark, ttl, found):
    from soldlens.sources import pages

    made = spark.sql("SELECT 'k' AS key, 'x' AS html, sha1('x') AS sha1, timestamp'2026-04-01 12:00:00' AS fetched_at")
    assert pages.cached(made, "k", ttl, F.expr("timestamp'2026-04-01 12:20:00'")).count() == found


def test_two_streams_into_one_store(spark, tmp_path):
    from soldlens.sources.store import Store
    from soldlens.streaming import ingest

    store = Store(spark, str(tmp_path / "store"))
    for name in ("a", "b"):
        folder = str(tmp_path / name)
        spark.createDataFrame([(name,)], "title string").write.parquet(folder)
        stream = spark.readStream.schema("title string").parquet(folder)
        for checkpoint in (name, name):  # run again: nothing new
            ingest.ingest_readings(stream, store, str(tmp_path / f"state-{checkpoint}"))
    assert sorted(r.title for r in store.facts("readings").collect()) == ["a", "b"]
    ingest.ingest_readings(spark.readStream.schema("title string").parquet(str(tmp_path / "a")), store, str(tmp_path / "lost"), stream=str(tmp_path / "state-a"))
    assert store.facts("readings").count() == 2  # a replay under the same stream writes its batch anew
    store.append("readings", spark.createDataFrame([("c", 1.0)], "title string, price double"))
    assert store.facts("readings").count() == 3


def test_absorption_by_brute_force(spark):
    """Partial readings of one sale, in any order, end as one row; readings that fit two rows stay."""
    from datetime import date

    from soldlens.operators import identity

    full = "hot cars nissan skyline gt r r34 zamac long title"
    day = date(2026, 4, 1)
    rows = [
        ("100", "s", full, 10.0, day), ("x-1", "s", full, None, day), ("x-2", "s", full[:30], 10.0, None), ("x-3", "s", full.replace("skyline", "skyl1ne"), 10.0, day),
        ("200", "s", "twin", 5.0, day), ("201", "s", "twin", 5.0, date(2026, 4, 2)), ("x-4", "s", "twin", 5.0, None),
        ("x-5", "s", "nothing shown", None, None), ("x-6", "t", full, 10.0, day),
        ("x-7", "s", "alone", 7.0, None), ("x-8", "s", "alone", 7.0, day),
    ]
    made = spark.createDataFrame(rows, "item_id string, site string, title_norm string, price double, sold_date date")
    left, aliases = identity.absorb(made)
    assert {(r.item_id, r.price, r.sold_date) for r in left.collect()} == {("100", 10.0, day), ("200", 5.0, day), ("201", 5.0, date(2026, 4, 2)), ("x-4", 5.0, None), ("x-5", None, None), ("x-6", 10.0, day), ("x-7", 7.0, day)}
    assert {(r.rid, r.item_id) for r in aliases.collect()} == {("x-1", "100"), ("x-2", "100"), ("x-3", "100"), ("x-8", "x-7")}
    again, none = identity.absorb(left)
    assert again.count() == left.count() and none.count() == 0
