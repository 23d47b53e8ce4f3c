"""Transcribed entries and texts off pixels as readings; crops; identity in publishing."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from soldlens.operators import geometry
from soldlens.plans import market
from soldlens.sources import transcribed
from soldlens.sources.store import Store

TODAY = date(2026, 6, 1)


def entry(title="Oak stool", **more):
    return {"title": title, "price_text": None, "original_price_text": None} | more


def pages(spark, *answers):
    rows = [(i, a if isinstance(a, str) or a is None else json.dumps(a), "extra") for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, "page long, answer string, note string")


def test_entries_of_untrusted_answers(spark):
    odd = [entry(), 7, None, "x", {"title": None}, {"price_text": "$1"}, {"title": 12, transcribed.FLAG: "true"}, entry("  two   words ", **{transcribed.FLAG: True}), [entry()]]
    got = transcribed.entries(pages(spark, odd, "no json", '{"title": "alone"}', None, "[]", "")).orderBy("page", "position").collect()
    assert [(r.page, r.position, r.title, r[transcribed.FLAG], r.note) for r in got] == [(0, 1, "Oak stool", False, "extra"), (0, 7, "12", False, "extra"), (0, 8, "two words", True, "extra")]


def test_prices_asked_and_paid(spark):
    cards = [
        entry(price_text="$12.50", original_price_text="$20.00"),
        entry(original_price_text="$20.00"),
        entry(price_text="$20.00", original_price_text="$ 20.00"),
        entry(price_text="$20.00", format_text="Best Offer Accepted, offer accepted"),
        entry(price_text="$3.75 to $23.95", bids_text="4 bids", format_text="or Best Offer"),
        entry("NEW LISTING Jar Opens in a new window or tab", price_text="See price", condition="Used · Maker", seller_text="kim 99.1% (2.1K)", location_text="from Oslo", sold_date_text="Sold May 2, 2026"),
    ]
    r = transcribed.listings(transcribed.entries(pages(spark, cards)), today=TODAY).orderBy("position").collect()
    assert [(x.price, x.price_max, x.original_price) for x in r] == [(12.5, None, 20.0), (None, None, None), (None, None, None), (None, None, None), (3.75, 23.95, None), (None, None, None)]
    assert [x.price_text for x in r[:4]] == ["$12.50", "$20.00", "$20.00", "$20.00"]
    assert (r[4].listing_format, r[4].bids, r[4].currency, r[4].extraction) == ("auction", 4, "USD", "llm")
    assert (r[5].title, r[5].condition, r[5].seller, r[5].seller_feedback_pct, r[5].seller_feedback_count, r[5].location, r[5].sold_date) == ("Jar", "Used", "kim", 99.1, 2100, "Oslo", date(2026, 5, 2))


def test_loose_matches_from_the_heading_on(spark):
    cards = [entry("a"), entry("New Listing", **{transcribed.FLAG: True}), entry("b"), entry("c")]
    r = transcribed.listings(transcribed.entries(pages(spark, cards, [entry("d")]))).orderBy("page", "position").collect()
    assert [(x.page, x.position, x.title, x.matches_query) for x in r] == [(0, 1, "a", True), (0, 2, "b", False), (0, 3, "c", False), (1, 1, "d", True)]
    assert transcribed.listings(transcribed.entries(pages(spark, "[]"))).count() == 0


def test_texts_off_pixels(spark):
    rows = [(1, {"title": "New listing: Red cup", "price": "EUR 4,50", "sold_date": "03/04/2026"}), (2, {})]
    df = spark.createDataFrame(rows, "card long, texts map<string,string>")
    a, b = transcribed.from_pixels(df, ["card"], site="www.ebay.de", today=TODAY).orderBy("card").collect()
    assert (a.title, a.price, a.currency, a.sold_date, a.shipping, a.condition) == ("Red cup", 4.5, "EUR", date(2026, 4, 3), None, None)
    assert (b.title, b.price, b.currency, b.price_text, b.extraction) == ("", None, None, None, "vision")


def test_crops(spark):
    box = lambda *v: geometry.box(*[F.lit(float(x)) for x in v])
    strips = F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(100.0).alias("h")) for y in (0, 80, 160)])
    row = spark.range(1).select(
        geometry.trimmed(box(0, 10, 50, 30), F.array(box(0, 30, 50, 20), box(60, 12, 9, 9), box(0, 0, 50, 14))).alias("cut"),
        geometry.trimmed(box(0, 10, 50, 30), F.slice(F.array(box(0, 0, 1, 1)), 1, 0)).alias("alone"),
        *[geometry.strip_for(box(0, y, 10, h), strips).alias(f"s{i}") for i, (y, h) in enumerate([(85, 10), (10, 10), (70, 50), (300, 5)])],
        geometry.scaled_size(F.lit(800), F.lit(3), 200).alias("small"), geometry.scaled_size(F.lit(100), F.lit(3), 200).alias("same"),
    ).first()
    assert (row.cut.y, row.cut.h, row.alone.y, row.alone.h) == (14.0, 16.0, 10.0, 30.0)
    assert (row.s0, row.s1, row.s2, row.s3) == (0, 0, 1, None)
    assert (row.small.w, row.small.h, row.same.w, row.same.h) == (200, 1, 100, 3)


def test_readings_without_an_id_join_their_sale(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    sold = "Sold May 2, 2026"
    whole = [entry("Green enamel kettle two litres", price_text="$31.00", sold_date_text=sold), entry("Brass bell", price_text="$8.00", sold_date_text=sold)]
    part = [entry("Green enamel kettle two", price_text="$31.00", shipping_text="Free delivery")]
    at = datetime(2026, 5, 9)
    answers = lambda path, cards, page: spark.createDataFrame([(path, "Kettle", page, at, json.dumps(cards))], "path string, keywords string, page int, seen_at timestamp, answer string")
    assert market.import_transcripts(spark, store, answers("a", whole, 1)).count() == 2
    market.import_transcripts(spark, store, answers("b", part, 2))
    market.import_transcripts(spark, store, answers("b", part, 2))  # again: nothing changes
    rows = {r.title: r for r in store.current("listings").collect()}
    assert sorted(rows) == ["Brass bell", "Green enamel kettle two litres"] and rows["Green enamel kettle two litres"].shipping == 0.0
    alias = store.current("aliases").collect()
    assert [r.item_id for r in alias] == [rows["Green enamel kettle two litres"].item_id]
    assert store.current("observations").where(F.col("item_id") == alias[0].item_id).count() == 2
