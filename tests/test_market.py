"""Slices, detector data sets, and the store from saved pages to the command line."""

import gzip
import json
from datetime import date

import pytest
from test_cards import OLD, new_page

from soldlens import cli
from soldlens.operators import slices
from soldlens.plans import market
from soldlens.sources import dataset, pages
from soldlens.sources.store import Store


def card(title, price=None, sold=None, **more):
    return {"title": title, "price_text": price, "sold_date_text": sold, "shipping_text": None, "seller_text": None, "flag": False} | more


def test_slices(spark):
    b = card("Card B", "$2.00", shipping_text="Free")
    read = [
        [card("Card A", "$1.00", "Apr 1"), card("Card B", "$2.00")],
        [b | {"sold_date_text": "Apr 2"}, card("Card C", "$3.00"), card("Card C", "$3.00")],
        [card("Card C", "$3.00", flag=True), card("Card D", "$4.00")],
    ]
    rows = [(7, s, i, *c.values()) for s, cards in enumerate(read) for i, c in enumerate(cards)] + [(8, 0, 0, "x", None, None, None, None, None), (8, 2, 0, "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page long, slice int, position int, title string, price_text string, sold_date_text string, shipping_text string, seller_text string, flag boolean")
    got = [r for r in slices.merge_slices(df, flag="flag").orderBy("page", "position").collect()]
    assert [r.title for r in got] == ["Card A", "Card B", "Card C", "Card C", "Card D", "x", "x"]
    assert (got[1].sold_date_text, got[1].shipping_text, got[3].flag, got[2].flag) == ("Apr 2", "Free", True, False)
    assert slices.merge_slices(df.where("false"), flag="flag").count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (card("Blue Bowl", "$1"), card("NEW LISTING blue bowl", "$1"), slices.SAME),
        (card("Blue Bowl", "$1"), card("Blue Bowl", "$2"), 0),
        (card("Blue Bowl set", "$1"), card("Blue Bowl", "$1"), slices.PART),
        (card("Blue Bowl set"), card("Blue Bowl"), 0),
        (card("Blue Bowl set", "$1", shipping_text="a"), card("bowl SET", "$1", shipping_text="b"), 0),
        (card("Bluebowl", "$1"), card("Blue", "$1"), 0),
        (card(None), card(None), 0),
    ],
)
def test_kind(a, b, want):
    assert slices.kind(a, b) == slices.kind(b, a) == want


def test_align_prefers_the_shared_edge():
    twin = card("A", "$1")
    assert slices.align([twin, twin], [twin]) == {0: 1}
    assert slices.align([twin], [twin, twin]) == {0: 0}
    assert slices.align([card("A"), card("B")], [card("B"), card("A")]) == {0: 1}
    assert slices.align([], [twin]) == {}


def test_dataset(spark, tmp_path):
    regions = spark.createDataFrame([("p", 1, (0.0, 0.0, 100.0, 100.0), {"title": (0.0, 90.0, 50.0, 20.0)}, {"title": "T"})], "render string, region int, box struct<x:double,y:double,w:double,h:double>, fields map<string,struct<x:double,y:double,w:double,h:double>>, texts map<string,string>")
    tiles = spark.createDataFrame([("p", 0, (0.0, 0.0, 100.0, 100.0), 2.0, 200, 200), ("p", 1, (0.0, 500.0, 100.0, 100.0), 2.0, 200, 200)], "render string, tile int, tile_box struct<x:double,y:double,w:double,h:double>, scale double, img_w int, img_h int")
    visible = dataset.visible_boxes(dataset.region_boxes(regions), tiles)
    assert {r.tile: r.lines for r in dataset.labels(visible, tiles).collect()} == {0: ["0 0.500000 0.500000 1.000000 1.000000", "1 0.250000 0.950000 0.500000 0.100000"], 1: []}
    splits = dataset.split(spark.createDataFrame([("p",), ("q",)], "render string"), "render", spark.createDataFrame([("q",)], "render string"))
    assert {r.render: r.split for r in splits.collect()} == {"p": "train", "q": "val"}
    assert dataset.instances(visible, splits, "render").first().asDict() == {"split": "train"} | {c: int(c in ("listing", "title")) for c in dataset.CLASSES}
    dataset.write(visible, tiles, splits, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/ground_truth").first().split == "train"


def test_guess_keywords(spark):
    html = ['<input id="gh-ac" name=_nkw value="hot &amp; cold">', "<title>blue  bowl for sale | eBay</title>", "<title>other</title>"]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    assert [r[0] for r in df.select(pages.guess_keywords(df.html)).collect()] == ["hot & cold", "blue bowl", None]


def test_store_and_command_line(spark, tmp_path, capsys):
    saved = tmp_path / "saved"
    saved.mkdir()
    (saved / "a.html").write_text("<title>blue bowl | eBay</title>" + OLD)
    with gzip.open(saved / "b.html.gz", "wt") as f:
        f.write("<title>blue bowl | eBay</title>" + new_page(("Buy It Now",), ("Brand New",)))
    (saved / "c.html").write_text("nothing here")
    store = Store(spark, f"{tmp_path}/store")
    report = market.import_pages(spark, store, str(saved)).orderBy("path").collect()
    assert [(r.keywords, r.page, r.listings, r.exact_match_count) for r in report] == [("blue bowl", 1, 2, 1), ("blue bowl", 2, 1, 1), ("c", 1, 0, 0)]
    market.import_pages(spark, store, str(saved))  # again: nothing changes
    found = market.query(store, "Blue  Bowl").collect()
    assert [(r.item_id, r.price, r.sold_date) for r in found] == [("161803398874", 17.0, date(2026, 2, 11)), ("271828182845", 37.4, date(2023, 11, 9))]
    assert market.query(store, "blue bowl", exact_matches_only=False).count() == 3 and market.query(store, "other").count() == 0
    run = lambda *a: cli.main(["--store", f"{tmp_path}/store", *a])
    assert run("stats", "blue bowl", "--json") == 0
    assert json.loads(capsys.readouterr().out)["USD"]["median"] == 27.2
    assert run("list", "blue bowl", "--limit", "1") == 0 and "2026-02-11  USD 17.00 [Brand New]  Widget" in capsys.readouterr().out
    assert run("stats", "other") == 1 and run("list", "--since", "soon") == 2
    assert run("export", "--format", "json", "--out", f"{tmp_path}/out.json") == 0
    assert {r["item_id"] for r in json.load(open(f"{tmp_path}/out.json"))} == {"161803398874", "271828182845"}
