"""Command line over a store: import-html, stats, list, export. Exit codes: 0 found, 1 nothing found, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.operators import stats
from soldlens.plans import market
from soldlens.session import get_spark
from soldlens.sources import export
from soldlens.sources.store import SchemaTooNew, Store


def _money(v: float | None) -> str:
    return "-" if v is None else f"{v:,.2f}"


def _found(store: Store, a: argparse.Namespace, **more) -> DataFrame:
    since = (date.today() - timedelta(days=int(a.since))).isoformat() if a.since and a.since.isdigit() else a.since
    for day in (since, a.until):
        date.fromisoformat(day or "2000-01-01")
    names = {"since": since, "until": a.until, "condition": a.condition, "currency": a.currency, "site": a.site}
    return market.query(store, a.keywords, exact_matches_only=not a.all_matches, **names, **more)


def _import(store: Store, a: argparse.Namespace) -> int:
    for path in a.files:
        for r in market.import_pages(store.spark, store, path, a.keywords, a.site).orderBy("path").toLocalIterator():
            print(f"{r.keywords}: page {r.page}, {r.listings} listings, {r.exact_match_count} exact")
    return 0


def _stats(store: Store, a: argparse.Namespace) -> int:
    rows = _found(store, a, priced_only=True).withColumn("currency", stats.currency_key(F.col("currency")))
    options = {"trim": not a.no_trim, "include_shipping": a.include_shipping}
    out = stats.price_series(rows, a.by, **options).orderBy("period", "currency") if a.by else stats.in_order(stats.price_stats(rows, **options))
    found = [r.asDict() for r in out.toLocalIterator()]  # one row per currency, or per period and currency
    if a.json:
        print(json.dumps(found if a.by else {r["currency"]: r for r in found}, indent=2, default=str))
        return 0 if found or not a.by else 1
    if not found:
        print("no sold listings match")
        return 1
    for r in found:
        head = f"{r['period']} " if a.by else ""
        print(f"{head}{r['currency']}: {r['count']} sold, {r['outliers_removed']} outliers trimmed, median {_money(r['median'])}, middle half {_money(r['p25'])} to {_money(r['p75'])}, mean {_money(r['mean'])}, min {_money(r['min'])}, max {_money(r['max'])}")
    return 0


def _list(store: Store, a: argparse.Namespace) -> int:
    n = 0
    for r in _found(store, a, limit=a.limit).toLocalIterator():
        n += 1
        top = f"-{_money(r.price_max)}" if r.price_max else ""
        ship = "" if r.shipping is None else " +free ship" if r.shipping == 0 else f" +{_money(r.shipping)} ship"
        print(f"{r.sold_date or '????-??-??'}  {r.currency or ''} {_money(r.price)}{top}{ship}{f' [{r.condition}]' if r.condition else ''}  {(r.title or '')[:80]}")
    return 0 if n else 1


def _export(store: Store, a: argparse.Namespace) -> int:
    rows = _found(store, a)
    rows = rows.select(*[c for c in export.export_columns() if c in rows.columns])
    if a.format == "csv":
        export.export_csv(rows, a.out, single=True)
        n = rows.count()
    else:
        n = export.export_json(rows, a.out)
    print(f"wrote {n} listings to {a.out}")
    return 0


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="soldlens", description="Sold prices from saved result pages.")
    p.add_argument("--store", default="data", help="the store's folder, in any place that Spark reads")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("import-html", help="read saved result pages into the store")
    c.add_argument("files", nargs="+")
    c.add_argument("--keywords")
    c.add_argument("--site", default="www.ebay.com")
    c.set_defaults(run=_import)
    for name, run, about in (("stats", _stats, "price statistics"), ("list", _list, "stored listings"), ("export", _export, "CSV or JSON of stored listings")):
        c = sub.add_parser(name, help=about)
        c.add_argument("keywords", nargs="?")
        for flag in ("--since", "--until", "--condition", "--currency", "--site"):
            c.add_argument(flag)
        c.add_argument("--all-matches", action="store_true")
        c.set_defaults(run=run)
        if name == "stats":
            c.add_argument("--include-shipping", action="store_true")
            c.add_argument("--no-trim", action="store_true")
            c.add_argument("--by", choices=["day", "week", "month"])
            c.add_argument("--json", action="store_true")
        elif name == "list":
            c.add_argument("--limit", type=int, default=50)
        else:
            c.add_argument("--format", choices=["csv", "json"], default="csv")
            c.add_argument("--out", required=True)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    try:
        return a.run(Store(get_spark("soldlens"), a.store), a)
    except (ValueError, LookupError, FileNotFoundError, SchemaTooNew) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
