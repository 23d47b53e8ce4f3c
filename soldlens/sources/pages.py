"""Saved pages: reading files, numbering pages within searches, the page cache, links, and choosing extractors."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soldlens.functions.text import clean_text, normalize_keywords, unescape


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, fetched_at and html of saved pages, gzipped or not; bad UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,html.gz}").load(path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for pdf in frames:
            raw = [gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "fetched_at": pdf["modificationTime"], "html": [r.decode("utf-8", "replace") for r in raw]})

    return files.select("path", "modificationTime", "content").mapInPandas(decode, "path string, fetched_at timestamp, html string")


def guess_keywords(html: Column) -> Column:
    """The search box's value, else the title before the site's name; null without either."""
    box = F.regexp_extract(html, r"""(?is)<input\b[^>]*?(?:\bid\s*=\s*["']?gh-ac["']?|\bname\s*=\s*["']?_nkw["']?)[^>]*?\bvalue\s*=\s*["']([^"']*)["']""", 1)
    title = F.regexp_extract(html, r"(?is)<title>(.*?)(?:\s+for sale)?\s*\|\s*eBay\s*</title>", 1)
    plain = lambda c: F.nullif(clean_text(unescape(c)), F.lit(""))
    return F.coalesce(plain(box), plain(title))


def number_pages(pages: DataFrame, keywords: str = "keywords", order: str = "path") -> DataFrame:
    """search_id: one per distinct keywords; page: the position within it."""
    norm = pages.withColumn("keywords_norm", normalize_keywords(F.col(keywords)))
    ids = norm.groupBy("keywords_norm").agg(F.min(order).alias("__first"))
    ids = ids.select("keywords_norm", F.dense_rank().over(Window.orderBy("__first")).cast("long").alias("search_id"))  # few rows: one per search
    return norm.join(ids, "keywords_norm").withColumn("page", F.row_number().over(Window.partitionBy("search_id").orderBy(order)).cast("long"))


def cached(cache: DataFrame, key: Column | str, ttl_hours: float, now: Column) -> DataFrame:
    """The latest valid page of a key: not expired (a ttl of 0 or less never expires) and with the right digest."""
    rows = cache.where((F.col("key") == key) & (F.sha1("html") == F.col("sha1")))
    if ttl_hours > 0:
        rows = rows.where(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(round(ttl_hours * 3600, 6))))
    return rows.orderBy(F.col("fetched_at").desc()).limit(1)


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        href = dict(attrs).get("href")
        if tag == "a" and href is not None:
            self.open = [href, ""]

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.open:
            self.found.append((self.open[0], " ".join(self.open[1].split())))
            self.open = None


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """A table function: one row per link with its position; a page that cannot be read gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, html in zip(pdf[key], pdf["html"], strict=True):
                p = _Links()
                p.feed(html or "")
                out += [(k, i, href, text) for i, (href, text) in enumerate(p.found, 1)]
            yield pd.DataFrame(out, columns=[key, "position", "href", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, position long, href string, text string")


def first_that_found(pages: DataFrame, key: str, *extractors) -> DataFrame:
    """Rows of the first extractor that finds any, page by page: each later one sees only the pages left over."""
    out, left = None, pages
    for extract in extractors:
        rows = extract(left)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        left = left.join(rows.select(key).distinct(), key, "left_anti")
    return out
