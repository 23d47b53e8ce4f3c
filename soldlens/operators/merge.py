"""Precedence merge of readings: for each field the last value of the highest rank, in one aggregation.

readings have a key, rank (vision 0, llm 1, dom 2), seq (a total order of arrival) and the fields. A null never erases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extractors by rank, and the merged fields.
RANKS = {"vision": 0, "llm": 1, "dom": 2}
MERGED_FIELDS = (
    "title price price_max original_price currency price_text shipping shipping_text sold_date sold_date_text condition listing_format bids "
    "seller seller_feedback_pct seller_feedback_count location url image_url sponsored"
).split()


def rank_of(extraction: Column) -> Column:
    out = F.lit(-1)
    for name, rank in RANKS.items():
        out = F.when(extraction == name, rank).otherwise(out)
    return out


def _last(value: Column, given: Column, by: Column) -> Column:
    """The value of the greatest `by` among rows where it is given."""
    return F.max_by(value, F.when(given, by))


def blank_to_null(df: DataFrame, fields: Sequence[str] = MERGED_FIELDS) -> DataFrame:
    """Blank strings and the format "unknown" are not shown; sponsored is never null."""
    for f in fields:
        if f not in df.columns:
            continue
        if df.schema[f].dataType.simpleString() == "string":
            df = df.withColumn(f, F.nullif(F.trim(f), F.lit("")))
        if f == "listing_format":
            df = df.withColumn(f, F.nullif(f, F.lit("unknown")))
        if f == "sponsored":
            df = df.withColumn(f, F.coalesce(f, F.lit(False)))
    return df


def fuller_title(rank: Column, seq: Column, title: Column, norm: Column) -> Column:
    """The title of the top rank, in order of arrival, where a truncated one does not replace the fuller."""
    rows = F.array_sort(F.collect_list(F.when(title.isNotNull(), F.struct(rank.alias("r"), seq.alias("s"), title.alias("t"), norm.alias("n")))))
    top = F.filter(rows, lambda x: x["r"] == F.array_max(F.transform(rows, lambda y: y["r"])))
    keep = lambda a, x: F.when((F.length(x["n"]) < F.length(a["n"])) & a["n"].startswith(x["n"]), a).otherwise(x)
    return F.aggregate(F.slice(top, 2, F.greatest(F.size(top), F.lit(1))), F.get(top, F.lit(0)), keep)["t"]


def precedence_merge(readings: DataFrame, key: Sequence[str], fields: Sequence[str], title_norm: str | None = None) -> DataFrame:
    """One row per key: merged fields, field_sources, extraction, confidence, first_seen_at, last_seen_at as far as given.

    price_max travels with the price; confidence is the last known one of the best extractor's readings.
    """
    by = F.struct("rank", "seq")
    aggs = []
    for f in fields:
        if f == "price_max":
            first = F.min_by("price_max", F.col("seq"))  # stands only if no reading has a price
            price = F.max(F.when(F.col("price").isNotNull(), F.struct("rank", "seq", F.col("price_max").alias("v"))))
            aggs.append(F.when(price.isNotNull(), price["v"]).otherwise(first).alias(f))
        elif f == "title" and title_norm:
            aggs.append(fuller_title(F.col("rank"), F.col("seq"), F.col("title"), F.col(title_norm)).alias(f))
        else:
            aggs.append(_last(F.col(f), F.col(f).isNotNull(), by).alias(f))
    names = F.array(*[F.lit(k) for k in RANKS])
    source = lambda f: F.get(names, F.max(F.when(F.col(f).isNotNull(), F.col("rank"))))
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), source(f).alias("v")) for f in fields if f != "price_max"])
    aggs.append(F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("field_sources"))
    aggs.append(F.get(names, F.max("rank")).alias("extraction"))
    if "confidence" in readings.columns:
        aggs.append(F.max(F.when(F.col("confidence").isNotNull(), F.struct("rank", "seq", "confidence"))).alias("__c"))
        aggs.append(F.max("rank").alias("__r"))
    if "seen_at" in readings.columns:
        aggs += [F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")]
    out = readings.groupBy(*key).agg(*aggs)
    if "__c" in out.columns:
        out = out.withColumn("confidence", F.when(F.col("__c.rank") == F.col("__r"), F.col("__c.confidence"))).drop("__c", "__r")
    return out


def upsert_stats(readings: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """new, updated and unchanged writes in order of arrival: the running merge of each field against the row before."""
    order = Window.partitionBy(*key).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    by = F.struct("rank", "seq")
    state = F.struct(*[F.max_by(f, F.when(F.col(f).isNotNull(), by)).over(upto).alias(f) for f in fields], F.max("rank").over(upto).alias("rank"))
    rows = readings.withColumn("__state", state)
    before = F.lag("__state").over(order)
    kind = F.when(F.row_number().over(order) == 1, "new").when(~before.eqNullSafe(F.col("__state")), "updated").otherwise("unchanged")
    return rows.withColumn("__kind", kind).agg(*[F.count_if(F.col("__kind") == k).alias(k) for k in ("new", "updated", "unchanged")])


def upsert_observations(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One observation per key: the last of the highest rank so far; its position falls back to the last known among writes that took effect."""
    upto = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    took = rows.withColumn("__took", F.col("rank") >= F.max("rank").over(upto)).where("__took")
    by = F.col("seq")
    return took.groupBy(*key).agg(F.max_by("matches_query", by).alias("matches_query"), F.max_by("rank", by).alias("rank"), F.max_by("position", F.when(F.col("position").isNotNull(), by)).alias("position"))


def replace_by_key(rows: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("__last"))
    return last.select(*key, "__last.*").select(*rows.columns)
