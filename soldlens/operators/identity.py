"""Which sale a reading is of: ids, aliases, and the absorption of synthetic rows by the rows that they turn out to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soldlens.functions.text import is_synthetic, synthetic_id
from soldlens.operators.resolve import best_fit, blocked_pairs, follow, scored_pairs
from soldlens.sources.shared import written

SHOWN = ("price", "sold_date", "title_norm")


def assign(readings: DataFrame, rows: DataFrame, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """rid, item_id and how ("real", "alias", "known", "match", "new") of every reading.

    readings: rid, item_id (null if not shown), site, title_norm, price, sold_date; rows: item_id and the same;
    aliases: alias_id, item_id. A reading with an id keeps it. Else its synthetic id is looked up among aliases, then among
    rows; else it is matched with a row, if it has a price or a date; else the synthetic id is new.
    """
    own = readings.withColumn("__own", synthetic_id(F.col("site"), F.col("title_norm"), F.col("price"), F.col("sold_date")))
    known = rows.select(F.col("item_id").alias("__known")).distinct()
    named = own.join(aliases.select(F.col("alias_id").alias("__own"), F.col("item_id").alias("__alias")), "__own", "left").join(known, F.col("__own") == F.col("__known"), "left")
    how = F.when(F.col("item_id").isNotNull(), "real").when(F.col("__alias").isNotNull(), "alias").when(F.col("__known").isNotNull(), "known")
    named = named.withColumn("how", how).withColumn("__id", F.coalesce("item_id", "__alias", "__known"))
    left = named.where("how IS NULL AND (price IS NOT NULL OR sold_date IS NOT NULL)")
    asked = left.select("rid", F.col("site").alias("r_site"), F.col("price").alias("r_price"), F.col("sold_date").alias("r_date"), F.col("title_norm").alias("r_title"))
    fits = _fits(asked, rows, fuzzy).select("rid", F.col("item_id").alias("__match"))
    found = named.join(fits, "rid", "left")
    return found.select("rid", F.coalesce("__id", "__match", "__own").alias("item_id"), F.coalesce("how", F.when(F.col("__match").isNotNull(), "match"), F.lit("new")).alias("how"))


def _fits(asked: DataFrame, rows: DataFrame, fuzzy: bool, among: bool = False) -> DataFrame:
    """The unique best real row of each reading, else its best synthetic row by exact tiers alone; `among`: readings are rows, and go to lesser ids."""
    shown = rows.select("item_id", "site", *SHOWN)
    synthetic = is_synthetic(F.col("item_id"))
    real = best_fit(scored_pairs(blocked_pairs(asked, shown.where(~synthetic), exact=not fuzzy), fuzzy))
    own = blocked_pairs(asked, shown.where(synthetic), exact=True).where((F.col("item_id") < F.col("rid")) if among else F.lit(True))
    return real.unionByName(best_fit(scored_pairs(own.join(real, "rid", "left_anti"), fuzzy=False))).select("rid", "item_id")


def absorb(rows: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, aliases) once no synthetic row fits another row any more.

    rows: item_id, site, title_norm, price, sold_date. A synthetic row goes into the row that is its unique best fit; what that
    row does not show, it takes from those that it absorbs, the one with the least id first. Each round removes a row or is the last.
    """
    rows = written(rows.select("item_id", "site", *SHOWN), "rows")
    aliases = rows.select(F.col("item_id").alias("rid"), "item_id").limit(0)
    while True:
        lone = rows.where(is_synthetic(F.col("item_id")) & (F.col("price").isNotNull() | F.col("sold_date").isNotNull()))
        asked = lone.select(F.col("item_id").alias("rid"), F.col("site").alias("r_site"), F.col("price").alias("r_price"), F.col("sold_date").alias("r_date"), F.col("title_norm").alias("r_title"))
        new = written(_fits(asked, rows, fuzzy, among=True), "fits")
        if new.isEmpty():
            return rows, follow(aliases)
        aliases = aliases.unionByName(new)
        ends = follow(new)
        named = rows.join(ends.select(F.col("rid").alias("item_id"), F.col("item_id").alias("__to")), "item_id", "left")
        order = F.struct(F.col("__to").isNotNull(), "item_id")  # the row itself first
        pick = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f)
        merged = named.groupBy(F.coalesce("__to", "item_id").alias("item_id")).agg(F.min_by("site", order).alias("site"), *[pick(f) for f in SHOWN])
        rows = written(merged.select("item_id", "site", *SHOWN), "rows")
