"""Detector data sets from captured tiles and card regions: label lines, ground truth, counts, all as joins per render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soldlens.operators import geometry

#: Classes by index, and the least share of a box that a tile must show (all others: LEAST_TEXT).
CLASSES = ("listing", "title", "price", "sold_date", "shipping", "condition", "image")
LEAST, LEAST_TEXT = {"listing": 0.3, "image": 0.3}, 0.5


def region_boxes(regions: DataFrame, render: str = "render") -> DataFrame:
    """render, region, cls, box, text: the card's own box and one row per field, of regions (render, region, box, fields, texts)."""
    card = regions.select(render, "region", F.lit("listing").alias("cls"), "box", F.lit(None).cast("string").alias("text"))
    fields = regions.select(render, "region", F.explode("fields").alias("cls", "box"), "texts")
    return card.unionByName(fields.select(render, "region", "cls", "box", F.try_element_at("texts", F.col("cls")).alias("text")).where(F.col("cls").isin(*CLASSES[1:])))


def visible_boxes(boxes: DataFrame, tiles: DataFrame, render: str = "render") -> DataFrame:
    """Boxes that a tile shows enough of, in its pixels, with the share shown; tiles (render, tile, tile_box, scale, img_w, img_h).

    The join is on the render; what does not overlap the tile is dropped within it.
    """
    least = F.lit(LEAST_TEXT)
    for name, share in LEAST.items():
        least = F.when(F.col("cls") == name, share).otherwise(least)
    seen = tiles.join(boxes, render).withColumn("part", geometry.clip(F.col("box"), F.col("tile_box")))
    seen = seen.where((geometry.area(F.col("box")) > 0) & (geometry.area(F.col("part")) > 0)).withColumn("visible", geometry.area(F.col("part")) / geometry.area(F.col("box")))
    scale, part, tile = F.col("scale"), F.col("part"), F.col("tile_box")
    pixels = geometry.box((part["x"] - tile["x"]) * scale, (part["y"] - tile["y"]) * scale, part["w"] * scale, part["h"] * scale)
    return seen.where(F.col("visible") + 1e-9 >= least).select(render, "tile", "img_w", "img_h", "region", "cls", pixels.alias("pixels"), "visible", "text")


def label_line(cls: Column, pixels: Column, w: Column, h: Column) -> Column:
    """Class index, centre and size as shares of the image; null for what is under a pixel."""
    left, top = F.greatest(F.lit(0.0), pixels["x"]), F.greatest(F.lit(0.0), pixels["y"])
    right, bottom = F.least(w.cast("double"), pixels["x"] + pixels["w"]), F.least(h.cast("double"), pixels["y"] + pixels["h"])
    index = F.array_position(F.array(*map(F.lit, CLASSES)), cls) - 1
    line = F.format_string("%d %.6f %.6f %.6f %.6f", index, (left + right) / 2 / w, (top + bottom) / 2 / h, (right - left) / w, (bottom - top) / h)
    return F.when((right - left >= 1) & (bottom - top >= 1), line)


def labels(visible: DataFrame, tiles: DataFrame, render: str = "render") -> DataFrame:
    """render, tile, lines: every tile, those without boxes with none; by region, then class."""
    order = F.struct("region", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("cls")).alias("i"), label_line(F.col("cls"), F.col("pixels"), F.col("img_w"), F.col("img_h")).alias("line"))
    lines = visible.groupBy(render, "tile").agg(F.transform(F.filter(F.sort_array(F.collect_list(order)), lambda x: x["line"].isNotNull()), lambda x: x["line"]).alias("lines"))
    return tiles.select(render, "tile").join(lines, [render, "tile"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def split(pages: DataFrame, page: str = "page", held_out: DataFrame | None = None, share: float = 0.2, seed: int = 0) -> DataFrame:
    """pages with split train or val: the pages held out by name, else a share by hash; a page is never in both."""
    if held_out is not None:
        named = held_out.select(page).distinct().withColumn("__val", F.lit(True))
        return pages.join(named, page, "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")
    draw = F.pmod(F.xxhash64(F.col(page), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return pages.withColumn("split", F.when(draw < share, "val").otherwise("train"))


def instances(visible: DataFrame, splits: DataFrame, page: str = "page") -> DataFrame:
    """Labelled boxes by split and class, in class order, zero where none."""
    line = label_line(F.col("cls"), F.col("pixels"), F.col("img_w"), F.col("img_h"))
    rows = visible.where(line.isNotNull()).join(splits.select(page, "split"), page)
    return rows.groupBy("split").pivot("cls", list(CLASSES)).count().na.fill(0)


def write(visible: DataFrame, tiles: DataFrame, splits: DataFrame, out: str, page: str = "render") -> None:
    """labels and ground_truth folders, by split, as text and JSON lines, and data.yaml's text beside them."""
    where = splits.select(page, "split")
    rows = labels(visible, tiles, page).join(where, page).select("split", F.to_json(F.struct(page, "tile", "lines")).alias("value"))
    rows.write.mode("overwrite").partitionBy("split").text(f"{out}/labels")
    truth = visible.groupBy(page, "tile", "region").agg(F.collect_list(F.struct("cls", "pixels", F.round("visible", 3).alias("visible"), "text")).alias("boxes"))
    truth.join(where, page).write.mode("overwrite").partitionBy("split").json(f"{out}/ground_truth")
    yaml = "\n".join([f"path: {out}", "train: images/train", "val: images/val", f"nc: {len(CLASSES)}", "names:", *(f"  {i}: {c}" for i, c in enumerate(CLASSES))])
    tiles.sparkSession.createDataFrame([(yaml,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/data.yaml")
