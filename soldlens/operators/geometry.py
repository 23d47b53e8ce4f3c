"""Rectangles: box arithmetic as column expressions, containment joins by page, tiles, reading order and greedy matching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def area(b: Column) -> Column:
    return F.greatest(b["w"], F.lit(0.0)) * F.greatest(b["h"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0.0))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def containment(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def union_box(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def clip(b: Column, to: Column) -> Column:
    x, y = F.greatest(b["x"], to["x"]), F.greatest(b["y"], to["y"])
    return box(x, y, F.greatest(F.least(b["x"] + b["w"], to["x"] + to["w"]) - x, F.lit(0.0)), F.greatest(F.least(b["y"] + b["h"], to["y"] + to["h"]) - y, F.lit(0.0)))


def trimmed(b: Column, others: Column) -> Column:
    """The box cut above and below where a box of the same column, among an array of others, comes in; its middle stays."""
    middle = b["y"] + b["h"] / 2
    beside = F.filter(others, lambda o: F.least(b["x"] + b["w"], o["x"] + o["w"]) > F.greatest(b["x"], o["x"]))
    at = lambda o: o["y"] + o["h"] / 2
    floor = F.array_min(F.transform(F.filter(beside, lambda o: at(o) > middle), lambda o: F.greatest(o["y"], middle + 1)))
    roof = F.array_max(F.transform(F.filter(beside, lambda o: at(o) < middle), lambda o: F.least(o["y"] + o["h"], middle - 1)))
    top, bottom = F.greatest(b["y"], roof), F.least(b["y"] + b["h"], floor)  # greatest and least skip nulls
    return box(b["x"], top, b["w"], F.greatest(bottom - top, F.lit(1.0)))


def strip_for(b: Column, strips: Column) -> Column:
    """The number, from 0, of the strip (struct<y, h>) to read a box from: one that shows it whole, then shows most, then leaves most room."""

    def seen(s: Column, i: Column) -> Column:
        top, bottom = b["y"] - s["y"], b["y"] + b["h"] - s["y"]
        room = F.least(top, s["h"] - bottom)
        return F.struct((room >= 0).alias("whole"), (F.least(bottom, s["h"]) - F.greatest(top, F.lit(0.0))).alias("inside"), room.alias("room"), (-i).alias("last"))

    best = F.array_max(F.transform(strips, seen))
    return F.when(best["inside"] >= 2, -best["last"])


def scaled_size(w: Column, h: Column, max_width: int) -> Column:
    """struct<w, h> of an image shrunk to a width, at least one pixel high; a narrower one stays."""
    small = F.struct(F.lit(max_width).cast("long").alias("w"), F.greatest(F.bround(h * F.lit(float(max_width)) / w).cast("long"), F.lit(1)).alias("h"))
    return F.when(w > max_width, small).otherwise(F.struct(w.cast("long").alias("w"), h.cast("long").alias("h")))


def same_object(a: Column, b: Column, least: float) -> Column:
    """IoU, or containment with four fifths of the width in common."""
    across = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0)) / F.least(a["w"], b["w"])
    return (iou(a, b) >= least) | ((intersection(a, b) / F.least(area(a), area(b)) >= least) & (across >= 0.8))


def assign_fields(fields: DataFrame, cards: DataFrame, page: str = "page", least: float = 0.5) -> DataFrame:
    """Each field with the card of its page that contains most of it, if at least half; ties to the lowest card.

    fields: page, field, box, ...; cards: page, card, card_box.
    """
    pairs = fields.join(cards, page).withColumn("share", containment(F.col("box"), F.col("card_box"))).where(F.col("share") >= least)
    best = pairs.withColumn("__rank", F.row_number().over(Window.partitionBy(page, "field").orderBy(F.col("share").desc(), "card")))
    return best.where("__rank = 1").drop("__rank", "card_box")


def most_confident(fields: DataFrame, keys) -> DataFrame:
    """The most confident row per keys."""
    others = [c for c in fields.columns if c not in keys]
    return fields.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("conf")).alias("__b")).select(*keys, "__b.*")


def spans(total: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>> of overlapping windows that cover 0..total; the last one ends at the total."""
    step = size - overlap
    count = F.when(total <= size, 1).otherwise(F.ceil((total - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).cast("long").alias("start"), F.least(i * step + size, total).cast("long").alias("end")))


def image_tokens(w: Column, h: Column) -> Column:
    return F.least(F.ceil(w * h / 750), F.lit(4784)).cast("long")


def _by_page(rows: DataFrame, page: str, columns: list[str], fn, schema: str) -> DataFrame:
    """fn(list of row dicts) -> list of tuples for each page; a page's rows travel as one array, many pages to a batch."""
    packed = rows.select(page, F.struct(*columns).alias("r")).groupBy(page).agg(F.collect_list("r").alias("rows"))

    def run(batches):
        names = [page, *(part.split()[0] for part in schema.split(", "))]
        for batch in batches:
            out = [(k, *t) for k, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in fn(rows)]
            types = [batch.schema.field(0).type, *({"long": pa.int64(), "double": pa.float64()}[part.split()[1]] for part in schema.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    kind = rows.schema[page].dataType.simpleString()
    return packed.mapInArrow(run, f"{page} {kind}, {schema}")


def reading_order(boxes: DataFrame, page: str = "page") -> DataFrame:
    """boxes (page, id, x, y, w, h) with line and position: a box joins a line if over half of the smaller height overlaps."""

    def order(rows: list[dict]) -> list[tuple]:
        lines: list[list[dict]] = []
        for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["id"])):
            for line in lines:
                head = line[0]
                shared = min(r["y"] + r["h"], head["y"] + head["h"]) - max(r["y"], head["y"])
                if shared > 0.5 * min(r["h"], head["h"]):
                    line.append(r)
                    break
            else:
                lines.append([r])
        placed = [(k, r) for k, line in enumerate(lines, 1) for r in sorted(line, key=lambda r: (r["x"], r["id"]))]
        return [(r["id"], k, n) for n, (k, r) in enumerate(placed, 1)]

    return _by_page(boxes, page, ["id", "x", "y", "w", "h"], order, "id long, line long, position long")


def match_greedily(pairs: DataFrame, page: str = "page", least: float = 0.5) -> DataFrame:
    """pairs (page, a, b, score): one-to-one matches per page, best score first."""

    def match(rows: list[dict]) -> list[tuple]:
        used_a, used_b, out = set(), set(), []
        for r in sorted(rows, key=lambda r: (-r["score"], r["a"], r["b"])):
            if r["a"] not in used_a and r["b"] not in used_b:
                used_a.add(r["a"])
                used_b.add(r["b"])
                out.append((r["a"], r["b"], r["score"]))
        return out

    return _by_page(pairs.where(F.col("score") >= least), page, ["a", "b", "score"], match, "a long, b long, score double")


def distinct_cards(cards: DataFrame, page: str = "page", least: float = 0.6) -> DataFrame:
    """cards (page, id, filled, x, y, w, h): most complete first; one that lies mostly inside a kept card goes."""

    def keep(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in sorted(rows, key=lambda r: (-r["filled"], r["id"])):
            if all(_inside(r, k) < least for k in kept):
                kept.append(r)
        return [(r["id"],) for r in kept]

    return _by_page(cards, page, ["id", "filled", "x", "y", "w", "h"], keep, "id long")


def _overlap(a: dict, b: dict) -> float:
    side = lambda p, s: max(0.0, min(a[p] + a[s], b[p] + b[s]) - max(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def _inside(a: dict, b: dict) -> float:
    return _overlap(a, b) / (a["w"] * a["h"]) if a["w"] * a["h"] > 0 else 0.0


def merged_boxes(boxes: DataFrame, page: str = "page", least: float = 0.5) -> DataFrame:
    """boxes (page, cls, conf, x, y, w, h): same-class boxes of one object become their union, until none is left to join."""

    def same(a: dict, b: dict) -> bool:
        i = _overlap(a, b)
        u = a["w"] * a["h"] + b["w"] * b["h"] - i
        across = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) / max(1e-9, min(a["w"], b["w"]))
        small = min(a["w"] * a["h"], b["w"] * b["h"])
        return u > 0 and i / u >= least or small > 0 and i / small >= least and across >= 0.8

    def merge(rows: list[dict]) -> list[tuple]:
        todo, done = sorted(rows, key=lambda r: (r["cls"], -r["conf"], r["x"], r["y"])), []
        while todo:
            r = todo.pop(0)
            k = next((k for k, o in enumerate(todo) if o["cls"] == r["cls"] and same(r, o)), None)
            if k is None:
                done.append(r)
                continue
            o = todo.pop(k)
            x, y = min(r["x"], o["x"]), min(r["y"], o["y"])
            todo.insert(0, {"cls": r["cls"], "conf": max(r["conf"], o["conf"]), "x": x, "y": y, "w": max(r["x"] + r["w"], o["x"] + o["w"]) - x, "h": max(r["y"] + r["h"], o["y"] + o["h"]) - y})
            todo += done
            done = []
        return [(r["cls"], r["conf"], r["x"], r["y"], r["w"], r["h"]) for r in sorted(done, key=lambda r: (r["cls"], r["y"], r["x"]))]

    return _by_page(boxes, page, ["cls", "conf", "x", "y", "w", "h"], merge, "cls long, conf double, x double, y double, w double, h double")
