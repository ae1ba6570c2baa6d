"""Sheets and images as tables of words and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import fixed

c = F.col


def parts_list(words: DataFrame) -> DataFrame:
    """sheet, item, part_id: each part file named on a sheet with the number of its row in the ITEM column.

    words: sheet, x0, y0, x1, y1, text. The number stands under the nearest ITEM header above the file and to its left, within
    the header's width on either side; without one, it is the nearest number to the file's left."""
    f = words.where(c("text").rlike(r"^part_\d\d\.step$")).select("sheet", F.monotonically_increasing_id().alias("fid"), c("x0").alias("fx"), c("y0").alias("fy"), c("y1").alias("fy1"), c("text").alias("file"))
    n = words.where(c("text").rlike(r"^\d{1,2}$")).select("sheet", c("x0").alias("nx0"), c("x1").alias("nx1"), ((c("y0") + c("y1")) / 2).alias("ny"), c("text").alias("item"))
    h = words.where(F.upper("text") == "ITEM").select("sheet", c("x0").alias("hx0"), c("x1").alias("hx1"), c("y1").alias("hy"))
    head = f.join(h, "sheet").where((c("hy") <= c("fy") + 1) & (c("hx1") <= c("fx"))).groupBy("sheet", "fid").agg(F.max(F.struct("hy", "hx0", "hx1")).alias("head"))
    row = f.join(n, "sheet").where((F.abs(c("ny") - (c("fy") + c("fy1")) / 2) < 4) & (c("nx1") <= c("fx"))).join(head, ["sheet", "fid"], "left")
    middle = (c("nx0") + c("nx1")) / 2
    pad = F.greatest(c("head.hx1") - c("head.hx0"), F.lit(1.0))
    under = F.coalesce((middle >= c("head.hx0") - pad) & (middle <= c("head.hx1") + pad), F.lit(False))
    away = F.when(under, F.abs(middle - (c("head.hx0") + c("head.hx1")) / 2)).otherwise(c("fx") - c("nx1"))
    best = row.groupBy("sheet", "fid", "file").agg(F.min_by("item", F.struct((~under).cast("int"), away)).alias("item"))
    return best.select("sheet", "item", F.regexp_replace("file", r"\.step$", "").alias("part_id"))


def tile_grid(width_mm: Column, height_mm: Column, lettering_mm: Column) -> Column:
    """rows and cols of tiles: 1 x 1 if the lettering is legible as it is, else the first grid that makes it so, else the last."""
    letter = fixed.CAP_PER_EM * F.coalesce(lettering_mm, F.lit(fixed.DEFAULT_LETTERING_MM))
    grid = lambda r, k: F.struct(F.lit(r).alias("rows"), F.lit(k).alias("cols"))
    out = F.when(letter * fixed.API_LONG_PX / F.greatest(width_mm, height_mm) >= fixed.TILE_MIN_CAP, grid(1, 1))
    grown = lambda x, n: x / n * (1 + fixed.TILE_OVERLAP if n > 1 else 1)
    for rows, cols in fixed.TILE_GRIDS:
        cap = letter * min(fixed.TILE_PX, fixed.API_LONG_PX) / F.greatest(grown(width_mm, cols), grown(height_mm, rows))
        out = out.when(cap >= fixed.TILE_MIN_CAP, grid(rows, cols))
    return out.otherwise(grid(*fixed.TILE_GRIDS[-1]))


def tiles(sheets: DataFrame) -> DataFrame:
    """Overlapping rectangles of each sheet (sheet, width, height, rows, cols); a sheet of one tile has none."""
    cells = sheets.where(c("rows") * c("cols") > 1).select("*", F.explode(F.sequence(F.lit(0), c("rows") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), c("cols") - 1)).alias("j"))
    w, h = c("width") / c("cols"), c("height") / c("rows")
    low = lambda k, n: F.greatest(F.lit(0.0), k * n - F.when(k > 0, n * fixed.TILE_OVERLAP).otherwise(0.0))
    high = lambda k, n, last, edge: F.least(edge, (k + 1) * n + F.when(k < last - 1, n * fixed.TILE_OVERLAP).otherwise(0.0))
    return cells.select("sheet", (c("i") + 1).alias("row"), (c("j") + 1).alias("col"), low(c("j"), w).alias("x0"), high(c("j"), w, c("cols"), c("width")).alias("x1"), low(c("i"), h).alias("y0"), high(c("i"), h, c("rows"), c("height")).alias("y1"))


def reading_area(pixels: DataFrame) -> DataFrame:
    """Bounds of a page's ink (sheet, y, x, grey), frame lines (rows and columns mostly inked, and two lines either side) and
    footer cleared; whole-page sheets without ink have none. Bounds are in pixels, without margin."""
    p = pixels.withColumn("ink", (c("grey") < fixed.INK_THRESHOLD).cast("int"))
    size = p.groupBy("sheet").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))

    def frames(axis: str) -> DataFrame:
        full = p.groupBy("sheet", axis).agg(F.avg("ink").alias("share")).where(c("share") > fixed.FRAME_RUN)
        return full.select("sheet", F.explode(F.sequence(c(axis) - 2, c(axis) + 2)).alias(axis)).distinct()

    left = p.where("ink = 1").join(frames("y"), ["sheet", "y"], "left_anti").join(frames("x"), ["sheet", "x"], "left_anti").join(size, "sheet")
    left = left.where(c("y") < F.floor(c("height") * fixed.FOOTER_BAND))
    return left.groupBy("sheet").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))


def pixel_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 less the share of the union silhouette whose pixels (image, y, x, r, g, b) differ by more than the tolerance; 1 without one.

    Part pixels are away from the corner's colour and not near black."""

    def seen(df: DataFrame, n: str) -> DataFrame:
        corner = df.where("x = 0 and y = 0").select("image", *[c(k).alias(f"c{k}") for k in "rgb"])
        far = F.greatest(*[F.abs(c(k) - c(f"c{k}")) for k in "rgb"]) > fixed.BACKGROUND_DISTANCE
        part = far & ~((c("r") < fixed.BLACK) & (c("g") < fixed.BLACK) & (c("b") < fixed.BLACK))
        return df.join(corner, "image").select("image", "y", "x", *[c(k).alias(f"{k}{n}") for k in "rgb"], part.alias(f"part{n}"))

    both = seen(a, "1").join(seen(b, "2"), ["image", "y", "x"])
    differs = F.greatest(*[F.abs(c(f"{k}1") - c(f"{k}2")) for k in "rgb"]) > fixed.PIXEL_DIFFERENCE
    union = c("part1") | c("part2")
    return both.groupBy("image").agg((1 - F.coalesce(F.avg(F.when(union, differs.cast("int"))), F.lit(0.0))).alias("agreement"))


def sent_bytes(size: Column, long_edge: Column, most: Column) -> Column:
    """Bytes of an image as sent: scaled down to the longest edge allowed, in base 64."""
    return size * F.pow(F.least(F.lit(1.0), most / long_edge), F.lit(2)) * 4 / 3


def first_in_priority(files: DataFrame, key: str, order: dict[str, int]) -> DataFrame:
    """The answer of each run: the file whose name comes first in the order; others are no answers."""
    rank = F.coalesce(*[F.when(c("path") == name, k) for name, k in order.items()])
    return files.withColumn("rank", rank).where("rank is not null").groupBy(key).agg(F.min_by("path", "rank").alias("answer"))


def folded_deltas(events: DataFrame, key: list[str], order: str, text: str, others: list[str]) -> DataFrame:
    """Streamed pieces put together: texts in order of arrival, other fields by their last value that isn't null."""
    last = [F.max_by(c(o), F.when(c(o).isNotNull(), c(order))).alias(o) for o in others]
    parts = F.array_sort(F.collect_list(F.when(c(text).isNotNull(), F.struct(c(order).alias("o"), c(text).alias("t")))))
    return events.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(text), *last)


def in_bom_order(instances: DataFrame, bom: DataFrame, group: str) -> DataFrame:
    """Part ids in the order of the list of parts where its ids are those placed, else sorted."""
    listed = bom.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part_id"))), lambda s: s["part_id"]).alias("listed"))
    placed = instances.groupBy(group).agg(F.array_sort(F.collect_set("part_id")).alias("placed"))
    both = placed.join(listed, group, "left")
    return both.select(group, F.when(F.array_sort(F.array_distinct("listed")) == c("placed"), F.array_distinct("listed")).otherwise(c("placed")).alias("parts"))


def task_of_case(cases: DataFrame, declared: DataFrame, depth: int = 2) -> DataFrame:
    """The task that a case names; else the task declared in its nearest ancestor directory. cases: case (path), env; declared: folder, env."""
    parts = F.split("case", "/")
    out = cases.join(declared.select(c("env").alias("__named")).distinct(), c("env") == c("__named"), "left")
    picks = [c("__named")]
    for up in range(1, depth + 1):
        at = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")
        out = out.join(declared.select(c("folder").alias(f"__f{up}"), c("env").alias(f"__e{up}")), at == c(f"__f{up}"), "left")
        picks.append(c(f"__e{up}"))
    return out.select("case", F.coalesce(*picks).alias("task"))
