"""Conditional counts and geometry over connected components, keyed by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import clip01
from ..sources.scratch import stored


def centers(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})


def in_cells(rows: DataFrame, radius: Column) -> DataFrame:
    """Adds u, v: the cell of a grid whose cells are radius / sqrt(2) wide, so that two points of one cell are
    never further apart than the radius, and those within it at most two cells."""
    size = radius / F.sqrt(F.lit(2.0))
    return rows.withColumns({"u": F.floor(F.col("cx") / size), "v": F.floor(F.col("cy") / size)})


#: Half of the 24 cells around a cell: of two cells each is beside the other, so one of both names the pair.
AHEAD = [(du, dv) for du in range(3) for dv in range(-2, 3) if du > 0 or dv > 0]
CELL = ("image_id", "u", "v")


def cell_pairs(cells: DataFrame) -> DataFrame:
    """The cells, each with `others`, the points of a cell beside it: each pair of occupied cells once. cells: a row per
    occupied cell with pts, its points. Only names of cells are copied to the twelve places ahead; points join the
    pairs that are found."""
    steps = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a, b in AHEAD])
    keys = cells.select(*CELL)
    ahead = keys.select("image_id", F.struct("u", "v").alias("from"), F.explode(steps).alias("step"), "u", "v")
    ahead = ahead.select("image_id", "from", (F.col("u") + F.col("step.du")).alias("u"), (F.col("v") + F.col("step.dv")).alias("v"))
    met = ahead.join(keys, list(CELL)).join(cells.select(*CELL, F.col("pts").alias("others")), list(CELL))
    return met.select("image_id", F.col("from.u").alias("u"), F.col("from.v").alias("v"), "others").join(cells, list(CELL))


def near_points(pairs: DataFrame, most2: Column) -> DataFrame:
    """(image_id, a, b): points of paired cells within the distance."""
    both = pairs.withColumn("a", F.explode("pts")).withColumn("b", F.explode("others"))
    return both.filter(gap2(F.col("a"), F.col("b")) <= most2).select("image_id", F.col("a.comp_id").alias("a"), F.col("b.comp_id").alias("b"))


#: Images of at most this many components are compared in one array; those of larger ones meet by cells.
FEW = 128


def gap2(a: Column, b: Column) -> Column:
    dx, dy = a["cx"] - b["cx"], a["cy"] - b["cy"]
    return dx * dx + dy * dy


def within(pts: Column, a: Column, most2: Column) -> Column:
    """How many of the points are within the distance of a, itself included."""
    return F.size(F.filter(pts, lambda b: gap2(a, b) <= most2))


def by_size(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The points of images of at most FEW, dealt by image, and the image_id of all larger ones (None if there are none).
    Images are counted first, so that none that is large is gathered; each point then moves once."""
    sizes = points.groupBy("image_id").agg(F.count("*").alias("n"))
    many = stored(sizes.filter(F.col("n") > FEW).select("image_id"), "many")
    if many.isEmpty():
        return points.repartition("image_id"), None
    return points.join(many, "image_id", "left_anti").repartition("image_id"), many


def isolated(rows: DataFrame, far: float = 60.0) -> DataFrame:
    """image_id, isolated: components with no other within `far`; the only one of an image counts, and so does one
    without a place."""
    rows = rows.filter("image_id is not null")
    few, many = by_size(centers(rows).select("image_id", "cx", "cy"))
    pts, far2 = F.col("pts"), F.lit(far * far)
    arrays = few.groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy")).alias("pts"))
    out = arrays.select("image_id", F.size(F.filter(pts, lambda a: within(pts, a, far2) <= 1)).cast("long").alias("isolated"))
    return out if many is None else out.union(isolated_by_cells(rows.join(many, "image_id", "left_semi"), far))


def isolated_by_cells(rows: DataFrame, far: float) -> DataFrame:
    """`isolated` for images of any size. Components that share a cell are not isolated; those alone in theirs are compared
    with each other, each pair of cells once, and with the crowds around them, so no crowd meets itself."""
    placed = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    points = in_cells(centers(rows).filter(placed), F.lit(far)).withColumn("pt", F.struct("comp_id", "cx", "cy"))
    counted = points.groupBy(*CELL).agg(F.count("*").alias("n"), F.first("pt").alias("only"))
    alone = stored(counted.filter("n = 1").select(*CELL, F.array("only").alias("pts")), "alone")
    steps = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)])
    crowds = counted.filter("n > 1").select(*CELL)
    around = crowds.select(*CELL, F.explode(steps).alias("step")).select("image_id", (F.col("u") + F.col("step.du")).alias("u"), (F.col("v") + F.col("step.dv")).alias("v"), F.struct("u", "v").alias("crowd"))
    pairs = near_points(cell_pairs(alone), F.lit(far * far))
    near = pairs.select("image_id", F.explode(F.array("a", "b")).alias("comp_id"))
    asked = around.join(alone, list(CELL)).select("image_id", F.col("crowd.u").alias("u"), F.col("crowd.v").alias("v"), F.col("pts")[0].alias("a"))
    beside = asked.join(points.select(*CELL, F.struct("cx", "cy").alias("b")), list(CELL)).filter(gap2(F.col("a"), F.col("b")) <= far * far)
    near = near.union(beside.select("image_id", F.col("a.comp_id"))).distinct()
    left = alone.select("image_id", F.col("pts")[0]["comp_id"].alias("comp_id")).join(near, ["image_id", "comp_id"], "left_anti").select("image_id", F.lit(1).alias("one"))
    every = centers(rows).select("image_id", F.when(placed, 0).otherwise(1).alias("one"))
    return every.union(left).groupBy("image_id").agg(F.sum("one").alias("isolated"))


def clusters(rows: DataFrame, side: Column, least: int = 4) -> DataFrame:
    """image_id, clustered: 1 if some component has `least` components, itself included, within the radius. side: the
    same for all components of an image. Components without a place are in no image."""
    radius = F.greatest(F.lit(28.0), side * 0.055)
    points = centers(rows).withColumn("radius", radius).filter("image_id is not null and cx is not null and cy is not null")
    few, many = by_size(points.select("image_id", "cx", "cy", "radius"))
    pts, most2 = F.col("pts"), F.col("radius") * F.col("radius")
    arrays = few.groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy")).alias("pts"), F.max("radius").alias("radius"))
    crowded = (F.size(pts) >= least) & F.exists(pts, lambda a: within(pts, a, most2) >= least)
    out = arrays.select("image_id", F.when(crowded, 1).otherwise(0).alias("clustered"))
    return out if many is None else out.union(clusters_by_cells(points.join(many, "image_id", "left_semi"), least))


def clusters_by_cells(rows: DataFrame, least: int) -> DataFrame:
    """`clusters` for images of any size. A cell with `least` components decides at once; an image without one has cells of
    fewer, and a component meets those of the cells around its own. Images with fewer components than `least` are done."""
    points = in_cells(rows, F.col("radius")).withColumn("radius2", F.col("radius") * F.col("radius"))
    pts = F.collect_list(F.when(F.col("place") < least, F.struct("comp_id", "cx", "cy"))).alias("pts")
    ranked = points.withColumn("place", F.row_number().over(Window.partitionBy(*CELL).orderBy("comp_id"))).filter(F.col("place") <= least)
    cells = stored(ranked.groupBy(*CELL).agg(pts, F.count("*").alias("n"), F.first("radius2").alias("radius2")), "cells")
    images = cells.groupBy("image_id").agg(F.max(F.when(F.col("n") >= least, 1).otherwise(0)).alias("clustered"), F.sum("n").alias("all"))
    images = stored(images, "clustered")
    open_ = cells.join(images.filter((F.col("clustered") == 0) & (F.col("all") >= least)).select("image_id"), "image_id", "left_semi")
    own = open_.select("image_id", F.explode("pts").alias("p"), (F.col("n") - 1).alias("near")).select("image_id", F.col("p.comp_id").alias("comp_id"), "near")
    both = near_points(cell_pairs(open_), F.col("radius2")).select("image_id", F.explode(F.array("a", "b")).alias("comp_id"), F.lit(1).alias("near"))
    near = own.union(both).groupBy("image_id", "comp_id").agg(F.sum("near").alias("near"))
    more = near.filter(F.col("near") + 1 >= least).select("image_id", F.lit(1).alias("clustered"))
    return images.select("image_id", "clustered").union(more).groupBy("image_id").agg(F.max("clustered").alias("clustered"))


def strips(boxes: DataFrame, width: int, height: int, margin: float = 0.22, pad: int = 4, most_area: float = 0.052, most_side: float = 0.36) -> DataFrame:
    """Boxes with an outcome (skipped_area, skipped_side, skipped_no_margin, painted) and their rectangles in
    the four margin strips. The strips are a literal, exploded beside each box."""
    m = max(4, round(min(width, height) * margin))
    frame = [(0, 0, width, min(m, height)), (0, max(0, height - m), width, height), (0, 0, min(m, width), height), (max(0, width - m), 0, width, height)]
    c = F.col
    x2, y2 = c("x") + c("w"), c("y") + c("h")

    def cut(s: tuple) -> Column:
        a, b, e, f = F.greatest(c("x"), F.lit(s[0])), F.greatest(c("y"), F.lit(s[1])), F.least(x2, F.lit(s[2])), F.least(y2, F.lit(s[3]))
        rect = F.struct(F.greatest(F.lit(0), a - pad).alias("x1"), F.greatest(F.lit(0), b - pad).alias("y1"), F.least(F.lit(width), e + pad).alias("x2"), F.least(F.lit(height), f + pad).alias("y2"))
        return F.when((e > a + 1) & (f > b + 1), rect)

    outcome = F.when(c("w") * c("h") > most_area * width * height, "skipped_area").when((c("w") > most_side * width) | (c("h") > most_side * height), "skipped_side").when(F.size("rects") == 0, "skipped_no_margin").otherwise("painted")
    return boxes.withColumn("rects", F.array_compact(F.array(*[cut(s) for s in frame]))).withColumn("outcome", outcome)


def counts(rows: DataFrame, side: int = 480) -> DataFrame:
    """One row per image: the counts by area, side and aspect that the scores read."""
    c = F.col
    short, long = F.least("w", "h"), F.greatest("w", "h")
    aspect = short / long
    round_ = c("area").between(20, 800) & (short >= 3) & (aspect >= 0.6)
    return rows.groupBy("image_id").agg(
        F.count("*").alias("n"),
        F.max("area").alias("largest"),
        F.count_if(c("area").between(5, 220)).alias("bright_spots"),
        F.count_if(round_).alias("round"),
        F.coalesce(F.sum(F.when(round_, c("area"))), F.lit(0)).alias("round_area"),
        F.count_if(c("area").between(13, 255) & (aspect < 0.26)).alias("elong_bright"),
        F.count_if(c("area").between(18, 380) & (aspect < 0.26)).alias("elong_dark"),
        F.count_if(c("area") <= 140).alias("tiny"),
        F.count_if(c("area").between(8, 800)).alias("markers"),
        F.count_if(c("area").between(3, 90) & (long <= 14)).alias("dots"),
        F.count_if(c("area").between(8, max(8000, int(side * side * 0.06))) & (short >= 3)).alias("background"),
    )


def label_scores(rows: DataFrame, side: int = 480, corner: float = 0.28, least: int = 12, most: float = 0.30, certain: int = 3) -> DataFrame:
    """image_id, suspicious, score: components in the margin, or bright ones elsewhere, other than the largest."""
    c = F.col
    band = side * corner
    w = Window.partitionBy("image_id")
    marked = centers(rows).withColumns({"biggest": F.max("area").over(w), "first": F.min(F.struct(-F.col("area"), F.col("comp_id"))).over(w)})
    rest = c("comp_id") != c("first.comp_id")
    margin = (c("cx") < band) | (c("cx") >= side - band) | (c("cy") < band) | (c("cy") >= side - band)
    hit = rest & (c("area") <= c("biggest") * most) & ((margin & (c("area") >= least)) | (~margin & (c("area") >= 3 * least)))
    return marked.groupBy("image_id").agg(F.count_if(hit).alias("suspicious")).withColumn("score", F.least(F.lit(1.0), F.col("suspicious") / certain))


def verdict(score: Column, clean: float = 0.20, labelled: float = 0.65) -> tuple[Column, Column]:
    """(verdict, confidence) of a label score."""
    inner = 1 - F.least(score - clean, labelled - score) / ((labelled - clean) / 2)
    name = F.when(score <= clean, "certain_clean").when(score >= labelled, "certain_labeled").otherwise("uncertain")
    conf = F.when(score <= clean, clip01(1 - score / clean)).when(score >= labelled, clip01((score - labelled) / (1 - labelled))).otherwise(clip01(inner))
    return name, conf


def chaos(area: Column, mirror: Column, hu: Column, edges: Column, clip_risk: Column) -> Column:
    """Fragmentation of the mask fused with mirror, shape, edge and model risk."""
    c = F.col
    frag = F.least(F.lit(1.0), (c("elong_bright") * 2.2 + c("elong_dark") * 1.5 + c("tiny") * 0.3) / F.greatest(F.lit(1.0), F.sqrt(area)))
    fuse = frag * 0.35 + F.greatest(F.lit(0.0), 0.5 - mirror) * 2 * 0.20 + F.least(F.lit(1.0), hu / 8) * 0.15 + F.least(F.lit(1.0), edges * 3) * 0.10 + clip_risk * 0.20
    boost = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 0.55 - mirror) * 3 - 0.4) * 0.15
    return clip01(fuse + boost)


def text_boxes(rows: DataFrame, least: int = 12, most: float = 0.003, grow: int = 6, side: int = 480) -> DataFrame:
    """Small components of an image that may be text, each box grown and clipped."""
    c = F.col
    marked = rows.withColumn("biggest", F.max("area").over(Window.partitionBy("image_id")))
    aspect = F.greatest("w", "h") / F.greatest(F.lit(1), F.least("w", "h"))
    good = marked.filter((c("area") >= least) & (c("area") <= c("biggest") * most) & ~((c("area") > 200) & (aspect < 2)))
    return good.select("image_id", "comp_id", F.greatest(F.lit(0), c("x") - grow).alias("x1"), F.greatest(F.lit(0), c("y") - grow).alias("y1"), F.least(F.lit(side), c("x") + c("w") + grow).alias("x2"), F.least(F.lit(side), c("y") + c("h") + grow).alias("y2"))


def share_with_boxes(rows: DataFrame, **how) -> DataFrame:
    """One row: images, those with any text box, and their share."""
    boxed = text_boxes(rows, **how).select("image_id").distinct().agg(F.count("*").alias("with_boxes"))
    counts = rows.select("image_id").distinct().agg(F.count("*").alias("images")).crossJoin(F.broadcast(boxed))
    return counts.withColumn("share", F.coalesce(F.round(F.try_divide(F.col("with_boxes"), F.col("images")), 6), F.lit(0.0)))


def label_action(verdict: Column, readable: Column) -> Column:
    """What is done with an image: unreadable ones first, certain ones as they are judged, others stripped."""
    return F.when(~readable, "unreadable").when(verdict == "certain_clean", "certain_clean").when(verdict == "certain_labeled", "certain_labeled_strip").otherwise("fallback_strip_uncertain")


def boxes_from_json(reply: Column) -> Column:
    """Array of (x1, y1, x2, y2) from the JSON array in a reply, under any of the key names."""
    names = ("x1", "y1", "x2", "y2", "left", "top", "right", "bottom")
    kind = "array<struct<" + ",".join(f"{n}:double" for n in names) + ">>"
    body = F.regexp_extract(reply, r"\[[\s\S]*\]", 0)
    pick = lambda b, a, z: F.coalesce(b[a], b[z], F.lit(0.0))
    return F.transform(F.coalesce(F.from_json(body, kind), F.array().cast(kind)), lambda b: F.struct(pick(b, "x1", "left").alias("x1"), pick(b, "y1", "top").alias("y1"), pick(b, "x2", "right").alias("x2"), pick(b, "y2", "bottom").alias("y2")))


def scaled_boxes(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Box coordinates as pixels: shares up to 1, per cents up to 100, pixels above; ends swapped if they run
    backwards; empty boxes dropped."""
    c = F.col
    most = F.greatest(*[F.abs(c(k)) for k in ("x1", "y1", "x2", "y2")])
    def scale(k: str, full: int, end: bool) -> Column:
        share = F.greatest(F.lit(0), F.rint(c(k) * full).cast("int"))
        pixel = F.greatest(F.lit(0), F.least(F.lit(full if end else full - 1), c(k).cast("int")))
        percent = (c(k) / 100 * full).cast("int")
        percent = F.least(F.lit(full), percent) if end else F.greatest(F.lit(0), percent)
        return F.when(most <= 1.000001, share).when(most > 100, pixel).otherwise(percent)
    s = rows.withColumns({"__a": scale("x1", width, False), "__b": scale("y1", height, False), "__c": scale("x2", width, True), "__d": scale("y2", height, True)})
    s = s.withColumns({"x1": F.least("__a", "__c"), "y1": F.least("__b", "__d"), "x2": F.greatest("__a", "__c"), "y2": F.greatest("__b", "__d")}).drop("__a", "__b", "__c", "__d")
    return s.filter((c("x2") > c("x1")) & (c("y2") > c("y1")))
