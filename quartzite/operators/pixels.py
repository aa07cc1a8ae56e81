"""Statistics over pixel tables (image_id, y, x, v). They fit small tiles and histograms; whole images stay
binary and go through quartzite.operators.images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import clip01


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, v, n: at most 256 rows an image, and all that the statistics below need."""
    return pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def weighted_percentile(hist: DataFrame, points: dict) -> DataFrame:
    """Exact percentiles, linear between neighbours, from counts."""
    return hist.groupBy("image_id").agg(*[F.percentile(F.col("v"), q, F.col("n")).alias(k) for k, q in points.items()])


def histogram_stats(pixels: DataFrame, bright: float = 0.9, dark: float = 0.1) -> DataFrame:
    h = histogram(pixels)
    n, v = F.col("n"), F.col("v")
    mean = F.sum(v * n) / F.sum(n)
    var = F.sum(v * v * n) / F.sum(n) - mean * mean
    return h.groupBy("image_id").agg(
        F.round(mean / 255, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), var)) / 255, 6).alias("std"),
        F.round((F.percentile(v, 0.99, n) - F.percentile(v, 0.01, n)) / 255, 6).alias("dynamic_range"),
        F.round(F.sum(F.when(v / 255 > bright, n).otherwise(0)) / F.sum(n), 6).alias("bright"),
        F.round(F.sum(F.when(v / 255 < dark, n).otherwise(0)) / F.sum(n), 6).alias("dark"),
    )


def running_variance(value: Column, order: str) -> Column:
    """Population variance of a group's values, updated value by value in the given order (Welford). Unlike var_pop, whose last bits
    depend on how partial sums meet, it is the same double however rows are dealt, so that comparisons at a tie come out as in SQL."""
    values = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("at"), value.cast("double").alias("v")))))

    def update(s: Column, p: Column) -> Column:
        n, gap = s["n"] + 1, p["v"] - s["mean"]
        mean = s["mean"] + gap / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + gap * (p["v"] - mean)).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, start, update, lambda s: F.try_divide(s["m2"], s["n"]))


def banding(pixels: DataFrame, least: int = 5, least_lines: int = 10, floor: float = 20.0) -> DataFrame:
    """Share of rows and columns whose spread is far from the median one, as a score; 1 if too few."""
    def lines(axis: str, along: str) -> DataFrame:
        one = pixels.groupBy("image_id", axis).agg(F.count("*").alias("n"), running_variance(F.col("v"), along).alias("var")).filter(F.col("n") >= least)
        # an image has few rows, so its variances fit one array
        all_ = one.groupBy("image_id").agg(F.collect_list("var").alias("vars"), F.median("var").alias("med"))
        odd = F.size(F.filter("vars", lambda x: (x < 0.15 * F.col("med")) | (x > 6 * F.col("med"))))
        return all_.select("image_id", F.size("vars").alias(f"n_{axis}"), odd.alias(f"odd_{axis}"))
    both = lines("y", "x").join(lines("x", "y"), "image_id")
    odd, n = F.col("odd_y") + F.col("odd_x"), F.col("n_y") + F.col("n_x")
    score = F.greatest(F.lit(0.0), 1 - odd / F.greatest(F.lit(floor), 0.05 * n))
    few = (F.col("n_y") < least_lines) | (F.col("n_x") < least_lines)
    return pixels.select("image_id").distinct().join(both, "image_id", "left").select("image_id", F.coalesce(F.when(few, 1.0).otherwise(score), F.lit(1.0)).alias("banding"))


def otsu(pixels: DataFrame) -> DataFrame:
    """The value that parts each image's histogram with the largest variance between both sides."""
    h = histogram(pixels)
    upto, whole = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    n, v = F.col("n"), F.col("v")
    r = h.withColumns({"w0": F.sum(n).over(upto), "s0": F.sum(n * v).over(upto), "w": F.sum(n).over(whole), "s": F.sum(n * v).over(whole)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, 6)
    r = r.filter("w0 < w").withColumn("between", between)
    return r.groupBy("image_id").agg(F.min_by("v", F.struct(-F.col("between"), F.col("v"))).alias("threshold"))


def mirror_similarity(pixels: DataFrame, width: int) -> DataFrame:
    """Mean product of z-scores of the left half and the flipped right half."""
    half = width // 2
    z = (F.col("v") - F.avg("v").over(Window.partitionBy("image_id", "side"))) / (F.stddev_pop("v").over(Window.partitionBy("image_id", "side")) + 1e-6)
    sides = pixels.filter((F.col("x") < half) | (F.col("x") >= width - half)).withColumn("side", F.col("x") < half).withColumn("z", z)
    at = F.when(F.col("side"), F.col("x")).otherwise(width - 1 - F.col("x"))
    pairs = sides.groupBy("image_id", "y", at.alias("at")).agg((F.max(F.when(F.col("side"), F.col("z"))) * F.max(F.when(~F.col("side"), F.col("z")))).alias("p"))
    return pairs.groupBy("image_id").agg(F.avg("p").alias("mirror"))


def winsorized(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Values clipped to the image's percentiles and stretched to 0..255."""
    ends = weighted_percentile(histogram(pixels), {"lo": low, "hi": high})
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    new = F.when(hi <= lo, v).otherwise(F.floor(F.round((F.greatest(lo, F.least(hi, v)) - lo) / (hi - lo) * 255, 6)).cast("int"))
    return pixels.join(ends, "image_id").select("image_id", "y", "x", new.alias("v"))


def matched(pixels: DataFrame, reference: DataFrame, blend: float) -> DataFrame:
    """Values moved to the reference's distribution by equal rank, linear between its values, blended.
    Both distributions are histograms of at most 256 values; the reference's is one row."""
    def cdf(h: DataFrame, keys: list) -> DataFrame:
        w = Window.partitionBy(*keys)
        return h.select(*keys, "v", (F.sum("n").over(w.orderBy("v")) / F.sum("n").over(w)).alias("q"))
    ref = cdf(reference.groupBy("v").agg(F.count("*").alias("n")).withColumn("all", F.lit(1)), ["all"])
    curve = ref.agg(F.array_sort(F.collect_list(F.struct("q", "v"))).alias("curve"))
    own = cdf(histogram(pixels), ["image_id"]).crossJoin(F.broadcast(curve))
    own = own.withColumn("under", F.size(F.filter("curve", lambda p: p["q"] < F.col("q") - 1e-12)))
    own = own.select("image_id", "v", "q", F.get("curve", F.col("under")).alias("hi"), F.get("curve", F.col("under") - 1).alias("lo"))
    hi, lo = F.col("hi"), F.col("lo")
    value = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (F.col("q") - lo["q"]) / (hi["q"] - lo["q"]))
    table = own.select("image_id", "v", ((1 - blend) * F.col("v") + blend * value).alias("new"))
    return pixels.join(table, ["image_id", "v"]).select("image_id", "y", "x", F.round("new", 6).alias("v"))


def center_overexposed(pixels: DataFrame, width: int, height: int, bright: int = 240, share: float = 0.30) -> DataFrame:
    c = F.col
    center = pixels.filter(c("x").between(width // 4, width - width // 4 - 1) & c("y").between(height // 4, height - height // 4 - 1))
    part = center.groupBy("image_id").agg(F.avg(F.when(c("v") >= bright, 1.0).otherwise(0.0)).alias("share"))
    return part.withColumn("overexposed", c("share") > share)


def orientation(pixels: DataFrame, width: int, percentile: float = 0.85, least: int = 50) -> DataFrame:
    """Angle, elongation and central share of the brightest pixels, and a score that falls for bars upright
    in the middle. The 2 x 2 covariance has closed-form eigenvalues."""
    cut = weighted_percentile(histogram(pixels), {"cut": percentile})
    c = F.col
    mid, strip = width // 2, max(1, width // 6)
    inside = c("x").between(max(0, mid - strip), mid + strip - 1)
    m = pixels.join(cut, "image_id").filter("v >= cut").groupBy("image_id").agg(F.count("*").alias("n"), F.var_samp("x").alias("a"), F.var_samp("y").alias("d"), F.covar_samp("x", "y").alias("b"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("central"))
    root = F.sqrt(F.pow((c("a") - c("d")) / 2, F.lit(2.0)) + c("b") * c("b"))
    m = m.withColumns({"big": F.greatest(F.lit(1e-6), (c("a") + c("d")) / 2 + root), "small": F.greatest(F.lit(1e-6), (c("a") + c("d")) / 2 - root)})
    # the main axis (b, big - a) against the vertical, as the angle from the row axis
    angle = F.when((F.abs("b") < 1e-12) & (c("a") >= c("d")), 90.0).when(F.abs("b") < 1e-12, 0.0).otherwise(F.degrees(F.atan2(F.abs("b"), F.abs(c("big") - c("a")))))
    m = m.withColumns({"angle": angle, "elongation": F.sqrt(c("big") / c("small"))})
    danger = F.greatest(F.lit(0.0), (c("angle") - 60) / 30) * 0.4 + F.greatest(F.lit(0.0), (c("elongation") - 2) / 4) * 0.4 + F.greatest(F.lit(0.0), (c("central") - 0.3) / 0.4) * 0.2
    return m.select("image_id", F.round("elongation", 6).alias("elongation"), F.round("central", 6).alias("central"), F.round(F.when(c("n") < least, 1.0).otherwise(clip01(1 - danger)), 6).alias("score"))


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: (pair, y, x) of set pixels. Shared over joint pixels, which nothing can make zero."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["pair", "y", "x"], "full_outer")
    shared = F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0))
    return both.groupBy("pair").agg((shared / (F.count("*") + 1e-6)).alias("iou"))


def mask_status(rows: DataFrame, low: float = 0.03, high: float = 0.80) -> DataFrame:
    """status: pre_existing, read_failed (ratio 0), mask_ratio_out_of_range or ok. Needs mask_ratio, exists."""
    r = F.col("mask_ratio")
    return rows.withColumn("status", F.when(F.col("exists"), "pre_existing").when(r == 0, "read_failed").when((r < low) | (r > high), "mask_ratio_out_of_range").otherwise("ok"))
