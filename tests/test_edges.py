"""Operators on small rows made for their edges, and the image kernels against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.functions import arrays, bands
from quartzite.functions.percentiles import exact_percentiles
from quartzite.operators import captions, catalog, components, grading, images, params, pixels, populations, runs, validation
from quartzite.sources import readers

BURDEN = "marker_score double, bg_count int, bg_frac double, dots int, lap_p75 double, grad_p75 double, mass_count int, cluster_count int, calc_dots int"


@pytest.mark.parametrize(
    ("row", "burdened"),
    [
        ((0.0, 0, 0.0, 0, None, None, 0, 0, 0), False),
        ((8.0, 0, 0.0, 0, None, None, 0, 0, 0), True),
        ((0.0, 20, 0.0, 0, None, None, 0, 0, 0), True),
        ((0.0, 0, 0.018, 0, None, None, 0, 0, 0), True),
        ((0.0, 0, 0.0, 10, None, None, 0, 0, 0), True),
        ((0.0, 0, 0.0, 0, 13.9, 20.0, 0, 0, 0), True),
        ((0.0, 0, 0.0, 0, 13.0, None, 0, 0, 0), False),
        ((0.0, 0, 0.0, 0, 20.0, 20.0, 1, 0, 0), True),
        ((7.9, 19, 0.017, 9, 14.0, 14.0, 0, 0, 5), False),
        ((0.0, 0, 0.0, 0, None, None, 0, 1, 0), True),
        ((0.0, 0, 0.0, 0, None, None, 0, 0, 6), True),
    ],
)
def test_artifact_burden(spark, row, burdened):
    assert spark.createDataFrame([row], BURDEN).select(bands.artifact_burden()).first()[0] is burdened


def test_double_band(spark):
    x = [0.0, 0.25, 0.3, 0.35, 0.95, 0.975, 1.0, 1.2]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(bands.double_band(F.col("x"), *[F.lit(v) for v in (0.25, 0.35, 0.95, 1.0)])).collect()]
    assert got == pytest.approx([0, 0.3, 0.65, 1, 1, 0.65, 0.3, 0], abs=1e-9)


def test_quality_rules_on_failed_reads_and_empty_masks(spark):
    schema = "height int, width int, mask_ratio double, mask_pixels int, bright_ratio double, dark_ratio double, skin_line boolean, marker_score int"
    rows = [(None, None, None, None, None, None, None, None), (2000, 1000, 0.5, 9000, 0.0, 0.0, True, 0), (2000, 1000, 0.5, 10, 0.9, 0.9, True, 41), (100, 100, 0.95, 9000, 0.06, 0.0, False, 0)]
    got = [r["reasons"] for r in catalog.quality_checked(spark.createDataFrame(rows, schema)).collect()]
    assert got == [["read_failed"], [], ["empty_breast_mask", "marker_or_ruler_heavy"], ["too_small_or_cropped", "mask_ratio_out_of_range", "overexposed", "skin_line_missing"]]


def test_last_case_row_wins_and_missing_column_is_named(spark):
    rows = [("P_1", "left", "cc", "1", 0, 5), ("P_1", "LEFT ", "CC", "4", 1, 1), ("P_1", "LEFT", "CC", "9", 2, 1), ("P_2", "", "CC", "1", 0, 0)]
    got = catalog.density_lookup(spark.createDataFrame(rows, "patient_id string, side string, view_raw string, density_code string, file_ord int, row_ord int")).collect()
    assert [tuple(r) for r in got] == [("P_1", "LEFT", "CC", "dense")]
    from pyspark.sql.types import StructType

    with pytest.raises(ValueError, match="density"):
        readers.clean_metadata(spark, "nowhere", StructType().add("view", "string"), ("view", "density"))


def test_histogram_distances_at_their_ends(spark):
    one = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 1.0, 2.0], [1.0, 1.0, 2.0])], "u array<double>, v array<double>")
    got = [tuple(r) for r in one.select(arrays.wasserstein_bins(F.col("u"), F.col("v")), arrays.emd_profile(F.col("u"), F.col("v")), arrays.entropy(F.col("u"))).collect()]
    assert got[0] == pytest.approx((1.0, 2 / 3, 0.0), abs=1e-9)
    assert got[1][0] == 1.0 and got[1][2] == 0.0
    assert got[2][:2] == pytest.approx((0, 0), abs=1e-9) and got[2][2] == pytest.approx(1.5 * np.log(2))


def test_one_row_strata_and_targets(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "k0 int, s string")
    counts = {r["s"]: r["count"] for r in captions.oversampled(rows, ["s"], "k0").groupBy("s").count().collect()}
    assert counts == {"a": 3, "b": 3}
    got = captions.to_target(rows, ["s"], "k0", 2).orderBy("s", "slot").collect()
    assert [(r["k0"], r["slot"]) for r in got] == [(1, 0), (1, 1), (2, 0), (3, 1)]


def test_grades_without_baseline(spark):
    t = grading.calibrated(None, spark).first()["t"]
    assert t["min_mask"] == 0.001 and t["soft_mask_hi"] == 0.75 and t["max_perim"] == 1.35


def test_tier_fallbacks(spark):
    schema = "total_score double, modality_p double, radiomics_score double, mask_iou double, soft_reasons array<string>, funnel_veto array<string>, ok boolean"
    rows = [(100.0, None, None, None, [], [], True), (60.0, 0.9, 0.8, None, ["GRID_SEAM", "GRID_SEAM"], [], True), (60.0, 0.1, 0.1, 0.0, [], ["MODALITY_LOW"], True)]
    got = grading.tiered(spark.createDataFrame(rows, schema)).collect()
    assert [(r["tier"], r["ok"]) for r in got] == [(1, True), (1, True), (3, False)]
    assert got[0]["semantic_score"] == 1.0 and got[1]["semantic_score"] == pytest.approx(0.58 * 0.9 + 0.42 * 0.8 - 0.05)


def test_validation_of_few_rows(spark):
    empty = spark.createDataFrame([], "image string, ok boolean, tier int, final_rank_score double")
    m = validation.metrics(empty).first()
    assert m["n_good"] == 0 and m["veto_recall"] == 0.0 and validation.top_purity(empty).first()["pure"] is False


def test_history_keeps_the_last_five(spark):
    rows = spark.createDataFrame([(i, "l", f"run_{i}") for i in range(7)], "t int, line string, tag string")
    got = params.latest(rows, ["line"], "t", "tag", 5).orderBy("index").collect()
    assert [r["index"] for r in got] == [1, 2, 3, 4, 5] and got[-1]["tag"] == "run_6"


def test_moments_and_distances_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(80, 5))
    y = x[:50] * 2 + 1
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "item int, x array<double>")
    a, b = populations.moments(frame(x), "x"), populations.moments(frame(y), "x")
    assert np.allclose(a[2], np.cov(x, rowvar=False)) and np.allclose(b[1], y.mean(0))
    assert populations.frechet(a, a) == pytest.approx(0, abs=1e-6) and populations.frechet(a, b) > 1
    assert populations.frechet((1, a[1], a[2]), b) is None
    got = populations.mahalanobis(frame(x), frame(x), "x", keep=5).orderBy("item").collect()
    delta = x - x.mean(0)
    want = np.einsum("ni,ij,nj->n", delta, np.linalg.inv(np.cov(x, rowvar=False) + 1e-3 * np.eye(5)), delta)
    assert np.allclose([r["d2"] for r in got], want)
    assert populations.mahalanobis(frame(x), frame(x[:3]), "x").first()["radiomics_score"] == 0.5


def test_component_labels_equal_a_search():
    m = np.random.default_rng(3).random((40, 40)) < 0.4
    lab = images.label_components(m)
    seen = np.zeros(m.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(m)):
        if seen[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        seen[y, x] = n
        while stack:
            a, b = stack.pop()
            for i in range(max(0, a - 1), min(40, a + 2)):
                for j in range(max(0, b - 1), min(40, b + 2)):
                    if m[i, j] and not seen[i, j]:
                        seen[i, j] = n
                        stack.append((i, j))
    assert lab.max() == n and len({(a, b) for a, b in zip(lab[m], seen[m])}) == n and (lab[~m] == 0).all()


def test_tissue_mask_of_blocks():
    """One bright block on a dark ground is the mask but for its corners; specks and small blocks are not."""
    a = np.full((128, 96), 20, np.uint8)
    a[20:110, 18:78] = 160
    m = images.tissue_mask(a)
    assert 0.95 * 90 * 60 < m.sum() <= 90 * 60 and m[60, 40] and not m[5, 5]
    a = np.zeros((64, 64), np.uint8)
    a[4:8, 4:8] = 200
    a[20:50, 20:50] = 200
    a[2, 60] = 255
    m = images.tissue_mask(a)
    assert 30 * 30 * 0.95 < m.sum() <= 30 * 30 and not m[:10].any()
    bright = np.full((64, 64), 200, np.uint8)
    bright[20:32, 20:32] = 10
    assert 0.85 * 144 < images.tissue_mask(bright).sum() <= 160  # over 80 % is bright, so the dark part counts
    assert not images.tissue_mask(np.full((32, 32), 7, np.uint8))[0, 0]


def test_spread_equals_a_disc_at_every_pixel():
    m = np.random.default_rng(2).random((30, 41)) < 0.02
    disc = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if abs(dx) <= round(3 * (1 - dy * dy / 9) ** 0.5)]
    want = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        for dy, dx in disc:
            if 0 <= y + dy < 30 and 0 <= x + dx < 41:
                want[y + dy, x + dx] = True
    assert (images.spread(m) == want).all() and (images.shrink(~m) == ~want).all()


def test_shrinking_keeps_the_mean():
    a = np.random.default_rng(5).integers(0, 256, (300, 211)).astype(np.uint8)
    small = images.shrunk(a, 100)
    assert small.shape == (100, 70) and abs(small.mean() - a.mean()) < 0.6 and images.shrunk(a, 300) is not None
    assert (images.shrunk(a[:200, :200], 100) == np.rint(a[:200, :200].reshape(100, 2, 100, 2).mean((1, 3)))).mean() > 0.99


def test_power_slope_of_a_known_spectrum():
    """Noise shaped to fall as r^-3 has slope 3; by polyfit over the same frequencies it is the same number."""
    r = np.random.default_rng(3)
    n = 128
    y, x = np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n), indexing="ij")
    radius = np.hypot(y, x)
    radius[0, 0] = 1
    a = np.fft.ifft2(np.fft.fft2(r.normal(size=(n, n))) * radius**-1.5).real
    a = np.rint(255 * (a - a.min()) / np.ptp(a)).astype(np.uint8)
    m = np.ones(a.shape, bool)
    got = images.slope_of(a, m)
    assert 2.6 < got < 3.4
    z = (a - a.mean()) / (a.std() + 1e-6)
    p = np.abs(np.fft.fftshift(np.fft.fft2(z))) ** 2
    d = np.array([[np.hypot(i - n / 2, j - n / 2) for j in range(n)] for i in range(n)])
    sel = (d >= max(2, 0.02 * n)) & (d <= 0.45 * n)
    assert got == pytest.approx(-np.polyfit(np.log(d[sel] + 1e-6), np.log(p[sel] + 1e-6), 1)[0])
    assert images.slope_of(a, m & False) == 0


def test_ring_means_by_edges():
    a = np.random.default_rng(7).random((40, 50))
    r, p = images.power(a)
    got, scaled = images.ring_means(r, p, 16), r / (r.max() + 1e-6)
    for k in range(16):
        ring = (scaled >= k / 16) & (scaled < (k + 1) / 16)
        assert got[k] == pytest.approx(p[ring].mean() if ring.any() else 0)


def test_gradient_shares_by_pixel():
    a = np.random.default_rng(8).integers(0, 256, (40, 30)).astype(np.uint8)
    m = np.zeros(a.shape, bool)
    m[5:35, 3:28] = True
    at = lambda y, x: a[abs(y) if y < 40 else 78 - y, abs(x) if x < 30 else 58 - x] / 255
    size = []
    for y, x in zip(*np.nonzero(m)):
        gx = sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
        size.append(np.hypot(gx, gy))
    want = np.histogram(np.clip(np.array(size) / np.percentile(size, 99.5), 0, 1), 64, (0, 1))[0] / len(size)
    assert images.gradient_shares(a, m) == pytest.approx(want, abs=2 / len(size))
    assert not images.gradient_shares(a, m & False).any()


def test_grid_and_seams():
    r = np.random.default_rng(1)
    noise = (r.random((128, 128)) * 60 + 100).astype(np.uint8)
    every = np.ones(noise.shape, bool)
    assert images.periodicity_of(noise, every) == 1.0 and images.periodicity_of(noise, every & False) == 1.0
    lines = np.tile((np.arange(128) % 20 < 3) * 150 + 60, (128, 1)).astype(np.uint8)
    assert images.periodicity_of(lines, every) == 0.0
    mixed = np.where(np.arange(128)[:, None] < 48, lines, noise)  # two of six sampled rows: no more than half
    assert images.periodicity_of(mixed.astype(np.uint8), every) == 1.0
    row = lines[40].astype(float) - lines[40].mean()
    auto = np.array([(row[: 128 - k] * row[k:]).sum() for k in range(128)]) / (row @ row)
    assert sum(auto[k] > 0.6 and auto[k] > auto[k - 1] and auto[k] > auto[k + 1] for k in range(17, 127)) >= 2
    assert images.seam_of(noise, 0)[0] is False
    grid = noise.astype(float)
    grid[::16] += 90
    grid[:, ::16] += 90
    seam, peaks = images.seam_of(np.clip(grid, 0, 255).astype(np.uint8), 16)
    assert seam is True and len(peaks) <= 12
    assert images.seam_of(np.clip(grid, 0, 255).astype(np.uint8), 8)[1] == peaks  # small patches are not looked up


def test_components_of_an_image_in_one_pass(spark):
    a = np.random.default_rng(9).integers(0, 256, (37, 29)).astype(np.uint8)
    got = images.components(spark.createDataFrame([(1, 37, 29, bytearray(a.tobytes()))], "image_id long, height int, width int, data binary")).toPandas()
    lab = images.label_components(a >= np.percentile(a, 85))
    assert len(got) == lab.max()
    for c in got.itertuples():
        y, x = np.nonzero(lab == c.comp_id)
        assert (c.area, c.x, c.y, c.w, c.h) == (len(x), x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1) and (c.cx, c.cy) == pytest.approx((x.mean(), y.mean()))


def test_scan_of_image_files(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY
    for name, value in (("a.png", 200), ("b_ffdm_compare.png", 9), ("img2img_c.jpg", 40)):
        image = jvm.java.awt.image.BufferedImage(24, 16, kind)
        for x in range(8):
            for y in range(16):
                image.getRaster().setSample(x, y, 0, value)
        jvm.javax.imageio.ImageIO.write(image, name.rsplit(".", 1)[1], jvm.java.io.File(f"{tmp_path}/{name}"))
    (tmp_path / "d.webp").write_bytes(b"no image")
    got = {r["name"]: r for r in images.scan(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.png", "img2img_c.jpg", "d.webp"} and got["d.webp"]["read_failed"]
    a = np.frombuffer(got["a.png"]["data"], np.uint8).reshape(16, 24)
    assert (a[:, :8] == 200).all() and (a[:, 8:] == 0).all()
    assert images.png(a)[:4] == b"\x89PNG"
    frame = images.scan(spark, f"file://{tmp_path}", prefix="a").selectExpr("1L as image_id", "height", "width", "data")
    stats = images.pixels_hist(frame, images.over(100)).first()
    assert stats["row_var"][0] == 0 and stats["col_var"][10] is None
    assert stats["mask_area"] == 128 and stats["hist"][200] == 128
    assert images.components(frame, 80).first()["area"] == 128


def test_pixel_statistics_of_flat_images(spark):
    flat = spark.createDataFrame([(1, y, x, 7) for y in range(8) for x in range(8)], "image_id int, y int, x int, v int")
    assert pixels.histogram_stats(flat).first()["std"] == 0 and pixels.winsorized(flat, 0.02, 0.98).first()["v"] == 7
    assert pixels.otsu(flat).count() == 0 and pixels.banding(flat).first()["banding"] == 1.0


def test_boxes_in_three_units(spark):
    rows = spark.createDataFrame([(0.1, 0.2, 0.5, 0.6), (50.0, 60.0, 10.0, 20.0), (300.0, 10.0, 900.0, 20.0), (5.0, 5.0, 5.0, 9.0)], "x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r) for r in components.scaled_boxes(rows, 400, 200).collect()]
    assert got == [(40, 40, 200, 120), (40, 40, 200, 120), (300, 10, 400, 20)]


def test_missing_aspect_columns_filter_nothing(spark):
    assert readers.filter_aspect(spark.range(3)).count() == 3
    assert runs.seeded_sample(spark.range(100), "id", 5, 1).collect() == runs.seeded_sample(spark.range(100).repartition(7), "id", 5, 1).collect()


def test_exact_percentiles_equal_numpy(spark):
    r = np.random.default_rng(4)
    groups = {"one": np.array([3.0]), "two": np.array([1.0, 9.0]), "ten": np.arange(10.0), "ties": np.repeat([1.0, 2.0, 5.0], [50, 3, 40]), "many": r.normal(size=30_000), "whole": r.integers(0, 7, 5000).astype(float)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("one", None)], "g string, x double")
    points = {"p0": 0.0, "p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x["g"]: [x[p] for p in points] for x in exact_percentiles(rows, "g", "x", points).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.percentile(v, [100 * q for q in points.values()]).tolist(), abs=1e-12), k
    coarse = exact_percentiles(rows.filter("g = 'many'"), "g", "x", points, accuracy=100).first()
    assert coarse["p95"] == pytest.approx(np.percentile(groups["many"], 95), abs=1e-12)


def test_places_in_a_stratum_that_spans_ranges(spark):
    """One stratum holds most rows, one is null, and keys repeat."""
    rows = spark.createDataFrame([(i % 40, "hot" if i % 5 else None if i % 3 else "cold", i) for i in range(300)], "key int, s string, i int").repartition(7)
    got = captions.numbered(rows, ["s"], "key", F.col("key")).toPandas()
    assert len(got) == 300
    for _, g in got.groupby("s", dropna=False):
        assert sorted(g.k) == list(range(1, len(g) + 1)) and (g.n == len(g)).all() and g.sort_values("k").key.is_monotonic_increasing
    assert captions.numbered(rows.limit(0), ["s"], "key", F.col("key")).count() == 0


def test_components_in_crowds_and_alone(spark):
    r = np.random.default_rng(6)
    points = [(1, int(x), int(y)) for x, y in r.integers(0, 400, (60, 2))] + [(2, 5, 5)] * 500 + [(2, 300, 300), (3, 10, 10), (4, 0, 0), (4, 60, 0), (5, 0, 0), (5, 61, 0)]
    rows = spark.createDataFrame([(i, k, 10, x, y, 0, 0) for k, (i, x, y) in enumerate(points)], "image_id int, comp_id int, area int, x int, y int, w int, h int")

    def near(i, far):
        p = np.array([(x, y) for j, x, y in points if j == i], float)
        return (((p[:, None] - p[None]) ** 2).sum(2) <= far * far).sum(1)

    assert {x["image_id"]: x["isolated"] for x in components.isolated(rows).collect()} == {i: int((near(i, 60) == 1).sum()) for i in range(1, 6)}
    for side, radius in ((100, 28), (1000, 55)):
        assert {x["image_id"]: x["clustered"] for x in components.clusters(rows, F.lit(side)).collect()} == {i: int(near(i, radius).max() >= 4) for i in range(1, 6)}


def test_runs_that_contain_a_name(spark):
    names = spark.createDataFrame([("a",), ("ab",), ("zz",), ("abcd",), (None,)], "name string")
    runs_ = spark.createDataFrame([("xab",), ("abc",), ("b",), (None,)], "run string")
    assert {r["name"]: r["run"] for r in captions.last_containing(names, "name", runs_, "run").collect()} == {"a": "xab", "ab": "xab", "zz": None, "abcd": None, None: None}


def test_required_pectoral_and_stricter_groups(spark):
    t = grading.calibrated(None, spark, require_pectoral=1.0, veto_group=0.6)
    assert t.first()["t"]["require_pectoral"] == 1.0 and t.first()["t"]["veto_group"] == 0.6
    rows = spark.createDataFrame([(True,), (False,)], "pectoral_found boolean").crossJoin(t)
    score, tag = grading.grade_columns()["A3"]
    assert [tuple(r) for r in rows.select(score, tag).collect()] == [(1.0, None), (0.0, "NO_PECTORAL")]


def test_percentiles_by_either_way(spark):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(r.normal(size=3000), r.integers(0, 5, 3000))], "mask_ratio double, circularity double")
    a, b = (grading.scalar_stats(rows, ["mask_ratio", "circularity"], large=x).orderBy("metric").collect() for x in (False, True))
    assert a == b and a[1]["p95"] == pytest.approx(np.percentile([x["mask_ratio"] for x in rows.collect()], 95), abs=1e-8)


def test_text_parameters(spark):
    rows = spark.createDataFrame([("notes_zh", "x" * 3000), ("lora_path", "  a/b "), ("strength", "1"), ("notes_zh", None)], "key string, value string")
    assert [(r["key"], r["value"]) for r in params.texts(rows).collect()] == [("notes_zh", "x" * 2000), ("lora_path", "a/b")]


def test_scratch_tables_can_be_cleared(spark):
    from pathlib import Path

    from quartzite.sources import scratch

    scratch.clear(spark)
    rows = scratch.stored(spark.range(5).toDF("id"), "scratch")
    assert rows.count() == 5
    folder = Path(scratch._given[-1].removeprefix("file:"))
    assert folder.exists() and scratch.clear(spark) == 1 and not folder.exists() and scratch.clear(spark) == 0
