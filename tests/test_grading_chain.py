"""The chain of grades: what its arrays hold, and how they are computed."""

import re

import pytest
from pyspark.sql import functions as F

from quartzite.functions.bands import rounded
from quartzite.operators import grading as op
from quartzite.operators import runs
from quartzite.plans import comparison
from quartzite.plans import grading as plans
from quartzite.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def test_no_rule_is_interpreted(spark):
    """Functions with a lambda have no generated code, and what stands in one is evaluated node by node for every row."""
    plan = plans.reviewed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"lambdafunction|namedlambdavariable", plan)


def test_present_keeps_the_order_and_drops_nulls(spark):
    rows = spark.createDataFrame([(1, True, None), (2, False, True), (3, None, False)], "i int, a boolean, b boolean")
    got = rows.select("i", op.present(F.when(F.col("a"), "A"), F.when(F.col("i") > 1, "I"), F.when(F.col("b"), "B")).alias("x"))
    assert [r.x for r in got.orderBy("i").collect()] == [["A"], ["I", "B"], ["I"]]
    assert not got.schema["x"].dataType.containsNull


@pytest.mark.parametrize(("soft", "loss"), [([], 0.0), (["GRID_SEAM"], 0.05), (["GRID_SEAM", None, "GRID_SEAM", "OTHER"], 0.05), (["SKIN_LINE_MISSING", "GRID_SEAM"], 0.12)])
def test_losses_of_soft_reasons(spark, soft, loss):
    schema = "total_score double, modality_p double, radiomics_score double, mask_iou double, soft_reasons array<string>, funnel_veto array<string>, ok boolean"
    got = op.tiered(spark.createDataFrame([(80.0, 1.0, 1.0, None, soft, [], True)], schema)).first()
    assert got.semantic_score == pytest.approx(1 - loss)


def test_summaries_write_no_items(spark, monkeypatch):
    """A table of verdicts that is written for sums of runs has no row names and nothing of tiers."""
    written = {}

    def keep(df, tag):
        written[tag] = df.columns
        return stored(df, tag)

    for module in (comparison, plans):
        monkeypatch.setattr(module, "stored", keep)
    comparison.summaries(spark, SF)
    assert not {"item", "tier", "semantic_score", "final_rank_score"} & set(written["review"])


def test_ok_makes_no_array_of_tags(spark):
    """Whether a hard tag is there comes from the rules; what needs no tags neither builds nor searches their array."""
    rows = plans.reviewed(spark, SF)
    plan = rows.select("item", "ok")._jdf.queryExecution().executedPlan().toString()
    assert "PSD_OFF" not in plan and "arrays_overlap" not in plan
    plain = F.arrays_overlap("tags", F.array(*map(F.lit, op.HARD_TAGS)))
    assert {(r.hard, r.n > 0) for r in rows.groupBy((plain == F.col("hard_tag")).alias("hard")).agg(F.count("*").alias("n")).collect()} == {(True, True)}
    assert rows.filter("hard_tag").count() and rows.filter("not hard_tag").count()


@pytest.mark.parametrize(("x", "want"), [(0.72700000000000009, 0.727), (-0.12345678901235, -0.1234567890124), (12345.678, 12345.678), (2e6, 2e6)])
def test_rounding_to_thirteen_places(spark, x, want):
    assert spark.range(1).select(rounded(F.lit(x) + F.col("id"), 13).alias("y")).first().y == want


def test_verdicts_and_summaries_make_no_arrays_and_no_names(spark):
    """Whether an item fails comes from conditions alone; arrays of reasons are made only where they are read."""
    rows = plans.reviewed(spark, SF)
    for each in (runs.batch_summary(rows), rows.select("run_name", "item", "ok", "tier", "final_rank_score", "total_score")):
        plan = each._jdf.queryExecution().executedPlan().toString()
        assert "array" not in plan and not [name for name in (*op.HARD_TAGS, *op.PENALTIES) if name in plan]


def test_flags_say_what_the_arrays_say(spark):
    rows = plans.reviewed(spark, SF, require_pectoral=1.0, veto_group=0.6)
    hard = F.arrays_overlap("tags", F.array(*map(F.lit, op.HARD_TAGS)))
    pairs = {"has_veto": F.size("group_veto") > 0, "in_funnel": F.size("funnel_veto") > 0, "hard_tag": hard, "soft_loss": op.penalty(lambda k: F.array_contains("soft_reasons", k))}
    kinds = rows.select(*[F.struct(F.col(k), v).alias(k) for k, v in pairs.items()]).agg(*[F.collect_set(k).alias(k) for k in pairs]).first()
    assert all(len(kinds[k]) > 1 and all(a == b for a, b in kinds[k]) for k in pairs)


def test_flags_of_nulls(spark):
    """What is not known neither fails an item nor costs it anything."""
    schema = "modality_p double, center_overexposed boolean, skin_line_present boolean, closed_ring boolean, mask_area_out boolean, seam boolean"
    got = op.funnel(spark.createDataFrame([(None,) * 6, (None, True, False, None, True, None)], schema)).collect()
    assert [(r.in_funnel, r.soft_loss, r.funnel_veto, r.soft_reasons) for r in got] == [(False, 0.0, [], []), (True, pytest.approx(0.15), ["CENTER_OVEREXPOSED"], ["MASK_AREA_OUT_OF_DIST", "SKIN_LINE_MISSING"])]


@pytest.mark.parametrize(("edge", "grades", "want"), [(0.0, 0.9, 0.5), (0.0, 0.3, 0.3), (1.0, 0.9, 0.9), (None, 0.9, 0.9), (0.0, None, 0.5), (1.0, None, None)])
def test_few_edges_hold_group_c_down(spark, edge, grades, want):
    rows = plans.items(spark, SF).limit(1).withColumn("edge_density", F.lit(edge).cast("double"))
    rows = op.graded(rows, op.calibrated(None, spark)).withColumns({g: F.lit(grades).cast("double") for g in ("C1", "C2", "C3")})
    assert op.totalled(rows).first().group_C == want
