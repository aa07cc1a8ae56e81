"""Queries of profiles and populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import metricjoin
from ..operators import populations as op
from ..sources.adapters import load
from .registry import query

D = "profiles"
H = "h as (select item, stratum, is_real, i - 1 as pos, x, x / sum(x) over (partition by item) as p from (select item, stratum, is_real, abs(cast(unnest(embedding) as double)) as x, generate_subscripts(embedding, 1) as i from profiles))"
REF = "raw as (select pos, avg(p) as value from h where is_real group by pos), ref as (select pos, value / (select sum(value) + 1e-12::double from raw) as value from raw)"
GAPS = "gaps as (select item, pos, abs(sum(p - value) over (partition by item order by pos)) as gap from h join ref using (pos)), dist as (select item, sum(case when pos < 63 then gap end) / 63 as wasserstein, sum(gap) / 64 as emd from gaps group by item)"


def histograms(spark, sf_dir):
    """item, is_real, hist: sizes of the components, adding up to one."""
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return load(spark, sf_dir, D).select("item", "stratum", "is_real", arrays.normalized(sizes).alias("hist"))


def populations(spark, sf_dir):
    rows = load(spark, sf_dir, D).select("item", "is_real", F.col("embedding").cast("array<double>").alias("x"))
    return rows.filter("is_real").drop("is_real"), rows.filter("not is_real").drop("is_real")


@query("normalize_hist", f"with {H} select item, pos, round(p, 9) as p from h", D)
def normalize_hist(spark, sf_dir):
    return histograms(spark, sf_dir).select("item", F.posexplode("hist").alias("pos", "p")).select("item", F.col("pos").cast("long").alias("pos"), F.round("p", 9).alias("p"))


@query("baseline_profile_mean", f"with {H}, {REF} select pos, round(value, 9) as value from ref", D)
def baseline_profile_mean(spark, sf_dir):
    mean = op.profile_mean(histograms(spark, sf_dir).filter("is_real"), "hist")
    return mean.select(F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


def distances(spark, sf_dir):
    rows = histograms(spark, sf_dir)
    return op.with_distances(rows, "hist", op.mean_as_row(op.profile_mean(rows.filter("is_real"), "hist")))


@query("wasserstein_bins", f"with {H}, {REF}, {GAPS} select item, round(wasserstein, 9) as wasserstein from dist", D)
def wasserstein_bins(spark, sf_dir):
    return distances(spark, sf_dir).select("item", F.round("wasserstein", 9).alias("wasserstein"))


@query("emd_profile", f"with {H}, {REF}, {GAPS} select item, round(emd, 9) as emd from dist", D)
def emd_profile(spark, sf_dir):
    return distances(spark, sf_dir).select("item", F.round("emd", 9).alias("emd"))


@query("baseline_profile_distances", f"with {H}, {REF}, {GAPS}, d as (select * from dist where item % 2 = 0) select round(quantile_cont(wasserstein, 0.01), 8) as w_p1, round(quantile_cont(wasserstein, 0.99), 8) as w_p99, round(quantile_cont(emd, 0.05), 8) as e_p5, round(quantile_cont(emd, 0.95), 8) as e_p95, round(avg(emd), 8) as e_mean, round(stddev_pop(emd), 8) as e_std from d", D)
def baseline_profile_distances(spark, sf_dir):
    p = lambda c, q: F.round(F.percentile(c, q), 8)
    return distances(spark, sf_dir).filter("is_real").agg(p("wasserstein", 0.01).alias("w_p1"), p("wasserstein", 0.99).alias("w_p99"), p("emd", 0.05).alias("e_p5"), p("emd", 0.95).alias("e_p95"), F.round(F.avg("emd"), 8).alias("e_mean"), F.round(F.stddev_pop("emd"), 8).alias("e_std"))


@query("local_entropy_hist", f"with {H} select item, round(-sum(case when p > 0 then p * ln(p) else 0 end), 9) as entropy from h group by item", D)
def local_entropy_hist(spark, sf_dir):
    return histograms(spark, sf_dir).select("item", F.round(arrays.entropy(F.col("hist")), 9).alias("entropy"))


X = "x as (select item, is_real, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as pos from profiles)"


@query("profile_covariance", f"with {X} select a.pos as i, b.pos as j, round(covar_samp(a.v, b.v), 9) as cov from x a join x b using (item) where a.is_real group by 1, 2", D)
def profile_covariance(spark, sf_dir):
    """Sample covariance of the real vectors; d x d numbers, made where they were added up."""
    real, _ = populations(spark, sf_dir)
    _, _, cov = op.moments(real, "x")
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i long, j long, cov double").select("i", "j", F.round("cov", 9).alias("cov"))


@query("frechet_distance")
def frechet_distance(spark, sf_dir):
    real, made = populations(spark, sf_dir)
    a, b = op.moments(real, "x"), op.moments(made, "x")
    return spark.createDataFrame([(a[0], b[0], op.frechet(a, b))], "n_real long, n_made long, distance double")


@query("spatial_frechet")
def spatial_frechet(spark, sf_dir):
    """Each vector as eight places of eight numbers."""
    cut = lambda rows: rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("x", k * 8 + 1, F.lit(8)))).alias("x"))
    real, made = populations(spark, sf_dir)
    a, b = op.moments(cut(real), "x"), op.moments(cut(made), "x")
    return spark.createDataFrame([(a[0], b[0], op.frechet(a, b))], "n_real long, n_made long, distance double")


SIDES = "s as (select item, is_real, [cast(v as double) for v in embedding] as x from profiles), a as (select * from s where is_real), b as (select * from s where not is_real)"
K = "power(list_inner_product({p}.x, {q}.x) / 64 + 1, 3)"
KID = f"with {SIDES} select round((select avg({K.format(p='p', q='q')}) from a p join a q on p.item <> q.item) + (select avg({K.format(p='p', q='q')}) from b p join b q on p.item <> q.item) - 2 * (select avg({K.format(p='p', q='q')}) from a p cross join b q), 9) as kid"


@query("kernel_distance", KID, D)
def kernel_distance(spark, sf_dir):
    return spark.createDataFrame([(op.kernel_distance(*populations(spark, sf_dir)),)], "kid double").select(F.round("kid", 9).alias("kid"))


@query("kernel_distance_all", KID, D)
def kernel_distance_all(spark, sf_dir):
    """The same under its former name, from when kernel_distance had a bound."""
    return kernel_distance(spark, sf_dir)


BALLS = "ra as (select p.item, list_distance(p.x, q.x) as gap, row_number() over (partition by p.item order by list_distance(p.x, q.x)) as k from a p join a q on p.item <> q.item), rb as (select p.item, list_distance(p.x, q.x) as gap, row_number() over (partition by p.item order by list_distance(p.x, q.x)) as k from b p join b q on p.item <> q.item)"
PRECISION = f"""with {SIDES}, {BALLS}, ks as (select unnest([1, 3, 5, 11, 21]) as k),
pr as (select ra.k, count(distinct b.item) as n from b join a on true join ra on ra.item = a.item and list_distance(a.x, b.x) <= ra.gap and ra.k in (1, 3, 5, 11, 21) group by 1),
re as (select rb.k, count(distinct a.item) as n from a join b on true join rb on rb.item = b.item and list_distance(a.x, b.x) <= rb.gap and rb.k in (1, 3, 5, 11, 21) group by 1)
select cast(ks.k as int) as k, round(coalesce(pr.n, 0) / (select count(*) from b), 6) as precision, round(coalesce(re.n, 0) / (select count(*) from a), 6) as recall from ks left join pr using (k) left join re using (k)"""


@query("manifold_precision_recall", PRECISION, D)
def manifold_precision_recall(spark, sf_dir):
    return metricjoin.precision_recall(*populations(spark, sf_dir)).drop("pairs")


@query("manifold_precision_recall_all", PRECISION, D)
def manifold_precision_recall_all(spark, sf_dir):
    """The same under its former name, from when manifold_precision_recall had a bound."""
    return manifold_precision_recall(spark, sf_dir)


@query("radiomics_mahalanobis")
def radiomics_mahalanobis(spark, sf_dir):
    """The first twenty numbers of each vector against the real ones."""
    rows = load(spark, sf_dir, D).select("item", "is_real", F.slice(F.col("embedding").cast("array<double>"), 1, 20).alias("x"))
    return op.mahalanobis(rows, rows.filter("is_real"), "x").select("item", F.round("d2", 6).alias("d2"), F.round("radiomics_score", 6).alias("radiomics_score"))
