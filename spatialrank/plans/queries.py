"""Every registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.benefit import root4
from ..lineage import cut, numbered
from ..operators import analyses, corridors, curves, focal, graph, greedy, regions, rules
from ..operators import transforms as t
from .fixtures import GRID, Fixture, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PROFILE = [(1.0, 1.0), (0.5, 0.8), (0.0, 0.2)]
G_SQL = "(CASE WHEN {0} <= 0.0 THEN 0.2 WHEN {0} <= 0.5 THEN 0.2+({0}-0.0)*((0.8-0.2)/(0.5-0.0)) WHEN {0} <= 1.0 THEN 0.8+({0}-0.5)*((1.0-0.8)/(1.0-0.5)) ELSE 1.0 END)"


def query(names: str = "", sql: str | None = None, recursive: bool = False):
    """Register a function of a fixture under its name, with SQL over common table expressions."""

    def add(function: Callable[[Fixture], DataFrame]):
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(Fixture(spark, sf_dir))
        if sql:
            SQL[name] = with_ctes(names, sql, recursive)
        return function

    return add


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """``df`` with its doubles rounded, so that engines agree."""
    chosen = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.select(*(F.round(c, digits).alias(c) if c in chosen else F.col(c) for c in df.columns))


# --- transforms


@query("norm", "SELECT y, x, feature, value FROM norm")
def occ_normalised(f: Fixture) -> DataFrame:
    return t.normalise(f.occ)


@query("occ", "SELECT feature, COUNT(*) AS n_cells, MAX(value) AS top, SUM(value) AS total FROM occ GROUP BY feature")
def feature_counts(f: Fixture) -> DataFrame:
    return f.occ.groupBy("feature").agg(F.count("*").alias("n_cells"), F.max("value").alias("top"), F.sum("value").alias("total"))


@query("occ", "SELECT y, x, COUNT(*) AS n_features FROM occ GROUP BY y, x")
def cell_counts(f: Fixture) -> DataFrame:
    return f.occ.groupBy("y", "x").agg(F.count("*").alias("n_features"))


@query("occ features", "SELECT y, x, SUM(greatest(value,0)*weight) AS wrscr FROM occ JOIN features ON occ.feature=features.feature GROUP BY y, x")
def richness_map(f: Fixture) -> DataFrame:
    return t.richness(f.occ, f.features)


@query("occ features", "SELECT y, x, COUNT(*) AS occurrences, SUM(weight) AS weighted_occurrences, SUM(value) AS level, SUM(value*weight) AS weighted_level FROM occ JOIN features ON occ.feature=features.feature WHERE value>0 GROUP BY y, x")
def richness_maps(f: Fixture) -> DataFrame:
    return t.richness_maps(f.occ, f.features)


@query("norm features cost", "SELECT n.y, n.x, round(MAX(value*weight)/MAX(cost),9) AS rmax FROM norm n JOIN features ON n.feature=features.feature JOIN cost c ON c.y=n.y AND c.x=n.x GROUP BY n.y, n.x")
def rarity_max_map(f: Fixture) -> DataFrame:
    return rounded(t.largest(t.normalise(f.occ), f.features, f.cost).select("y", "x", "rmax"), 9)


@query("occ", "SELECT feature, SUM(value) AS total, SUM(value*x)/SUM(value) AS cx, SUM(value*y)/SUM(value) AS cy FROM occ GROUP BY feature")
def feature_centroids(f: Fixture) -> DataFrame:
    return t.centroids(f.occ)


_GAP = """, kept AS (SELECT o.y, o.x, o.feature, total, {0} AS kept FROM occ o JOIN total t ON o.feature=t.feature JOIN features f ON f.feature=o.feature JOIN cells c ON c.y=o.y AND c.x=o.x),
s AS (SELECT feature, SUM(kept) AS s FROM kept GROUP BY feature)
SELECT y, x, k.feature, round(kept/s,9) AS value, round(s/total,6) AS retained FROM kept k JOIN s ON s.feature=k.feature"""


@query("occ total features cells", _GAP.format("greatest(value-beta*50000.0*weight/total,0)"))
def infogap_abs(f: Fixture) -> DataFrame:
    return rounded(rounded(t.infogap(f.occ, f.cells, f.features, 50000.0), 9, "value"), 6, "retained")


@query("occ total features cells", _GAP.format("greatest(value*(1-beta*500.0*weight/total),0)"))
def infogap_prop(f: Fixture) -> DataFrame:
    return rounded(rounded(t.infogap(f.occ, f.cells, f.features, 500.0, proportional=True), 9, "value"), 6, "retained")


@query("occ", ", v AS (SELECT y, x, feature, exp(value*0.02)/(1+exp(value*0.02)) AS v FROM occ), s AS (SELECT feature, SUM(v) AS s FROM v GROUP BY feature) SELECT y, x, v.feature, round(v/s,9) AS value FROM v JOIN s ON s.feature=v.feature")
def logit_back(f: Fixture) -> DataFrame:
    return rounded(t.logistic(f.occ, 0.02), 9)


@query("occ features cells", "SELECT o.y, o.x, o.feature, CASE WHEN grp=1 THEN value*COALESCE(cond,1) ELSE value END AS value FROM occ o JOIN features f ON f.feature=o.feature JOIN cells c ON c.y=o.y AND c.x=o.x")
def condition_apply(f: Fixture) -> DataFrame:
    return t.conditioned(f.occ, f.features, 1, f.cells)


def _ret(f: Fixture) -> DataFrame:
    return f.cells.select("y", "x", F.col("cond").alias("ret"))


@query("occ features cells", "SELECT o.y, o.x, o.feature, CASE WHEN grp=2 THEN value*COALESCE(1-cond,1) ELSE value END AS value FROM occ o JOIN features f ON f.feature=o.feature JOIN cells c ON c.y=o.y AND c.x=o.x")
def retention_apply(f: Fixture) -> DataFrame:
    return t.retained(f.occ, f.features, 2, _ret(f))


@query("occ features cells", """, s AS (SELECT f.feature, weight, SUM(value*COALESCE(cond,0)) AS lost, SUM(value*(1-COALESCE(cond,0))) AS remains
FROM occ o JOIN features f ON f.feature=o.feature JOIN cells c ON c.y=o.y AND c.x=o.x WHERE grp=1 GROUP BY f.feature, weight)
SELECT feature, round(lost,4) AS lost, round(remains,4) AS remains, round(weight*lost/remains,6) AS by_loss, round(weight*lost/(remains+lost),6) AS by_gain FROM s""")
def retention_weights(f: Fixture) -> DataFrame:
    return rounded(rounded(t.retention_weights(f.occ, f.features, 1, _ret(f)), 4, "lost", "remains"), 6, "by_loss", "by_gain")


@query("occ total cells", ", v AS (SELECT o.y, o.x, o.feature, value/(1-beta/2) AS v FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x), s AS (SELECT feature, SUM(v) AS s FROM v GROUP BY feature) SELECT y, x, v.feature, round(v*total/s,6) AS value FROM v JOIN s ON s.feature=v.feature JOIN total t ON t.feature=v.feature")
def edge_correction(f: Fixture) -> DataFrame:
    return rounded(t.edge_corrected(f.occ, f.cells.select("y", "x", (F.col("beta") / 2).alias("edge"))))


@query("occ sim", ", v AS (SELECT y, x, i AS feature, SUM(value*w) AS v FROM occ JOIN sim ON feature=j GROUP BY y, x, i), s AS (SELECT feature, SUM(v) AS s FROM v GROUP BY feature) SELECT y, x, v.feature, round(v/s,9) AS value FROM v JOIN s ON s.feature=v.feature")
def community_similarity(f: Fixture) -> DataFrame:
    return rounded(t.similar(f.occ, f.sim), 9)


@query("occ total", """, k AS (SELECT y, x, feature, value, ROW_NUMBER() OVER (ORDER BY y, x, feature) AS k FROM occ WHERE feature<5),
v AS (SELECT y, x, feature, CASE WHEN k=1 OR floor((k-1)*0.2)>floor((k-2)*0.2) THEN 0 ELSE value END AS v FROM k UNION ALL SELECT y, x, feature, value FROM occ WHERE feature>=5),
s AS (SELECT feature, SUM(v) AS s FROM v GROUP BY feature)
SELECT y, x, v.feature, round(CASE WHEN s<>0 THEN v*total/s ELSE v END,6) AS value FROM v JOIN s ON s.feature=v.feature JOIN total t ON t.feature=v.feature""")
def deterministic_omissions(f: Fixture) -> DataFrame:
    return rounded(t.omitted(f.occ, 20.0, 5))


@query("occ", "SELECT n_nationkey AS feature, n_name AS name FROM nation WHERE n_nationkey IN (SELECT feature FROM occ)")
def drop_empty_features(f: Fixture) -> DataFrame:
    return t.occurring(f.source("nation").select(F.col("n_nationkey").alias("feature"), F.col("n_name").alias("name")), f.occ)


@query("occ", ", w AS (SELECT y, x, MAX(CASE WHEN feature=7 THEN -value ELSE value END) AS m FROM occ GROUP BY y, x) SELECT o.y, o.x, feature, value FROM occ o JOIN w ON w.y=o.y AND w.x=o.x WHERE m>0")
def zero_to_missing(f: Fixture) -> DataFrame:
    return t.positive_cells(f.occ, f.negative.withColumn("weight", F.when(F.col("weight") < 0, -1.0).otherwise(1.0))).select("y", "x", "feature", "value")


@query("occ features present", "SELECT p.y, p.x, f.feature, COALESCE(value,0) AS value FROM present p CROSS JOIN features f LEFT JOIN occ o ON o.y=p.y AND o.x=p.x AND o.feature=f.feature")
def missing_to_zero(f: Fixture) -> DataFrame:
    return t.filled(f.occ, f.features)


@query("cost", "SELECT y, x, CASE WHEN cost-2>0 THEN cost-2 ELSE 1 END AS cost, NOT cost-2>0 AS replaced FROM cost")
def cost_sanitised(f: Fixture) -> DataFrame:
    return t.sane_cost(f.cost.withColumn("cost", F.col("cost") - 2))


@query("cost cells", "SELECT c.y, c.x, CASE WHEN mask_level=1 THEN NULL ELSE cost END AS cost0, COALESCE(CASE WHEN mask_level=1 THEN NULL ELSE cost END, beta) AS cost FROM cells c JOIN cost k ON k.y=c.y AND k.x=c.x")
def cost_by_area(f: Fixture) -> DataFrame:
    part = f.cells.join(f.cost, ["y", "x"]).select("y", "x", F.when(F.col("mask_level") != 1, F.col("cost")).alias("cost"))
    return t.cell_cost(f.cells, part, f.cells.withColumnRenamed("beta", "area")).join(part.withColumnRenamed("cost", "cost0"), ["y", "x"])


@query("features", "SELECT feature, weight/(SELECT MAX(abs(weight)) FROM features) AS weight FROM features")
def weight_rescale(f: Fixture) -> DataFrame:
    return t.weights_rescaled(f.features).select("feature", "weight")


@query("occ cost", "SELECT o.y, o.x, feature, value*cost AS value FROM occ o JOIN cost c ON c.y=o.y AND c.x=o.x")
def area_weighting(f: Fixture) -> DataFrame:
    return t.area_weighted(f.occ, f.cost.withColumnRenamed("cost", "area"))


@query("cells", "SELECT y, x, round(beta/(SELECT AVG(beta) FROM cells WHERE beta>=0),9) AS beta FROM cells")
def infogap_layer_mean(f: Fixture) -> DataFrame:
    return rounded(t.mean_normalised(f.cells, "beta"), 9)


@query("occ cells", "SELECT o.y, o.x, feature, value FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x WHERE mask_level>0")
def area_mask(f: Fixture) -> DataFrame:
    return t.masked(f.occ, f.cells.withColumnRenamed("mask_level", "mask")).select("y", "x", "feature", "value")


@query("cost", "SELECT COUNT(cost) AS n, MIN(cost) AS low, MAX(cost) AS high, round(AVG(cost),9) AS mean, round(STDDEV_POP(cost),6) AS deviation FROM cost")
def raster_statistics(f: Fixture) -> DataFrame:
    return rounded(rounded(t.statistics(f.cost, "cost"), 9, "mean"), 6, "deviation")


# --- neighbourhoods


@query("nb", "SELECT y, x, nb4 AS nb FROM nb")
def neighbour4_count(f: Fixture) -> DataFrame:
    return focal.counted(t_present(f), focal.NEAR4)


def t_present(f: Fixture) -> DataFrame:
    return f.occ.select("y", "x").distinct()


@query("nb", "SELECT y, x, nb8 AS nb FROM nb")
def neighbour8_count(f: Fixture) -> DataFrame:
    return focal.counted(t_present(f), focal.NEAR8)


@query("nb", "SELECT y, x, nb8-nb4 AS corners FROM nb")
def corner_count(f: Fixture) -> DataFrame:
    return focal.corners(t_present(f))


@query("present", "SELECT p.y, p.x, COUNT(*) AS nb FROM present p JOIN present q ON q.y BETWEEN p.y-2 AND p.y+2 AND q.x BETWEEN p.x-2 AND p.x+2 GROUP BY p.y, p.x")
def box_count_r2(f: Fixture) -> DataFrame:
    return focal.counted(t_present(f), focal.box(2))


@query("nb", "SELECT CAST(SUM(4-nb4) AS BIGINT) AS boundary, COUNT(*) AS n FROM nb")
def boundary_length(f: Fixture) -> DataFrame:
    return focal.boundary_length(t_present(f))


@query("nb cells off8", """SELECT y, x FROM nb WHERE nb8<8 UNION SELECT a.y, a.x FROM cells a CROSS JOIN off8 JOIN cells b ON b.y=a.y+dy AND b.x=a.x+dx WHERE a.mask_level<>b.mask_level""")
def edge_cells(f: Fixture) -> DataFrame:
    return focal.edge(t_present(f), f.cells)


@query("nb", "SELECT y, x FROM nb WHERE nb8=8")
def erosion(f: Fixture) -> DataFrame:
    return focal.eroded(t_present(f), 1)


@query("ranked", "SELECT a.y, a.x, COUNT(b.y)/24.0 AS occupancy FROM ranked a LEFT JOIN ranked b ON b.rank>=0.5 AND b.y BETWEEN a.y-2 AND a.y+2 AND b.x BETWEEN a.x-2 AND a.x+2 AND NOT (a.y=b.y AND a.x=b.x) GROUP BY a.y, a.x")
def neighbourhood_occupancy(f: Fixture) -> DataFrame:
    return focal.occupancy(f.ranked, 0.5, 2)


_BETAS = [0.0, 0.1, 1.0, 10.0]


@query("norm nb", ", b AS (SELECT * FROM (VALUES (0.0::DOUBLE),(0.1),(1.0),(10.0)) t(beta)), s AS (SELECT beta, feature, SUM(value*exp(-beta*(1-nb8/8.0))) AS kept FROM norm n JOIN nb ON nb.y=n.y AND nb.x=n.x CROSS JOIN b GROUP BY beta, feature) SELECT beta, round(MIN(kept),6) AS least FROM s GROUP BY beta")
def fragmentation_scan(f: Fixture) -> DataFrame:
    shares = focal.counted(t_present(f), focal.NEAR8).select("y", "x", (F.col("nb") / 8).alias("share"))
    return rounded(focal.fragmentation(t.normalise(f.occ), shares, _BETAS), 6, "least")


def _conv(k: str, where: str = "") -> str:
    return f""", off AS (SELECT dy, dx, {k} AS k FROM (SELECT CAST(range AS INT) AS dy FROM range(-3,4)) a CROSS JOIN (SELECT CAST(range AS INT) AS dx FROM range(-3,4)) b),
conv AS (SELECT o.y-dy AS y, o.x-dx AS x, feature, SUM(value*k) AS conn FROM occ o CROSS JOIN off WHERE k<>0 {where} GROUP BY 1,2,3)"""


_EXP = "exp(-0.5*sqrt(dy*dy+dx*dx))/(2*3.141592653589793*0.25)"


@query("occ", _conv(_EXP) + " SELECT y, x, feature, round(conn,6) AS conn FROM conv")
def convolve_exp_r3(f: Fixture) -> DataFrame:
    return rounded(focal.convolve(f.occ, focal.kernel("exponential", 0.5, 3)))


@query("occ", _conv("CASE WHEN sqrt(dy*dy+dx*dx)<2.5 THEN 1.0 ELSE 0.0 END") + " SELECT y, x, feature, CAST(conn AS DOUBLE) AS conn FROM conv")
def convolve_threshold_r3(f: Fixture) -> DataFrame:
    return focal.convolve(f.occ, focal.kernel("threshold", 2.5, 3))


@query("occ", _conv("greatest(1-sqrt(dy*dy+dx*dx)/3.0,0)") + " SELECT y, x, feature, round(conn,6) AS conn FROM conv")
def convolve_triangular_r3(f: Fixture) -> DataFrame:
    return rounded(focal.convolve(f.occ, focal.kernel("triangular", 3.0, 3)))


@query("occ", _conv(_EXP) + ", v AS (SELECT o.y, o.x, o.feature, conn AS v FROM occ o JOIN conv c ON c.y=o.y AND c.x=o.x AND c.feature=o.feature), s AS (SELECT feature, SUM(v) AS s FROM v GROUP BY feature) SELECT y, x, v.feature, round(v/s,9) AS value FROM v JOIN s ON s.feature=v.feature")
def distribution_smoothing(f: Fixture) -> DataFrame:
    return rounded(focal.smoothed(f.occ, focal.kernel("exponential", 0.5, 3)), 9)


def _interact(resource: int, consumer: int, gamma: float, factor: str) -> str:
    return _conv(_EXP, f"AND feature={consumer}") + f""", m AS (SELECT MAX(conn)*{gamma} AS m FROM conv),
v AS (SELECT o.y, o.x, o.feature, value*{factor} AS v FROM occ o LEFT JOIN conv c ON c.y=o.y AND c.x=o.x CROSS JOIN m WHERE o.feature={resource}),
s AS (SELECT SUM(v) AS s FROM v) SELECT y, x, feature, round(v/s,9) AS value FROM v CROSS JOIN s"""


@query("occ", _interact(1, 2, 0.5, "least(COALESCE(conn/m,0),1)"))
def interaction_positive(f: Fixture) -> DataFrame:
    return rounded(focal.attracted(f.occ, 1, 2, focal.kernel("exponential", 0.5, 3), 0.5), 9)


@query("occ", _interact(3, 4, 0.8, "(1-least(COALESCE(conn/m,0),1))"))
def interaction_negative(f: Fixture) -> DataFrame:
    return rounded(focal.avoided(f.occ, 3, 4, focal.kernel("exponential", 0.5, 3), 0.8), 9)


@query("occ sim", ", mixed AS (SELECT y, x, i AS feature, SUM(value*w) AS value FROM occ JOIN sim ON feature=j GROUP BY y, x, i)" + _conv("CASE WHEN sqrt(dy*dy+dx*dx)<2.5 THEN 1.0 ELSE 0.0 END").replace("FROM occ o", "FROM mixed o") + """,
m AS (SELECT feature, MAX(conn) AS m FROM conv GROUP BY feature), v AS (SELECT o.y, o.x, o.feature, value*least(conn/m,1) AS v FROM occ o JOIN conv c ON c.y=o.y AND c.x=o.x AND c.feature=o.feature JOIN m ON m.feature=o.feature),
s AS (SELECT feature, SUM(v) AS s FROM v GROUP BY feature) SELECT y, x, v.feature, round(v/s,9) AS value FROM v JOIN s ON s.feature=v.feature""")
def matrix_connectivity(f: Fixture) -> DataFrame:
    return rounded(focal.connected(f.occ, f.sim, focal.kernel("threshold", 2.5, 3)), 9)


@query()
def convolve_fft(f: Fixture) -> DataFrame:
    """By FFT; the tests compare it with the join."""
    return rounded(focal.convolve_fft(f.occ, GRID.yd, GRID.xd, lambda d: np.exp(-0.5 * d) / (2 * np.pi * 0.25)), 6)


# --- removal rules



_SUMS = {
    "caz": "MAX(weight*value/r)",
    "abf": "SUM(value*weight*0.25/(sqrt(r)*sqrt(sqrt(r))))",
    "tbf": "SUM(CASE WHEN r-value>tj THEN value*0.25/(sqrt((r-tj)/(1-tj))*sqrt(sqrt((r-tj)/(1-tj)))) WHEN r<tj THEN 0 ELSE 8 END)",
}


def _half(f: Fixture, occ: DataFrame) -> DataFrame:
    """The landscape after the lower half of the cells is gone: representation isn't 1 any more."""
    return occ.join(f.ranked.where("rank > 0.5"), ["y", "x"], "left_semi")


def _rr4(r: str) -> str:
    return f"(CASE WHEN {r}<=tj OR tj>=1 THEN weight*sqrt({r}/tj) ELSE weight+w2*sqrt(sqrt(({r}-tj)/(1-tj))) END)"


_HALF = ", half AS (SELECT n.* FROM norm n JOIN ranked k ON k.y=n.y AND k.x=n.x WHERE rank>0.5), st AS (SELECT f.feature, weight, tj, w2, sum(value) AS r FROM half n JOIN features f ON f.feature=n.feature GROUP BY f.feature, weight, tj, w2)"


def _delta_sql(body: str) -> str:
    return _HALF + f", d AS (SELECT h.y, h.x, {body} AS delta FROM half h JOIN st ON st.feature=h.feature GROUP BY h.y, h.x) SELECT d.y, d.x, round(delta/cost,6) AS delta FROM d JOIN cost c ON c.y=d.y AND c.x=d.x"


def _rule(f: Fixture, rule: str, features: DataFrame | None = None) -> DataFrame:
    occ = _half(f, t.normalise(f.occ))
    return rounded(rules.over_cost(rules.deltas(occ, rules.state(occ, f.features if features is None else features), rule, 8), f.cost))


@query("norm ranked features cost", _delta_sql(_SUMS["caz"]))
def delta_caz(f: Fixture) -> DataFrame:
    return _rule(f, "caz")


@query("norm ranked features cost", _delta_sql("COALESCE(MAX(CASE WHEN h.feature<>7 THEN weight*value/r END),0)+least(COALESCE(MIN(CASE WHEN h.feature=7 THEN -1*value/r END),0),0)"))
def delta_caz_negw(f: Fixture) -> DataFrame:
    return _rule(f, "caz", f.negative)


@query("norm ranked features cost", _delta_sql(_SUMS["abf"]))
def delta_abf(f: Fixture) -> DataFrame:
    return _rule(f, "abf")


@query("norm ranked features cost", _delta_sql(_SUMS["tbf"]))
def delta_tbf(f: Fixture) -> DataFrame:
    return _rule(f, "tbf")


@query("norm ranked features cost", _delta_sql(f"SUM({_rr4('r')}-{_rr4('greatest(r-value,0)')})"))
def delta_gbf(f: Fixture) -> DataFrame:
    return _rule(f, "gbf")


@query()
def delta_random(f: Fixture) -> DataFrame:
    """Seeded uniform numbers; tests check range, spread and repetition."""
    return rules.random_deltas(f.occ, 7)


def _ssi(f: Fixture) -> DataFrame:
    return analyses.points_to_cells(f.ssi, f.cells)


@query("ssi present norm", """, hit AS (SELECT s.* FROM ssi s JOIN present p ON p.y=s.y AND p.x=s.x), tot AS (SELECT feature, SUM(value) AS total FROM hit GROUP BY feature)
SELECT y, x, h.feature, value/total AS value FROM hit h JOIN tot ON tot.feature=h.feature""")
def ssi_points_to_cells(f: Fixture) -> DataFrame:
    return _ssi(f)


@query("ssi present norm", """, hit AS (SELECT s.* FROM ssi s JOIN present p ON p.y=s.y AND p.x=s.x), tot AS (SELECT feature, SUM(value) AS total FROM hit GROUP BY feature),
u AS (SELECT y, x, feature, value FROM norm UNION ALL SELECT y, x, 100+h.feature, value/total FROM hit h JOIN tot ON tot.feature=h.feature)
SELECT y, x, round(MAX(value),9) AS delta FROM u GROUP BY y, x""")
def delta_ssi(f: Fixture) -> DataFrame:
    """Point features join the occurrences with weight 1."""
    both = t.normalise(f.occ).unionByName(_ssi(f).withColumn("feature", F.col("feature") + 100))
    names = both.select("feature").distinct().withColumn("weight", F.lit(1.0))
    sums = names.withColumn("r", F.lit(1.0))
    return rounded(rules.deltas(both, sums, "caz", 11), 9)


@query("norm cells features cost", """, u AS (SELECT plu_id, feature, SUM(value) AS value FROM norm n JOIN cells c ON c.y=n.y AND c.x=n.x GROUP BY plu_id, feature),
k AS (SELECT plu_id, SUM(cost) AS cost FROM cells c JOIN cost k ON k.y=c.y AND k.x=c.x GROUP BY plu_id), d AS (SELECT plu_id, MAX(weight*value) AS delta FROM u JOIN features f ON f.feature=u.feature GROUP BY plu_id)
SELECT d.plu_id, round(delta/cost,6) AS delta FROM d JOIN k ON k.plu_id=d.plu_id""")
def delta_plu(f: Fixture) -> DataFrame:
    profiles = regions.unit_profiles(t.normalise(f.occ), f.cells)
    now = f.features.withColumn("r", F.lit(1.0))
    return rounded(rules.over_cost(rules.deltas(profiles, now, "caz", 8, ("plu_id",)), regions.unit_cost(f.cells, f.cost), ("plu_id",)))


_CW1 = "0.5*(0.5*w+(1-0.5)*weight)"


@query("norm cells features own_w", f", d AS (SELECT n.y, n.x, MAX({_CW1}*value) AS delta FROM norm n JOIN cells c ON c.y=n.y AND c.x=n.x JOIN own_w o ON o.admu=c.admu AND o.feature=n.feature JOIN features f ON f.feature=n.feature GROUP BY n.y, n.x) SELECT y, x, round(delta,6) AS delta FROM d")
def delta_admu_mode1(f: Fixture) -> DataFrame:
    return rounded(regions.regional_deltas(t.normalise(f.occ), f.cells, f.features, f.own_w, f.units, 1))


@query("occ total cells features own_w", """, ra AS (SELECT admu, feature, SUM(value) AS ra FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x GROUP BY admu, feature), n AS (SELECT COUNT(*) AS n FROM units)
SELECT o.y, o.x, round(0.5*MAX(weight*value/total)+0.5*MAX(0.5*w*value/ra)/MAX(n),6) AS delta FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x JOIN own_w w ON w.admu=c.admu AND w.feature=o.feature
JOIN ra ON ra.admu=c.admu AND ra.feature=o.feature JOIN features f ON f.feature=o.feature JOIN total t ON t.feature=o.feature CROSS JOIN n GROUP BY o.y, o.x""")
def delta_admu_mode2(f: Fixture) -> DataFrame:
    return rounded(regions.regional_deltas(f.occ, f.cells, f.features, f.own_w, f.units, 2))


@query("nb", ", s AS (SELECT SUM(4-nb4) AS bl, COUNT(*) AS n FROM nb) SELECT y, x, nb4, round(CASE WHEN nb4=2 THEN 0 ELSE 0.5*(bl/CAST(n AS DOUBLE)-(bl+2*nb4-4)/CAST(n-1 AS DOUBLE)) END,9) AS term FROM nb CROSS JOIN s")
def blp_delta(f: Fixture) -> DataFrame:
    return rounded(rules.boundary_term(t_present(f), 0.5), 9)


_RING = """, now AS (SELECT y, x FROM ranked WHERE rank>0.3), k AS (SELECT p.y, p.x, COUNT(*)-1 AS o, COUNT(n.y)-1 AS k FROM now p JOIN present q ON q.y BETWEEN p.y-1 AND p.y+1 AND q.x BETWEEN p.x-1 AND p.x+1 LEFT JOIN now n ON n.y=q.y AND n.x=q.x GROUP BY p.y, p.x)"""


def _now(f: Fixture) -> DataFrame:
    return f.ranked.where("rank > 0.3").select("y", "x")


@query("norm ranked present", _RING + f" SELECT n.y, n.x, feature, round(value*{G_SQL.format('(CASE WHEN o>0 THEN k/CAST(o AS DOUBLE) ELSE 1.0 END)')},9) AS loss FROM norm n JOIN k ON k.y=n.y AND k.x=n.x")
def bqp_local(f: Fixture) -> DataFrame:
    return rounded(rules.local_quality_loss(t.normalise(f.occ), _now(f), t_present(f), 1, PROFILE), 9)


@query("norm ranked present off8", _RING + f""", g AS (SELECT n.y, n.x, feature, value*({G_SQL.format('(k/CAST(o AS DOUBLE))')}-{G_SQL.format('((k-1)/CAST(o AS DOUBLE))')}) AS lost FROM norm n JOIN k ON k.y=n.y AND k.x=n.x WHERE o>0 AND k>0),
m AS (SELECT g.y-dy AS y, g.x-dx AS x, feature, SUM(lost) AS loss FROM g CROSS JOIN off8 GROUP BY 1,2,3) SELECT m.y, m.x, feature, round(loss,9) AS loss FROM m JOIN now ON now.y=m.y AND now.x=m.x""")
def bqp_buffer(f: Fixture) -> DataFrame:
    return rounded(rules.buffer_quality_loss(t.normalise(f.occ), _now(f), t_present(f), 1, PROFILE), 9)


@query("norm features nb", ", d AS (SELECT y, x, round(MAX(weight*value),9) AS delta FROM norm n JOIN features f ON f.feature=n.feature GROUP BY y, x), o AS (SELECT d.y, d.x, delta, ROW_NUMBER() OVER (ORDER BY delta, nb8, d.y, d.x) AS place FROM d JOIN nb ON nb.y=d.y AND nb.x=d.x) SELECT y, x, delta, CAST(place AS INT) AS place FROM o WHERE place<=100")
def warp_block_bottom_k(f: Fixture) -> DataFrame:
    occ = t.normalise(f.occ)
    return greedy.block(rules.deltas(occ, f.features.withColumn("r", F.lit(1.0)), "caz", 8), t_present(f), 100)


@query("occ", ", s AS (SELECT y, x, SUM(value) AS value FROM occ GROUP BY y, x), n AS (SELECT CAST(floor(COUNT(*)*0.1) AS BIGINT) AS n FROM s), o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value, y, x) AS k FROM s) SELECT y, x, value FROM o CROSS JOIN n WHERE k<=n")
def initial_removal(f: Fixture) -> DataFrame:
    return greedy.initial_removal(f.occ.groupBy("y", "x").agg(F.sum("value").alias("value")), "value", 10.0)


@query("nb", "SELECT y, x, nb4, nb8 FROM nb WHERE nb4>1 AND nb8<7")
def split_risk_cells(f: Fixture) -> DataFrame:
    return rules.split_risk(t_present(f))


@query("cells", "SELECT y, x, 2*COALESCE(cond,0)+0.5*beta AS coefficient FROM cells")
def domain_coefficient(f: Fixture) -> DataFrame:
    layers = f.cells.select("y", "x", F.lit(2.0).alias("weight"), F.coalesce("cond", F.lit(0.0)).alias("value")).union(f.cells.select("y", "x", F.lit(0.5), F.col("beta")))
    return rules.domain_coefficient(f.cells, layers)


# --- greedy rankings


def _greedy_sql(delta: str, k: int = 1, level: str = "0", extra: str = "") -> str:
    return f""", w AS (SELECT 0 AS it, y, x, value, feature, weight, {level} AS lvl, CAST(NULL AS BIGINT) AS rn FROM (SELECT win.*, weight FROM win JOIN features ON features.feature=win.feature) q {extra}
UNION ALL SELECT it+1, y, x, value, feature, weight, lvl, rn FROM (
  SELECT w.it, w.y, w.x, w.value, w.feature, w.weight, w.lvl, d.rn FROM w JOIN (
    SELECT y, x, row_number() OVER (ORDER BY lvl, delta, y, x) AS rn FROM (
      SELECT a.y, a.x, a.lvl, round({delta},9) AS delta FROM w a JOIN (SELECT feature, sum(value) AS s FROM w GROUP BY feature) r ON r.feature=a.feature GROUP BY a.y, a.x, a.lvl)) d ON d.y=w.y AND d.x=w.x) z WHERE rn > {k})
SELECT y, x, CAST(max(it)+1 AS INT) AS round FROM w GROUP BY y, x"""


@query("win features", _greedy_sql("max(a.weight*a.value/r.s)"), recursive=True)
def greedy_caz_window(f: Fixture) -> DataFrame:
    return greedy.rank_small(f.win, f.features, "caz").select("y", "x", "round")


@query("win features", _greedy_sql("sum(a.value*a.weight*0.25/(sqrt(r.s)*sqrt(sqrt(r.s))))"), recursive=True)
def greedy_abf_window(f: Fixture) -> DataFrame:
    return greedy.rank_small(f.win, f.features, "abf").select("y", "x", "round")


@query("win features", _greedy_sql("max(a.weight*a.value/r.s)", 1, "CAST(FLOOR((x+y)/9.0) AS INT)"), recursive=True)
def greedy_masked_window(f: Fixture) -> DataFrame:
    levels = f.win.select("y", "x", F.floor((F.col("x") + F.col("y")) / 9.0).cast("int").alias("mask_level")).distinct()
    return greedy.rank_small(f.win, f.features, "caz", 1, levels).select("y", "x", "round")


@query("win features", _greedy_sql("max(a.weight*a.value/r.s)", 10), recursive=True)
def greedy_caz_blocks(f: Fixture) -> DataFrame:
    return greedy.rank_small(f.win, f.features, "caz", 10).select("y", "x", "round")


@query("win features", _greedy_sql("max(a.weight*a.value/r.s)").replace("FROM (SELECT win.*, weight FROM win", "FROM (SELECT y, x, win.feature, value, weight FROM (SELECT CAST(FLOOR(y/4.0) AS INT) AS y, CAST(FLOOR(x/4.0) AS INT) AS x, feature, SUM(value) AS value FROM win GROUP BY 1,2,3) win"), recursive=True)
def greedy_plu_window(f: Fixture) -> DataFrame:
    units = f.win.groupBy(F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x"), "feature").agg(F.sum("value").alias("value"))
    return greedy.rank_small(units, f.features, "caz").select("y", "x", "round")


@query()
def greedy_distributed(f: Fixture) -> DataFrame:
    """The driver's loop over the whole landscape, a hundredth of what is left in a round, rounds in batches of the cheapest cells; tests compare it with the kernel."""
    n = t_present(f).count()
    return greedy.rank(f.occ, f.features, "caz", warp=-(-n // 4), cost=f.cost)


@query()
def greedy_random_seeded(f: Fixture) -> DataFrame:
    n = t_present(f).count()
    return greedy.rank_small(f.occ, f.features, "random", warp=-(-n // 3), seed=11, whole_blocks=False, neighbours=True)


@query("occ features nb", """, d1 AS (SELECT o.y, o.x, round(MAX(weight*value/s),9) AS delta FROM occ o JOIN features f ON f.feature=o.feature JOIN (SELECT feature, SUM(value) AS s FROM occ GROUP BY feature) r ON r.feature=o.feature GROUP BY o.y, o.x),
k1 AS (SELECT y, x FROM (SELECT d1.y, d1.x, ROW_NUMBER() OVER (ORDER BY delta, nb8, d1.y, d1.x) AS rn FROM d1 JOIN nb ON nb.y=d1.y AND nb.x=d1.x) q WHERE rn<=200),
o2 AS (SELECT o.* FROM occ o LEFT JOIN k1 ON k1.y=o.y AND k1.x=o.x WHERE k1.y IS NULL), p2 AS (SELECT DISTINCT y, x FROM o2),
nb2 AS (SELECT p.y, p.x, COUNT(q.y) AS nb8 FROM p2 p CROSS JOIN off8 LEFT JOIN p2 q ON q.y=p.y+dy AND q.x=p.x+dx GROUP BY p.y, p.x),
d2 AS (SELECT o.y, o.x, round(MAX(weight*value/s),9) AS delta FROM o2 o JOIN features f ON f.feature=o.feature JOIN (SELECT feature, SUM(value) AS s FROM o2 GROUP BY feature) r ON r.feature=o.feature GROUP BY o.y, o.x)
SELECT y, x, CAST(rn AS INT) AS place, delta FROM (SELECT d2.y, d2.x, delta, ROW_NUMBER() OVER (ORDER BY delta, nb8, d2.y, d2.x) AS rn FROM d2 JOIN nb2 ON nb2.y=d2.y AND nb2.x=d2.x) q WHERE rn<=200""")
def two_round_unrolled_full(f: Fixture) -> DataFrame:
    first = greedy.block(rules.deltas(f.occ, rules.state(f.occ, f.features), "caz", 8), t_present(f), 200)
    left = f.occ.join(F.broadcast(first), ["y", "x"], "left_anti")
    return greedy.block(rules.deltas(left, rules.state(left, f.features), "caz", 8), left.select("y", "x").distinct(), 200).select("y", "x", "place", "delta")


# --- replay and curves


@query("occ", "SELECT y, x, step, CAST(step AS DOUBLE)/n AS rank FROM (SELECT y, x, ROW_NUMBER() OVER (ORDER BY s, y, x) AS step, COUNT(*) OVER () AS n FROM (SELECT y, x, SUM(value) AS s FROM occ GROUP BY y, x) a) b")
def rank_map(f: Fixture) -> DataFrame:
    sums = f.occ.groupBy("y", "x").agg(F.sum("value").alias("s"))
    order = numbered(sums, [F.col("s"), F.col("y"), F.col("x")])
    n = order.agg(F.count("*").alias("n"))
    return order.crossJoin(F.broadcast(n)).select("y", "x", "step", (F.col("step") / F.col("n")).alias("rank"))


@query("occ ranked total", ", v AS (SELECT step, feature, SUM(value) AS v FROM occ o JOIN ranked k ON k.y=o.y AND k.x=o.x GROUP BY step, feature) SELECT step, v.feature, round(1-SUM(v) OVER (PARTITION BY v.feature ORDER BY step)/total,9) AS repr FROM v JOIN total t ON t.feature=v.feature")
def replay_curves(f: Fixture) -> DataFrame:
    return rounded(greedy.replay(f.occ, f.ranked), 9)


_SNAPS = """, n AS (SELECT COUNT(*) AS n FROM ranked), snaps AS (SELECT CAST(floor(n*p/20) AS BIGINT) AS step FROM n CROSS JOIN (SELECT range AS p FROM range(1,21)) q),
c AS (SELECT s.step, t.feature, 1-COALESCE(SUM(value),0)/MAX(total) AS repr FROM snaps s CROSS JOIN total t LEFT JOIN (SELECT o.feature, o.value, k.step FROM occ o JOIN ranked k ON k.y=o.y AND k.x=o.x) v ON v.feature=t.feature AND v.step<=s.step GROUP BY s.step, t.feature)"""


def _snap_curves(f: Fixture) -> DataFrame:
    n = f.ranked.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("p"), "n")
    return curves.at_steps(n.select(F.floor(F.col("n") * F.col("p") / 20).alias("step")), f.occ, f.ranked)


@query("occ ranked total features", _SNAPS + " SELECT step, round(MIN(repr),9) AS min_rem, round(AVG(repr),9) AS mean_rem, round(SUM(repr*weight)/SUM(weight),9) AS wmean_rem FROM c JOIN features f ON f.feature=c.feature GROUP BY step")
def curves_min_mean_wmean(f: Fixture) -> DataFrame:
    return rounded(curves.summary(_snap_curves(f), f.features).select("step", "min_rem", "mean_rem", "wmean_rem"), 9)


_RISK = "1-sqrt(sqrt(greatest(repr,0)))"


@query("occ ranked total features", _SNAPS + f" SELECT step, round(AVG({_RISK}),6) AS ext1, round(SUM(({_RISK})*weight)/SUM(weight),6) AS ext2 FROM c JOIN features f ON f.feature=c.feature WHERE step<(SELECT n FROM n) GROUP BY step")
def ext_risk(f: Fixture) -> DataFrame:
    n = f.ranked.agg(F.max("step").alias("last"))
    return rounded(curves.summary(_snap_curves(f).join(F.broadcast(n), F.col("step") < F.col("last")), f.features).select("step", "ext1", "ext2"))


@query("occ ranked total features", _SNAPS + f" SELECT step, grp, round(MIN(repr),6) AS min_rem, round(AVG(repr),6) AS mean_rem, round(MAX(repr),6) AS max_rem, round(SUM(repr*weight)/SUM(weight),6) AS wmean_rem, round(AVG({_RISK}),6) AS ext_risk FROM c JOIN features f ON f.feature=c.feature WHERE step<(SELECT n FROM n) GROUP BY step, grp")
def group_curves(f: Fixture) -> DataFrame:
    n = f.ranked.agg(F.max("step").alias("last"))
    return rounded(curves.by_group(_snap_curves(f).join(F.broadcast(n), F.col("step") < F.col("last")).select("step", "feature", "repr"), f.features))


@query("occ ranked total", _SNAPS + " SELECT step, " + ", ".join(f"round(MAX(CASE WHEN feature={i} THEN repr END),9) AS f{i}" for i in range(8)) + " FROM c GROUP BY step")
def curves_wide(f: Fixture) -> DataFrame:
    wide = curves.wide(_snap_curves(f), list(range(8)))
    return rounded(wide.select("step", *(F.col(str(i)).alias(f"f{i}") for i in range(8))), 9)


@query("occ ranked total features", ", v AS (SELECT step, feature, SUM(value) AS v FROM occ o JOIN ranked k ON k.y=o.y AND k.x=o.x GROUP BY step, feature), c AS (SELECT step, v.feature, 1-SUM(v) OVER (PARTITION BY v.feature ORDER BY step)/total AS repr FROM v JOIN total t ON t.feature=v.feature) SELECT c.feature, MIN(CASE WHEN repr<tj THEN step END) AS violated_at, MIN(CASE WHEN repr<=1e-12 THEN step END) AS lost_at FROM c JOIN features f ON f.feature=c.feature GROUP BY c.feature")
def target_violation(f: Fixture) -> DataFrame:
    return curves.violations(greedy.replay(f.occ, f.ranked), f.features)


@query("occ ranked total features", ", v AS (SELECT step, feature, SUM(value) AS v FROM occ o JOIN ranked k ON k.y=o.y AND k.x=o.x GROUP BY step, feature), c AS (SELECT step, v.feature, 1-SUM(v) OVER (PARTITION BY v.feature ORDER BY step)/total AS repr FROM v JOIN total t ON t.feature=v.feature), w AS (SELECT c.feature, MIN(CASE WHEN repr<tj THEN step END) AS violated_at, MIN(CASE WHEN repr<=1e-12 THEN step END) AS lost_at FROM c JOIN features f ON f.feature=c.feature GROUP BY c.feature) SELECT f.feature, name, weight, SUM(value) AS total, SUM(value*x)/SUM(value) AS cx, SUM(value*y)/SUM(value) AS cy, MAX(violated_at) AS violated_at, MAX(lost_at) AS lost_at FROM features f JOIN occ o ON o.feature=f.feature LEFT JOIN w ON w.feature=f.feature GROUP BY f.feature, name, weight")
def feature_report(f: Fixture) -> DataFrame:
    return curves.feature_report(f.occ, f.features, greedy.replay(f.occ, f.ranked))


@query("ranked cost", "SELECT k.y, k.x, step, CAST(step AS DOUBLE)/n AS rank, CAST(step+1 AS DOUBLE)/(n+1) AS prop_lost, n-step AS cells_left, cost FROM ranked k JOIN cost c ON c.y=k.y AND c.x=k.x CROSS JOIN (SELECT COUNT(*) AS n FROM ranked) q")
def removal_rows(f: Fixture) -> DataFrame:
    return curves.removal_rows(f.ranked.select("y", "x", "step"), f.cost)


@query("ranked", "SELECT y, x, CAST(CASE WHEN rank<0.2 THEN 1 WHEN rank<0.5 THEN 2 WHEN rank<0.75 THEN 3 WHEN rank<0.9 THEN 4 WHEN rank<0.95 THEN 5 WHEN rank<0.98 THEN 6 ELSE 7 END AS INT) AS band FROM ranked")
def rank_bands(f: Fixture) -> DataFrame:
    return curves.bands(f.ranked)


_CURVE = ", s AS (SELECT CAST(floor(rank*20) AS INT) AS p, SUM(cost) AS cost FROM ranked k JOIN cost c ON c.y=k.y AND c.x=k.x GROUP BY 1), u AS (SELECT 1-p/20.0 AS prop_left, SUM(cost) OVER (ORDER BY p DESC) AS cost_left FROM s)"


@query("ranked cost", _CURVE + ", l AS (SELECT *, lead(cost_left) OVER (ORDER BY cost_left, prop_left) AS nc, lead(prop_left) OVER (ORDER BY cost_left, prop_left) AS np FROM u) SELECT round(prop_left+(1000-cost_left)/(nc-cost_left)*(np-prop_left),6) AS fraction FROM l WHERE cost_left<=1000 AND nc>1000")
def cost_for_fraction(f: Fixture) -> DataFrame:
    from pyspark.sql import Window

    parts = f.ranked.join(f.cost, ["y", "x"]).groupBy(F.floor(F.col("rank") * 20).cast("int").alias("p")).agg(F.sum("cost").alias("cost"))
    curve = parts.select((1 - F.col("p") / 20).alias("prop_left"), F.sum("cost").over(Window.orderBy(F.desc("p"))).alias("cost_left"))
    return rounded(curves.fraction_for_cost(curve, 1000.0))


@query("occ cells", "SELECT DISTINCT c.y, c.x, 'ranking' AS missing_in FROM cells c WHERE mask_level=2 UNION ALL SELECT y, 0 AS x, 'landscape' FROM (SELECT DISTINCT y FROM cells WHERE mask_level=1) q")
def reload_consistency(f: Fixture) -> DataFrame:
    order = f.cells.where("mask_level <> 2").select("y", "x").union(f.cells.where("mask_level = 1").select("y", F.lit(0)).distinct())
    return greedy.consistent(f.occ, order)


# --- regions


@query("cells", "SELECT plu_id, COUNT(*) AS n_cells, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0, MAX(x) AS x1 FROM cells GROUP BY plu_id")
def plu_boxes(f: Fixture) -> DataFrame:
    return regions.unit_boxes(f.cells)


@query("occ cells", "SELECT plu_id, feature, SUM(value) AS value FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x GROUP BY plu_id, feature")
def plu_profiles(f: Fixture) -> DataFrame:
    return regions.unit_profiles(f.occ, f.cells)


@query("occ cells", """, u AS (SELECT y, x FROM cells WHERE (x+y)%7<>0), d AS (SELECT DISTINCT y, x FROM occ WHERE (x+2*y)%9<>0)
SELECT COUNT(*) FILTER (WHERE u.y IS NULL) AS without_unit, COUNT(*) FILTER (WHERE d.y IS NULL) AS without_data FROM u FULL OUTER JOIN d ON u.y=d.y AND u.x=d.x""")
def plu_alignment(f: Fixture) -> DataFrame:
    """Units and data that each lack some cells of the other."""
    return regions.alignment(f.cells.where("(x + y) % 7 <> 0"), f.occ.where("(x + 2 * y) % 9 <> 0"))


_TREE = ", known AS (SELECT t.id, CASE WHEN k.id IS NULL THEN -1 ELSE t.down_id END AS down_id FROM tree t LEFT JOIN tree k ON k.id=t.down_id), r AS (SELECT id, down_id AS below FROM known WHERE down_id<>-1 UNION ALL SELECT r.id, k.down_id FROM r JOIN known k ON k.id=r.below WHERE k.down_id<>-1)"


@query("tree", _TREE + " SELECT t.id, COUNT(below) AS below FROM tree t LEFT JOIN r ON r.id=t.id GROUP BY t.id", recursive=True)
def tree_downstream(f: Fixture) -> DataFrame:
    return regions.downstream_counts(f.tree)


@query("tree", _TREE + " SELECT t.id, COUNT(r.id) AS above FROM tree t LEFT JOIN r ON r.below=t.id GROUP BY t.id", recursive=True)
def tree_upstream(f: Fixture) -> DataFrame:
    return regions.upstream_counts(f.tree)


@query("tree", _TREE + " SELECT k.id, COALESCE(MIN(CASE WHEN q.down_id=-1 THEN q.id END), k.id) AS root FROM known k LEFT JOIN r ON r.id=k.id LEFT JOIN known q ON q.id=r.below GROUP BY k.id", recursive=True)
def basins(f: Fixture) -> DataFrame:
    return regions.basins(f.tree)


@query("tree occ cells", _TREE + ", p AS (SELECT plu_id, feature, SUM(value) AS value FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x GROUP BY plu_id, feature), e AS (SELECT id, below AS pos FROM r UNION ALL SELECT id, id FROM tree) SELECT pos AS plu_id, feature, SUM(value) AS value FROM e JOIN p ON p.plu_id=e.id GROUP BY pos, feature", recursive=True)
def tree_amounts(f: Fixture) -> DataFrame:
    return regions.upstream_amounts(f.tree, regions.unit_profiles(f.occ, f.cells))


@query("cells cost", "SELECT admu, COUNT(*) AS n_cells, SUM(cost) AS cost FROM cells c JOIN cost k ON k.y=c.y AND k.x=c.x GROUP BY admu")
def admu_counts(f: Fixture) -> DataFrame:
    return regions.counts(f.cells, f.cost)


@query("occ total cells", "SELECT admu, o.feature, SUM(value)/MAX(total) AS share FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x JOIN total t ON t.feature=o.feature GROUP BY admu, o.feature")
def admu_representation(f: Fixture) -> DataFrame:
    return regions.representation(f.occ, f.cells)


@query("features own_w", f"SELECT admu, f.feature, {_CW1} AS weight FROM own_w o JOIN features f ON f.feature=o.feature")
def admu_weights(f: Fixture) -> DataFrame:
    return regions.combined_weights(f.features, f.own_w, f.units)


@query("ranked cells", "SELECT k.y, k.x, admu, CAST(ROW_NUMBER() OVER (PARTITION BY admu ORDER BY step) AS DOUBLE)/COUNT(*) OVER (PARTITION BY admu) AS rank FROM ranked k JOIN cells c ON c.y=k.y AND c.x=k.x")
def admu_redistributed_rank(f: Fixture) -> DataFrame:
    return regions.redistributed(f.ranked, f.cells)


@query("ranked cells cost", "SELECT k.y, k.x, admu, SUM(cost) OVER (PARTITION BY admu ORDER BY step)/SUM(cost) OVER (PARTITION BY admu) AS rank FROM ranked k JOIN cells c ON c.y=k.y AND c.x=k.x JOIN cost a ON a.y=k.y AND a.x=k.x")
def admu_area_rank(f: Fixture) -> DataFrame:
    return regions.area_ranks(f.ranked, f.cells, f.cost)


def _regional(keys: str) -> str:
    return f""", n AS (SELECT COUNT(*) AS n FROM ranked), v AS (SELECT admu, o.feature, value, CAST(ceil(step*10/CAST(n AS DOUBLE)) AS INT) AS part FROM occ o JOIN cells c ON c.y=o.y AND c.x=o.x JOIN ranked k ON k.y=o.y AND k.x=o.x CROSS JOIN n),
e AS (SELECT admu, feature, SUM(value) AS total FROM v GROUP BY admu, feature), q AS (SELECT e.admu, e.feature, p.part, 1-COALESCE(SUM(value),0)/MAX(total) AS repr FROM e CROSS JOIN (SELECT CAST(range AS INT) AS part FROM range(1,11)) p LEFT JOIN v ON v.admu=e.admu AND v.feature=e.feature AND v.part<=p.part GROUP BY e.admu, e.feature, p.part)
SELECT {keys}, round(MIN(repr),6) AS min_rem, round(AVG(repr),6) AS mean_rem, round(MAX(repr),6) AS max_rem, round(SUM(repr*weight)/SUM(weight),6) AS wmean_rem FROM q JOIN features f ON f.feature=q.feature GROUP BY {keys}"""


@query("occ cells ranked features", _regional("admu, part"))
def admu_curves(f: Fixture) -> DataFrame:
    return rounded(regions.curves(f.occ, f.cells, f.ranked, f.features, 10))


@query("occ cells ranked features", _regional("admu, part, grp"))
def admu_group_curves(f: Fixture) -> DataFrame:
    return rounded(regions.curves(f.occ, f.cells, f.ranked, f.features, 10, by_group=True))


# --- patches, networks, analyses


_PATCH = """, top AS (SELECT y, x, CAST(y*128+x AS BIGINT) AS id, rank FROM ranked WHERE rank>=0.9), nx AS (SELECT a.id AS a, b.id AS b FROM top a JOIN top b ON b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1),
reach AS (SELECT id, id AS low FROM top UNION SELECT nx.b, r.low FROM reach r JOIN nx ON nx.a=r.id), lab AS (SELECT id, MIN(low) AS label FROM reach GROUP BY id),
spots AS (SELECT y, x, label, rank FROM top JOIN lab ON lab.id=top.id), stats AS (SELECT label, COUNT(*) AS area, AVG(rank) AS mean_rank, MAX(rank) AS top_rank, AVG(x) AS cx, AVG(y) AS cy, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0, MAX(x) AS x1 FROM spots GROUP BY label)"""
_PAIRS = """, pr AS (SELECT DISTINCT a.label AS a, b.label AS b FROM spots a JOIN spots b ON a.label<b.label AND b.y BETWEEN a.y-3 AND a.y+3 AND (a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)<=9)"""
_LEVELS = """, pf AS (SELECT label, feature, SUM(value) AS value FROM spots s JOIN occ o ON o.y=s.y AND o.x=s.x GROUP BY label, feature), mean AS (SELECT feature, SUM(value)/(SELECT SUM(area) FROM stats) AS m FROM pf GROUP BY feature),
lv AS (SELECT s.label, mean.feature, CASE WHEN d<0.01*m THEN 0 WHEN d<0.1*m THEN 1 WHEN d<m THEN 2 WHEN d<10*m THEN 3 WHEN d<100*m THEN 4 ELSE 5 END AS level FROM (SELECT s.label, mean.feature, m, COALESCE(value,0)/area AS d FROM stats s CROSS JOIN mean LEFT JOIN pf ON pf.label=s.label AND pf.feature=mean.feature) mean JOIN stats s ON s.label=mean.label),
sim2 AS (SELECT pr.a, pr.b, AVG(abs(x.level-y.level)) AS difference FROM pr JOIN lv x ON x.label=pr.a JOIN lv y ON y.label=pr.b AND y.feature=x.feature GROUP BY pr.a, pr.b)"""
_NETS = """, lk AS (SELECT a, b FROM sim2 WHERE difference<0.9 UNION SELECT b, a FROM sim2 WHERE difference<0.9), nr AS (SELECT label, label AS low FROM stats UNION SELECT lk.b, r.low FROM nr r JOIN lk ON lk.a=r.label),
net AS (SELECT label, MIN(low) AS network FROM nr GROUP BY label), seeded AS (SELECT DISTINCT network FROM net JOIN stats ON stats.label=net.label WHERE top_rank>=0.98)"""


def _labels(f: Fixture) -> DataFrame:
    return graph.patches(analyses.top(f.ranked, 0.1), GRID.xd)


@query("ranked", _PATCH + " SELECT label, area, round(mean_rank,9) AS mean_rank, round(top_rank,9) AS top_rank, round(cx,9) AS cx, round(cy,9) AS cy, y0, y1, x0, x1 FROM stats", recursive=True)
def spots(f: Fixture) -> DataFrame:
    return rounded(graph.patch_stats(_labels(f), f.ranked), 9)


@query("ranked", _PATCH.replace("JOIN top b ON b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1", "JOIN top b ON abs(a.y-b.y)+abs(a.x-b.x)=1") + " SELECT y, x, label FROM spots", recursive=True)
def components4(f: Fixture) -> DataFrame:
    return graph.patches(analyses.top(f.ranked, 0.1), GRID.xd, diagonal=False)


@query("ranked occ", _PATCH + " SELECT label, feature, SUM(value) AS value FROM spots s JOIN occ o ON o.y=s.y AND o.x=s.x GROUP BY label, feature", recursive=True)
def spot_features(f: Fixture) -> DataFrame:
    return graph.patch_features(_labels(f), f.occ)


@query("ranked", _PATCH + _PAIRS + " SELECT a, b FROM pr", recursive=True)
def spot_distance(f: Fixture) -> DataFrame:
    return graph.near_patches(_labels(f), 3)


@query("ranked occ", _PATCH + _PAIRS + _LEVELS + " SELECT a, b, round(difference,9) AS difference FROM sim2", recursive=True)
def spot_similarity(f: Fixture) -> DataFrame:
    labels = _labels(f)
    level = graph.levels(graph.patch_features(labels, f.occ), graph.patch_stats(labels, f.ranked))
    return rounded(graph.similarity(graph.near_patches(labels, 3), level), 9)


@query("ranked occ", _PATCH + _PAIRS + _LEVELS + _NETS + " SELECT y, x, s.label, seeded.network FROM spots s JOIN net ON net.label=s.label LEFT JOIN seeded ON seeded.network=net.network", recursive=True)
def networks(f: Fixture) -> DataFrame:
    return analyses.landscape_networks(f.ranked, f.occ, GRID.xd, 0.1, 0.02, 3, 0.9)


def _report_sql(key: str, groups: str) -> str:
    return f""", g AS ({groups}), ar AS (SELECT {key}, COUNT(*) AS area, AVG(rank) AS mean_rank, AVG(g.x) AS cx, AVG(g.y) AS cy FROM g JOIN ranked k ON k.y=g.y AND k.x=g.x GROUP BY {key}),
h AS (SELECT {key}, o.feature, SUM(value)/MAX(total) AS share FROM g JOIN occ o ON o.y=g.y AND o.x=g.x JOIN total t ON t.feature=o.feature GROUP BY {key}, o.feature),
hs AS (SELECT {key}, SUM(share) AS shares, COUNT(*) FILTER (WHERE share>0.1) AS over_10, COUNT(*) FILTER (WHERE share>0.01) AS over_1, COUNT(*) FILTER (WHERE share>0.001) AS over_01, COUNT(*) FILTER (WHERE share>0.0001) AS over_001 FROM h GROUP BY {key})
SELECT ar.{key}, area, round(mean_rank,6) AS mean_rank, round(cx,6) AS cx, round(cy,6) AS cy, round(shares,6) AS shares, over_10, over_1, over_01, over_001 FROM ar JOIN hs ON hs.{key}=ar.{key}"""


@query("ranked occ total", _PATCH + _report_sql("label", "SELECT y, x, label FROM spots"), recursive=True)
def network_report(f: Fixture) -> DataFrame:
    return rounded(analyses.unit_report(_labels(f), f.ranked, f.occ, "label"))


@query("ranked occ total cells", _report_sql("mask_level", "SELECT y, x, mask_level FROM cells"))
def unit_report(f: Fixture) -> DataFrame:
    return rounded(analyses.unit_report(f.cells.select("y", "x", "mask_level"), f.ranked, f.occ, "mask_level"))


_CLASS = ", c AS (SELECT a.y, a.x, a.rank AS r1, b.rank AS r2, CASE WHEN a.rank>=0.75 AND b.rank>=0.6 THEN 1 WHEN a.rank>=0.75 THEN 2 WHEN b.rank>=0.6 THEN 3 ELSE 0 END AS class FROM ranked a JOIN ranked2 b ON a.y=b.y AND a.x=b.x)"


@query("ranked ranked2", _CLASS + " SELECT y, x, CAST(class AS INT) AS class FROM c")
def comparison_classes(f: Fixture) -> DataFrame:
    return analyses.comparison(f.ranked, f.ranked2, 0.25, 0.4).select("y", "x", "class")


@query("ranked ranked2", _CLASS + " SELECT COUNT(*) FILTER (WHERE class IN (1,2)) AS n_first, COUNT(*) FILTER (WHERE class IN (1,3)) AS n_second, COUNT(*) FILTER (WHERE class=1) AS n_both, round(COUNT(*) FILTER (WHERE class=1)/CAST(COUNT(*) FILTER (WHERE class IN (1,2)) AS DOUBLE),9) AS overlap_first, round(COUNT(*) FILTER (WHERE class=1)/CAST(COUNT(*) FILTER (WHERE class IN (1,3)) AS DOUBLE),9) AS overlap_second, round(AVG(abs(r1-r2)),6) AS mean_difference FROM c")
def solution_comparison(f: Fixture) -> DataFrame:
    found = analyses.comparison_summary(f.ranked, f.ranked2, 0.25, 0.4)
    return rounded(rounded(found, 9, "overlap_first", "overlap_second"), 6, "mean_difference")


@query("ranked occ total cost features off8", """, top AS (SELECT y, x FROM ranked WHERE rank>=0.7), b AS (SELECT CAST(SUM(CASE WHEN q.y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS boundary, COUNT(*)//4 AS n FROM top t CROSS JOIN (SELECT * FROM off8 WHERE dy=0 OR dx=0) o LEFT JOIN top q ON q.y=t.y+dy AND q.x=t.x+dx),
s AS (SELECT t.feature, COALESCE(SUM(CASE WHEN p.y IS NOT NULL THEN value END),0)/MAX(total) AS share FROM total t JOIN occ o ON o.feature=t.feature LEFT JOIN top p ON p.y=o.y AND p.x=o.x GROUP BY t.feature)
SELECT boundary, n, (SELECT SUM(cost) FROM top JOIN cost c ON c.y=top.y AND c.x=top.x) AS cost, round(MIN(share),9) AS min_rem, round(AVG(share),9) AS mean_rem, round(SUM(share*weight)/SUM(weight),9) AS wmean_rem FROM b CROSS JOIN s JOIN features f ON f.feature=s.feature GROUP BY boundary, n""")
def top_fraction_boundary(f: Fixture) -> DataFrame:
    return rounded(analyses.fraction_report(f.ranked, f.occ, f.cost, f.features, 0.3), 9, "min_rem", "mean_rem", "wmean_rem")


@query("occ", "SELECT o.feature, CAST(floor(value*20/top) AS INT) AS bin, COUNT(*) AS n FROM occ o JOIN (SELECT feature, MAX(value) AS top FROM occ GROUP BY feature) m ON m.feature=o.feature GROUP BY 1,2")
def occurrence_histogram(f: Fixture) -> DataFrame:
    return analyses.histogram(f.occ)


@query("occ total", ", c AS (SELECT o.feature, SUM(value) OVER (PARTITION BY o.feature ORDER BY value DESC, y, x) AS s, ROW_NUMBER() OVER (PARTITION BY o.feature ORDER BY value DESC, y, x) AS k, total FROM occ o JOIN total t ON t.feature=o.feature) SELECT feature, MIN(k) AS n_cells FROM c WHERE s>=total*0.9 GROUP BY feature")
def cells_for_90pct(f: Fixture) -> DataFrame:
    return analyses.cells_for(f.occ, 0.9)


# --- corridors


def _top3(f: Fixture) -> DataFrame:
    return analyses.top(f.ranked, 0.3).select("y", "x")


@query()
def corridor_penalty_fast(f: Fixture) -> DataFrame:
    """Tests compare it with hand-made landscapes."""
    cells = _top3(f)
    return rounded(corridors.fast_penalty(cells, f.occ.join(cells, ["y", "x"], "left_semi"), GRID.xd, 1.0))


@query()
def corridor_penalty_exact(f: Fixture) -> DataFrame:
    cells = _top3(f)
    return rounded(corridors.exact_penalty(cells, f.occ.join(cells, ["y", "x"], "left_semi"), GRID.yd, GRID.xd, 1.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank every cell by core-area removal, a hundredth of what is left in a round, and give what each removal leaves of each feature."""
    f = Fixture(spark, sf_dir)
    occ = t.normalise(f.occ)
    n = t_present(f).count()
    ranking = cut(greedy.rank_small(occ, f.features, "caz", warp=-(-n // 4), whole_blocks=False, neighbours=True))
    return greedy.replay(occ, numbered(ranking, [F.col("round"), F.col("place")]))


__all__ = ["QUERIES", "SQL", "Column", "flagship", "root4"]
