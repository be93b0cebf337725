"""Queries of unit and tree losses, point features, maps and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves, focal, regions, rules
from ..operators import transforms as t
from .fixtures import Fixture
from .queries import _TREE, G_SQL, PROFILE, query, rounded

_LEFT = "plu_id%5<>0"
_RATIO = "CASE WHEN {0}0>0 THEN {1} ELSE {2} END"
_UP, _DOWN = (_RATIO.format(k, G_SQL.format(f"(CAST({k}_ AS DOUBLE)/{k}0)"), "1.0") for k in ("up", "down"))
_UP_LESS, _DOWN_LESS = (_RATIO.format(k, G_SQL.format(f"(CAST({k}_-taken AS DOUBLE)/{k}0)"), "0.0") for k in ("up", "down"))


@query("occ cells present off8", f""", now AS (SELECT y, x, plu_id FROM cells WHERE (x+3*y)%4<>0),
around AS (SELECT n.y, n.x, n.plu_id, COUNT(DISTINCT (o.dy, o.dx)) FILTER (WHERE p.y IS NOT NULL) AS orig, COUNT(DISTINCT (o.dy, o.dx)) FILTER (WHERE q.y IS NOT NULL) AS left_
  FROM now n CROSS JOIN off8 o LEFT JOIN present p ON p.y=n.y+o.dy AND p.x=n.x+o.dx LEFT JOIN now q ON q.y=n.y+o.dy AND q.x=n.x+o.dx GROUP BY ALL),
share AS (SELECT *, CASE WHEN orig>0 THEN CAST(left_ AS DOUBLE)/orig ELSE 1.0 END AS s FROM around),
own AS (SELECT plu_id, feature, value*{G_SQL.format('s')} AS loss FROM share JOIN occ ON occ.y=share.y AND occ.x=share.x),
near AS (SELECT a.y, a.x, u.plu_id, COUNT(*) AS k FROM around a CROSS JOIN off8 o JOIN now u ON u.y=a.y+o.dy AND u.x=a.x+o.dx WHERE u.plu_id<>a.plu_id GROUP BY ALL),
fell AS (SELECT n.plu_id, a.y, a.x, {G_SQL.format('(CAST(left_ AS DOUBLE)/orig)')}-{G_SQL.format('(CAST(left_-k AS DOUBLE)/orig)')} AS fall FROM near n JOIN around a ON a.y=n.y AND a.x=n.x WHERE orig>0),
given AS (SELECT f.plu_id, feature, value*fall AS loss FROM fell f JOIN occ ON occ.y=f.y AND occ.x=f.x WHERE value>0)
SELECT plu_id, feature, ROUND(SUM(loss), 6) AS loss FROM (SELECT * FROM own UNION ALL SELECT * FROM given) a GROUP BY plu_id, feature""")
def plu_quality_loss(f: Fixture) -> DataFrame:
    now = f.cells.where("(x + 3 * y) % 4 <> 0").select("y", "x", "plu_id")
    held = f.occ.join(now.select("y", "x"), ["y", "x"], "left_semi")
    return rounded(rules.unit_quality_loss(held, now.select("y", "x"), f.cells.select("y", "x"), now, 1, PROFILE))


@query("tree sizes profiles", _TREE + f""", here AS (SELECT t.id, COALESCE((SELECT SUM(n_cells) FROM r JOIN sizes s ON s.plu_id=r.id WHERE r.below=t.id), 0) AS up0,
  COALESCE((SELECT SUM(n_cells) FROM r JOIN sizes s ON s.plu_id=r.id WHERE r.below=t.id AND s.{_LEFT}), 0) AS up_,
  COALESCE((SELECT SUM(n_cells) FROM r JOIN sizes s ON s.plu_id=r.below WHERE r.id=t.id), 0) AS down0,
  COALESCE((SELECT SUM(n_cells) FROM r JOIN sizes s ON s.plu_id=r.below WHERE r.id=t.id AND s.{_LEFT}), 0) AS down_ FROM tree t WHERE t.id%5<>0),
own AS (SELECT id AS plu_id, id AS of_, ({_UP})*({_DOWN}) AS share FROM here),
under AS (SELECT r.id AS plu_id, h.id AS of_, ({_DOWN})*(({_UP})-({_UP_LESS})) AS share FROM (SELECT r.id, r.below, s.n_cells AS taken FROM r JOIN sizes s ON s.plu_id=r.id) r JOIN here h ON h.id=r.below WHERE r.id%5<>0),
over_ AS (SELECT r.below AS plu_id, h.id AS of_, ({_UP})*(({_DOWN})-({_DOWN_LESS})) AS share FROM (SELECT r.id, r.below, s.n_cells AS taken FROM r JOIN sizes s ON s.plu_id=r.below) r JOIN here h ON h.id=r.id WHERE r.below%5<>0)
SELECT s.plu_id, feature, ROUND(SUM(value*share), 6) AS loss FROM (SELECT * FROM own UNION ALL SELECT * FROM under UNION ALL SELECT * FROM over_) s JOIN profiles p ON p.plu_id=s.of_ GROUP BY s.plu_id, feature""", recursive=True)  # fmt: skip
def tree_connectivity_loss(f: Fixture) -> DataFrame:
    left = f.tree.where("id % 5 <> 0").select("id")
    return rounded(regions.tree_loss(f.tree, f.profiles, f.sizes, left, PROFILE, PROFILE))


@query("occ ranked features total", """, placed AS (SELECT y, x, CAST(CEIL(step*100/n) AS INT) AS block FROM ranked, (SELECT COUNT(*) AS n FROM ranked) k),
lost AS (SELECT feature, block, SUM(value) AS v FROM occ JOIN placed ON occ.y=placed.y AND occ.x=placed.x GROUP BY feature, block),
every AS (SELECT total.feature, total, b.block, COALESCE(v, 0) AS v FROM total JOIN features ON features.feature=total.feature AND weight>=0 CROSS JOIN (SELECT unnest(range(1, 101)) AS block) b LEFT JOIN lost ON lost.feature=total.feature AND lost.block=b.block),
gone AS (SELECT block, COALESCE(SUM(v) OVER (PARTITION BY feature ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/total AS lost FROM every),
least AS (SELECT block, MAX(lost) AS l FROM gone GROUP BY block)
SELECT y, x, ROUND(COALESCE(l, 0), 6) AS prop_loss FROM placed LEFT JOIN least ON least.block=placed.block""")
def prop_loss_map(f: Fixture) -> DataFrame:
    return rounded(curves.loss_map(f.occ, f.ranked, f.features))


@query("occ cost", """, c AS (SELECT feature, CAST(FLOOR(SUM(value*y)/SUM(value)+0.5) AS INT) AS y, CAST(FLOOR(SUM(value*x)/SUM(value)+0.5) AS INT) AS x FROM occ GROUP BY feature), m AS (SELECT MAX(cost) AS top FROM cost)
SELECT feature, ROUND(0.5*sqrt(COALESCE(cost, top))/sqrt(top), 6) AS alpha FROM c CROSS JOIN m LEFT JOIN cost ON cost.y=c.y AND cost.x=c.x""")
def cell_size_alpha(f: Fixture) -> DataFrame:
    area = f.cost.withColumnRenamed("cost", "area")
    return rounded(t.cell_size_alphas(f.features.withColumn("alpha", F.lit(0.5)), f.occ, area))


@query("present off8", "SELECT DISTINCT p.y+dy AS y, p.x+dx AS x FROM present p CROSS JOIN off8 WHERE NOT EXISTS (SELECT 1 FROM present q WHERE q.y=p.y+dy AND q.x=p.x+dx)")
def map_border(f: Fixture) -> DataFrame:
    return focal.border(f.present)


_RUNS = ", ".join(f"{pos}-ROW_NUMBER() OVER (PARTITION BY {line} ORDER BY {pos}) AS r{i}" for i, (line, pos) in enumerate((("y", "x"), ("x", "y"), ("y-x", "x"), ("y+x", "x"))))
_ROOM = "+".join(f"power(least({pos}-MIN({pos}) OVER (PARTITION BY {line}, r{i}), MAX({pos}) OVER (PARTITION BY {line}, r{i})-{pos})+1, 2)" for i, (line, pos) in enumerate((("y", "x"), ("x", "y"), ("y-x", "x"), ("y+x", "x"))))


@query("present", f", runs AS (SELECT y, x, {_RUNS} FROM present) SELECT y, x, CAST(FLOOR(sqrt({_ROOM})) AS INT) AS room FROM runs")
def clearance_map(f: Fixture) -> DataFrame:
    return focal.clearance(f.present)


@query()
def resampled_features(f: Fixture) -> DataFrame:
    """Five features without replacement; which, is by a hash that SQL engines don't share."""
    return t.subsampled(f.features, 5, 3).select("feature", "name", "weight")


@query("ranked occ", """, rounds AS (SELECT CAST(CEIL(step*100/n) AS BIGINT) AS round, MAX(s) AS threshold FROM ranked JOIN (SELECT y, x, SUM(value) AS s FROM occ GROUP BY y, x) v ON v.y=ranked.y AND v.x=ranked.x CROSS JOIN (SELECT COUNT(*) AS n FROM ranked) k GROUP BY 1),
numbered AS (SELECT round, threshold, ROW_NUMBER() OVER (ORDER BY round) AS i FROM rounds),
walk AS (SELECT i, round, threshold AS average FROM numbered WHERE i=1 UNION ALL SELECT n.i, n.round, w.average*0.95+n.threshold*(1-0.95) FROM walk w JOIN numbered n ON n.i=w.i+1)
SELECT round, ROUND(average, 6) AS average FROM walk""", recursive=True)
def threshold_average(f: Fixture) -> DataFrame:
    worth = f.occ.groupBy("y", "x").agg(F.sum("value").alias("s"))
    n = f.ranked.agg(F.count("*").alias("n"))
    rows = f.ranked.join(worth, ["y", "x"]).crossJoin(F.broadcast(n))
    return rounded(curves.moving_average(rows.groupBy(F.ceil(F.col("step") * 100 / F.col("n")).alias("round")).agg(F.max("s").alias("threshold")), "threshold"))


@query("ssi ranked", "SELECT feature, COUNT(*) AS n_cells, SUM(value) AS total, ROUND(MAX(rank), 6) AS lost_at FROM ssi JOIN ranked ON ranked.y=ssi.y AND ranked.x=ssi.x GROUP BY feature")
def point_feature_report(f: Fixture) -> DataFrame:
    return rounded(curves.point_report(f.ssi, f.ranked), 6, "lost_at")


_POINTS = ", s AS (SELECT feature, SUM(value) AS total FROM ssi GROUP BY feature), v AS (SELECT y, x, ssi.feature, value/total AS v, weight, 1.0 AS r FROM ssi JOIN s ON s.feature=ssi.feature JOIN features ON features.feature=ssi.feature) "


def _points(f: Fixture, rule: str) -> DataFrame:
    now = f.features.withColumn("r", F.lit(1.0))
    return rounded(rules.point_deltas(t.normalise(f.ssi), now, rule), 9)


@query("ssi features", _POINTS + "SELECT y, x, ROUND(MAX(weight*v/r), 9) AS delta FROM v GROUP BY y, x")
def delta_points_caz(f: Fixture) -> DataFrame:
    return _points(f, "caz")


@query("ssi features", _POINTS + "SELECT y, x, ROUND(SUM(weight*(sqrt(sqrt(r))-sqrt(sqrt(greatest(r-v, 0))))), 9) AS delta FROM v GROUP BY y, x")
def delta_points_abf(f: Fixture) -> DataFrame:
    return _points(f, "abf")


@query("rawcost present", "SELECT COALESCE(SUM(cost) FILTER (WHERE p.y IS NOT NULL), 0) AS inside, COALESCE(SUM(cost) FILTER (WHERE p.y IS NULL), 0) AS outside, COUNT(*) FILTER (WHERE p.y IS NOT NULL AND NOT COALESCE(cost>0, false)) AS bad_cells FROM rawcost c FULL OUTER JOIN present p ON p.y=c.y AND p.x=c.x")
def cost_inside_outside(f: Fixture) -> DataFrame:
    return t.cost_report(f.rawcost, f.present)


@query("occ", "SELECT CAST(SUM(n) AS BIGINT) AS occurrences, COUNT(*) AS cells, ROUND(AVG(n), 6) AS mean_features, MAX(n) AS most_features, (SELECT COUNT(DISTINCT feature) FROM occ) AS features, ROUND(SUM(n)/(COUNT(*)*(SELECT COUNT(DISTINCT feature) FROM occ)), 6) AS filled FROM (SELECT y, x, COUNT(*) AS n FROM occ GROUP BY y, x) a")
def occurrence_density(f: Fixture) -> DataFrame:
    return rounded(t.density_report(f.occ))


@query("occ cells ranked features", """, n AS (SELECT COUNT(*) AS n FROM ranked), rows_ AS (SELECT admu, feature, CAST(CEIL(step*10/n) AS INT) AS part, value FROM occ JOIN cells ON cells.y=occ.y AND cells.x=occ.x JOIN ranked ON ranked.y=occ.y AND ranked.x=occ.x CROSS JOIN n),
whole AS (SELECT admu, feature, SUM(value) AS total FROM rows_ GROUP BY admu, feature), every AS (SELECT w.admu, w.feature, total, b.part, COALESCE((SELECT SUM(value) FROM rows_ r WHERE r.admu=w.admu AND r.feature=w.feature AND r.part<=b.part), 0) AS lost FROM whole w CROSS JOIN (SELECT unnest(range(1, 11)) AS part) b)
SELECT e.admu, CAST(e.part AS INT) AS part, e.feature, ROUND(1-lost/total, 6) AS min_rem, ROUND(1-lost/total, 6) AS mean_rem, ROUND(1-lost/total, 6) AS max_rem, ROUND(1-lost/total, 6) AS wmean_rem FROM every e JOIN features f ON f.feature=e.feature WHERE weight>=0""")
def admu_feature_curves(f: Fixture) -> DataFrame:
    return rounded(regions.curves(f.occ, f.cells, f.ranked, f.features, 10, by_feature=True))
