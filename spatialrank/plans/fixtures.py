"""Landscapes derived from the star-schema tables, as DataFrames and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..landscape import Grid
from ..lineage import numbered

GRID = Grid(96, 128)
#: name -> (the expressions it needs, its SQL); valid in both engines.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "occ": ((), """SELECT CAST((l_partkey*7+l_linenumber)%96 AS INT) AS y, CAST(l_orderkey%128 AS INT) AS x,
       CAST(CAST(regexp_extract(p_brand,'([0-9]+)',1) AS INT)%8 AS INT) AS feature, CAST(SUM(l_quantity) AS DOUBLE) AS value
FROM lineitem JOIN part ON l_partkey=p_partkey
WHERE l_returnflag='R' AND l_quantity>=25 AND (l_partkey*7+l_linenumber)%96 BETWEEN 1 AND 94 AND l_orderkey%128 BETWEEN 1 AND 126 GROUP BY 1,2,3"""),
    "features": ((), """SELECT CAST(n_nationkey AS INT) AS feature, n_name AS name, CAST(n_regionkey+1 AS DOUBLE) AS weight, CAST(0.25 AS DOUBLE) AS sr_par,
       CAST(1.0 AS DOUBLE) AS w2, CAST(0.3 AS DOUBLE) AS tj, CAST(0.5 AS DOUBLE) AS exp1, CAST(0.25 AS DOUBLE) AS exp2, CAST(n_nationkey%3 AS INT) AS grp
FROM nation WHERE n_nationkey<8"""),
    "cells": (("occ",), """SELECT y, x, CAST(FLOOR((x+y)/64.0) AS INT) AS mask_level, CAST(FLOOR(y/8.0)*16+FLOOR(x/8.0) AS INT) AS plu_id, CAST(FLOOR(x/26.0) AS INT) AS admu,
       CASE WHEN (x*5+y*3)%17=0 THEN NULL ELSE CAST((x*7+y*13)%11 AS DOUBLE)/10 END AS cond, CAST((x*3+y*5)%7 AS DOUBLE)/10 AS beta
FROM (SELECT DISTINCT y, x FROM occ) c"""),
    "cost": (("cells",), """SELECT c.y, c.x, CAST(1+COALESCE(o.n,0) AS DOUBLE) AS cost FROM cells c LEFT JOIN (
  SELECT CAST(o_custkey%96 AS INT) AS y, CAST(o_orderkey%128 AS INT) AS x, COUNT(*) AS n FROM orders GROUP BY 1,2) o ON c.y=o.y AND c.x=o.x"""),
    "rawcost": ((), "SELECT CAST(o_custkey%96 AS INT) AS y, CAST(o_orderkey%128 AS INT) AS x, CAST(COUNT(*)-1 AS DOUBLE) AS cost FROM orders GROUP BY 1,2"),
    "sizes": (("cells",), "SELECT plu_id, COUNT(*) AS n_cells FROM cells GROUP BY plu_id"),
    "profiles": (("cells", "occ"), "SELECT plu_id, feature, SUM(value) AS value FROM occ JOIN cells ON occ.y=cells.y AND occ.x=cells.x GROUP BY plu_id, feature"),
    "ssi": ((), """SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS INT) AS feature, CAST(event_id%96 AS INT) AS y,
       CAST((user_id*31+event_id)%128 AS INT) AS x, CAST(SUM(FLOOR(value)) AS DOUBLE) AS value FROM events GROUP BY 1,2,3"""),
    "tree": (("cells",), """SELECT DISTINCT plu_id AS id, CASE WHEN plu_id=0 THEN -1 ELSE CAST(FLOOR((plu_id-1)/4.0) AS INT) END AS down_id FROM cells"""),
    "ranked": (("occ",), """SELECT y, x, step, CAST(step AS DOUBLE)/n AS rank FROM (
  SELECT y, x, ROW_NUMBER() OVER (ORDER BY s, y, x) AS step, COUNT(*) OVER () AS n FROM (SELECT y, x, SUM(value) AS s FROM occ GROUP BY y, x) a) b"""),
    "ranked2": (("occ",), """SELECT y, x, step, CAST(step AS DOUBLE)/n AS rank FROM (
  SELECT y, x, ROW_NUMBER() OVER (ORDER BY m, y, x) AS step, COUNT(*) OVER () AS n FROM (SELECT y, x, MAX(value) AS m FROM occ GROUP BY y, x) a) b"""),
    "win": (("occ",), "SELECT * FROM occ WHERE y BETWEEN 1 AND 12 AND x BETWEEN 1 AND 16"),
    "sim": ((), "SELECT i, j, 1.0/(1+abs(i-j)) AS w FROM (SELECT CAST(n_nationkey AS INT) AS i FROM nation WHERE n_nationkey<8) a, (SELECT CAST(n_nationkey AS INT) AS j FROM nation WHERE n_nationkey<8) b"),
    "units": (("cells",), "SELECT DISTINCT admu, CAST(0.5 AS DOUBLE) AS global_w, CAST(0.5 AS DOUBLE) AS local_w FROM cells"),
    "own_w": (("features", "units"), "SELECT feature, admu, CAST(1+(feature+admu)%3 AS DOUBLE) AS w FROM features, units"),
    "total": (("occ",), "SELECT feature, SUM(value) AS total FROM occ GROUP BY feature"),
    "norm": (("occ", "total"), "SELECT y, x, occ.feature, value/total AS value FROM occ JOIN total ON occ.feature=total.feature"),
    "present": (("occ",), "SELECT DISTINCT y, x FROM occ"),
    "off8": ((), "SELECT * FROM (VALUES (-1,0),(1,0),(0,-1),(0,1),(-1,-1),(-1,1),(1,-1),(1,1)) t(dy,dx)"),
    "nb": (("present", "off8"), """SELECT p.y, p.x, COUNT(q.y) FILTER (WHERE dy=0 OR dx=0) AS nb4, COUNT(q.y) AS nb8
FROM present p CROSS JOIN off8 LEFT JOIN present q ON q.y=p.y+dy AND q.x=p.x+dx GROUP BY p.y, p.x"""),
}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``body``, a query or ", more expressions" and a query, with the common table expressions it needs before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


class Fixture:
    """The tables of one data directory as a landscape, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in CTES:
            raise AttributeError(name)
        if name not in self._made:
            needs, text = CTES[name]
            tables = {t: self.source(t) for t in ("lineitem", "part", "nation", "orders", "events")} | {n: getattr(self, n) for n in needs}
            used = {t: df for t, df in tables.items() if t in text}
            for t in sorted(used, key=len, reverse=True):
                text = _named(text, t)
            self._made[name] = self.spark.sql(text, **used)
        return self._made[name]

    def _order(self, worth: str) -> DataFrame:
        """The cells by the sum or the max of their values: numbered in range partitions, as no task could hold them all."""
        if worth not in self._made:
            rows = numbered(self.occ.groupBy("y", "x").agg(F.expr(f"{worth}(value)").alias("worth")), [F.col(c) for c in ("worth", "y", "x")])
            n = rows.agg(F.count("*").alias("n"))
            self._made[worth] = rows.crossJoin(F.broadcast(n)).select("y", "x", F.col("step").cast("long").alias("step"), (F.col("step") / F.col("n")).alias("rank"))
        return self._made[worth]

    @property
    def ranked(self) -> DataFrame:
        return self._order("sum")

    @property
    def ranked2(self) -> DataFrame:
        return self._order("max")

    @property
    def negative(self) -> DataFrame:
        """The features with the weight of feature 7 at -1."""
        return self.features.withColumn("weight", F.when(F.col("feature") == 7, -1.0).otherwise(F.col("weight")))


def _named(text: str, table: str) -> str:
    """Tables after FROM, JOIN or a comma become parameters."""
    import re

    return re.sub(rf"(?i)(\bFROM\s+|\bJOIN\s+|,\s*){table}\b(?!\.)", lambda m: f"{m[1]}{{{table}}} AS {table}" if not re.match(r"\s+[a-z]\b(?!\.)", text[m.end() :]) else f"{m[1]}{{{table}}}", text)
