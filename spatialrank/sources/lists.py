"""The small list files of a run: features, points, groups, profiles, matrices, trees and analyses.

They hold a line for each feature, unit or pair at most, so they are parsed on the driver; the tables made of
them are small dimension tables.
"""

from __future__ import annotations

import re
import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..landscape import Grid

SHORT = ("weight", "alpha", "profile", "radius", "exponent")
LONG = ("weight", "alpha", "profile", "radius", "w2", "tj", "exp1", "exp2")


class ListError(ValueError):
    """A file with lines that can't be used; ``problems`` has (line number, what)."""

    def __init__(self, path: str, problems: list[tuple[int, str]]):
        super().__init__(f"{path}: " + "; ".join(f"line {n}: {what}" for n, what in problems))
        self.problems = problems


def lines(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Lines without comments and blanks, with their numbers from 1."""
    text = spark.read.text(path, wholetext=True).first()
    rows = enumerate((text.value if text else "").splitlines(), 1)
    return [(n, kept) for n, line in rows if (kept := re.sub(r"#.*", "", line).strip())]


def _numbers(words: list[str]) -> list[float]:
    return [float(w) for w in words]


def numbers(spark: SparkSession, path: str, least: int, most: int | None = None) -> list[list[float]]:
    """Rows of numbers, each of ``least`` to ``most`` columns."""
    rows, problems = [], []
    for n, line in lines(spark, path):
        try:
            row = _numbers(line.split())
            if not least <= len(row) <= (most or len(row)):
                raise ValueError(f"{len(row)} columns")
            rows.append(row)
        except ValueError as e:
            problems.append((n, str(e)))
    if problems:
        raise ListError(path, problems)
    return rows


def _with_path(line: str, columns: int) -> tuple[list[float], str]:
    words = shlex.split(line, posix=True)
    return _numbers(words[:columns]), " ".join(words[columns:])


def feature_list(spark: SparkSession, path: str, long: bool | None = None) -> DataFrame:
    """feature, the columns of the short or the long form, and path; the first line shows which form it is."""
    rows, problems = [], []
    for n, line in lines(spark, path):
        if long is None:
            try:
                _, rest = _with_path(line, 8)
                long = bool(rest)
            except ValueError:
                long = False
        try:
            values, file = _with_path(line, 8 if long else 5)
            if not file or len(values) < (8 if long else 5):
                raise ValueError("too few columns")
            rows.append((len(rows), *values, file))
        except ValueError as e:
            problems.append((n, str(e)))
    if problems:
        raise ListError(path, problems)
    names = LONG if long else SHORT
    schema = "feature int, " + ", ".join(f"{c} double" for c in names) + ", path string"
    return spark.createDataFrame(rows, schema)


def point_observations(spark: SparkSession, path: str, grid: Grid, cells: DataFrame, feature: int) -> DataFrame:
    """y, x, feature, value of points `X Y abundance [sd]` that hit a present cell, summing to 1."""
    words = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    number = lambda i: F.try_element_at(words, F.lit(i)).try_cast("double")
    points = spark.read.text(path).select(number(1).alias("X"), number(2).alias("Y"), number(3).alias("value")).dropna()
    placed = grid.cell(points).where(F.col("y").between(0, grid.yd - 1) & F.col("x").between(0, grid.xd - 1))
    hits = placed.join(cells.select("y", "x"), ["y", "x"], "left_semi").groupBy("y", "x").agg(F.sum("value").alias("value"))
    return hits.crossJoin(F.broadcast(hits.agg(F.sum("value").alias("total")))).select("y", "x", F.lit(feature).alias("feature"), (F.col("value") / F.col("total")).alias("value"))


def groups(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Five to seven whole numbers for each feature, in the order of the feature list."""
    rows = numbers(spark, path, 5, 7)
    if len(rows) != n_features:
        raise ValueError(f"{path}: {len(rows)} rows for {n_features} features")
    names = ("grp_out", "grp_cond", "grp_ret", "ret_mode", "kernel_ds", "kernel_mct", "kernel_ia")
    return spark.createDataFrame([(i, *(int(v) for v in r), *[-1] * (7 - len(r))) for i, r in enumerate(rows)], "feature int, " + ", ".join(f"{n} int" for n in names))


def profiles(spark: SparkSession, path: str) -> dict[int, list[tuple[float, float]]]:
    """Response profiles: id and pairs (share left, response), shares falling from 1 to 0."""
    out = {}
    for row in numbers(spark, path, 3):
        pairs = list(zip(row[1::2], row[2::2], strict=True))
        shares = [p for p, _ in pairs]
        if shares != sorted(shares, reverse=True):
            raise ValueError(f"{path}: shares of profile {int(row[0])} must fall")
        out[int(row[0])] = pairs
    return out


def interactions(spark: SparkSession, path: str) -> list[tuple[int, int, float, int, float]]:
    """(resource, consumer, alpha, type, gamma), features from 0."""
    out = [(int(a) - 1, int(b) - 1, alpha, int(kind), gamma) for a, b, alpha, kind, gamma in numbers(spark, path, 5, 5)]
    if any(kind not in (1, 2) for _, _, _, kind, _ in out):
        raise ValueError(f"{path}: the type is 1 or 2")
    return out


def matrix(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A square matrix of numbers not under 0 as (i, j, w)."""
    rows = numbers(spark, path, 1)
    if any(len(r) != len(rows) for r in rows) or (n is not None and len(rows) != n):
        raise ValueError(f"{path}: not square" + (f" of {n}" if n else ""))
    if any(v < 0 for r in rows for v in r):
        raise ValueError(f"{path}: a weight under 0")
    return spark.createDataFrame([(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "i int, j int, w double")


def weighted_paths(spark: SparkSession, path: str, expect: int | None = None) -> list[tuple[float, str]]:
    """`weight path` or `index path` for each line."""
    out = [((values := _with_path(line, 1))[0][0], values[1]) for _, line in lines(spark, path)]
    if expect is not None and len(out) != expect:
        raise ValueError(f"{path}: {len(out)} layers, not {expect}")
    return out


def tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in numbers(spark, path, 2, 2)], "id int, down_id int")


def kernel_points(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    points = [(a, b) for a, b in numbers(spark, path, 2, 2)]
    if any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError(f"{path}: distances must increase")
    return points


def admin_units(spark: SparkSession, path: str) -> DataFrame:
    rows = [(w[0], float(w[1]), float(w[2]), " ".join(w[3:])) for w in (line.split() for _, line in lines(spark, path))]
    return spark.createDataFrame([(int(i), g, loc, name) for i, g, loc, name in rows], "admu int, global_w double, local_w double, name string")


def admin_weights(spark: SparkSession, path: str, units: list[int]) -> DataFrame:
    """A row for each feature, a column for each unit."""
    rows = numbers(spark, path, len(units), len(units))
    return spark.createDataFrame([(f, u, w) for f, r in enumerate(rows) for u, w in zip(units, r, strict=True)], "feature int, admu int, w double")


def unknown_units(layer: DataFrame, units: DataFrame, name: str = "admu") -> DataFrame:
    """The ids of a unit layer that the descriptions don't have."""
    return layer.select(name).distinct().join(units, name, "left_anti")


#: The analyses and the columns of each (fixed values).
ANALYSES = {"LSI": ("f1", "f2", "distance", "similarity"), "LSC": ("f1", "f2", "compare", "out"), "LSM": ("mask", "f2", "distance", "similarity"), "LSB": ("mask", "f1", "f2", "distance", "similarity")}
_TEXT = ("compare", "out", "mask")


def analyses(spark: SparkSession, path: str) -> list[dict]:
    out = []
    for n, line in lines(spark, path):
        kind, *words = shlex.split(line)
        names = ANALYSES.get(kind)
        if names is None or len(words) != len(names):
            raise ListError(path, [(n, f"{kind} with {len(words)} columns")])
        out.append({"kind": kind} | {k: w if k in _TEXT else float(w) for k, w in zip(names, words, strict=True)})
    return out
