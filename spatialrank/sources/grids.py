"""Grid layers: ASCII grids in and out, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..landscape import Grid

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def _numbered(lines: DataFrame) -> DataFrame:
    """Text lines with their number from 0: blocks of the file in order, lines in order within each.

    Only a count for each block is gathered in one place.
    """
    rows = lines.select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(first.select("block", "first", before.alias("before"))), "block").select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def read_header(spark: SparkSession, path: str) -> tuple[Grid, float | None]:
    """The shape and place of a grid, and its missing value."""
    head = {}
    for row in spark.read.text(path).where(F.lower("value").rlike(r"^\s*(?:" + "|".join(HEADER) + r")\b")).limit(len(HEADER)).collect():
        key, value = row.value.split()[:2]
        head[key.lower()] = float(value)
    missing = [k for k in HEADER[:5] if k not in head]
    if missing:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    grid = Grid(int(head["nrows"]), int(head["ncols"]), head["xllcorner"], head["yllcorner"], head["cellsize"])
    return grid, head.get("nodata_value")


def read_grid(spark: SparkSession, path: str, name: str = "value", expect: Grid | None = None, frame: bool = False) -> DataFrame:
    """y, x and the value of each cell that isn't missing; the outermost frame is missing unless ``frame``."""
    grid, nodata = read_header(spark, path)
    if expect is not None and (grid.yd, grid.xd) != (expect.yd, expect.xd):
        raise ValueError(f"{path}: {grid.yd} x {grid.xd} cells, not {expect.yd} x {expect.xd}")
    head = 5 + (nodata is not None)
    rows = _numbered(spark.read.text(path)).where(F.col("line") >= head).select((F.col("line") - head).cast("int").alias("y"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("x", "word"))
    values = rows.select("y", "x", F.col("word").try_cast("double").alias(name)).where(F.col(name).isNotNull() & ~F.isnan(name))
    if nodata is not None:
        values = values.where(F.col(name) != nodata)
    return values if frame else grid.inside(values)


def read_layers(spark: SparkSession, paths: list[str], grid: Grid) -> DataFrame:
    """One occurrence table of many layers; a layer's number is its feature.  Negative values are missing."""
    out = None
    for i, path in enumerate(paths):
        layer = read_grid(spark, path, expect=grid).where("value >= 0").select("y", "x", F.lit(i).alias("feature"), "value")
        out = layer if out is None else out.unionByName(layer)
    return out


def grid_lines(layer: DataFrame, grid: Grid, name: str = "value", missing: str = "-1") -> DataFrame:
    """line and value: the text of an ASCII grid; a task makes whole lines."""
    cells = layer.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", F.col(name).cast("string")))).alias("row"))
    every = layer.sparkSession.range(grid.yd).select(F.col("id").cast("int").alias("y")).join(cells, "y", "left")
    words = F.transform(F.sequence(F.lit(0), F.lit(grid.xd - 1)), lambda x: F.coalesce(F.try_element_at("row", x), F.lit(missing)))
    body = every.select((F.col("y") + 6).alias("line"), F.array_join(words, " ").alias("value"))
    head = [("ncols", grid.xd), ("nrows", grid.yd), ("xllcorner", grid.xc), ("yllcorner", grid.yc), ("cellsize", grid.cs), ("NODATA_value", missing)]
    return layer.sparkSession.createDataFrame([(i, f"{k} {v}") for i, (k, v) in enumerate(head)], "line int, value string").union(body)


def write_grid(layer: DataFrame, grid: Grid, path: str, name: str = "value", missing: str = "-1") -> None:
    """An ASCII grid as one text file in a folder; lines are made in parallel and put in order at the end."""
    grid_lines(layer, grid, name, missing).repartition(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def save_occurrences(occ: DataFrame, path: str) -> None:
    """The occurrence table, for later runs: by feature, so that a reader prunes to the features it needs."""
    occ.select("y", "x", "feature", "value").repartition("feature").write.mode("overwrite").partitionBy("feature").parquet(path)


def load_occurrences(spark: SparkSession, path: str, grid: Grid | None = None) -> DataFrame:
    occ = spark.read.schema("y int, x int, value double, feature int").parquet(path).select("y", "x", "feature", "value")
    if grid is not None and occ.where((F.col("y") >= grid.yd) | (F.col("x") >= grid.xd)).limit(1).count():
        raise ValueError(f"{path}: cells outside {grid.yd} x {grid.xd}")
    return occ


def save_stages(stages: dict[str, DataFrame], path: str) -> None:
    """The occurrence table after each named transform."""
    for name, occ in stages.items():
        occ.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/stage={name}")


def save_table(df: DataFrame, path: str) -> None:
    """Any report or map as Parquet."""
    df.write.mode("overwrite").parquet(path)
