"""A landscape: the occurrence table and the tables beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Rows from the top, columns from the left; the outermost frame is always missing."""

    yd: int
    xd: int
    xc: float = 0.0
    yc: float = 0.0
    cs: float = 1.0

    def inside(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("y").between(1, self.yd - 2) & F.col("x").between(1, self.xd - 2))

    def cell(self, rows: DataFrame, east: str = "X", north: str = "Y") -> DataFrame:
        """Map coordinates to y and x."""
        x = F.floor((F.col(east) - self.xc) / self.cs).cast("int")
        y = (F.lit(self.yd - 1) - F.floor((F.col(north) - self.yc) / self.cs)).cast("int")
        return rows.withColumn("x", x).withColumn("y", y)


@dataclass(frozen=True)
class Landscape:
    grid: Grid
    occ: DataFrame
    features: DataFrame
    cells: DataFrame
    cost: DataFrame


def present(occ: DataFrame) -> DataFrame:
    """The cells with any occurrence."""
    return occ.select("y", "x").distinct()
