"""Ink strokes: arrays of points, selected, erased and found by geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR2 = 0.003
SIDE = NEAR2**0.5


def stroke_bounds(strokes: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box of all points of a selection of strokes."""
    p = strokes.select(*by, F.explode("points").alias("p"))
    return p.groupBy(*by).agg(F.min("p.x").alias("left"), F.min("p.y").alias("top"), F.max("p.x").alias("right"), F.max("p.y").alias("bottom"))


def nearest(strokes: DataFrame, touches: DataFrame, by: list[str]) -> DataFrame:
    """(touch, id): the stroke with the nearest point, if its squared distance is under 0.003; ties to the first stroke.

    Points meet touches by cells as wide as that distance and the eight around them, so a touch meets only what is near.
    """
    cell = lambda v: F.floor(F.col(v) / SIDE).cast("int")
    p = strokes.select(*by, "ord", "id", F.explode("points").alias("p")).select(*by, "ord", "id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    p = p.withColumn("cx", cell("px")).withColumn("cy", cell("py"))
    near = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    t = touches.select(*by, "touch", "x", "y", F.explode(near).alias("c")).select(*by, "touch", "x", "y", "c.cx", "c.cy")
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    hit = t.join(p, [*by, "cx", "cy"]).withColumn("_d", dx * dx + dy * dy).where(F.col("_d") < NEAR2)
    return hit.groupBy("touch").agg(F.min(F.struct("_d", "ord", "id")).alias("m")).select("touch", F.col("m.id").alias("id"))


def kept_runs(points: Column, path: Column, radius: Column) -> Column:
    """Runs of two or more neighbouring points farther than the radius from every point of an eraser's path."""
    far = lambda p: ~F.exists(path, lambda e: F.hypot(p["x"] - e["x"], p["y"] - e["y"]) <= radius)
    empty = F.slice(F.transform(points, lambda p: F.array(p)), 1, 0)

    def step(acc: Column, p: Column) -> Column:
        grown = F.concat(acc["open"], F.array(p))
        closed = F.when(F.size(acc["open"]) >= 2, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.when(far(p), F.struct(acc["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(closed.alias("done"), F.slice(points, 1, 0).alias("open")))

    end = F.aggregate(points, F.struct(empty.alias("done"), F.slice(points, 1, 0).alias("open")), step)
    return F.when(F.size(end["open"]) >= 2, F.concat(end["done"], F.array(end["open"]))).otherwise(end["done"])


def erased(strokes: DataFrame, path: Column, radius: Column) -> DataFrame:
    """(id, fragment, points): the strokes an eraser touches, each with the pieces that stay (none if nothing stays)."""
    touched = F.exists("points", lambda p: F.exists(path, lambda e: F.hypot(p["x"] - e["x"], p["y"] - e["y"]) <= radius))
    runs = strokes.where(touched).withColumn("_r", kept_runs(F.col("points"), path, radius))
    return runs.select("id", F.posexplode_outer("_r").alias("fragment", "points"))
