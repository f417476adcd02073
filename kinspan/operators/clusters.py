"""Groups of rows that hang together: connected components, and clusters by density."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import settled


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node is linked to, over any way.

    ``links`` has one and two. A round gives each root the least root that a link of its tree
    leads to and then halves the ways to the roots, so that rounds grow with the logarithm
    of the longest way in most graphs; labels only fall. Only links between different trees
    stay in the next round.
    """
    labels = settled(nodes.select("node", F.col("node").alias("component")).distinct(), "components")
    left = settled(links.select("one", "two").where("one <> two").distinct(), "links")
    while not left.isEmpty():
        ends = left.select(F.greatest("one", "two").alias("root"), F.least("one", "two").alias("lower"))
        hooks = settled(ends.groupBy("root").agg(F.min("lower").alias("up")), "hooks")
        while True:
            # Ways within this round's hooks are shortened until all end at a root.
            above = hooks.select(F.col("root").alias("up"), F.col("up").alias("upper"))
            longer = hooks.join(above, "up", "left")
            if longer.where("upper is not null").isEmpty():
                break
            hooks = settled(longer.select("root", F.coalesce("upper", "up").alias("up")), "hooks")

        def moved(df: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            named = hooks.select(F.col("root").alias(column), F.col("up").alias("_up"))
            return df.join(named, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")

        labels = settled(moved(labels, "component").select("node", "component"), "components")
        left = settled(moved(moved(left, "one"), "two").where("one <> two").select("one", "two").distinct(), "links")
    return labels


def density_clusters(points: DataFrame, x: str, y: str, reach: float, least: int) -> DataFrame:
    """``points`` and their cluster: clusters by density in the plane.

    A point with at least ``least`` points (itself too) within ``reach`` is a core point; core
    points within reach of one another are of one cluster, named by its least cell; another
    point within reach of core points belongs to the nearest one's cluster (of equally near
    ones the lower), and has null else. Rows with a null coordinate have null.

    Equal points are one place with a count. Cells are so small that all in one are within
    reach, so a cell of ``least`` points is core as it stands, its places are of one cluster,
    and clusters are components of cells. Places are compared with those of the cells
    around, never with all.
    """
    side = reach / sqrt(2)
    around = int(ceil(reach / side))
    at = {"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")}
    places = points.select(*[c.alias(n) for n, c in at.items()]).na.drop().groupBy("_x", "_y").agg(F.count("*").alias("n"))
    places = settled(places.withColumns({"cx": F.floor(F.col("_x") / side), "cy": F.floor(F.col("_y") / side)}), "places")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-around, around + 1) for j in range(-around, around + 1)]))

    def near(one: DataFrame, two: DataFrame) -> DataFrame:
        """Pairs of places within reach, those of ``two`` with the prefix o_."""
        other = two.select(*[F.col(c).alias(f"o_{c}") for c in two.columns])
        asked = one.withColumn("_s", steps).withColumns({"o_cx": F.col("cx") + F.col("_s.dx"), "o_cy": F.col("cy") + F.col("_s.dy")}).drop("_s")
        away = F.pow(F.col("_x") - F.col("o__x"), 2) + F.pow(F.col("_y") - F.col("o__y"), 2)
        return asked.join(other, ["o_cx", "o_cy"]).withColumn("_away", away).where(F.col("_away") <= reach * reach)

    full = places.groupBy("cx", "cy").agg(F.sum("n").alias("_in_cell")).where(F.col("_in_cell") >= least).select("cx", "cy")
    sparse = places.join(full, ["cx", "cy"], "left_anti")
    counted = near(sparse, places).groupBy("_x", "_y").agg(F.sum("o_n").alias("_near")).where(F.col("_near") >= least).select("_x", "_y")
    core = settled(places.join(full, ["cx", "cy"], "left_semi").unionByName(places.join(counted, ["_x", "_y"], "left_semi").join(full, ["cx", "cy"], "left_anti")).select(*places.columns), "core")

    def cell(a: Column, b: Column) -> Column:
        return F.struct(a.alias("cx"), b.alias("cy"))

    nodes = core.select(cell(F.col("cx"), F.col("cy")).alias("node")).distinct()
    links = near(core, core).where("cx <> o_cx or cy <> o_cy").select(cell(F.col("cx"), F.col("cy")).alias("one"), cell(F.col("o_cx"), F.col("o_cy")).alias("two"))
    labels = components(nodes, links.distinct())
    named = core.join(labels.select(F.col("node.cx").alias("cx"), F.col("node.cy").alias("cy"), "component"), ["cx", "cy"])
    rest = places.join(core.select("_x", "_y"), ["_x", "_y"], "left_anti")
    border = near(rest, named).groupBy("_x", "_y").agg(F.min(F.struct("_away", "o_component")).alias("_best")).select("_x", "_y", F.col("_best.o_component").alias("component"))
    found = named.select("_x", "_y", "component", F.lit(True).alias("is_core")).unionByName(border.withColumn("is_core", F.lit(False)))
    return points.withColumns(at).join(found, ["_x", "_y"], "left").drop("_x", "_y").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
