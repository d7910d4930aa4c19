"""Breadth-first walk over the links of pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.scratch import cut

DEPTH = 4


def breadth_first(links: DataFrame, start: DataFrame, depth: int = DEPTH, blocked: DataFrame | None = None) -> DataFrame:
    """(url, depth) of all urls within `depth` of start (url) over links (url, target), each at its least depth.

    Level by level: the frontier joins the links, what was visited before is taken off. Blocked urls (url) are visited, but
    give no children. Each level is written to the shared folder, which cuts its lineage; the loop ends after `depth` rounds, or
    once a level is empty. Null urls and targets are no pages.
    """
    links, start = links.dropna(subset=["url", "target"]), start.dropna(subset=["url"])
    frontier = start.select("url").distinct().withColumn("depth", F.lit(0))
    visited = frontier
    for level in range(1, depth + 1):
        open_ = frontier.join(blocked.select("url"), "url", "left_anti") if blocked is not None else frontier
        new = open_.select("url").join(links.select("url", "target"), "url").select(F.col("target").alias("url")).distinct()
        frontier = cut(new.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
