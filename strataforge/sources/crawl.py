"""Breadth-first crawl over a table of links, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int | None = None, admit: Column | None = None) -> DataFrame:
    """(url, depth): what a crawl from `seeds` (url) over `links` (url, link) reaches, each URL once at its least depth.

    `admit` is a condition on `link`. `max_pages` stops after that many pages, by depth and URL. Each level is an anti-join against what was seen, its
    lineage cut; null links lead nowhere; cycles end since seen URLs do not come again.
    """
    edges = links.where(F.col("link").isNotNull() & (admit if admit is not None else F.lit(True))).select("url", "link").distinct()
    frontier = cut_lineage(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    seen, n = frontier, frontier.count()
    for depth in range(1, max_depth + 1):
        if max_pages is not None and n >= max_pages:
            break
        step = edges.join(frontier.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct()
        frontier = cut_lineage(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        if not new:
            break
        n += new
        seen = seen.unionByName(frontier)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def failure_rate(results: DataFrame, group: str, least: int = 10, most: float = 0.5) -> DataFrame:
    """group, done, failed, abort: a crawl is given up when more than `most` of at least `least` child pages failed.

    results: group, depth, failed (boolean), refreshed (boolean; pages gone in a refresh do not count). A failed root always aborts.
    """
    child = F.col("depth") > 0
    g = results.groupBy(group).agg(
        F.count_if(child).alias("done"),
        F.count_if(child & F.col("failed") & ~F.coalesce(F.col("refreshed"), F.lit(False))).alias("failed"),
        F.coalesce(F.max(F.col("failed") & (F.col("depth") == 0)), F.lit(False)).alias("root"),
    )
    return g.select(group, "done", "failed", (F.col("root") | ((F.col("done") >= least) & (F.col("failed") > F.col("done") * most))).alias("abort"))
