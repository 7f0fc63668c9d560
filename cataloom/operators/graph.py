"""Breadth-first expansion of an artist graph.

Levels are joined one after the other, so a node's depth is its least one, and the first to
reach it at that depth decides its priority: of several the highest.  The frontier and what was
visited are written tables in the shared folder, so that neither lineage nor a lost executor makes earlier levels run anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import artist_priority
from ..session import written


def capped(edges: DataFrame, caps: dict[str, int], order: Column) -> DataFrame:
    """Edges (src, dst, kind, ...): of a kind with a cap at most so many of each source, first by ``order``; 0 is no cap."""
    place = F.row_number().over(Window.partitionBy("src", "kind").orderBy(order))
    keep = F.lit(True)
    for kind, most in caps.items():
        if most:
            keep = keep & ((F.col("kind") != kind) | (F.col("_n") <= most))
    return edges.withColumn("_n", place).filter(keep).drop("_n")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 5) -> DataFrame:
    """(node, depth, priority) of all nodes within ``max_depth`` of the seeds (node, priority). Edges: (src, dst, priority), or (src, dst) of priority 0.1."""
    if "priority" not in edges.columns:
        edges = edges.withColumn("priority", F.lit(0.1))
    edges = written(edges.select("src", "dst", "priority"))
    seen = written(seeds.groupBy("node").agg(F.max("priority").alias("priority")).select("node", F.lit(0).alias("depth"), "priority"))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("priority").alias("priority"))
        frontier = written(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "priority"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def related_priority(popularity: Column, followers: Column) -> Column:
    """Priority of a related artist: 0.6 of its own."""
    return artist_priority(popularity, followers) * 0.6


def bootstrap(queue: DataFrame, tracks: DataFrame, artist_queue: DataFrame, limit: int = 500) -> DataFrame:
    """(artist_id) to seed a graph: nothing where the queue has items; the top artists, or where there are none the first of the artist queue."""
    from .aggregate import top_artists

    empty = queue.agg((F.count(F.lit(1)) == 0).alias("_empty"))
    top = top_artists(tracks, limit).select("artist_id", F.lit(0).alias("_source"))
    rest = artist_queue.select(F.col("spotify_id").alias("artist_id"), F.lit(1).alias("_source")).orderBy("artist_id").limit(limit)
    both = top.unionAll(rest)
    first = both.agg(F.min("_source").alias("_first"))
    return both.join(F.broadcast(first), F.col("_source") == F.col("_first")).crossJoin(F.broadcast(empty)).filter("_empty").select("artist_id")
