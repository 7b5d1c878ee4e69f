"""Connected components of an edge table by alternating stars."""

from pyspark.sql import functions as F

from tagloom.staging import BROADCAST_BYTES, HOT_ROWS, lookup_join, stage, stage_sized


def _state(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs):
    """Each node's smallest neighbour, or itself if that is smaller."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges, limit=BROADCAST_BYTES, hot_rows=HOT_ROWS):
    """(a, b) links, in either direction, to (node, component).

    ``component`` is the smallest node that can be reached.  Large stars tie
    every larger neighbour of a node to its smallest one, small stars tie the
    smaller neighbours together; when a round changes nothing, the edges are
    stars around the smallest nodes.  A round is two aggregates with map-side
    combine and two joins.  A node's smallest neighbour is looked up by broadcast
    if all of them take ``limit`` bytes or less, else by a shuffle that salts the
    hubs, nodes of over ``hot_rows`` links; links are never collected to a list.  Rounds grow as the logarithm of the longest
    chain.  Each round is a written table: a lost executor costs one round.

    Null ends and self-links are ignored; an empty table gives an empty table.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = stage(edges.where(F.col("a") != F.col("b")).select(a, b).distinct(), "links")
    seen = _state(current)

    def smallest(pairs):
        return lookup_join(pairs, stage_sized(_star(pairs), "stars"), "a", spread=["b"], limit=limit, hot_rows=hot_rows)

    while seen[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = smallest(both).where(F.col("b") > F.col("a"))
        large = stage(found.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        small = smallest(large)
        tied = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stage(tied.union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = _state(current)
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
