"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each vertex of an undirected edge list with its component's minimum.

    ``edges`` has two columns of one orderable type. Rows holding a null and
    loops are ignored; an empty list gives an empty result. Returns one row
    ``(node, component)`` per vertex that has an edge.

    Each round hangs every vertex's larger neighbours below its smallest one,
    then does the same with the smaller neighbours, until nothing moves. The edge
    count never grows, the number of rounds is logarithmic, and all a vertex
    contributes to a shuffle is a partial minimum, so a vertex with a third of
    all edges costs no more than others. Rounds are cut in the shared folder.
    """
    a, b = edges.columns
    pairs = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    pairs = cut(pairs)
    state = _digest(pairs)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        pairs = cut(_small_star(_large_star(pairs)))
        after = _digest(pairs)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components still move after {max_rounds} rounds")
    down = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return down.unionByName(roots)


def _digest(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = pairs.agg(
        F.count("*").alias("n"),
        F.sum(h.cast("decimal(38,0)")).alias("s"),
        F.bit_xor(h).alias("x"),
    ).first()
    return row["n"], row["s"], row["x"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Larger neighbours of each vertex move below its smallest neighbour or itself."""
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and the vertex, move below the smallest."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
