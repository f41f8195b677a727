"""Connected components as joins and sums over an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the smallest node it is connected to.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest one, and every node
    links its smaller neighbours to the smallest of them. The number of edges never grows, no task sees a whole
    component, and the number of rounds grows with the logarithm of the longest path. Each round is written to the shared
    folder, and so are the smallest neighbours before they are joined: a node with very many edges is then split among tasks. Edges with a null end and loops are left out.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.dropna(subset=["a", "b"]).select(u, v).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        new_mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if new_mark == mark:
            break
        mark = new_mark
        both = now.union(now.select("v", "u"))
        low = stored(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("low")), "least")
        star = stored(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")), "stars")
        low = stored(star.groupBy("u").agg(F.min("v").alias("low")), "least")
        near = star.join(low, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = stored(near.union(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
