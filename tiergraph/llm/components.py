"""Connected components of a link table by repeated contraction.

In each round every vertex takes the name of that one among itself and its neighbours whose hash, another
one in each round, is the least; links are renamed, and links within one name vanish.  As the order is a
random one, each round leaves a fixed share of the names on average, on chains as well as on stars, so the
number of rounds grows with the logarithm of the table.  The minimum is aggregated before the shuffle,
joins on vertices with many links are plain equi-joins that the adaptive planner can split, and every round
is stored in the shared folder, so the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.tables import staged, unstage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of the links; the root is the least vertex of its component.

    Links may repeat, run either way or join a vertex with itself; rows with a null end are left out.
    """
    live = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    live = staged(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names: DataFrame | None = None
    turn = 0
    while True:
        ends = live.select(F.explode(F.array(*(F.struct(F.col(x).alias("vertex"), F.col(y).alias("other")) for x in "ab" for y in "ab"))).alias("e")).select("e.*")
        taken = staged(ends.groupBy("vertex").agg(F.min_by("other", F.struct(F.xxhash64("other", F.lit(turn)), "other")).alias("root")), "names")
        renamed = live.join(taken.select(F.col("vertex").alias("a"), F.col("root").alias("ra")), "a").join(taken.select(F.col("vertex").alias("b"), F.col("root").alias("rb")), "b")
        left = staged(renamed.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if names is None:
            names = taken
        else:
            step = taken.select(F.col("vertex").alias("root"), F.col("root").alias("next"))
            joined = staged(names.join(step, "root", "left").select("vertex", F.coalesce("next", "root").alias("root")), "roots")
            unstage(names, taken)
            names = joined
        unstage(live)
        live, turn = left, turn + 1
        if live.isEmpty():
            least = names.groupBy("root").agg(F.min("vertex").alias("least"))
            out = staged(names.join(least, "root").select("vertex", F.col("least").alias("root")), "roots")
            unstage(names, live)
            return out
