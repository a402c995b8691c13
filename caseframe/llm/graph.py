"""Connected components by joins, for graphs that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.common import Written


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, most_rounds: int = 200) -> Written:
    """v and component (the smallest vertex that v reaches) for every vertex of edges (a, b).

    Large stars and small stars in turn: first every vertex links its larger neighbours to the smallest one, then its smaller
    ones and itself. Edges never grow in number, the diameter falls by more than half a round, and a round is two
    aggregations and two joins. Rounds are cut from their past by tables in the shared folder. An unfinished result is never
    returned: it raises if the edges still change after `most_rounds`."""
    state = Written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(state.df)
    done = not before[0]
    for _ in range(most_rounds):
        if done:
            break
        both = state.df.unionByName(state.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = Written(large, "edges")
        least = large.df.groupBy("a").agg(F.min("b").alias("least"))
        small = large.df.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        following = Written(small, "edges")
        large.drop()
        after = _mark(following.df)
        state.drop()
        state = following
        done = after == before
        before = after
    if not done:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Every edge now leads from a vertex to the smallest of its component.
    tops = state.df.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    found = Written(state.df.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(tops), "components")
    state.drop()
    return found
