"""Connected components of a link table, all of it as joins and grouped minima.

Each round hooks every node to its smallest neighbour, shortens the paths to
the roots by doubling, and replaces the links by those between different
roots.  A round at least halves the nodes that still have links.  Nothing but
the answer to "is anything left" reaches the driver; each step is a written
table, so that a lost executor repeats one step only, and that joins on a hot
node read plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import staged


def _flatten(forest: DataFrame) -> DataFrame:
    """``id, parent`` with every parent a root."""
    while True:
        child, above = forest.alias("c"), forest.alias("p")
        hop = child.join(above, F.col("c.parent") == F.col("p.id")).select(
            F.col("c.id").alias("id"),
            F.col("p.parent").alias("parent"),
            (F.col("p.parent") != F.col("c.parent")).alias("moved"),
        )
        hop = staged(hop, "forest")
        if hop.where("moved").isEmpty():
            return hop.select("id", "parent")
        forest = hop.select("id", "parent")


def connected_components(links: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``links(a, b)``; the root is the smallest id reachable.

    Ids are bigint.  Repeated links, loops and either direction are fine; a link
    with a null end is ignored.  Without links the result is empty.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = staged(ends, "links")
    both = ends.select("a").union(ends.select("b")).distinct()
    roots = both.select(F.col("a").alias("id"), F.col("a").alias("root"))
    first = True
    while first or not ends.isEmpty():
        smallest = (
            ends.select(F.col("b").alias("id"), F.col("a").alias("parent"))
            .union(ends.select(F.col("a").alias("id"), F.col("a").alias("parent")))
            .groupBy("id")
            .agg(F.min("parent").alias("parent"))
        )
        forest = _flatten(staged(smallest, "forest"))
        if first:
            roots = forest.select("id", F.col("parent").alias("root"))
        else:
            up = forest.alias("f")
            old = roots.alias("r")
            roots = old.join(up, F.col("r.root") == F.col("f.id"), "left").select(
                F.col("r.id").alias("id"), F.coalesce("f.parent", "r.root").alias("root")
            )
            roots = staged(roots, "roots")
        a, b = forest.alias("x"), forest.alias("y")
        ends = (
            ends.join(a, F.col("a") == F.col("x.id"))
            .join(b, F.col("b") == F.col("y.id"))
            .where("x.parent <> y.parent")
            .select(
                F.least("x.parent", "y.parent").alias("a"), F.greatest("x.parent", "y.parent").alias("b")
            )
            .distinct()
        )
        ends = staged(ends, "links")
        first = False
    return roots
