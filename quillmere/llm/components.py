"""Problem 1: consolidating pairwise matches into groups.

Method: peel the giant component by breadth-first frontier joins from the highest-degree vertex,
anti-join it away, and label the remaining components by minimum propagation.

* ``links`` turns the match lists into distinct undirected edges (partial aggregation before the
  shuffle, so a link repeated in a third of all rows costs one row a map task).
* ``peel`` joins the frontier with the edges until it runs dry.  The frontier joins are sort-merge
  joins that adaptive execution may split when the hub's key is hot.  A component can also be a
  long chain, of which the search would take one step a round; after ``max_rounds`` the part
  reached so far is contracted into its smallest vertex instead, which keeps the result exact.
* ``propagate`` spreads the smallest known id by alternating large-star and small-star rounds, so
  a chain of n vertices needs a logarithmic number of rounds; vertices that can't change any more
  leave after each round, so that the rounds shrink.

Defined cases: null ids, null and empty lists and null list elements link nothing; a file that
lists itself isn't linked by that; repeated rows and both directions count once; a table without
links gives no row in ``found`` and singletons in ``groups``.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.plans.cut import Cut

MAX_FRONTIER_ROUNDS = 4


def links(matches: DataFrame, id_col: str = "file_id", list_col: str = "similar_files") -> DataFrame:
    """Distinct edges (a, b), a < b."""
    pairs = matches.select(F.col(id_col).cast("long").alias("x"), F.explode(F.col(list_col).cast("array<bigint>")).alias("y"))
    return (
        pairs.where("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))


def peel(edges: DataFrame, max_rounds: int = MAX_FRONTIER_ROUNDS) -> tuple[list[Cut], int | None, bool]:
    """Frontiers of the search from the highest-degree vertex, their smallest vertex, and whether the search ran dry."""
    ways = both_ways(edges)
    top = ways.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not top:
        return [], None, True
    spark, hub = edges.sparkSession, top[0]["u"]
    layers = [Cut(spark.range(1).select(F.lit(hub).cast("long").alias("vertex")), "frontier")]
    least, dry = hub, False
    for _ in range(max_rounds):
        before = layers[-1].df if len(layers) == 1 else layers[-1].df.union(layers[-2].df)
        step = (
            ways.join(layers[-1].df.withColumnRenamed("vertex", "u"), "u")
            .select(F.col("v").alias("vertex"))
            .distinct()
            .join(before, "vertex", "left_anti")  # neighbours of a layer lie in it, in the last one or in the next
        )
        layer = Cut(step, "frontier")
        smallest = layer.df.agg(F.min("vertex")).first()[0]
        if smallest is None:
            layer.drop()
            dry = True
            break
        layers.append(layer)
        least = min(least, smallest)
    return layers, least, dry


def propagate(edges: DataFrame) -> DataFrame:
    """(vertex, root) for each vertex that isn't the smallest of its component.

    A vertex with one edge, to a smaller one, has nothing to tell the others: after each round such leaves
    are set aside, so that only what is still open goes round again.  At the end every layer of leaves
    takes the roots of the vertices it hangs on from the later layers."""
    now, leaves = Cut(edges, "open"), []
    while not now.df.isEmpty():
        low = both_ways(now.df).groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u").alias("a"), F.least("u", "m").alias("m"))
        # written, as it is read twice; repeated pairs go with those of the small stars
        large = Cut(now.df.join(low, "a").select(F.col("m").alias("a"), "b"), "large")
        least = large.df.groupBy("b").agg(F.min("a").alias("m"))
        # the pair (a, b) links a to the smallest vertex below b; (m, b) itself comes from a = m
        other = F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a"))
        stars = Cut(large.df.join(least, "b").select(F.col("m").alias("a"), other.alias("b")).distinct(), "stars")
        large.drop()
        now.drop()
        once = stars.df.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select("a", "b")
        leaf = Cut(once.join(stars.df.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("a", "b"), "leaves")
        now = Cut(stars.df.join(leaf.df.select("b"), "b", "left_anti").select("a", "b"), "open")
        stars.drop()
        leaves.append(leaf)
    now.drop()
    done: DataFrame | None = None
    for leaf in reversed(leaves):
        part = leaf.df.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
        if done is not None:
            known = done.select(F.col("vertex").alias("root"), F.col("root").alias("higher"))
            part = part.join(known, "root", "left").select("vertex", F.coalesce("higher", "root").alias("root"))
        part = Cut(part, "roots").df
        leaf.drop()
        done = part if done is None else done.union(part)
    return done if done is not None else edges.select(F.col("b").alias("vertex"), F.col("a").alias("root"))


def components(edges: DataFrame, max_rounds: int = MAX_FRONTIER_ROUNDS) -> DataFrame:
    """(vertex, root) for each vertex of ``edges``; root is the smallest vertex of its component."""
    stored = Cut(edges, "edges")
    layers, least, dry = peel(stored.df, max_rounds)
    if least is None:
        return stored.df.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    spark: SparkSession = edges.sparkSession
    giant = layers[0].df
    for layer in layers[1:]:
        giant = giant.union(layer.df)
    if dry:
        rest = stored.df.join(giant, stored.df.a == giant.vertex, "left_anti")
    else:
        seen = giant.select(F.col("vertex").alias("v"), F.lit(True).alias("s"))
        half = stored.df.join(seen, F.col("a") == F.col("v"), "left").select(
            F.when(F.col("s"), F.lit(least)).otherwise(F.col("a")).alias("a"), "b"
        )
        whole = half.join(seen, F.col("b") == F.col("v"), "left").select(
            "a", F.when(F.col("s"), F.lit(least)).otherwise(F.col("b")).alias("b")
        )
        rest = whole.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rooted = propagate(rest)
    root = least
    if not dry:
        row = rooted.where(F.col("vertex") == least).select("root").first()
        root = row["root"] if row else least
    small = rooted.union(rooted.select(F.col("root").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("root")))
    if not dry:
        small = small.where(F.col("vertex") != least)  # its own row comes from the peeled part
    return small.union(giant.select("vertex", F.lit(root).cast("long").alias("root")))


def found(spark: SparkSession, matches: DataFrame) -> DataFrame:
    got = components(links(matches))
    return got.select(F.col("vertex").alias("file_id"), F.col("root").alias("group_id"))


def groups(spark: SparkSession, matches: DataFrame) -> DataFrame:
    """One row for every file that occurs; a file without links is its own group."""
    seen = matches.select(F.col("file_id").cast("long").alias("file_id")).union(
        matches.select(F.explode(F.col("similar_files").cast("array<bigint>")))
    ).where("file_id is not null").distinct()
    linked = found(spark, matches)
    return seen.join(linked, "file_id", "left").select("file_id", F.coalesce("group_id", "file_id").alias("group_id"))
