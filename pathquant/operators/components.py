"""Connected components by alternating large-star and small-star rounds.

Every round is two joins on partially aggregated minima, so a vertex with very many neighbours costs no more
than its rows, and the minima are exchanged anew, so that Spark can split the rows of such a vertex over several tasks. The
number of rounds grows with the logarithm of the graph. Rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathquant.plans.store import stored


#: Rows of an exchange that one task takes, about, and rows of a vertex above which they are not exchanged at all.
TASK_ROWS, HOT = 2_000_000, 500_000


def _parts(df: DataFrame, rows: int) -> int:
    """Tasks among which so many rows are dealt; 0 where Spark's own number does. Ids are small in an exchange, but not in memory."""
    return 0 if rows < TASK_ROWS else max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _dealt(df: DataFrame, parts: int, *by: str) -> DataFrame:
    return df.repartition(parts, *by) if parts else df


def _hashed(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """The side of a join that is hashed where tables are dealt; the other goes past it, so none of its rows are held."""
    return _dealt(df, parts, *by).hint("shuffle_hash") if parts else df


def _least(edges: DataFrame, parts: int, name: str) -> DataFrame:
    """(u, m, n): the least v of every u, and how many it has."""
    least = _dealt(edges, parts, "u").groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return stored(least, name) if parts else least


def _met(edges: DataFrame, least: DataFrame, parts: int) -> DataFrame:
    """edges with the minimum m of their u. The key of the minima is computed: an exchange of their own lets a skewed join be split.

    With parts the minima are hashed and edges go past them; those of a vertex with very many stay where they are.
    """
    if not parts:
        own = least.select((F.col("u") + 0).alias("key"), "m")
        return edges.join(own, F.col("u") == F.col("key")).drop("key")
    hot = least.where(F.col("n") > HOT)
    rest = _dealt(edges.join(F.broadcast(hot.select("u")), "u", "left_anti"), parts, "u")
    return rest.join(_hashed(least.where(F.col("n") <= HOT).select("u", "m"), parts, "u"), "u").unionByName(edges.join(F.broadcast(hot.select("u", "m")), "u"))


def _large_star(edges: DataFrame, parts: int, name: str) -> DataFrame:
    """(u, v), u > v -> every larger neighbour of a vertex linked to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, parts, name).withColumn("m", F.least("u", "m"))
    found = _met(both.where("v > u"), least, parts).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(found, name) if parts else found


def _small_star(edges: DataFrame, parts: int, name: str) -> DataFrame:
    """(u, v), u > v -> a vertex and its smaller neighbours linked to the least of them."""
    least = _least(edges, parts, name)
    links = _met(edges, least, parts).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.where("u != v").union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(vertex, component) of every vertex of an edge; component is the smallest vertex reachable.

    Edges with a null end are ignored. A loop makes its vertex a component of its own if it has no other
    edge. Repeated edges count once. Millions of edges are dealt by their number, so that a task's memory does not grow with them.
    """
    ends = stored(edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p IS NOT NULL AND q IS NOT NULL").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")), f"{name}-edges")
    parts = _parts(ends, 2 * ends.count())
    ends = stored(_dealt(ends, parts, "u", "v").distinct(), name)
    star, before = ends.where("u != v"), None
    while True:
        star = stored(_dealt(_small_star(_large_star(star, parts, name), parts, name), parts, "u", "v").distinct(), name)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    vertices = _dealt(ends.select(F.explode(F.array("u", "v")).alias("vertex")), parts, "vertex").distinct()
    return vertices.join(_hashed(star.withColumnRenamed("u", "vertex"), parts, "vertex"), "vertex", "left").select("vertex", F.coalesce("v", "vertex").alias("component"))


def extended_components(labels: DataFrame, edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Components of a graph of which some are known: labels(vertex, component), as this module gives them, and new edges.

    Only the new edges are walked, between the components that they join; then labels that lie in a joined component
    are replaced. The result is that of ``connected_components`` over all edges. Edges with a null end are ignored.
    """
    ends = stored(edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p IS NOT NULL AND q IS NOT NULL"), f"{name}-edges")
    parts = _parts(ends, max(2 * ends.count(), labels.count()))
    vertices = _dealt(ends.select(F.explode(F.array("p", "q")).alias("vertex")), parts, "vertex").distinct()
    known = vertices.join(_hashed(labels, parts, "vertex"), "vertex", "left")
    known = stored(known.select("vertex", F.col("component").isNull().alias("fresh"), F.coalesce("component", "vertex").alias("label")), f"{name}-ends")
    between = ends
    for c in ("p", "q"):
        at = known.select(F.col("vertex").alias(c), F.col("label").alias(f"{c}_label"))
        between = _dealt(between, parts, c).join(_hashed(at, parts, c), c)
    between = _dealt(between.select("p_label", "q_label"), parts, "p_label", "q_label").distinct()
    joined = stored(connected_components(between, "p_label", "q_label", name).where("vertex != component").select(F.col("vertex").alias("label"), F.col("component").alias("joined")), f"{name}-joined")
    every = labels.select("vertex", F.col("component").alias("label")).unionByName(known.where("fresh").select("vertex", "label"))
    # many vertices have one label, so they stay where they are unless very many labels change
    joined = F.broadcast(joined) if parts and joined.count() < TASK_ROWS else _hashed(joined, parts, "label")
    return every.join(joined, "label", "left").select("vertex", F.coalesce("joined", "label").alias("component"))
