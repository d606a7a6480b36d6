"""Graphs by rule, and random ones whose chance is md5: the same under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..functions.parameters import closed_form_lower_bound_path, closed_form_upper_bound
from ..functions.sampling import integer_between, uniform, uniform_bits
from ..graph import Graph
from .closure import transitive_closure


def _ids(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


def _graph(spark: SparkSession, n: int, edges: DataFrame) -> Graph:
    return Graph.of(edges, _ids(spark, n))


def _pairs(spark: SparkSession, n: int, ordered: bool) -> DataFrame:
    """src, dst: pairs i < j, or all with i <> j.

    The n or so partners of a vertex come from a sequence, so pairs are made where they are needed.
    """
    src = _ids(spark, n, "src")
    if ordered:
        return src.where(F.col("src") < n - 1).select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    return src.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src <> dst")


def path_graph(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _ids(spark, max(0, n - 1), "src").select("src", (F.col("src") + 1).alias("dst")))


def cycle_graph(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _ids(spark, n, "src").select("src", ((F.col("src") + 1) % max(1, n)).alias("dst")))


def complete_dag(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _pairs(spark, n, True))


def random_dag(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Each pair i < j with chance ``p``."""
    return _graph(spark, n, _pairs(spark, n, True).where(uniform(seed, F.col("src"), F.col("dst")) < p))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    return _graph(spark, n, _pairs(spark, n, False).where(uniform(seed, F.col("src"), F.col("dst")) < p))


def dense_graph(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """Exactly ``m`` edges: the pairs of least md5."""
    if m > n * (n - 1):
        raise InvalidValue(f"{n} vertices have no {m} edges")
    return _graph(spark, n, _pairs(spark, n, False).orderBy(uniform_bits(seed, F.col("src"), F.col("dst")), "src", "dst").limit(m))


def layered_dag(spark: SparkSession, sizes: Sequence[int], p: float = 1.0, seed: int = 0) -> Graph:
    """Vertices numbered layer by layer; edges between consecutive layers with chance ``p``."""
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    spans = [(firsts[i], firsts[i] + sizes[i], firsts[i + 1], firsts[i + 1] + sizes[i + 1]) for i in range(len(sizes) - 1) if sizes[i] and sizes[i + 1]]
    layers = spark.createDataFrame(spans, "a long, b long, c long, d long")
    edges = layers.select(F.explode(F.expr("sequence(a, b - 1)")).alias("src"), "c", "d").select("src", F.explode(F.expr("sequence(c, d - 1)")).alias("dst"))
    return _graph(spark, sum(sizes), edges.where(uniform(seed, F.col("src"), F.col("dst")) < p))


def graph_with_components(spark: SparkSession, sizes: Sequence[int], p: float, seed: int = 0) -> Graph:
    """Cycles of the given sizes (one vertex: a self-loop), and forward edges between them with chance ``p``."""
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    rows = spark.createDataFrame([(f, f + s, sum(sizes)) for f, s in zip(firsts, sizes) if s], "a long, b long, n long")
    members = rows.select(F.explode(F.expr("sequence(a, b - 1)")).alias("src"), "a", "b", "n")
    cycle = members.select("src", F.expr("if(src + 1 = b, a, src + 1)").alias("dst"))
    ahead = members.where("b < n").select("src", F.explode(F.expr("sequence(b, n - 1)")).alias("dst"))
    return _graph(spark, sum(sizes), cycle.union(ahead.where(uniform(seed, F.col("src"), F.col("dst")) < p)))


def grid_graph(spark: SparkSession, rows: int, columns: int) -> Graph:
    """Vertex r * columns + c; edges of weight 1 to the right and down."""
    place = _ids(spark, rows * columns, "src")
    right = place.where(F.col("src") % columns < columns - 1).select("src", (F.col("src") + 1).alias("dst"))
    down = place.where(F.col("src") < (rows - 1) * columns).select("src", (F.col("src") + columns).alias("dst"))
    return _graph(spark, rows * columns, right.union(down).withColumn("w", F.lit(1).cast("long")))


def weighted(graph: Graph, low: int, high: int, seed: int = 0) -> Graph:
    """The graph with weights from ``low`` to ``high``."""
    if low < 0 or high < low:
        raise InvalidValue("weights must be from 0 up")
    return Graph(graph.vertices, graph.edges.withColumn("w", integer_between(low, high, seed, "w", F.col("src"), F.col("dst"))))


def weighted_path_graph(spark: SparkSession, n: int, low: int = 1, high: int = 10, seed: int = 0) -> Graph:
    return weighted(path_graph(spark, n), low, high, seed)


def weighted_random_dag(spark: SparkSession, n: int, p: float, low: int = 1, high: int = 10, seed: int = 0) -> Graph:
    return weighted(random_dag(spark, n, p, seed), low, high, seed)


def weighted_dense_graph(spark: SparkSession, n: int, m: int, low: int = 1, high: int = 10, seed: int = 0) -> Graph:
    return weighted(dense_graph(spark, n, m, seed), low, high, seed)


# --- strongly regular families ---------------------------------------------------------------------


def petersen_graph(spark: SparkSession) -> Graph:
    """Outer 5-cycle 0-4, inner pentagram 5-9, spokes; both directions."""
    i = _ids(spark, 5, "i")
    one_way = i.select(F.col("i").alias("src"), ((F.col("i") + 1) % 5).alias("dst")).union(i.selectExpr("i", "i + 5")).union(i.selectExpr("i + 5", "(i + 2) % 5 + 5"))
    return _graph(spark, 10, one_way.union(one_way.selectExpr("dst", "src")))


def rook_graph(spark: SparkSession) -> Graph:
    """The 4 by 4 rook's graph: vertex 4 * row + column; edges within a row or a column."""
    return _graph(spark, 16, _pairs(spark, 16, False).where("(src div 4 = dst div 4) <> (src % 4 = dst % 4)"))


def shrikhande_graph(spark: SparkSession) -> Graph:
    """Z4 x Z4 with differences +-(1,0), +-(0,1), +-(1,1)."""
    row, column = "pmod(dst div 4 - src div 4, 4)", "pmod(dst % 4 - src % 4, 4)"
    return _graph(spark, 16, _pairs(spark, 16, False).where(f"({row}, {column}) in ((1, 0), (3, 0), (0, 1), (0, 3), (1, 1), (3, 3))"))


def paley_graph(spark: SparkSession, q: int) -> Graph:
    """Vertices modulo the prime q = 1 mod 4; edges where the difference is a square."""
    if q < 5 or q % 4 != 1 or any(q % d == 0 for d in range(2, int(q**0.5) + 1)):
        raise InvalidValue("q must be a prime that is 1 modulo 4")
    squares = sorted({x * x % q for x in range(1, q)})
    i = _ids(spark, q, "src")
    return _graph(spark, q, i.select("src", F.explode(F.array(*(F.lit(s).cast("long") for s in squares))).alias("s")).select("src", ((F.col("src") + F.col("s")) % q).alias("dst")))


def hamming_graph(spark: SparkSession, d: int, q: int) -> Graph:
    """Words of length d over q letters, as numbers of base q; edges where they differ in one place."""
    if d < 1 or q < 2:
        raise InvalidValue("d must be 1 or more and q 2 or more")
    words = _ids(spark, q**d, "src")
    steps = words.select("src", F.explode(F.array(*(F.lit(q**i).cast("long") for i in range(d)))).alias("unit")).select("src", "unit", F.explode(F.sequence(F.lit(1), F.lit(q - 1))).alias("by"))
    digit = "(src div unit) % {q}".format(q=q)
    return _graph(spark, q**d, steps.selectExpr("src", f"src + unit * (pmod({digit} + by, {q}) - {digit}) as dst"))


def binary_tree_dag(spark: SparkSession, depth: int) -> Graph:
    """Vertex i leads to 2i + 1 and 2i + 2."""
    n = 2 ** (depth + 1) - 1
    inner = _ids(spark, n // 2, "src")
    return _graph(spark, n, inner.select("src", F.explode(F.array(F.col("src") * 2 + 1, F.col("src") * 2 + 2)).alias("dst")))


def barbell_graph(spark: SparkSession, k: int) -> Graph:
    """Two complete graphs of k vertices, 0 to k - 1 and k to 2k - 1, and one edge from 0 to k."""
    left = _pairs(spark, k, False)
    return _graph(spark, 2 * k, left.union(left.selectExpr(f"src + {k}", f"dst + {k}")).union(spark.createDataFrame([(0, k)], "src long, dst long")))


def star_graph(spark: SparkSession, leaves: int) -> Graph:
    return _graph(spark, leaves + 1, _ids(spark, leaves, "i").select(F.lit(0).cast("long").alias("src"), (F.col("i") + 1).alias("dst")))


def chain_of_stars(spark: SparkSession, k: int, leaves: int) -> Graph:
    """k centres in a path, each with its own leaves."""
    size = leaves + 1
    i = _ids(spark, k, "i")
    stars = i.select((F.col("i") * size).alias("src"), F.explode(F.sequence(F.lit(1), F.lit(leaves))).alias("leaf")).select("src", (F.col("src") + F.col("leaf")).alias("dst"))
    links = i.where(F.col("i") < k - 1).select((F.col("i") * size).alias("src"), ((F.col("i") + 1) * size).alias("dst"))
    return _graph(spark, k * size, stars.union(links))


# --- closed forms ------------------------------------------------------------------------------------


def closed_form_shortcuts(spark: SparkSession, family: str, sizes: Sequence[int]) -> DataFrame:
    """src, dst: known smallest shortcut sets: none for path, cycle and star; all pairs inside a layer for layered."""
    if family in ("path", "cycle", "star"):
        return spark.createDataFrame([], "src long, dst long")
    if family != "layered":
        raise InvalidValue(f"no closed form for {family}")
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    layers = spark.createDataFrame([(f, f + s) for f, s in zip(firsts, sizes) if s], "a long, b long")
    inside = layers.select(F.explode(F.expr("sequence(a, b - 1)")).alias("src"), "a", "b")
    return inside.select("src", F.explode(F.expr("sequence(a, b - 1)")).alias("dst")).where("src <> dst")


def verify_closed_form(spark: SparkSession, family: str, sizes: Sequence[int]) -> bool:
    """Whether the family's closure is the expected set of pairs, counted and compared whole."""
    n = sum(sizes)
    if family == "path":
        graph, expected = path_graph(spark, n), _pairs(spark, n, True)
    elif family == "cycle":
        graph, expected = cycle_graph(spark, n), _pairs(spark, n, False)
    elif family == "star":
        graph = star_graph(spark, n - 1)
        expected = graph.edges
    elif family in ("layered", "bipartite"):
        graph = layered_dag(spark, sizes)
        place = F.expr(" + ".join(f"cast(id >= {sum(sizes[:i])} as int)" for i in range(1, len(sizes))) or "0")
        layer = _ids(spark, n).select("id", place.alias("layer"))
        expected = _pairs(spark, n, True).join(layer.selectExpr("id as src", "layer as i"), "src").join(layer.selectExpr("id as dst", "layer as j"), "dst").where("i < j").select("src", "dst")
    else:
        raise InvalidValue(f"no closed form for {family}")
    found = transitive_closure(graph).where("src <> dst").select("src", "dst")
    return not found.exceptAll(expected.select("src", "dst")).head(1) and not expected.select("src", "dst").exceptAll(found).head(1)


def closed_form_bounds(n: int, m: int) -> tuple[int, float]:
    return closed_form_lower_bound_path(n), closed_form_upper_bound(n, m)
