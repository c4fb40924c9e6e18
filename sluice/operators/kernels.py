"""Geometry, signals and graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import signal
from sluice.functions.arrays import all_finite, blend, distance, points
from sluice.operators.registry import query, table
from sluice.plans.lineage import durable

JOINTS = 24
#: Edges of one hand: four joints in a chain to the wrist, and five fingers of four.
HAND = [(i, i + 1) for i in range(3)] + [(3 if k == 0 else 4 * f + 3 + k, 4 * f + 4 + k) for f in range(5) for k in range(4)]
HAND_SQL = ", ".join(f"({a}, {b})" for a, b in HAND)


def hand_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HAND, "a int, b int")


@query(f"""
WITH e(a, b) AS (VALUES {HAND_SQL}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT i::INT, i::INT FROM range({JOINTS}) r(i)), d AS (SELECT a, count(*) AS n FROM s GROUP BY a)
SELECT s.a, s.b, round(1 / sqrt(x.n * y.n), 6) AS weight FROM s JOIN d x ON s.a = x.a JOIN d y ON s.b = y.a""")
def normalised_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a skeleton's edges and loops, each over the root of both degrees."""
    e = hand_edges(spark)
    loops = spark.range(JOINTS).select(F.col("id").cast("int").alias("a"), F.col("id").cast("int").alias("b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(loops)
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    out = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    return out.select("a", "b", F.round(1 / F.sqrt(F.col("n") * F.col("m")), 6).alias("weight"))


@query(f"""
WITH RECURSIVE e(a, b) AS (VALUES {HAND_SQL}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), h(a, b, hops) AS (SELECT i::INT, i::INT, 0 FROM range({JOINTS}) r(i) UNION SELECT h.a, s.b, h.hops + 1 FROM h JOIN s ON h.b = s.a WHERE h.hops < 6)
SELECT a, b, min(hops)::INT AS hops FROM h GROUP BY a, b""")
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops between a skeleton's joints, up to six: the frontier joins the edges, a hop at a time."""
    e = hand_edges(spark)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = F.broadcast(both.select(F.col("a").alias("at"), F.col("b").alias("to")))  # the edges of one skeleton
    seen = durable(spark.range(JOINTS).select(F.col("id").cast("int").alias("a"), F.col("id").cast("int").alias("b"), F.lit(0).alias("hops")))
    for hops in range(1, 7):
        front = seen.where(F.col("hops") == hops - 1).join(step, F.col("b") == F.col("at")).select("a", F.col("to").alias("b")).distinct()
        seen = durable(seen.unionByName(front.join(seen, ["a", "b"], "left_anti").withColumn("hops", F.lit(hops))))
    return seen


_GRAPH = "SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey % 5 <> 4"


@query(f"""
WITH RECURSIVE e AS ({_GRAPH}), r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT x.a, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT a AS node, root::INT AS root, count(*) OVER (PARTITION BY root) AS size FROM c""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components: node, root (its least node) and size."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    edges = n.select("a", ((F.col("a") * 7 + 3) % 25).alias("b")).unionByName(n.where("a % 5 <> 4").select("a", (F.col("a") + 1).alias("b"))).distinct()
    roots = strong_components(n.select(F.col("a").alias("node")), edges)
    return roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size")


#: Hops between two looks at whether a spread has ended.
HOPS = 6
#: Links, at most, that one task takes to finish what trimming and colouring leave.
FEW_LINKS = 1 << 19


def strong_components(nodes: DataFrame, edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node and root of every node: the least of the nodes that it reaches and that reach it.

    Nodes that no link leads to, or from, are components of their own and are
    trimmed until none is left. Then each node takes the least rank, a hash, of
    those that reach it; a node of its own rank is the pivot of those of its
    rank that reach it back, a component. A round holds a row for each node and
    link left, never one for each pair of nodes. Once no more than ``few`` links
    are left, a bound and not a share, one task finds their components.
    """
    links, found = durable(edges.select("a", "b").where("a <> b").distinct()), []
    while True:
        links, n = _trimmed(links)
        if n <= few:
            break
        colour = _spread(_ends(links).select("node", F.struct(F.xxhash64("node").alias("rank"), "node").alias("mark")), links)
        sides = links.join(colour.select(F.col("node").alias("a"), F.col("mark").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("mark").alias("cb")), "b")
        back = sides.where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))
        found.append(_reached(colour.where("node = mark.node").select("node", F.col("mark.node").alias("mark")), durable(back)))
        done = found[-1].select("node")
        links = durable(links.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti"))
    if n:
        kind = edges.schema["a"].dataType.simpleString()
        found.append(durable(links.coalesce(1).groupBy().applyInPandas(_components, f"node {kind}, mark {kind}")))
    marks = nodes.select("node").distinct()
    if not found:
        return marks.select("node", F.col("node").alias("root"))
    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    least = every.groupBy("mark").agg(F.min("node").alias("root"))
    rooted = every.join(least, "mark").select("node", "root")
    return marks.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _trimmed(links: DataFrame) -> tuple[DataFrame, int]:
    """The links between nodes that lie between others, and their number."""
    n = links.count()
    while n:
        for _ in range(HOPS // 2):
            links = links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        links = durable(links)
        left = links.count()
        # a long tail that a few hops hardly shorten is left to the next steps
        if left == n or n - left < n // 100:
            return links, left
        n = left
    return links, n


def _components(links: pd.DataFrame) -> pd.DataFrame:
    """node and mark (a node of its component) of a bounded number of links: depth-first, without recursion."""
    names, flat = np.unique(np.concatenate([links["a"], links["b"]]), return_inverse=True)
    a, b = flat[: len(links)], flat[len(links) :]
    order = np.argsort(a, kind="stable")
    heads, starts = b[order].tolist(), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    at = list(starts[:-1])
    seen, low, mark, path, clock = [0] * len(names), [0] * len(names), [-1] * len(names), [], 0
    for first in range(len(names)):
        todo = [] if seen[first] else [first]
        while todo:
            v = todo[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                path.append(v)
            while at[v] < starts[v + 1] and seen[heads[at[v]]]:
                w = heads[at[v]]
                if mark[w] < 0:
                    low[v] = min(low[v], low[w])
                at[v] += 1
            if at[v] < starts[v + 1]:
                todo.append(heads[at[v]])
                continue
            todo.pop()
            if low[v] == seen[v]:
                while mark[v] < 0:
                    mark[path.pop()] = v
    return pd.DataFrame({"node": names, "mark": names[mark]})


def _spread(marks: DataFrame, links: DataFrame) -> DataFrame:
    """Each node's least mark of those that lead to it."""
    marks = durable(marks)
    while True:
        now = marks
        for _ in range(HOPS):
            came = links.join(now.select(F.col("node").alias("a"), "mark"), "a").select(F.col("b").alias("node"), "mark")
            now = now.unionByName(came).groupBy("node").agg(F.min("mark").alias("mark"))
        now = durable(now)
        if now.join(marks, ["node", "mark"], "left_anti").isEmpty():
            return now
        marks = now


def _reached(begin: DataFrame, links: DataFrame) -> DataFrame:
    """node and mark of all that links lead to from the first ones."""
    seen, count = durable(begin), -1
    while (now := seen.count()) != count:
        count = now
        for _ in range(HOPS):
            seen = seen.unionByName(links.join(seen.select(F.col("node").alias("a"), "mark"), "a").select(F.col("b").alias("node"), "mark")).distinct()
        seen = durable(seen)
    return seen


_J = "SELECT vec_id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(21) r(i)"


@query(f"""
WITH j AS ({_J}), d AS (SELECT vec_id, i, sqrt((x - 0.1) ** 2 + y ** 2 + (z + 1) ** 2) AS out, sqrt((x + 0.1) ** 2 + y ** 2 + (z + 1) ** 2) AS back FROM j)
SELECT vec_id, i::INT AS i, round((out + back) / 299792458.0 * 1e9, 6) AS delay_ns, round(1 / (out * back), 6) AS gain FROM d""")
def path_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay and gain of the way from one antenna over a point to another."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(points(F.col("embedding").cast("array<double>"))).alias("i", "p"))
    antenna = lambda x: F.array(F.lit(x), F.lit(0.0), F.lit(-1.0))
    ways = poses.select("vec_id", "i", distance(F.col("p"), antenna(0.1)).alias("out"), distance(F.col("p"), antenna(-0.1)).alias("back"))
    return ways.select("vec_id", "i", F.round((F.col("out") + F.col("back")) / signal.LIGHT * 1e9, 6).alias("delay_ns"), F.round(1 / (F.col("out") * F.col("back")), 6).alias("gain"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum([0.25 * a[i] + 0.75 * b[i] FOR i IN range(1, 65)]), 6) AS total, round(0.25 * a[1] + 0.75 * b[1], 6) AS first FROM l""")
def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The convex blend of each vector and the next one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    mixed = both.select("vec_id", blend(F.col("v"), F.col("w"), F.lit(0.25)).alias("m"))
    return mixed.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("m", F.lit(0)), 6).alias("first"))


@query("""
WITH s AS (SELECT label, avg(embedding[1]::DOUBLE) AS m, stddev_pop(embedding[1]::DOUBLE) AS d FROM embeddings GROUP BY label) SELECT vec_id, round((embedding[1]::DOUBLE - m) / d, 5) AS z FROM embeddings JOIN s USING (label)""")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores by the statistics of each row's data set."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    stats = rows.groupBy("label").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    return rows.join(stats, "label").select("vec_id", F.round((F.col("x") - F.col("m")) / F.col("d"), 5).alias("z"))


@query(f"""
WITH j AS ({_J}), e(a, b) AS (VALUES {", ".join(f"({a}, {b})" for a, b in HAND if max(a, b) < 21)}), k AS (SELECT unnest([1, 2]) AS k)
SELECT a.vec_id, e.a, e.b, k::INT AS k, round(a.x + (b.x - a.x) * k / 3, 6) AS x, round(a.y + (b.y - a.y) * k / 3, 6) AS y, round(a.z + (b.z - a.z) * k / 3, 6) AS z FROM e JOIN j a ON a.i = e.a JOIN j b ON b.i = e.b AND a.vec_id = b.vec_id, k""")
def densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points between the joints of every edge, two on each."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", points(F.col("embedding").cast("array<double>")).alias("p"))
    edges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in HAND if max(a, b) < 21])
    ends = poses.select("vec_id", F.explode(edges).alias("e"), "p").select("vec_id", "e.a", "e.b", F.get("p", F.col("e.a")).alias("p"), F.get("p", F.col("e.b")).alias("q"))
    ends = ends.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    at = lambda i, name: F.round(F.get("p", F.lit(i)) + (F.get("q", F.lit(i)) - F.get("p", F.lit(i))) * F.col("k") / 3, 6).alias(name)
    return ends.select("vec_id", "a", "b", "k", at(0, "x"), at(1, "y"), at(2, "z"))


@query("""SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS shaped, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS finite, count(*) FILTER (list_min(embedding) >= -1 AND list_max(embedding) <= 1) AS in_range FROM embeddings GROUP BY label""")
def tensor_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, finiteness and range of arrays."""
    v = F.col("embedding").cast("array<double>")
    inside = F.forall(v, lambda x: x.between(-1, 1))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size(v) == 64).alias("shaped"), F.count_if(all_finite(v)).alias("finite"), F.count_if(inside).alias("in_range"))


@query("""SELECT k AS config, round(299792458.0 / (2 * bandwidth), 9) AS range_resolution, round(rate * 299792458.0 / (2 * slope), 6) AS max_range, round(299792458.0 / 77e9 / (2 * chirps * chirp), 6) AS velocity_resolution, round(299792458.0 / 77e9 / (4 * chirp), 6) AS max_velocity
FROM (SELECT p_partkey AS k, (1 + p_size % 4) * 1e9 AS bandwidth, 10e6 AS rate, (20 + p_size % 50) * 1e12 AS slope, 32 AS chirps, 60e-6 AS chirp FROM part)""")
def radar_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions and ranges that a waveform's numbers make."""
    size, wave = F.col("p_size"), signal.LIGHT / 77e9
    bandwidth, slope, chirp = (1 + size % 4) * F.lit(1e9), (20 + size % 50) * F.lit(1e12), 60e-6
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config"), F.round(F.lit(signal.LIGHT) / (2 * bandwidth), 9).alias("range_resolution"), F.round(F.lit(10e6) * signal.LIGHT / (2 * slope), 6).alias("max_range"), F.round(F.lit(wave / (2 * 32 * chirp)), 6).alias("velocity_resolution"), F.round(F.lit(wave / (4 * chirp)), 6).alias("max_velocity"))


@query()
def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-Doppler and beam power of every vector, by Arrow batches."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = v.select("vec_id", signal.range_doppler_16("embedding").alias("power"), signal.beams_9("embedding").alias("beams"))
    return found.select("vec_id", F.round(F.array_max("power"), 6).alias("peak"), (F.array_position("power", F.array_max("power")) - 1).cast("int").alias("bin"), (F.array_position("beams", F.array_max("beams")) - 1).cast("int").alias("beam"))


@query()
def beat_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beat signal of every pose's paths: first sample and energy."""
    paths = path_geometry(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list("delay_ns")).alias("delays"))
    heard = paths.select("vec_id", signal.beat_32("delays").alias("s"))
    return heard.select("vec_id", F.round(F.get("s", F.lit(0)), 6).alias("first"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))
