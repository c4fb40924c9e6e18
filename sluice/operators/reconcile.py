"""Reconciling tables: joins that must match, coverage both ways, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.registry import query, table
from sluice.plans import blocks
from sluice.plans.ordinal import with_ordinal

EXAMPLES = 5


def coverage(left: DataFrame, right: DataFrame, key: str, examples: int = EXAMPLES) -> DataFrame:
    """Keys that only one side has: side, how many and the first few."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    sides = [("missing", a.join(b, key, "left_anti")), ("extra", b.join(a, key, "left_anti"))]
    out = None
    for side, rows in sides:
        few = rows.orderBy(key).limit(examples).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
        one = rows.agg(F.lit(side).alias("side"), F.count("*").alias("n")).crossJoin(F.broadcast(few))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner equi-join of samples and labels."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS unmatched, count(*) FILTER (c_custkey IS NULL) AS unmatched_customer FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def must_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join in which every row should meet its parent, and how many do not."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.select("l_orderkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    joined = joined.join(customers.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("unmatched"), F.count_if(F.col("c_custkey").isNull()).alias("unmatched_customer"))


@query("""
WITH m AS (SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)), e AS (SELECT DISTINCT doc_id FROM labels ANTI JOIN documents USING (doc_id))
SELECT 'missing' AS side, (SELECT count(*) FROM m) AS n, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM m ORDER BY doc_id LIMIT 5)), '') AS examples
UNION ALL SELECT 'extra', (SELECT count(*) FROM e), coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM e ORDER BY doc_id LIMIT 5)), '')""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without label and labels without document, with the first few."""
    return coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_SHADOW = "CASE WHEN doc_id % 97 = 0 THEN n_chars + 1 ELSE n_chars END"


@query(f"""
WITH a AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
b AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT doc_id, {_SHADOW} AS n_chars FROM documents WHERE doc_id % 89 <> 1 UNION ALL SELECT -1, 0))
SELECT (SELECT count(*) FROM b) AS shadow_rows, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS unknown_keys, (SELECT count(*) FROM a JOIN b USING (doc_id) WHERE a.n_chars <> b.n_chars) AS conflicts,
(SELECT count(*) FROM a FULL JOIN b USING (i) WHERE a.doc_id IS DISTINCT FROM b.doc_id OR a.n_chars IS DISTINCT FROM b.n_chars) AS rowwise_mismatches""")
def shadow_copy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against a shadow copy of it: by key, and row by row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    shadow = docs.where("doc_id % 89 <> 1").select("doc_id", F.expr(_SHADOW).alias("n_chars")).unionByName(spark.createDataFrame([(-1, 0)], "doc_id long, n_chars long"))
    a = with_ordinal(docs, ["doc_id"]).select("doc_id", F.col("n_chars").alias("a_chars"), "ordinal")
    b = with_ordinal(shadow, ["doc_id"]).select("doc_id", F.col("n_chars").alias("b_chars"), "ordinal")
    by_key = b.join(a.select("doc_id", "a_chars"), "doc_id", "left").agg(F.count("*").alias("shadow_rows"), F.count_if(F.col("a_chars").isNull()).alias("unknown_keys"), F.count_if(F.col("a_chars") != F.col("b_chars")).alias("conflicts"))
    rows = a.withColumnRenamed("doc_id", "a_id").join(b.withColumnRenamed("doc_id", "b_id"), "ordinal", "full_outer")
    by_row = rows.agg(F.count_if(~F.col("a_id").eqNullSafe(F.col("b_id")) | ~F.col("a_chars").eqNullSafe(F.col("b_chars"))).alias("rowwise_mismatches"))
    return by_key.crossJoin(F.broadcast(by_row))


@query("SELECT c_mktsegment, count(*) AS n FROM customer SEMI JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: customers that have an order."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT doc_id AS k, true AS a FROM documents WHERE doc_id % 3 <> 0), p AS (SELECT page_id AS k, true AS b FROM pages WHERE page_id % 2 = 0)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'no sidecar' ELSE 'no artifact' END AS state, count(*) AS n FROM d FULL JOIN p USING (k) GROUP BY 1""")
def pair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join by identity: artifacts and sidecars, and which lack the other."""
    a = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), F.lit(True).alias("a"))
    b = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("k"), F.lit(True).alias("b"))
    state = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "no sidecar").otherwise("no artifact")
    return a.join(b, "k", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT event_id, nullif(event_type, 'view') AS t, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS u FROM events),
b AS (SELECT event_id, nullif(event_type, 'click') AS t, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS u FROM events)
SELECT count(*) AS pairs, count(*) FILTER (a.t IS NOT DISTINCT FROM b.t AND a.u IS NOT DISTINCT FROM b.u) AS null_safe, count(*) FILTER (a.t = b.t AND a.u = b.u) AS strict FROM a JOIN b USING (event_id)""")
def null_safe_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite identity of two columns, where absent equals absent."""
    events = table(spark, sf_dir, "events")
    side = lambda kind, n: events.select("event_id", F.nullif("event_type", F.lit(kind)).alias(f"t{n}"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias(f"u{n}"))
    joined = side("view", 1).join(side("click", 2), "event_id")
    safe = F.col("t1").eqNullSafe(F.col("t2")) & F.col("u1").eqNullSafe(F.col("u2"))
    return joined.agg(F.count("*").alias("pairs"), F.count_if(safe).alias("null_safe"), F.count_if((F.col("t1") == F.col("t2")) & (F.col("u1") == F.col("u2"))).alias("strict"))


@query("""
SELECT label, count(*) AS n, count(DISTINCT len(embedding)) = 1 AS one_shape, min(len(embedding))::INT AS dim, count(*) FILTER (d.doc_id IS NULL) AS no_document FROM embeddings LEFT JOIN documents d ON vec_id = d.doc_id GROUP BY label""")
def uniform_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose right side may be absent, and one shape for all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))
    joined = vectors.join(table(spark, sf_dir, "documents").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return joined.groupBy("label").agg(F.count("*").alias("n"), (F.min("dim") == F.max("dim")).alias("one_shape"), F.min("dim").alias("dim"), F.count_if(F.col("doc_id").isNull()).alias("no_document"))


@query("""
WITH t AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 < 8), v AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 >= 7)
SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM t INTERSECT SELECT o_orderkey FROM v)) AS shared_samples, (SELECT count(*) FROM (SELECT o_custkey FROM t INTERSECT SELECT o_custkey FROM v)) AS shared_sequences""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two splits share, on two keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    train, check = orders.where("o_orderkey % 10 < 8"), orders.where("o_orderkey % 10 >= 7")
    shared = lambda c, name: train.select(c).intersect(check.select(c)).agg(F.count("*").alias(name))
    return shared("o_orderkey", "shared_samples").crossJoin(F.broadcast(shared("o_custkey", "shared_sequences")))


@query("""
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'redo' ELSE 'done' END AS state FROM documents LEFT JOIN labels l USING (doc_id)
WHERE doc_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn > 3)""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is neither finished nor quarantined: anti-joins on state tables."""
    docs, labels, held = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "conversations").where("role = 'assistant' and turn > 3").select(F.col("conv_id").alias("doc_id"))
    state = F.when(F.col("quality").isNull(), "new").when(F.col("quality") == 0, "redo").otherwise("done")
    return docs.join(held, "doc_id", "left_anti").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", state.alias("state"))


@query("""
WITH h AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant')
SELECT conv_id, count(h.text) AS left_rows, count(r.text) AS right_rows, count(h.text) = count(r.text) AND bool_and(h.text IS NOT NULL AND r.text IS NOT NULL) AS equal_length FROM h FULL JOIN r USING (conv_id, i) GROUP BY conv_id""")
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two lists met by their position, strictly: lists of one length."""
    from pyspark.sql import Window as W

    turns = table(spark, sf_dir, "conversations")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: turns.where(F.col("role") == role).select("conv_id", F.col("text").alias(name), place.alias("i"))
    both = side("user", "a").join(side("assistant", "b"), ["conv_id", "i"], "full_outer")
    equal = (F.count("a") == F.count("b")) & F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy("conv_id").agg(F.count("a").alias("left_rows"), F.count("b").alias("right_rows"), equal.alias("equal_length"))


@query("""
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS axis FROM embeddings), p AS (SELECT a.axis, abs(a.x - b.x) AS d FROM l a JOIN l b ON b.vec_id = a.vec_id + 1 AND a.axis = b.axis)
SELECT axis % 3 AS coordinate, axis // 3 AS joint, count(*) AS n, round(avg(d), 6) AS mean_error, round(max(d), 6) AS max_error, bool_and(d <= 1e-6 + 1e-5) AS all_close FROM p WHERE axis < 63 GROUP BY GROUPING SETS ((), (coordinate), (joint))""")
def array_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of paired arrays, over all, by coordinate and by joint."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("axis", "x")).where("axis < 63")
    a = long.select((F.col("vec_id") + 1).alias("vec_id"), "axis", F.col("x").alias("y"))
    pairs = a.join(long, ["vec_id", "axis"]).select((F.col("axis") % 3).cast("long").alias("coordinate"), F.floor(F.col("axis") / 3).alias("joint"), F.abs(F.col("x") - F.col("y")).alias("d"))
    sets = pairs.groupingSets([[], ["coordinate"], ["joint"]], "coordinate", "joint")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_error"), F.round(F.max("d"), 6).alias("max_error"), F.bool_and(F.col("d") <= 1e-6 + 1e-5).alias("all_close")).select("coordinate", "joint", "n", "mean_error", "max_error", "all_close")


@query("""
WITH b AS (SELECT vec_id, vec_id // 16 AS batch, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) AS s FROM b x JOIN b y USING (batch))
SELECT a AS vec_id, round(max(s) FILTER (a = b), 6) AS positive, round(max(s) FILTER (a <> b), 6) AS hardest_negative, count(*) FILTER (a <> b AND s >= 0.999) AS same_as FROM p GROUP BY a""")
def batch_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the pairs in a batch of 16: the diagonal and the hardest negative."""
    from sluice.functions.arrays import cosine

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), F.col("embedding").cast("array<double>").alias("v"))
    other = rows.select(F.col("vec_id").alias("b"), "batch", F.col("v").alias("w"))
    pairs = rows.join(other, "batch").select("vec_id", "b", cosine(F.col("v"), F.col("w")).alias("s"))
    same = F.col("vec_id") == F.col("b")
    return pairs.groupBy("vec_id").agg(F.round(F.max(F.when(same, F.col("s"))), 6).alias("positive"), F.round(F.max(F.when(~same, F.col("s"))), 6).alias("hardest_negative"), F.count_if(~same & (F.col("s") >= 0.999)).alias("same_as"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM v), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.u, y.u) AS s FROM u x, u y)
SELECT a AS vec_id, round(max(s) FILTER (a <> b), 6) AS nearest, round(ln(sum(exp(14.285714285714286 * s))), 6) AS log_sum_exp, round(max(s) FILTER (a = b), 6) AS positive, count(*) FILTER (a <> b AND s >= 0.999) AS same_as FROM p GROUP BY a""")
def all_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of every vector with all others, by blocks: the nearest, the contrastive denominator at temperature 0.07, and equals."""
    found = blocks.similarities(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=1 / 0.07)
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("nearest", "log_sum_exp", "positive")], "same_as")


@query("""
WITH s AS (SELECT 'a' AS shard, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', doc_id FROM documents WHERE doc_id % 3 = 0), k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM k WHERE n > 1) AS in_both, (SELECT count(*) FROM k) AS merged, (SELECT count(*) FROM (SELECT doc_id FROM s WHERE shard = 'a' EXCEPT SELECT doc_id FROM s WHERE shard = 'b')) AS only_a,
NOT EXISTS (SELECT doc_id FROM s WHERE shard = 'a' EXCEPT SELECT doc_id FROM s WHERE shard = 'b') AS equal_sets""")
def shard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of shards, their duplicates, intersection, difference and equality."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    a, b = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0")
    both = a.withColumn("shard", F.lit("a")).unionByName(b.withColumn("shard", F.lit("b")))
    by_id = both.groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = by_id.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("in_both"), F.count("*").alias("merged"))
    only = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    return counts.crossJoin(F.broadcast(only)).withColumn("equal_sets", F.col("only_a") == 0)
