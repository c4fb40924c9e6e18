"""Contracts of records, sources and payloads: what breaks them becomes rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.arrays import norm, points
from sluice.functions.hashing import digest
from sluice.operators.registry import query, table
from sluice.plans import artifacts, payload, predictions, variants
from sluice.plans.ordinal import with_ordinal
from sluice.sources import manifests

#: Joints of a hand before its palm, and the distance within which a joint is right.
ARM_JOINTS, NEAR = 3, 0.3


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '  ' WHEN doc_id % 19 = 0 THEN text || chr(0) ELSE text END AS caption, CASE WHEN doc_id % 5 = 0 THEN upper(lang) || '-Latn-419' WHEN doc_id % 7 = 0 THEN lang || '_x' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS tag FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN caption IS NULL OR length(trim(regexp_replace(caption, '\\s+', ' ', 'g'))) = 0 THEN 'empty caption' END, CASE WHEN contains(caption, chr(0)) THEN 'NUL' END, CASE WHEN tag IS NULL OR NOT regexp_full_match(tag, '[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*') THEN 'language tag' END], lambda x: x IS NOT NULL), ',') AS problems FROM r""")
def caption_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that are blank or hold a NUL, and language tags of another form than aa-Bbbb-cc."""
    doc = F.col("doc_id")
    caption = F.when(doc % 17 == 0, "  ").when(doc % 19 == 0, F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    tag = F.when(doc % 5 == 0, F.concat(F.upper("lang"), F.lit("-Latn-419"))).when(doc % 7 == 0, F.concat("lang", F.lit("_x"))).when(doc % 11 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(manifests.caption_problems(caption, tag), ",").alias("problems"))


@query("""
WITH r AS (SELECT doc_id, 'g' || doc_id % 40 AS g, CASE WHEN doc_id % 40 < 30 THEN 'train' WHEN doc_id % 40 < 35 THEN 'validation' ELSE 'test' END AS s FROM documents),
l AS (SELECT doc_id, CASE WHEN doc_id % 53 = 0 THEN 'short' ELSE sha256(g) END AS group_id, CASE WHEN doc_id % 59 = 0 THEN 'Bad Split' WHEN doc_id % 61 = 0 THEN 'test' ELSE s END AS split FROM r),
p AS (SELECT *, list_filter([CASE WHEN doc_id % 53 = 0 THEN 'group_id' END, CASE WHEN doc_id % 59 = 0 THEN 'split' END], lambda x: x IS NOT NULL) AS problems FROM l),
k AS (SELECT group_id, count(DISTINCT split) AS splits FROM p WHERE len(problems) = 0 GROUP BY group_id)
SELECT p.doc_id::VARCHAR AS sample_id, array_to_string(problems || CASE WHEN k.splits > 1 THEN ['leaks'] ELSE [] END, ',') AS problems FROM p LEFT JOIN k ON p.group_id = k.group_id AND len(p.problems) = 0""")
def split_assignment_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split assignments as JSON lines: fields of the wrong form, and groups in several splits."""
    doc = F.col("doc_id")
    place = doc % 40
    group = F.when(doc % 53 == 0, "short").otherwise(F.sha2(F.concat(F.lit("g"), place), 256))
    split = F.when(doc % 59 == 0, "Bad Split").when(doc % 61 == 0, "test").when(place < 30, "train").when(place < 35, "validation").otherwise("test")
    record = F.struct(F.lit(manifests.SPLIT_VERSION).alias("schema_version"), doc.cast("string").alias("sample_id"), group.alias("group_id"), split.alias("split"))
    found = manifests.split_records(table(spark, sf_dir, "documents").select(F.to_json(record).alias("line")))
    return manifests.with_leaks(found).select("record.sample_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of configurations as compact JSON, their keys in order."""
    fields = {"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}
    return table(spark, sf_dir, "orders").select("o_orderkey", fingerprint(fields).alias("fingerprint"))


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of a configuration's JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)


@query("SELECT split_part(url, '.', 1) AS seq_id, arg_max(html, page_id) AS caption FROM pages GROUP BY 1")
def caption_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions by what precedes the first dot of a file's name; of several the last one stays."""
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(F.substring_index("url", ".", 1).alias("seq_id")).agg(F.max_by("html", "page_id").alias("caption"))


@query("""
WITH f AS (SELECT o_orderkey, 'in/' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.zip.part' WHEN o_orderkey % 7 = 0 THEN '.PART' ELSE '.zip' END AS path, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS size FROM orders)
SELECT o_orderkey, CASE WHEN ends_with(path, '.part') THEN 'incomplete' WHEN size IS NULL THEN 'missing' ELSE 'complete' END AS state FROM f""")
def complete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that may be read: not those still being written, nor those that are not there."""
    key = F.col("o_orderkey")
    ending = F.when(key % 5 == 0, ".zip.part").when(key % 7 == 0, ".PART").otherwise(".zip")
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("in/"), key, ending).alias("path"), F.when(key % 9 != 0, F.col("o_custkey")).alias("size"))
    return files.select("o_orderkey", manifests.file_state(F.col("path"), F.col("size")).alias("state"))


@query("WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id) SELECT user_id, first, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS place FROM f")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value once, in the order of its first row."""
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    return with_ordinal(first, ["first"], name="place").select("user_id", "first", "place")


@query("""
WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM orders), a AS (SELECT * FROM s UNION ALL SELECT id, 'test' FROM s WHERE split = 'val')
SELECT split, count(*) AS n, split IN ('val', 'test') AS val_is_test FROM a GROUP BY split""")
def validation_as_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation rows again as test rows, and which splits hold the same rows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train").alias("split"))
    every = rows.unionByName(rows.where("split = 'val'").withColumn("split", F.lit("test")))
    # rows are compared by number and by two sums of hashes, in any order
    marks = [F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    sums = every.groupBy("split").agg(F.count("*").alias("n"), *marks)
    pair = sums.where("split in ('val', 'test')").groupBy("n", "h1", "h2").agg(F.collect_set("split").alias("names")).where("size(names) = 2").select(F.explode("names").alias("split"), F.lit(True).alias("same"))
    return sums.join(F.broadcast(pair), "split", "left").select("split", "n", F.coalesce("same", F.lit(False)).alias("val_is_test"))


@query("""
WITH e AS (SELECT user_id, event_id AS seen, sha256(event_type) AS sha FROM events), v AS (SELECT user_id, sha, min(seen) AS early, max(seen) AS late FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY early) AS nth, row_number() OVER (PARTITION BY user_id ORDER BY late DESC) AS newest FROM v)
SELECT user_id, CASE WHEN nth = 1 THEN user_id::VARCHAR ELSE user_id || '--source_' || sha END AS artifact, CASE WHEN newest = 1 THEN 'current' ELSE 'quarantined' END AS state FROM r""")
def source_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that comes again with other content is a variant of its own; the newest counts."""
    arrivals = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), F.sha2("event_type", 256).alias("sha"))
    return variants.resolved(arrivals, "user_id", "sha", "at").select("user_id", "artifact", "state")


_SHARDS = """
WITH s AS (SELECT event_id % 4 AS rank, event_id AS sample_id, value FROM events WHERE event_id % 4 <> 2 UNION ALL SELECT 3, event_id, value FROM events WHERE event_id % 100 = 0),
t AS (SELECT event_id % 4 AS rank, count(*) + CASE WHEN event_id % 4 = 3 THEN (SELECT count(*) FROM events WHERE event_id % 100 = 0) ELSE 0 END AS n FROM events WHERE event_id % 4 <> 2 GROUP BY 1)"""


@query(f"""{_SHARDS}
SELECT 'missing rank' AS problem, '2' AS detail UNION ALL SELECT 'tampered', '1'
UNION ALL SELECT 'repeated', sample_id::VARCHAR FROM s GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT 'missing', event_id::VARCHAR FROM events WHERE event_id % 4 = 2 AND event_id % 100 <> 0""")
def shard_merge_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps shards of predictions from being merged: here a rank is missing, one was changed and keys repeat."""
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("int").alias("rank"), F.col("event_id").alias("sample_id"), "value")
    shards = events.where("rank <> 2").unionByName(events.where("sample_id % 100 = 0").withColumn("rank", F.lit(3)))
    receipts = predictions.receipts(shards)
    changed = shards.withColumn("value", F.when((F.col("rank") == 1) & (F.col("sample_id") % 8 == 1), F.col("value") + 1).otherwise(F.col("value")))
    return predictions.problems(changed, receipts, events.select("sample_id"), 4)


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS c, vec_id % 13 AS k FROM embeddings)
SELECT vec_id, array_to_string(list_filter([CASE WHEN k = 1 THEN 'caption' END, CASE WHEN k = 6 THEN 'confidence range' WHEN k <> 3 AND (c + 0.5 < 0 OR c + 0.5 > 1) THEN 'confidence range' END, CASE WHEN k = 3 THEN 'confidence shape' END, CASE WHEN k = 4 THEN 'frame mask' WHEN k = 5 THEN 'frame mask' END, CASE WHEN k = 7 THEN 'not finite' END, CASE WHEN k = 2 THEN 'pose shape' END], lambda x: x IS NOT NULL), ',') AS problems FROM p""")
def payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes, masks and ranges of nested arrays, checked where they lie."""
    k = F.col("vec_id") % 13
    x = F.get("embedding", F.lit(0)).cast("double")
    nest = lambda value, *sizes: nest(F.array_repeat(value, sizes[-1]), *sizes[:-1]) if sizes else value
    frames = 2
    value = F.when(k == 7, F.lit(float("inf"))).otherwise(x)
    sure = F.when(k == 6, F.lit(2.0)).otherwise(x + 0.5)
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit(frames).alias("frame_count"), F.when(k == 1, " ").otherwise("words").alias("caption"),
        F.when(k == 2, nest(value, frames, 2, 24, 2)).otherwise(nest(value, frames, 2, 24, 3)).alias("pose"),
        F.when(k == 3, nest(F.lit(0.5), frames, 2, 23)).otherwise(nest(sure, frames, 2, 24)).alias("pose_confidence"),
        F.when(k == 4, nest(F.lit(True), 3)).when(k == 5, nest(F.lit(False), 2)).otherwise(F.array(F.lit(True), F.lit(False))).alias("frame_mask"),
    )
    return rows.select("vec_id", F.array_join(payload.translation_problems(joints=24, coordinates=3), ",").alias("problems"))


@query("""
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), g AS (SELECT doc_id, sha256(source) AS group_id FROM documents)
SELECT 'delivery.v1' AS schema_version, 'translation' AS product, d.doc_id::VARCHAR AS sample_id, g.group_id, CASE WHEN left(g.group_id, 1) < '8' THEN 'train' ELSE 'test' END AS split, d.text AS caption, d.lang AS caption_language, greatest(1, d.n_chars // 100)::INT AS frame_count, l.quality
FROM documents d JOIN g USING (doc_id) JOIN l USING (doc_id)""")
def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a delivery: the common columns, and those of a product, from samples, splits and labels."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("caption"), F.col("lang").alias("caption_language"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 100)).cast("int").alias("frame_count"), digest(F.col("source")).alias("group_id"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("sample_id")).agg(F.max("quality").alias("quality"))
    splits = docs.select("sample_id", F.when(F.substring("group_id", 1, 1) < "8", "train").otherwise("test").alias("split"))
    return payload.rows(docs.join(labels, "sample_id"), splits, "translation").select("schema_version", "product", "sample_id", "group_id", "split", "caption", "caption_language", "frame_count", "quality")


@query("""
WITH j AS (SELECT vec_id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(3, 21) r(i)),
m AS (SELECT vec_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM j GROUP BY vec_id), c AS (SELECT j.vec_id, i, j.x - m.x AS x, j.y - m.y AS y, j.z - m.z AS z FROM j JOIN m USING (vec_id)),
d AS (SELECT a.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM c a JOIN c b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
SELECT vec_id, round(avg(d), 6) AS mean_distance, round(avg((d <= 0.3)::INT), 6) AS pck FROM d GROUP BY vec_id""")
def palm_pck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of palm joints within a distance, both palms centred on their mean; joints whose target is not a number do not count."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", points(F.col("embedding").cast("array<double>")).alias("p"))
    both = poses.join(poses.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    found = both.select("vec_id", palm_distances(F.col("p"), F.col("q")).alias("d"))
    near = F.size(F.filter("d", lambda d: d <= NEAR)) / F.nullif(F.size("d"), F.lit(0))
    return found.select("vec_id", F.round(F.aggregate("d", F.lit(0.0), lambda s, d: s + d) / F.nullif(F.size("d"), F.lit(0)), 6).alias("mean_distance"), F.round(near, 6).alias("pck"))


def palm_distances(predicted: Column, target: Column) -> Column:
    """Distances of the joints after the arm's, each side less its palm's mean."""
    def centred(pose: Column) -> Column:
        palm = F.slice(pose, ARM_JOINTS + 1, 1_000)
        mean = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda a: F.aggregate(palm, F.lit(0.0), lambda s, p: s + F.get(p, a)) / F.size(palm))
        # the mean is worked out once for the palm
        return F.get(F.transform(F.array(mean), lambda m: F.transform(palm, lambda p: F.zip_with(p, m, lambda a, b: a - b))), F.lit(0))

    pairs = F.arrays_zip(centred(predicted).alias("p"), centred(target).alias("q"))
    told = F.filter(pairs, lambda j: ~F.exists(j["q"], lambda v: F.isnan(v)))
    return F.transform(told, lambda j: norm(F.zip_with(j["p"], j["q"], lambda a, b: a - b)))


@query()
def body_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-body frames made denser: body, three points on each of its edges, both hands, the depth drawn in."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", points(F.col("embedding").cast("array<double>")).alias("p"))
    after = lambda k: F.lead("p", k).over(W.partitionBy(F.floor(F.col("vec_id") / 10)).orderBy("vec_id"))
    frames = poses.select("vec_id", F.concat("p", after(1), after(2)).alias("joints")).where("joints is not null")
    return frames.select("vec_id", F.posexplode(payload.body_cloud(F.col("joints"))).alias("i", "p")).select("vec_id", "i", *[F.round(F.get("p", F.lit(k)), 6).alias(n) for k, n in enumerate("xyz")])


_FP = "f" * 64


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 23 AS c FROM orders)
SELECT k::VARCHAR AS sample_id, CASE c WHEN 1 THEN 'sidecar_unreadable_or_missing' WHEN 2 THEN 'invalid_sidecar_json' WHEN 3 THEN 'sidecar_not_object' WHEN 4 THEN 'sidecar_schema_mismatch' WHEN 5 THEN 'sidecar_status_not_completed' WHEN 6 THEN 'config_fingerprint_mismatch'
  WHEN 7 THEN 'sample_id_path_mismatch' WHEN 8 THEN 'source_archive_path_mismatch' WHEN 9 THEN 'missing_artifact_identity' WHEN 10 THEN 'invalid_declared_artifact_size' WHEN 11 THEN 'invalid_declared_artifact_sha256' WHEN 12 THEN 'invalid_declared_artifact_path' WHEN 13 THEN 'declared_artifact_path_mismatch'
  WHEN 14 THEN 'artifact_unreadable_or_missing' WHEN 15 THEN 'artifact_not_regular_file' WHEN 16 THEN 'artifact_changed_during_audit' WHEN 17 THEN 'artifact_size_mismatch,artifact_stream_size_mismatch' WHEN 18 THEN 'artifact_sha256_mismatch' WHEN 19 THEN 'sidecar_changed_during_audit' ELSE '' END AS failures,
  c IN (0, 4, 7, 8, 12, 13, 15, 16, 19, 20, 21, 22) AS complete, CASE WHEN c = 21 THEN 'completed' WHEN c IN (0, 7, 8, 12, 13, 15, 16, 19, 20, 22) THEN 'completed' END AS state FROM o""")
def artifact_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts and their sidecars, some broken in each of the ways that have a name."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 23).alias("c"))
    c, sha = F.col("c"), F.sha2("id", 256)
    broken = lambda k, bad, good: F.when(c == k, bad).otherwise(good)
    artifact = F.struct(broken(12, F.lit(""), broken(13, F.lit("elsewhere"), F.concat(F.lit("out/"), "id", F.lit(".npz")))).alias("path"), broken(10, F.lit("-1"), F.lit("7")).alias("size_bytes"), broken(11, F.lit("xyz"), sha).alias("sha256"))
    record = F.to_json(F.struct(
        broken(4, F.lit("v0"), F.lit(artifacts.SIDECAR_VERSION)).alias("schema_version"), broken(5, F.lit("running"), F.lit("completed")).alias("status"), broken(6, F.lit("0" * 64), F.lit(_FP)).alias("config_fingerprint"),
        broken(7, F.lit("other"), F.col("id")).alias("sample_id"), F.struct(broken(8, F.lit("b.zip"), F.lit("a.zip")).alias("archive")).alias("source"), F.when(c != 9, artifact).alias("artifact"),
    ))
    json = F.when(c == 2, "{").when(c == 3, "[1]").when(c != 1, record)
    sidecars = orders.select(F.col("id").alias("stem"), json.alias("json"), F.lit("a.zip").alias("archive"), F.lit("7@1").alias("before"), broken(19, F.lit("8@2"), F.lit("7@1")).alias("after"))
    files = orders.where("c <> 14").select(
        F.col("id").alias("stem"), F.concat(F.lit("out/"), "id", F.lit(".npz")).alias("path"), broken(17, F.lit(9), F.lit(7)).cast("long").alias("size"), F.lit(7).cast("long").alias("read"), broken(18, F.lit("0" * 64), sha).alias("sha256"),
        F.lit("7@1").alias("before"), broken(16, F.lit("7@2"), F.lit("7@1")).alias("after"), (c != 15).alias("regular"),
    )
    both = artifacts.paired(sidecars, files)
    return both.select(F.col("stem").alias("sample_id"), F.array_join(artifacts.pair_failures(_FP), ",").alias("failures"), artifacts.is_complete(_FP).alias("complete"), artifacts.terminal_state(_FP).alias("state"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT sqrt(list_dot_product(v, v)) AS norm, list_dot_product(v, v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(v, v))) AS own FROM v)
SELECT count(*) AS n, round(min(norm), 6) AS minimum_norm, round(min(own), 6) AS self_similarity, bool_and(norm > 0 AND own >= 0.999) AS ok FROM n""")
def embedding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, least norm and least similarity with itself of a model's vectors."""
    v = F.col("embedding").cast("array<double>")
    length = norm(v)
    rows = table(spark, sf_dir, "embeddings").select(length.alias("norm"), F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), length * length).alias("own"))
    return rows.agg(F.count("*").alias("n"), F.round(F.min("norm"), 6).alias("minimum_norm"), F.round(F.min("own"), 6).alias("self_similarity"), F.bool_and((F.col("norm") > 0) & (F.col("own") >= 0.999)).alias("ok"))


@query("""
WITH j AS (SELECT vec_id, vec_id // 8 AS seq, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(21) r(i)), c AS (SELECT seq, avg(z) AS depth FROM j WHERE i IN (6, 7) GROUP BY seq)
SELECT vec_id, (CASE WHEN i < 5 THEN i ELSE i - 6 END)::INT AS joint, round(x, 6) AS x, round(y, 6) AS y, round(z - depth + 1e-9, 6) AS z FROM j JOIN c USING (seq) WHERE i < 5 OR i >= 11""")
def joint_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose's first and last joints, their depth less the sequence's mean depth of two joints."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("seq"), points(F.col("embedding").cast("array<double>")).alias("p"))
    depth = lambda j: F.get(F.get("p", F.lit(j)), F.lit(2))
    centres = poses.groupBy("seq").agg(((F.avg(depth(6)) + F.avg(depth(7))) / 2).alias("depth"))
    kept = poses.join(centres, "seq").select("vec_id", "depth", F.posexplode(F.concat(F.slice("p", 1, 5), F.slice("p", -10, 10))).alias("joint", "q"))
    at = lambda k: F.get("q", F.lit(k))
    return kept.select("vec_id", "joint", F.round(at(0), 6).alias("x"), F.round(at(1), 6).alias("y"), F.round(at(2) - F.col("depth") + 1e-9, 6).alias("z"))
