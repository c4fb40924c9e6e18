"""Immutable deliveries: layout, staging, inventory, checks, publication."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.lineage import durable
from sluice.plans.ordinal import with_ordinal
from sluice.sources.archives import register
from sluice.sources.manifests import checksum_list
from sluice.sources.storage import stream

#: The layout's bounds.
ROWS_PER_PART, PARTS_PER_CHUNK = 1024, 64
ROW_GROUP_BYTES = 1 << 30
#: Tasks that write parts, for each that can run at a time.
WRITERS = 4


@dataclass(frozen=True)
class Delivery:
    """Where a delivery lies, and its two side tables."""

    data: str
    index: str
    inventory: str


def laid_out(rows: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART, parts_per_chunk: int = PARTS_PER_CHUNK) -> DataFrame:
    """``rows`` (with split) and their chunk, part and row_index, by key within the split."""
    placed = with_ordinal(rows, [key], ["split"])
    part = F.floor(F.col("ordinal") / rows_per_part)
    return placed.select(*rows.columns, F.floor(part / parts_per_chunk).cast("int").alias("chunk"), part.cast("int").alias("part"), (F.col("ordinal") % rows_per_part).cast("int").alias("row_index"))


def staged(rows: DataFrame, key: str, folder: str, **layout) -> Delivery:
    """A delivery written below ``folder``: one file for each part, an index and an inventory.

    The files appear by Spark's commit protocol; a folder that exists is left alone and fails.
    """
    out = Delivery(f"{folder}/data", f"{folder}/index", f"{folder}/inventory")
    laid = laid_out(rows, key, **layout)
    # a number of tasks of its own: small parts would be put together into few tasks, which write their files one after the other
    dealt = laid.repartition(WRITERS * rows.sparkSession.sparkContext.defaultParallelism, "split", "chunk", "part").sortWithinPartitions("split", "chunk", "part", "row_index")
    # a part's rows fit into one row group
    dealt.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("split", "chunk", "part").parquet(out.data)
    spark = rows.sparkSession
    written = read(spark, out)
    written.select(key, "split", "chunk", "part", "row_index").write.option("compression", "zstd").parquet(out.index)
    facts = file_facts(spark, out).select("split", "chunk", "part", F.col("sha256").alias("file_sha256"), "row_groups")
    inventory_of(written, key).select("split", "chunk", "part", "rows", "files", "bytes", "keys_sha256").join(facts, ["split", "chunk", "part"]).write.parquet(out.inventory)
    return out


def read(spark: SparkSession, delivery: Delivery) -> DataFrame:
    """A delivery's rows; splits, chunks and parts prune the files read."""
    return spark.read.parquet(delivery.data)


#: Keys, at most, that are looked up by naming the files that hold them.
FEW_KEYS = 10_000


def lookup(spark: SparkSession, delivery: Delivery, keys: DataFrame, key: str, few: int = FEW_KEYS) -> DataFrame:
    """The rows of some keys, found by the index.

    Up to ``few`` keys reach the index's scan as a filter, which skips the row
    groups of other ranges, and only the folders of the parts that it names are
    read, again with the keys as a filter. More are met by joins.
    """
    index = spark.read.parquet(delivery.index)
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    told = [r[0] for r in wanted.limit(few + 1).collect()]
    if len(told) > few:
        return read(spark, delivery).join(index.join(wanted, key, "left_semi"), [key, *LAYOUT], "left_semi")
    places = index.where(F.col(key).isin(told))
    parts = sorted({(r["split"], r["chunk"], r["part"]) for r in places.select("split", "chunk", "part").distinct().collect()})
    folders = [f"{delivery.data}/split={s}/chunk={c}/part={p}" for s, c, p in parts]
    rows = spark.read.schema(read(spark, delivery).schema).option("basePath", delivery.data).parquet(*folders) if folders else read(spark, delivery).limit(0)
    return rows.where(F.col(key).isin(told)).join(F.broadcast(places), [key, *LAYOUT], "left_semi")  # as many rows as keys


def inventory_of(written: DataFrame, key: str, checks: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part: rows, files, bytes and the digest of its ordered keys, and what :func:`problems` needs of it."""
    checks = checks or {}
    keyed = written.select("split", "chunk", "part", "row_index", F.col(key).alias("own"), F.col(key).cast("string").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), *[bad.alias(f"bad_{i}") for i, bad in enumerate(checks.values())])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "key"))), lambda r: F.concat(r["key"], F.lit("\n")))
    facts = [F.count("*").alias("rows"), F.count_distinct("file").alias("files"), F.max("size").alias("bytes"), F.sha2(F.array_join(ordered, ""), 256).alias("keys_sha256")]
    more = [F.min("own").alias("low"), F.max("own").alias("high"), F.min("row_index").alias("first"), F.max("row_index").alias("last"), F.count_distinct("row_index").alias("places")]
    return keyed.groupBy("split", "chunk", "part").agg(*facts, *more, *[F.count_if(F.coalesce(f"bad_{i}", F.lit(True))).alias(f"bad_{i}") for i in range(len(checks))])


def file_facts(spark: SparkSession, delivery: Delivery) -> DataFrame:
    """split, chunk, part, file, size, sha256, file_rows and row_groups of each data file: its bytes are digested and its footer read."""
    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("file_rows", pa.int64()), ("row_groups", pa.int64()), ("problem", pa.string())])

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size, sha256, problem in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "sha256", "problem"))):
                n = groups = None
                try:
                    with stream(f"{delivery.data}/{path}") as file:
                        about = pq.read_metadata(file)
                    n, groups = about.num_rows, about.num_row_groups
                except (pa.ArrowInvalid, OSError):
                    problem = problem or "unreadable"
                rows.append((path, size, sha256, n, groups, problem))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, schema.types)], schema=schema)

    register(spark)
    found = spark.read.format("sluice_inventory").option("glob", "*.parquet").load(delivery.data)
    read_ = found.mapInArrow(footers, "file string, size long, sha256 string, file_rows long, row_groups long, problem string")
    place = lambda name, kind: F.regexp_extract("file", rf"(?:^|/){name}=([^/]*)/", 1).cast(kind).alias(name)
    return read_.select(place("split", "string"), place("chunk", "int"), place("part", "int"), "file", "size", "sha256", "file_rows", "row_groups", "problem")


def problems(spark: SparkSession, delivery: Delivery, expected: DataFrame, key: str, payload: dict[str, Column] | None = None, files: bool = False) -> DataFrame:
    """Everything wrong with a delivery, as rows of (check, detail); none if it is whole.

    ``payload`` names conditions on a row's columns that say it is bad. Two
    scans of the data make all of it: one by key, with the index and what was
    expected, and one by part. With ``files`` a third digests the files and
    reads their footers.
    """
    rows = read(spark, delivery)
    index, told = spark.read.parquet(delivery.index), spark.read.parquet(delivery.inventory)
    payload = payload or {}
    say = lambda df, check, detail: df.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    none = F.lit(None).cast("struct<split:string,chunk:int,part:int,row_index:int>")
    place = F.struct(F.col("split").cast("string").alias("split"), F.col("chunk").cast("int").alias("chunk"), F.col("part").cast("int").alias("part"), F.col("row_index").cast("int").alias("row_index"))
    tagged = [df.select(F.col(key).alias("key"), at.alias("at"), *[F.lit(int(kind == k)).alias(k) for k in ("data", "index", "wanted")]) for df, kind, at in ((rows, "data", place), (index, "index", place), (expected, "wanted", none))]
    by_key = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("key").agg(
        *[F.sum(k).alias(k) for k in ("data", "index", "wanted")],
        F.min(F.when(F.col("data") == 1, F.col("at"))).alias("data_at"), F.min(F.when(F.col("index") == 1, F.col("at"))).alias("index_at"),
        F.max(F.when(F.col("data") == 1, F.col("at"))).alias("data_to"), F.max(F.when(F.col("index") == 1, F.col("at"))).alias("index_to"))
    by_key = durable(by_key.where((F.col("data") != 1) | (F.col("index") != 1) | (F.col("wanted") != 1) | ~F.col("data_at").eqNullSafe(F.col("index_at")) | F.col("key").isNull() | (F.length(F.trim(F.col("key").cast("string"))) == 0)))
    found = durable(inventory_of(rows, key, payload))
    part = F.concat_ws("/", "split", "chunk", "part")
    before = found.select("split", (F.col("part") + 1).alias("part"), F.col("high").alias("before"))
    moved = ~F.col("data_at").eqNullSafe(F.col("index_at")) | ~F.col("data_to").eqNullSafe(F.col("index_to"))
    checks = [
        say(by_key.where("wanted > 0 and data = 0"), "missing", F.col("key")),
        say(by_key.where("wanted = 0 and data > 0"), "unexpected", F.col("key")),
        say(by_key.where("data > 1"), "repeated", F.col("key")),
        say(by_key.where((F.col("data") > 0) & moved), "not in the index", F.col("key")),
        say(by_key.where((F.col("index") > 0) & moved), "only in the index", F.col("key")),
        say(by_key.where(F.col("data") > 0).where(F.col("key").isNull() | (F.length(F.trim(F.col("key").cast("string"))) == 0)), "blank key", F.col("key")),
        say(found.join(told, ["split", "chunk", "part", "rows", "keys_sha256"], "left_anti"), "inventory", part),
        say(told.join(found, ["split", "chunk", "part"], "left_anti"), "part gone", part),
        say(found.where((F.col("files") > 1) | (F.col("rows") > ROWS_PER_PART)), "layout", part),
        say(found.where((F.col("first") != 0) | (F.col("last") != F.col("rows") - 1) | (F.col("places") != F.col("rows"))), "row order", part),
        say(found.groupBy("split", "chunk").agg((F.max("part") - F.min("part") + 1).alias("span"), F.count("*").alias("n")).where((F.col("span") != F.col("n")) | (F.col("n") > PARTS_PER_CHUNK)), "parts", F.concat_ws("/", "split", "chunk")),
        say(found.join(before, ["split", "part"]).where("low <= before"), "key order", part),
        say(found.where(F.coalesce(F.length(F.trim("split")) == 0, F.lit(True))), "blank split", part),
        *[say(found.where(f"bad_{i} > 0"), name, part) for i, name in enumerate(payload)],
        say(spark.createDataFrame([(schema_digest(rows, key), schema_digest(expected, key))], "found string, wanted string").where("found <> wanted and wanted is not null"), "schema", F.col("found")),
    ]
    if files:
        facts = durable(file_facts(spark, delivery))
        met = facts.join(told.select("split", "chunk", "part", F.col("rows").alias("told_rows"), F.col("file_sha256").alias("told_sha256")), ["split", "chunk", "part"], "left")
        wrong = F.when(F.col("problem").isNotNull(), F.concat(F.lit("file "), "problem")).when(~F.col("sha256").eqNullSafe(F.col("told_sha256")), "file digest").when(F.col("row_groups") != 1, "row groups").when(~F.col("file_rows").eqNullSafe(F.col("told_rows")), "file rows")
        checks.append(met.select(wrong.alias("check"), F.col("file").alias("detail")).where("check is not null"))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


LAYOUT = ("split", "chunk", "part", "row_index")


def schema_digest(rows: DataFrame, key: str) -> str | None:
    """Digest of the names and types of the payload's columns; none where only keys are known."""
    fields = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema if f.name not in (*LAYOUT, key))
    return hashlib.sha256(",".join(fields).encode()).hexdigest() if fields else None


def checksums_written(spark: SparkSession, folder: str, target: str) -> None:
    """The list of a delivery's files and digests, as text lines; a target that exists fails."""
    checksums(spark, folder).select(F.concat("sha256", F.lit("  "), "path").alias("value")).write.text(target)


def checksum_problems(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """problem and path: files that the list lacks, that are gone, or that differ from it."""
    found, told = checksums(spark, folder).select("path", F.col("sha256").alias("found")), checksum_list(spark, target).select("path", F.col("sha256").alias("told"))
    wrong = F.when(F.col("told").isNull(), "not listed").when(F.col("found").isNull(), "gone").when(F.col("found") != F.col("told"), "differs")
    return found.join(told, "path", "full").select(wrong.alias("problem"), "path").where("problem is not null")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, path (below the folder) and size of every file of a delivery."""
    from sluice.sources.files import inventory

    found = inventory(spark, folder).where(~F.col("path").rlike(r"/[._][^/]*$"))
    return found.select("sha256", F.regexp_replace("path", r"^.*?(?=(data|index|inventory)/)", "").alias("path"), "size")


def published(spark: SparkSession, staging: str, target: str) -> None:
    """Moves a staged delivery to its place in one step; a target that exists is never replaced."""
    jvm = spark.sparkContext._jvm
    source, goal = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(goal):
        raise FileExistsError(target)
    files.mkdirs(goal.getParent())
    if not files.rename(source, goal):
        raise OSError(f"{staging} could not be moved to {target}")
