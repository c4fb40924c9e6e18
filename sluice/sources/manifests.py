"""Strict scans of text manifests: JSON lines, CSV, checksum lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sample record's version, fields and the form of its digests.
SAMPLE_VERSION = "sample.v1"
SAMPLE_SCHEMA = "schema_version string, sample_id string, dataset string, sequence_id string, subject_id string, modalities map<string, struct<uri: string, text: string, shape: array<bigint>, dtype: string, sha256: string>>, group_keys map<string, string>, acquisition string, provenance string"
SAMPLE_FIELDS = ("schema_version", "sample_id", "dataset", "sequence_id", "subject_id", "modalities", "group_keys", "acquisition", "provenance")
SHA256 = "^[0-9a-f]{64}$"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of JSON files, blank ones left out: line and file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.where(F.length(F.trim("line")) > 0)


def unknown_keys(line: Column, allowed: tuple[str, ...]) -> Column:
    """A JSON object's keys that are not allowed; null if it is no object."""
    return F.array_except(F.json_object_keys(line), F.array(*[F.lit(k) for k in allowed]))


def sample_records(lines: DataFrame) -> DataFrame:
    """line, record (a struct) and problems (sorted names) of JSON lines.

    The record is closed: keys beyond the schema's are a problem, at the top
    and in each modality, which must be a location or a text, not both.
    """
    parsed = lines.withColumn("record", F.from_json("line", SAMPLE_SCHEMA))
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    refs = F.map_values(F.coalesce(F.col("record.modalities"), F.create_map().cast("map<string, struct<uri: string, text: string, shape: array<bigint>, dtype: string, sha256: string>>")))
    bad_path = lambda u: u.rlike(r"^/") | u.rlike(r"(^|/)\.\.(/|$)")
    checks = {
        "not an object": F.json_object_keys("line").isNull(),
        "unknown key": F.size(F.coalesce(unknown_keys(F.col("line"), SAMPLE_FIELDS), F.array().cast("array<string>"))) > 0,
        "version": ~F.col("record.schema_version").eqNullSafe(F.lit(SAMPLE_VERSION)),
        "blank id": blank(F.col("record.sample_id")) | blank(F.col("record.dataset")),
        "no modality": F.size(refs) == 0,
        "location and text": F.exists(refs, lambda r: r["uri"].isNull() == r["text"].isNull()),
        "unsafe location": F.exists(refs, lambda r: F.coalesce(bad_path(r["uri"]), F.lit(False))),
        "negative shape": F.exists(refs, lambda r: F.coalesce(F.exists(r["shape"], lambda n: n < 0), F.lit(False))),
        "digest": F.exists(refs, lambda r: F.coalesce(~r["sha256"].rlike(SHA256), F.lit(False))),
    }
    problems = F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))
    return parsed.select("line", "record", problems.alias("problems"))


#: The split record's version, its fields and the form of a split's name.
SPLIT_VERSION = "split.v1"
SPLIT_SCHEMA = "schema_version string, sample_id string, group_id string, split string"
SPLIT_FIELDS = ("schema_version", "sample_id", "group_id", "split")
SPLIT_NAME = "^[a-z][a-z0-9_-]*$"
#: Fixed value: the form of a language tag.
LANGUAGE_TAG = "^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$"


def _named(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))


def split_records(lines: DataFrame) -> DataFrame:
    """line, record and problems of split assignments as JSON lines; the record is closed."""
    parsed = lines.withColumn("record", F.from_json("line", SPLIT_SCHEMA))
    problems = _named({
        "not an object": F.json_object_keys("line").isNull(),
        "unknown key": F.size(F.coalesce(unknown_keys(F.col("line"), SPLIT_FIELDS), F.array().cast("array<string>"))) > 0,
        "version": ~F.col("record.schema_version").eqNullSafe(F.lit(SPLIT_VERSION)),
        "sample_id": F.length(F.trim("record.sample_id")) == 0,
        "group_id": ~F.col("record.group_id").rlike(SHA256),
        "split": ~F.col("record.split").rlike(SPLIT_NAME),
    })
    return parsed.select("line", "record", problems.alias("problems"))


def with_leaks(records: DataFrame) -> DataFrame:
    """``records``, and ``leaks`` among the problems of sound ones whose group lies in several splits."""
    sound = records.where("size(problems) = 0").select("record.group_id", "record.split").distinct()
    leaking = sound.groupBy("group_id").agg(F.count("*").alias("splits")).where("splits > 1").select(F.col("group_id").alias("leaking"))
    met = (F.size("problems") == 0) & (F.col("record.group_id") == F.col("leaking"))
    leaks = F.when(F.col("leaking").isNotNull(), F.array(F.lit("leaks"))).otherwise(F.array().cast("array<string>"))
    return records.join(leaking, met, "left").select("line", "record", F.concat("problems", leaks).alias("problems"))


def caption_problems(caption: Column, tag: Column) -> Column:
    """Names of what is wrong with a caption and its language tag."""
    from sluice.functions.text import collapsed

    return _named({"empty caption": F.length(collapsed(caption)) == 0, "NUL": F.contains(F.coalesce(caption, F.lit("")), F.lit("\0")), "language tag": ~tag.rlike(LANGUAGE_TAG)})


def file_state(path: Column, size: Column) -> Column:
    """complete, incomplete (still being written, as its name says) or missing."""
    return F.when(F.endswith(path, F.lit(".part")), "incomplete").when(size.isNull(), "missing").otherwise("complete")


def predictions_folder(spark: SparkSession, path: str) -> DataFrame:
    """file, sample_id, prediction and reference of a folder's JSON files, each an object by sample; spaces and line ends go."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string, struct<prediction: string, reference: string>>").alias("of"))
    plain = lambda c: F.translate(c, " \n", "")
    return texts.select("file", F.explode("of").alias("sample_id", "r")).select("file", "sample_id", plain("r.prediction").alias("prediction"), plain("r.reference").alias("reference"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def csv_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with header; fields may hold line breaks and doubled quotes; a row of another form fails."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=False)


def labels_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labels (video, pose, text) with the video's base name as key."""
    from sluice.functions.text import basename

    return spark.read.json(path, schema="video string, pose string, text string", multiLine=True).withColumn("key", basename(F.col("video")))


def label_problems(labels: DataFrame) -> DataFrame:
    """key and problem of labels without a key or a text, and of keys that come more than once."""
    blank = labels.where(F.coalesce(F.length(F.trim("key")) == 0, F.lit(True))).select("key", F.lit("blank key").alias("problem"))
    mute = labels.where(F.coalesce(F.length(F.trim("text")) == 0, F.lit(True))).select("key", F.lit("blank text").alias("problem"))
    return blank.unionByName(mute).unionByName(repeated(labels, "key").select("key", F.lit("repeated").alias("problem")))


#: The annotation record's version and fields.
ANNOTATION_VERSION = "annotation_lines.v1"
ANNOTATION_FIELDS = ("schema_version", "name", "caption", "label_char", "label_gloss")


def annotation_records(lines: DataFrame) -> DataFrame:
    """name, caption, label_char, label_gloss and problems (sorted names) of annotations as JSON lines.

    A line is parsed once, to a VARIANT. The caption is the joined characters;
    a gloss is a text or an object that has one; none at all is an empty list.
    """
    of = lines.select(F.try_parse_json("line").alias("v")).select("v", *[F.try_variant_get("v", f"$.{name}", "variant").alias(name) for name in ("name", "label_char", "label_gloss")])
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    glosses = F.transform(F.try_variant_get("label_gloss", "$", "array<variant>"), lambda x: F.coalesce(text(x), text(F.try_variant_get(x, "$.gloss", "variant"))))
    characters = F.transform(F.try_variant_get("label_char", "$", "array<variant>"), text)
    parsed = of.select(text(F.col("name")).alias("name"), characters.alias("label_char"), F.when(kind(F.col("label_gloss")) == "VOID", F.array().cast("array<string>")).otherwise(glosses).alias("label_gloss"), kind(F.col("v")).startswith("OBJECT").alias("_object"))
    blank = lambda c: F.length(F.trim(c)) == 0
    problems = _named({
        "not an object": ~F.col("_object"),
        "name": blank(F.col("name")),
        "label_char": (F.size("label_char") == 0) | F.exists("label_char", lambda c: c.isNull()),
        "label_gloss": F.col("label_gloss").isNull() | F.exists("label_gloss", lambda g: g.isNull() | blank(g)),
    })
    return parsed.select("name", F.array_join("label_char", "").alias("caption"), "label_char", "label_gloss", problems.alias("problems"))


def by_name(rows: DataFrame) -> DataFrame:
    """``rows`` in the order in which annotations are written."""
    return rows.repartitionByRange("name").sortWithinPartitions("name")


def annotations_written(rows: DataFrame, target: str, ordered: bool = False) -> None:
    """Writes rows of name, label_char and label_gloss (texts or a VARIANT) as JSON lines, by name; a target that exists fails.

    With ``ordered`` rows come from :func:`by_name`, which moved them before their texts were taken apart, and are not moved again.
    """
    record = {"schema_version": F.lit(ANNOTATION_VERSION), "name": F.col("name"), "caption": F.array_join("label_char", ""), "label_char": F.col("label_char"), "label_gloss": F.col("label_gloss")}
    placed = rows if ordered else by_name(rows)
    placed.select(F.to_json(F.struct(*[record[f].alias(f) for f in sorted(ANNOTATION_FIELDS)])).alias("value")).write.text(target)


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and path of the lines of a checksum list ("<hex>  <path>" or "<hex> *<path>")."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    part = lambda i: F.regexp_extract("value", r"^([0-9a-f]{64}) [ *](.+)$", i)
    return lines.select(part(1).alias("sha256"), part(2).alias("path"))
