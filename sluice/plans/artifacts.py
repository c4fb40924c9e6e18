"""Artifacts and the records beside them: named failures, completion, terminal states, archive audits.

Sidecars (JSON as text), files (path, size, sha256) and what was expected are
tables; a left join by path brings them together and every rule is an
expression, so nothing stops at the first failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.sources.manifests import SHA256

#: The record's version and its fields.
SIDECAR_VERSION = "annotation.v1"
SIDECAR = (
    "schema_version string, status string, config_fingerprint string, sample_id string, sequence_id string, "
    "source struct<archive: string, archive_size_bytes: bigint, member_size_bytes: bigint, member_crc32: bigint, archive_sha256: string>, "
    "artifact struct<path: string, size_bytes: string, sha256: string>, audit_artifact struct<size_bytes: bigint, sha256: string>, qc struct<reasons: array<string>>"
)


#: Names of failures below are fixed values.
def codes(checks: dict[str, Column]) -> Column:
    """Names of the checks that are true, each once, sorted; a check that cannot be made is not true."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))))


def paired(sidecars: DataFrame, files: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """Sidecars (path, json, archive, stem, before, after) with their record and the artifact file of the same stem.

    ``before`` and ``after`` are sizes and times of the sidecar, as text, before
    and after it was read; ``regular``, if there, says whether it is a regular
    file. ``audits`` (stem, size, sha256) are the files that audit artifacts declare.
    """
    regular = F.coalesce("regular", F.lit(True)) if "regular" in sidecars.columns else F.lit(True)
    sidecars = sidecars.withColumn("sidecar_regular", regular).drop("regular")
    if audits is not None:
        sidecars = sidecars.join(audits.select(F.col("stem").alias("_audit"), F.col("size").alias("audit_size"), F.col("sha256").alias("audit_sha256")), F.col("stem") == F.col("_audit"), "left").drop("_audit")
    held = files.select(F.col("stem").alias("_stem"), *[F.col(c).alias(f"file_{c}") for c in ("path", "size", "read", "sha256", "before", "after", "regular")])
    return sidecars.withColumn("record", F.from_json("json", SIDECAR)).join(held, F.col("stem") == F.col("_stem"), "left").drop("_stem")


def pair_failures(fingerprint: str) -> Column:
    """The named failures of a :func:`paired` row: of its sidecar, of what it declares, and of the file found."""
    r, object_ = F.col("record"), F.json_object_keys("json").isNotNull()
    broken = F.col("json").isNotNull() & F.try_parse_json("json").isNull()
    declared, size = r["artifact"], r["artifact"]["size_bytes"].try_cast("long")
    sound = F.col("json").isNotNull() & ~broken & object_
    variant = F.startswith(F.col("stem"), F.concat(r["sample_id"], F.lit("--source_"))) & F.col("stem").rlike("--source_[0-9a-f]{64}$") & (F.length("stem") == F.length(r["sample_id"]) + 73)
    of_source = F.col("stem").eqNullSafe(r["sample_id"]) | F.coalesce(variant, F.lit(False))
    there = F.col("file_path").isNotNull()
    good_sha = declared["sha256"].rlike(SHA256)
    return codes({
        "sidecar_unreadable_or_missing": F.col("json").isNull(),
        "sidecar_not_regular_file": ~F.col("sidecar_regular"),
        "sidecar_changed_during_audit": ~F.col("before").eqNullSafe(F.col("after")),
        "invalid_sidecar_json": broken,
        "sidecar_not_object": F.col("json").isNotNull() & ~broken & ~object_,
        "sidecar_schema_mismatch": sound & ~r["schema_version"].eqNullSafe(F.lit(SIDECAR_VERSION)),
        "sidecar_status_not_completed": sound & ~r["status"].eqNullSafe(F.lit("completed")),
        "config_fingerprint_mismatch": sound & ~r["config_fingerprint"].eqNullSafe(F.lit(fingerprint)),
        "sample_id_path_mismatch": sound & ~of_source,
        "source_archive_path_mismatch": sound & ~r["source"]["archive"].eqNullSafe(F.col("archive")),
        "missing_artifact_identity": sound & declared.isNull(),
        "invalid_declared_artifact_size": sound & declared.isNotNull() & ~F.coalesce(size >= 0, F.lit(False)),
        "invalid_declared_artifact_sha256": sound & declared.isNotNull() & ~F.coalesce(good_sha, F.lit(False)),
        "invalid_declared_artifact_path": sound & declared.isNotNull() & ~F.coalesce(F.length(declared["path"]) > 0, F.lit(False)),
        "declared_artifact_path_mismatch": sound & there & (F.length(declared["path"]) > 0) & (declared["path"] != F.col("file_path")),
        "artifact_unreadable_or_missing": ~there,
        "artifact_not_regular_file": there & ~F.col("file_regular"),
        "artifact_changed_during_audit": there & ~F.col("file_before").eqNullSafe(F.col("file_after")),
        "artifact_stream_size_mismatch": there & (F.col("file_read") != F.col("file_size")),
        "artifact_size_mismatch": there & (size >= 0) & (size != F.col("file_size")),
        "artifact_sha256_mismatch": there & good_sha & (declared["sha256"] != F.col("file_sha256")),
    })


def is_complete(fingerprint: str, source: Column | None = None) -> Column:
    """True if a :func:`paired` row need not be made again: status, fingerprint, size, digest and, if given, source agree."""
    r = F.col("record")
    same = r["status"].eqNullSafe(F.lit("completed")) & r["config_fingerprint"].eqNullSafe(F.lit(fingerprint))
    same &= (r["artifact"]["size_bytes"].try_cast("long") == F.col("file_size")) & (r["artifact"]["sha256"] == F.col("file_sha256"))
    if source is not None:
        for field in ("archive_size_bytes", "member_size_bytes", "member_crc32", "archive_sha256"):
            same &= source[field].isNull() | (r["source"][field] == source[field])
    return F.coalesce(same, F.lit(False))


def terminal_state(fingerprint: str, audited: bool = False) -> Column:
    """completed, skipped (with reasons) or null (to be made again), of a :func:`paired` row.

    With ``audited`` the audit artifact that the record declares must be there
    too, with its size and digest.
    """
    r = F.col("record")
    known = r["config_fingerprint"].eqNullSafe(F.lit(fingerprint)) & r["schema_version"].eqNullSafe(F.lit(SIDECAR_VERSION))
    if audited:
        known &= F.coalesce((r["audit_artifact"]["size_bytes"] == F.col("audit_size")) & (r["audit_artifact"]["sha256"] == F.col("audit_sha256")), F.lit(False))
    whole = (r["artifact"]["size_bytes"].try_cast("long") == F.col("file_size")) & (r["artifact"]["sha256"] == F.col("file_sha256"))
    return F.when(known & (r["status"] == "skipped") & (F.size(r["qc"]["reasons"]) > 0), "skipped").when(known & (r["status"] == "completed") & whole, "completed")


def archive_failures(archives: DataFrame, members: DataFrame, labels: DataFrame, probes: DataFrame) -> DataFrame:
    """archive, failures and status of each archive, from its members, labels by video name, and sampled probes.

    ``members`` is what :func:`sluice.sources.files.zip_members` gives; ``labels``
    has video and text; ``probes`` has archive, member and ok.
    """
    name = lambda c: F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    by_video = labels.groupBy(name(F.col("video")).alias("_video")).agg(F.count("*").alias("_labels"), F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("_chars"))
    named = members.select("archive", "problem", "member", name(F.col("member")).alias("_video"))
    met = named.join(by_video, "_video", "left")
    of = met.groupBy("archive", "_video").agg(
        F.count("member").alias("n"), *[F.count_if(F.col("problem") == p).alias(p.replace(" ", "_")) for p in ("not an archive", "checksum", "unsafe", "encrypted", "repeated")],
        F.max("_labels").alias("labels"), F.max("_chars").alias("chars"),
    ).groupBy("archive").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("not_an_archive", "checksum", "unsafe", "encrypted", "repeated")], F.count_if(F.col("n") > 1).alias("same"),
        F.count_if((F.col("n") > 0) & F.col("labels").isNull()).alias("unlabelled"), F.count_if(F.col("chars") == 0).alias("blank"), F.count_if(F.col("labels") > 1).alias("twice"),
    )
    bad = probes.groupBy("archive").agg(F.count_if(~F.col("ok")).alias("probes"))
    every = archives.select("archive").join(of, "archive", "left").join(bad, "archive", "left")
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    found = codes({
        "unreadable archive": some("not_an_archive"), "no videos": ~some("not_an_archive") & ~some("n"), "integrity": some("checksum"), "unsafe members": some("unsafe"),
        "encrypted members": some("encrypted"), "duplicate names": some("repeated") | some("same"), "duplicate labels": some("twice"), "missing labels": some("unlabelled"), "empty labels": some("blank"), "failed probes": some("probes"),
    })
    return every.select("archive", found.alias("failures")).withColumn("status", F.when(F.size("failures") == 0, "passed").otherwise("failed"))
