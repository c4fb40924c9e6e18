"""Mixing sources to target weights by a low-discrepancy slot schedule.

The words of each source, in a shuffled order of its documents, are cut into
blocks of (nearly) equal length. Golden-ratio points walk through the
cumulative slot weights and so name a source for every slot of the mix; the
k-th slot of a source takes that source's k-th block, starting over with its
first block after the last. All of it is DataFrame operations.

Defined cases: null text counts 0 words; null sources are one source, ranked
last; null ids are shuffled as an empty id; repeated rows are rows of their
own; documents of 0 words are returned with 0 taken; an empty table gives an
empty mix; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.plans.lineage import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Fractional part of the golden ratio: the step of the point sequence.
GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: The mix is dealt in about so many blocks, and more if sources need them.
SLOTS = 1 << 17
#: Blocks of a source and slots of its target, at least; or one block per word.
LEAST_BLOCKS = 512
#: Cells of the unit interval by which points meet the sources' intervals.
CELLS = 1024
#: Rows for which one task keeps running sums.
ROWS_PER_BUCKET = 20_000


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the shuffle key of every row."""
    # rows without id are told apart by their text, so that they do not share a key
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("t"), docs["text"]), F.lit("")).cast("binary"))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        key.alias("shuffle_key"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> DataFrame:
    """One row per source: its target in words, its blocks and its slots' interval.

    Shares fill up by weight; a source whose share is above ``max_epochs``
    times its size stops there and the rest goes to the others, by weight.
    """
    every, by_source = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    caps = totals.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = caps.withColumn("level", left / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    open_level = F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every)
    target = F.least("cap", F.coalesce(open_level, F.lit(0.0)) * F.col("weight"))
    block_words = F.greatest(F.lit(1.0), F.sum("source_size").over(every) / F.lit(float(slots)))
    least = F.least(F.col("source_size").cast("double"), F.ceil(F.lit(float(LEAST_BLOCKS)) * F.greatest(F.lit(1.0), F.try_divide(F.col("source_size"), target))).cast("double"))
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block_words), least)).otherwise(0).cast("long")
    out = level.select("source", "source_size", target.alias("target"), blocks.alias("blocks"))
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("need", need)
    upper = F.sum("need").over(by_source.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("need").over(every)
    return out.select(
        "source", "source_size", "target", "blocks",
        F.coalesce(F.try_divide(upper - F.col("need"), total), F.lit(0.0)).alias("lower"),
        F.coalesce(F.try_divide(upper, total), F.lit(0.0)).alias("upper"),
        F.round(total).cast("long").alias("slots"),
    )


def slot_schedule(targets: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """slot, source, rank, block and epoch of every slot of the mix.

    Points meet intervals by an equi-join on cells of the unit interval. The
    number of slots grows with the number of sources, LEAST_BLOCKS for each.
    """
    slots = targets.sparkSession.range(targets.agg(F.max("slots")).first()[0] or 0).select(F.col("id").alias("slot"))
    step = F.col("slot").cast("double") * F.lit(GOLDEN)
    points = slots.select("slot", (step - F.floor(step)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    spans = targets.where("upper > lower").select("*", F.explode(F.sequence(F.floor(F.col("lower") * CELLS).cast("int"), F.floor(F.col("upper") * CELLS).cast("int"))).alias("cell"))
    hits = points.join(spans, "cell").where("u >= lower and u < upper")
    rank = F.row_number().over(W.partitionBy("source").orderBy("slot")).cast("long") - 1
    ranked = hits.select("slot", "source", "blocks", rank.alias("rank"))
    out = ranked.select("slot", "source", "rank", F.pmod("rank", "blocks").alias("block"), F.floor(F.col("rank") / F.col("blocks")).cast("long").alias("epoch"))
    return out.where(F.col("epoch") < max_epochs)


def placed_documents(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with its first and last word's place in its shuffled source.

    Running sums go by source and key prefix, so no task holds a whole source.
    """
    rows, digits = sized.count(), 1
    while rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    by_prefix = sized.withColumn("prefix", F.substring("shuffle_key", 1, digits))
    ordered = W.partitionBy("source", "prefix").orderBy("shuffle_key", F.asc_nulls_first("doc_id"), "size")
    inner = by_prefix.select("*", F.row_number().over(ordered).alias("pos"), F.sum("size").over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    sums = by_prefix.groupBy("source", "prefix").agg(F.sum("size").alias("in_prefix"))
    before = sums.select(F.col("source").alias("o_source"), F.col("prefix").alias("o_prefix"), (F.sum("in_prefix").over(W.partitionBy("source").orderBy("prefix")) - F.col("in_prefix")).alias("before"))
    placed = inner.join(before, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("prefix") == F.col("o_prefix")))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "blocks")
    return placed.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "source", "size", "prefix", "pos", "source_size", "target", "blocks",
        (F.col("before") + F.col("upto") - F.col("size")).alias("first"), (F.col("before") + F.col("upto")).alias("last"),
    )


def document_blocks(placed: DataFrame) -> DataFrame:
    """One row per document and block that it reaches into, with the words in it.

    Block j of a source of S words in n blocks starts at word floor(j * S / n).
    """
    block_of = lambda word: F.expr(f"(({word}) * blocks + source_size - 1) div source_size - 1")
    spread = placed.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(block_of("first + 1"), block_of("last")))).alias("block"))
    begins, ends = F.expr("(block * source_size) div blocks"), F.expr("((block + 1) * source_size) div blocks")
    return spread.withColumn("words", F.coalesce(F.least("last", ends) - F.greatest("first", begins), F.lit(0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words) of every row of ``docs``."""
    sized = durable(sized_documents(docs))
    targets = durable(source_targets(sized, weights, max_epochs, slots))
    times = slot_schedule(targets, max_epochs).groupBy(F.col("source").alias("s_source"), F.col("block").alias("s_block")).agg(F.count("*").alias("times"))
    blocks = document_blocks(placed_documents(sized, targets))
    joined = blocks.join(times, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")), "left")
    return (
        joined.groupBy("source", "prefix", "pos", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``.

    A document taken k times and a part has k whole rows and one excerpt: its
    first words, up to the words taken. Documents not taken are left out. Rows
    alike in id, source and size may stand for each other.
    """
    taken = mix(docs, **params).where("taken > 0")
    same = W.partitionBy("t_id", "t_source", "t_size").orderBy("taken")
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "taken")
    taken = taken.withColumn("t_nth", F.row_number().over(same))
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    # the row goes along as one column, so that no name of it can clash
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), docs["source"].cast("string").alias("source"), size.alias("words"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("digest"))
    alike = W.partitionBy("id", "source", "words").orderBy("digest")
    rows = rows.withColumn("nth", F.row_number().over(alike))
    met = F.col("id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("words") == F.col("t_size")) & (F.col("nth") == F.col("t_nth"))
    part = F.expr("taken % t_size")
    parts = F.concat(F.array_repeat(F.col("t_size"), F.expr("taken div t_size").cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = rows.join(taken, met).select("row", "t_size", F.explode(parts).alias("part"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    excerpt = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    text = F.when(F.col("part") == F.col("t_size"), F.col("row.text")).otherwise(excerpt)
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
