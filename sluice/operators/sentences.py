"""Scores of single pairs of texts, and of texts with several references or sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import alignment
from sluice.functions.overlap import overlap
from sluice.functions.text import tokens_none, without_space
from sluice.operators.registry import query
from sluice.operators.scores import BETA, CHAR_ORDER, ORDER, _CHARS_SQL, _WORDS_SQL, _gram_sql, matches, pairs
from sluice.plans.lineage import durable

#: Smoothing methods and the value that each takes.
SMOOTHING = {"none": 0.0, "exp": 0.0, "floor": 0.1, "add_k": 1.0}
ROUGE_BETA = 1.2


def sentence_bleu(counts: Column, method: str, value: float = 0.0, order: int = ORDER) -> Column:
    """BLEU of one text from its :func:`overlap` counts, with smoothing.

    ``exp`` halves for each order without a match, ``floor`` puts a value in
    its place, ``add_k`` adds the value to both counts of orders 3 and up; an
    order without n-grams, and all after it, has precision 0.
    """
    matched = [F.get(counts, F.lit(n))["matched"].cast("double") for n in range(order)]
    total = [F.get(counts, F.lit(n))["hyp_grams"].cast("double") for n in range(order)]
    if method == "add_k":
        matched, total = ([c + value if n > 1 else c for n, c in enumerate(cs)] for cs in (matched, total))
    logs, misses, open_ = F.lit(0.0), F.lit(0), F.lit(True)
    for n in range(order):
        open_ = open_ & (total[n] > 0)
        misses = misses + F.when(matched[n] == 0, 1).otherwise(0)
        other = {"exp": 1 / (F.pow(F.lit(2.0), misses) * total[n]), "floor": value / total[n]}.get(method, F.lit(0.0))
        p = F.when(open_ & (total[n] > 0), F.when(matched[n] > 0, matched[n] / F.nullif(total[n], F.lit(0.0))).otherwise(other))
        logs = logs + F.log(F.nullif(p, F.lit(0.0)))
    hyp, ref = F.get(counts, F.lit(0))["hyp_grams"], F.get(counts, F.lit(0))["ref_grams"]
    brevity = F.when(hyp == 0, 0.0).when(hyp < ref, F.exp(1 - ref / F.nullif(hyp, F.lit(0)))).otherwise(1.0)
    return F.coalesce(100 * brevity * F.exp(logs / order), F.lit(0.0))


def _bleu_sql(method: str, value: float) -> str:
    c, t = ([f"({name}{n} + {value if method == 'add_k' and n > 2 else 0.0})" for n in range(1, ORDER + 1)] for name in "ct")
    terms = []
    for n in range(ORDER):
        misses = " + ".join(f"({c[k]} = 0)::INT" for k in range(n + 1))
        other = {"exp": f"1 / (2.0 ** ({misses}) * {t[n]})", "floor": f"{value} / {t[n]}"}.get(method, "0")
        open_ = " AND ".join(f"{t[k]} > 0" for k in range(n + 1))
        terms.append(f"ln(nullif(CASE WHEN {open_} THEN CASE WHEN {c[n]} > 0 THEN {c[n]} / {t[n]} ELSE {other} END END, 0))")
    return f"round(coalesce(100 * CASE WHEN t1 = 0 THEN 0 WHEN t1 < r1 THEN exp(1 - r1 / t1) ELSE 1 END * exp(({' + '.join(terms)}) / {ORDER}), 0), 5) AS bleu_{method}"


def _wide(order: int) -> str:
    cells = ", ".join(f"coalesce(sum(least(h, r)) FILTER (n = {n}), 0)::DOUBLE AS c{n}, coalesce(sum(h) FILTER (n = {n}), 0)::DOUBLE AS t{n}, coalesce(sum(r) FILTER (n = {n}), 0)::DOUBLE AS r{n}" for n in range(1, order + 1))
    empty = ", ".join(f"coalesce({k}{n}, 0) AS {k}{n}" for n in range(1, order + 1) for k in "ctr")
    return f"w0 AS (SELECT conv_id, turn, {cells} FROM c GROUP BY ALL), w AS (SELECT p.conv_id, p.turn, {empty} FROM p LEFT JOIN w0 USING (conv_id, turn))"


@query(f"{_gram_sql(ORDER, _WORDS_SQL)}, {_wide(ORDER)} SELECT conv_id, turn, {', '.join(_bleu_sql(m, v) for m, v in SMOOTHING.items())} FROM w")
def sentence_bleu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of each pair under every smoothing."""
    rows = pairs(spark, sf_dir).select("conv_id", "turn", overlap(tokens_none(F.col("hyp")), tokens_none(F.col("ref")), ORDER).alias("g"))
    return rows.select("conv_id", "turn", *[F.round(sentence_bleu(F.col("g"), m, v), 5).alias(f"bleu_{m}") for m, v in SMOOTHING.items()])


def corpus_bleu(found: DataFrame, method: str, value: float = 0.0) -> DataFrame:
    """bleu of all pairs together, from :func:`sluice.operators.scores.matches`, under a smoothing: the sums of all pairs as if of one text."""
    sums = found.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("hyp_grams", "ref_grams", "matched")])
    counts = sums.agg(F.array_sort(F.collect_list(F.struct("n", "hyp_grams", "ref_grams", "matched"))).alias("g"))  # a row for each order
    return counts.select(sentence_bleu(F.col("g"), method, value).alias("bleu"))


_SUMS_SQL = ", ".join(f"coalesce(sum(least(h, r)) FILTER (n = {n}), 0)::DOUBLE AS c{n}, coalesce(sum(h) FILTER (n = {n}), 0)::DOUBLE AS t{n}, coalesce(sum(r) FILTER (n = {n}), 0)::DOUBLE AS r{n}" for n in range(1, ORDER + 1))


@query(f"{_gram_sql(ORDER, _WORDS_SQL)}, w AS (SELECT {_SUMS_SQL} FROM c) SELECT {', '.join(_bleu_sql(m, v) for m, v in SMOOTHING.items())} FROM w")
def bleu_smoothings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU under every smoothing."""
    found = durable(matches(pairs(spark, sf_dir), tokens_none(F.col("hyp")), tokens_none(F.col("ref")), ["conv_id", "turn"], ORDER))
    out = None
    for method, value in SMOOTHING.items():
        one = corpus_bleu(found, method, value).select(F.round("bleu", 5).alias(f"bleu_{method}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def sentence_chrf(counts: Column, order: int = CHAR_ORDER, beta: float = BETA) -> Column:
    """chrF of one text: the mean precision and recall of orders that both sides have."""
    both = F.filter(counts, lambda c: (c["hyp_grams"] > 0) & (c["ref_grams"] > 0))
    mean = lambda side: F.aggregate(both, F.lit(0.0), lambda s, c: s + c["matched"] / c[side]) / F.nullif(F.size(both), F.lit(0))
    p, r = mean("hyp_grams"), mean("ref_grams")
    return F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))


_CHRF_P, _CHRF_R = (" + ".join(f"CASE WHEN t{n} > 0 AND r{n} > 0 THEN c{n} / {k}{n} ELSE 0 END" for n in range(1, CHAR_ORDER + 1)) for k in "tr")
_CHRF_N = " + ".join(f"(t{n} > 0 AND r{n} > 0)::INT" for n in range(1, CHAR_ORDER + 1))


@query(f"{_gram_sql(CHAR_ORDER, _CHARS_SQL)}, {_wide(CHAR_ORDER)}, a AS (SELECT conv_id, turn, ({_CHRF_P}) / nullif({_CHRF_N}, 0) AS p, ({_CHRF_R}) / nullif({_CHRF_N}, 0) AS r FROM w) SELECT conv_id, turn, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) AS chrf FROM a")
def sentence_chrf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF of each pair."""
    found = overlap(without_space(F.col("hyp")), without_space(F.col("ref")), CHAR_ORDER)
    return pairs(spark, sf_dir).select("conv_id", "turn", found.alias("g")).select("conv_id", "turn", F.round(sentence_chrf(F.col("g")), 6).alias("chrf"))


def rouge_of_references(hyp: Column, references: Column, lengths: Column, beta: float = ROUGE_BETA) -> Column:
    """ROUGE-L against several references: the best precision and the best recall, of any of them."""
    p = F.array_max(F.transform(lengths, lambda n: n / F.nullif(F.size(hyp), F.lit(0))))
    r = F.array_max(F.zip_with(lengths, references, lambda n, ref: n / F.nullif(F.size(ref), F.lit(0))))
    return F.coalesce(F.try_divide((1 + beta**2) * p * r, r + beta**2 * p), F.lit(0.0))


@query()
def rouge_several_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next one and the one after it, words parted by single spaces."""
    words = lambda c: F.split(F.col(c), " ")
    first = pairs(spark, sf_dir)
    second = first.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("ref2"))
    rows = first.join(second, ["conv_id", "turn"], "left").select("conv_id", "turn", words("hyp").alias("h"), words("ref").alias("a"), words("ref2").alias("b"))
    rows = rows.where("h is not null and a is not null").withColumn("b", F.coalesce("b", "a"))
    lengths = F.array(alignment.lcs("a", "h"), alignment.lcs("b", "h"))
    found = rows.withColumn("lengths", lengths)
    return found.select("conv_id", "turn", F.round(rouge_of_references(F.col("h"), F.array("a", "b"), F.col("lengths")), 6).alias("rouge_l"))


def f_p_r(total: Column, reference_words: Column, hypothesis_words: Column) -> Column:
    """The F-measure of a common length, with beta as precision over recall."""
    r, p = total / F.nullif(reference_words, F.lit(0)), total / F.nullif(hypothesis_words, F.lit(0))
    beta = p / (r + 1e-12)
    return F.coalesce((1 + beta * beta) * r * p / (r + beta * beta * p + 1e-12), F.lit(0.0))


@query()
def rouge_summary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of texts of several sentences: unions of common subsequences, summed over the reference's sentences."""
    sentences = lambda c: F.filter(F.transform(F.split(F.col(c), r"[.!?]\s+|\n"), F.trim), lambda s: s != "")
    words = lambda c: F.aggregate(F.transform(F.col(c), lambda s: F.size(F.split(s, " "))), F.lit(0), lambda a, n: a + n)
    rows = pairs(spark, sf_dir).select("conv_id", "turn", sentences("hyp").alias("h"), sentences("ref").alias("r")).where("size(h) > 0 and size(r) > 0")
    found = rows.withColumn("total", alignment.union_lcs("h", "r"))
    return found.select("conv_id", "turn", F.round("total", 6).alias("union_lcs"), F.round(f_p_r(F.col("total"), words("r"), words("h")), 6).alias("rouge_l_sum"))


@query()
def word_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each pair set side by side: a row for each step of the cheapest alignment."""
    rows = pairs(spark, sf_dir).where("hyp is not null and ref is not null")
    return alignment.steps_of(rows.select("conv_id", "turn", tokens_none(F.col("ref")).alias("r"), tokens_none(F.col("hyp")).alias("h")), "r", "h", ["conv_id", "turn"])
