"""Evaluation metrics, all as sums that partial aggregation merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import alignment
from sluice.functions.arrays import dot, norm, points
from sluice.functions.overlap import overlap
from sluice.functions.text import TOKENIZERS, ngrams, tokens_none, without_space
from sluice.operators.registry import query, table

ORDER, CHAR_ORDER, BETA = 4, 6, 2.0
WRIST = 0

_PAIRS = "SELECT a.conv_id, a.turn, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as the hypothesis of the next one."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return turns.select("conv_id", "turn", F.col("text").alias("hyp")).join(after, ["conv_id", "turn"])


#: DuckDB's edit distance goes by bytes, so each pair's characters become bytes of their own first (a pair has fewer than 128).
_LANGUAGE = f"""
WITH p AS (SELECT trim(hyp) AS hyp, trim(ref) AS ref FROM ({_PAIRS}) WHERE hyp IS NOT NULL AND ref IS NOT NULL),
c AS (SELECT *, list_filter(string_split(hyp, ''), lambda x: x <> '') AS h, list_filter(string_split(ref, ''), lambda x: x <> '') AS r FROM p), u AS (SELECT *, list_distinct(h || r) AS u FROM c),
e AS (SELECT hyp, ref, levenshtein(array_to_string([chr(list_position(u, x)) FOR x IN h], ''), array_to_string([chr(list_position(u, x)) FOR x IN r], '')) AS edits FROM u)
SELECT count(*) AS n, round(avg((hyp = ref)::INT), 6) AS exact, sum(edits)::BIGINT AS edits, sum(length(ref))::BIGINT AS characters, round(sum(edits) / sum(length(ref)), 6) AS cer FROM e"""


@query(_LANGUAGE)
def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches and character error rate of all pairs of texts, in code points."""
    return language_totals(pairs(spark, sf_dir).where("hyp is not null and ref is not null"))


@query(_LANGUAGE)
def language_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as :func:`language_scores`, by its earlier name."""
    return language_scores(spark, sf_dir)


def language_totals(rows: DataFrame) -> DataFrame:
    """n, exact, edits, characters and cer of ``hyp`` and ``ref``, micro-averaged."""
    rows = rows.select(F.trim("hyp").alias("hyp"), F.trim("ref").alias("ref"))
    edits = F.sum(F.levenshtein("hyp", "ref")).cast("long")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("hyp") == F.col("ref")).cast("int")), 6).alias("exact"), edits.alias("edits"), F.sum(F.length("ref")).alias("characters"), F.round(F.try_divide(edits, F.sum(F.length("ref"))), 6).alias("cer"))


def matches(rows: DataFrame, hyp: Column, ref: Column, keys: list[str], order: int) -> DataFrame:
    """keys, n, hyp_grams, ref_grams and matched (clipped) n-grams of each row.

    Both sides of a pair are in one row, so its n-grams are counted there and
    nothing but ``order`` small rows of counts leaves it. Of texts n-grams are
    of characters, of arrays of tokens.
    """
    return rows.select(*keys, F.inline(overlap(hyp, ref, order)))


def _gram_sql(order: int, tokens: str) -> str:
    grams = " UNION ALL ".join(f"SELECT conv_id, turn, side, {n} AS n, unnest([array_to_string(t[i:i + {n - 1}], ' ') FOR i IN range(1, len(t) - {n} + 2)]) AS gram FROM t" for n in range(1, order + 1))
    return f"""WITH p AS ({_PAIRS}), t AS (SELECT conv_id, turn, 'h' AS side, {tokens.format(c="hyp")} AS t FROM p UNION ALL SELECT conv_id, turn, 'r', {tokens.format(c="ref")} FROM p),
g AS ({grams}), c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL), s AS (SELECT n, sum(h)::BIGINT AS hyp_grams, sum(r)::BIGINT AS ref_grams, sum(least(h, r))::BIGINT AS matched FROM c GROUP BY n)"""


_WORDS_SQL = "list_filter(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_CHARS_SQL = "list_filter(string_split(regexp_replace({c}, '\\s+', '', 'g'), ''), lambda x: x <> '')"


@query(f"""{_gram_sql(4, _WORDS_SQL)}, l AS (SELECT max(hyp_grams) FILTER (n = 1) AS hyp, max(ref_grams) FILTER (n = 1) AS ref FROM s), b AS (SELECT CASE WHEN hyp < ref THEN exp(1 - ref / hyp) ELSE 1 END AS bp FROM l),
x AS (SELECT n, hyp_grams, matched, CASE WHEN matched > 0 THEN matched / hyp_grams ELSE 1 / (2 ** (count(*) FILTER (matched = 0) OVER (ORDER BY n)) * hyp_grams) END AS p FROM s)
SELECT n, hyp_grams, matched, round(100 * p, 6) AS precision, round(100 * bp * exp(avg(ln(p)) OVER (ORDER BY n)), 6) AS bleu FROM x, b""")
def bleu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU-1 to -4, clipped, with brevity penalty and exponential smoothing."""
    return bleu(matches(pairs(spark, sf_dir), tokens_none(F.col("hyp")), tokens_none(F.col("ref")), ["conv_id", "turn"], ORDER))


def bleu(found: DataFrame) -> DataFrame:
    """n, hyp_grams, matched, precision and bleu (of orders up to n), from :func:`matches`."""
    from pyspark.sql import Window as W

    sums = found.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("hyp_grams", "ref_grams", "matched")])
    lengths = sums.where("n = 1").select(F.when(F.col("hyp_grams") < F.col("ref_grams"), F.exp(1 - F.col("ref_grams") / F.col("hyp_grams"))).otherwise(1.0).alias("bp"))
    # at most four rows
    upto = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    misses = F.sum((F.col("matched") == 0).cast("int")).over(upto)
    smooth = F.when(F.col("matched") > 0, F.col("matched") / F.col("hyp_grams")).otherwise(1 / (F.pow(F.lit(2.0), misses) * F.col("hyp_grams")))
    out = sums.withColumn("p", smooth).crossJoin(F.broadcast(lengths))
    return out.select("n", "hyp_grams", "matched", F.round(100 * F.col("p"), 6).alias("precision"), F.round(100 * F.col("bp") * F.exp(F.avg(F.log("p")).over(upto)), 6).alias("bleu"))


@query(f"""{_gram_sql(6, _CHARS_SQL)}, a AS (SELECT avg(matched / hyp_grams) AS p, avg(matched / ref_grams) AS r FROM s WHERE hyp_grams > 0 AND ref_grams > 0)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(5 * p * r / (4 * p + r), 6) AS chrf FROM a""")
def chrf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus chrF: character n-grams up to six, recall weighing double."""
    found = matches(pairs(spark, sf_dir), without_space(F.col("hyp")), without_space(F.col("ref")), ["conv_id", "turn"], CHAR_ORDER)
    sums = found.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("hyp_grams", "ref_grams", "matched")]).where("hyp_grams > 0 and ref_grams > 0")
    means = sums.agg(F.avg(F.col("matched") / F.col("hyp_grams")).alias("p"), F.avg(F.col("matched") / F.col("ref_grams")).alias("r"))
    f = F.try_divide((1 + BETA**2) * F.col("p") * F.col("r"), BETA**2 * F.col("p") + F.col("r"))
    return means.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f, 6).alias("chrf"))


@query(f"""
WITH p AS ({_PAIRS}), t AS (SELECT {_WORDS_SQL.format(c="hyp")} AS h, {_WORDS_SQL.format(c="ref")} AS r FROM p),
s AS (SELECT list_distinct(h) AS h1, list_distinct(r) AS r1, list_distinct([h[i] || ' ' || h[i + 1] FOR i IN range(1, len(h))]) AS h2, list_distinct([r[i] || ' ' || r[i + 1] FOR i IN range(1, len(r))]) AS r2 FROM t),
o AS (SELECT len(list_intersect(h1, r1)) AS o1, len(list_intersect(h2, r2)) AS o2, len(h1) AS a1, len(r1) AS b1, len(h2) AS a2, len(r2) AS b2 FROM s)
SELECT count(*) AS n, round(avg(coalesce(2 * o1 / nullif(a1 + b1, 0), 0)), 6) AS rouge_1, round(avg(coalesce(2 * o2 / nullif(a2 + b2, 0), 0)), 6) AS rouge_2 FROM o""")
def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 and -2 F1 on n-gram sets, averaged over pairs."""
    def f1(n: int) -> Column:
        h, r = F.array_distinct(ngrams(F.col("h"), n)), F.array_distinct(ngrams(F.col("r"), n))
        return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(h, r)), F.size(h) + F.size(r)), F.lit(0.0))

    rows = pairs(spark, sf_dir).select(tokens_none(F.col("hyp")).alias("h"), tokens_none(F.col("ref")).alias("r"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(f1(1)), 6).alias("rouge_1"), F.round(F.avg(f1(2)), 6).alias("rouge_2"))


@query()
def rouge_l_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L by pair: with beta of P/R, and with beta 1.2."""
    rows = pairs(spark, sf_dir).select("conv_id", "turn", tokens_none(F.col("hyp")).alias("h"), tokens_none(F.col("ref")).alias("r")).withColumn("lcs", alignment.lcs("h", "r"))
    p, r = F.try_divide("lcs", F.size("h")), F.try_divide("lcs", F.size("r"))
    f = lambda b2: F.coalesce(F.try_divide((1 + b2) * p * r, r + b2 * p), F.lit(0.0))
    return rows.select("conv_id", "turn", "lcs", F.round(f(F.pow(F.try_divide(p, r), 2)), 6).alias("rouge_l"), F.round(f(F.lit(1.44)), 6).alias("rouge_l_1_2"))


@query()
def wer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of the corpus, and its parts, in percent of reference words."""
    rows = pairs(spark, sf_dir).select(tokens_none(F.col("hyp")).alias("h"), tokens_none(F.col("ref")).alias("r"))
    counts = rows.select(F.size("r").alias("words"), alignment.edit_counts("r", "h").alias("e"))
    rate = lambda c, name: F.round(100 * F.try_divide(F.sum(c), F.sum("words")), 6).alias(name)
    return counts.agg(rate(F.col("e.deletions") + F.col("e.insertions") + F.col("e.substitutions"), "wer"), rate(F.col("e.deletions"), "deletions"), rate(F.col("e.insertions"), "insertions"), rate(F.col("e.substitutions"), "substitutions"))


@query()
def tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every benchmark text by each tokenizer of the registry."""
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.size(f(F.col("text"))).alias(f"n_{name}") for name, f in TOKENIZERS.items()])


@query(f"""
WITH t AS (SELECT {_WORDS_SQL.format(c="hyp")} AS h, {_WORDS_SQL.format(c="ref")} AS r, hyp = ref AS same FROM ({_PAIRS})), m AS (SELECT len(list_filter(range(1, least(len(h), len(r)) + 1), lambda i: h[i] = r[i])) AS hits, len(h) AS n, same FROM t)
SELECT round(sum(hits) / sum(n), 6) AS token_accuracy, round(avg(same::INT), 6) AS sequence_accuracy FROM m""")
def accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens right at their place, and whole sequences right."""
    rows = pairs(spark, sf_dir).select(tokens_none(F.col("hyp")).alias("h"), tokens_none(F.col("ref")).alias("r"), (F.col("hyp") == F.col("ref")).alias("same"))
    hits = F.size(F.filter(F.zip_with("h", "r", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    return rows.agg(F.round(F.sum(hits) / F.sum(F.size("h")), 6).alias("token_accuracy"), F.round(F.avg(F.col("same").cast("int")), 6).alias("sequence_accuracy"))


@query("""
WITH p AS (SELECT a.label AS truth, b.label AS guess FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), c AS (SELECT truth, guess, count(*) AS n FROM p GROUP BY ALL)
SELECT truth, max(CASE WHEN guess = truth THEN n ELSE 0 END) AS hits, sum(n)::BIGINT AS n, round(max(CASE WHEN guess = truth THEN n ELSE 0 END) / sum(n), 6) AS recall, (SELECT round(sum(n) FILTER (guess = truth) / sum(n), 6) FROM c) AS accuracy,
(SELECT round(avg(r), 6) FROM (SELECT coalesce(sum(n) FILTER (guess = truth), 0) / sum(n) AS r FROM c GROUP BY truth)) AS macro_accuracy FROM c GROUP BY truth""")
def class_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by class, and accuracy per instance and per class."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    joined = v.select("vec_id", F.col("label").alias("truth")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("guess")), "vec_id")
    hit = F.col("truth") == F.col("guess")
    by = joined.groupBy("truth").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    whole = by.agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("macro_accuracy"))
    return by.crossJoin(F.broadcast(whole)).select("truth", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), "accuracy", "macro_accuracy")


@query("""
WITH p AS (SELECT a.label AS truth, b.label AS guess FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT truth, count(*) FILTER (guess = 0) AS "0", count(*) FILTER (guess = 1) AS "1", count(*) FILTER (guess = 2) AS "2", count(*) FILTER (guess = 3) AS "3", count(*) FILTER (guess = 4) AS "4" FROM p GROUP BY truth""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth by guess, for the stated classes."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    joined = v.select("vec_id", F.col("label").alias("truth")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("guess")), "vec_id")
    return joined.groupBy("truth").pivot("guess", [0, 1, 2, 3, 4]).agg(F.count("guess")).na.fill(0)


_POSES = """WITH j AS (SELECT vec_id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(21) r(i)),
p AS (SELECT a.vec_id, a.i, (a.vec_id + a.i) % 7 <> 0 AS valid, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, a.x - b.x - (wa.x - wb.x) AS rx, a.y - b.y - (wa.y - wb.y) AS ry, a.z - b.z - (wa.z - wb.z) AS rz FROM j a JOIN j b ON b.vec_id = a.vec_id + 1 AND a.i = b.i JOIN j wa ON wa.vec_id = a.vec_id AND wa.i = 0 JOIN j wb ON wb.vec_id = b.vec_id AND wb.i = 0),
e AS (SELECT vec_id, i, valid, (abs(dx) + abs(dy) + abs(dz)) / 3 AS l1, sqrt(dx * dx + dy * dy + dz * dz) AS d, sqrt(rx * rx + ry * ry + rz * rz) AS rd FROM p)"""


def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each joint of paired poses: valid, l1, d and rd (relative to the wrist)."""
    poses = table(spark, sf_dir, "embeddings").select("vec_id", points(F.col("embedding").cast("array<double>")).alias("p"))
    other = poses.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    both = poses.join(other, "vec_id")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    wrist = minus(F.get("p", F.lit(WRIST)), F.get("q", F.lit(WRIST)))
    joints = both.select("vec_id", wrist.alias("w"), F.posexplode(F.arrays_zip("p", "q")).alias("i", "j"))
    diff = joints.select("vec_id", "i", "w", minus(F.col("j.p"), F.col("j.q")).alias("d"))
    l1 = F.aggregate("d", F.lit(0.0), lambda s, x: s + F.abs(x)) / 3
    return diff.select("vec_id", "i", ((F.col("vec_id") + F.col("i")) % 7 != 0).alias("valid"), l1.alias("l1"), norm(F.col("d")).alias("d"), norm(minus(F.col("d"), F.col("w"))).alias("rd"))


@query(f"{_POSES} SELECT count(*) FILTER (valid) AS joints, round(avg(l1) FILTER (valid), 6) AS l1, round(avg(d) FILTER (valid), 6) AS mpjpe, round(avg(rd) FILTER (valid), 6) AS relative_mpjpe, round(avg((rd <= 0.3)::INT) FILTER (valid), 6) AS pck, (SELECT round(avg(m), 6) FROM (SELECT avg(d) AS m FROM e WHERE valid GROUP BY vec_id)) AS macro_mpjpe FROM e")
def pose_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pose errors: over all joints, and averaged by sample first."""
    errors = pose_errors(spark, sf_dir).where("valid")
    sums = errors.groupBy("vec_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("l1", "d", "rd")], F.count_if(F.col("rd") <= 0.3).alias("near"))
    share = lambda c, name: F.round(F.sum(c) / F.sum("n"), 6).alias(name)
    return sums.agg(F.sum("n").alias("joints"), share("l1", "l1"), share("d", "mpjpe"), share("rd", "relative_mpjpe"), share("near", "pck"), F.round(F.avg(F.col("d") / F.col("n")), 6).alias("macro_mpjpe"))


@query(f"{_POSES}, f AS (SELECT vec_id, max(d) AS worst, arg_max(i, (d, -i)) AS joint, avg(d) AS mean FROM e GROUP BY vec_id) SELECT vec_id, joint::INT AS joint, round(worst, 6) AS worst, round(mean, 6) AS mean FROM f ORDER BY worst DESC, vec_id LIMIT 10")
def worst_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten frames with the largest joint distance, and which joint it is."""
    by = pose_errors(spark, sf_dir).groupBy("vec_id").agg(F.max("d").alias("worst"), F.max_by("i", F.struct("d", -F.col("i"))).alias("joint"), F.avg("d").alias("mean"))
    return by.orderBy(F.desc("worst"), "vec_id").limit(10).select("vec_id", "joint", F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"))


@query("""
WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) % 3 AS axis FROM embeddings) SELECT axis, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM l GROUP BY axis""")
def axis_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation by axis, from mergeable sums."""
    long = table(spark, sf_dir, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return long.groupBy((F.col("i") % 3).cast("long").alias("axis")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("deviation"))


@query("""SELECT year(o_orderdate)::INT AS epoch, count(*) AS n, round(sum(o_totalprice * w) / sum(w), 4) AS mean FROM (SELECT o_orderdate, o_totalprice, 1 + o_orderkey % 5 AS w FROM orders) GROUP BY 1""")
def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by epoch, weighted by each rank's count."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("epoch"), "o_totalprice", (1 + F.col("o_orderkey") % 5).alias("w"))
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice") * F.col("w")) / F.sum("w"), 4).alias("mean"))


@query("""
WITH v AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings) SELECT label, count(*) AS n, round(min(sqrt(list_dot_product(v, v))), 6) AS least_norm, round(max(sqrt(list_dot_product(v, v))), 6) AS largest_norm, bool_and(list_dot_product(v, v) > 0.999) AS unit FROM v GROUP BY label""")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("label", norm(v).alias("norm"), dot(v, v).alias("square"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("norm"), 6).alias("least_norm"), F.round(F.max("norm"), 6).alias("largest_norm"), F.bool_and(F.col("square") > 0.999).alias("unit"))


@query("""
WITH f AS (SELECT regexp_extract(url, '(\\.[a-z]+)$', 1) AS ext, strlen(html) AS size FROM pages) SELECT CASE WHEN ext = '' THEN 'none' ELSE ext END AS extension, count(*) AS files, sum(size)::BIGINT AS bytes, round(100 * count(*) / (SELECT count(*) FROM f), 4) AS percent FROM f GROUP BY 1""")
def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by extension, and their share."""
    ext = F.regexp_extract("url", r"(\.[a-z]+)$", 1)
    counts = table(spark, sf_dir, "pages").groupBy(F.when(ext == "", "none").otherwise(ext).alias("extension")).agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).alias("bytes"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("files").alias("all")))).select("extension", "files", "bytes", F.round(100 * F.col("files") / F.col("all"), 4).alias("percent"))
