"""Quality gates: registries, audits, thresholds, exclusions, content scans."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.registry import query, table
from sluice.plans import quantile, rules
from sluice.plans.ordinal import with_ordinal


def failure_codes(checks: dict[str, Column]) -> Column:
    """The sorted names of the checks that fail; a null check fails."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_sort(F.array_compact(F.array(*failed)))


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS failed,
CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'failed' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'pending' ELSE 'passed' END AS status FROM orders GROUP BY 1""")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by state and a status of three."""
    is_in = lambda s: F.count_if(F.col("o_orderstatus") == s)
    status = F.when(is_in("P") > 0, "failed").when(is_in("O") > 0, "pending").otherwise("passed")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), is_in("F").alias("passed"), is_in("O").alias("pending"), is_in("P").alias("failed"), status.alias("status"))


@query("""
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 AND o_orderdate IS NOT NULL""")
def passed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's entries that passed and whose fields are of their type and range."""
    passed = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0) & F.col("o_orderdate").isNotNull()
    return table(spark, sf_dir, "orders").where(passed).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


_CODES = """
WITH c AS (SELECT l_orderkey, l_linenumber, list_sort(list_filter([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_discount < 0.09 THEN 'discount' END,
CASE WHEN NOT l_tax > 0.005 THEN 'tax' END, CASE WHEN NOT l_shipdate < TIMESTAMP '1998-06-01' THEN 'shipdate' END, CASE WHEN NOT l_returnflag <> 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS codes FROM lineitem)
"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.09, "tax": F.col("l_tax") > 0.005, "shipdate": F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp"), "returned": F.col("l_returnflag") != "R"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", failure_codes(checks).alias("codes"))


@query(f"{_CODES} SELECT l_orderkey, l_linenumber, array_to_string(codes, ',') AS failures, CASE WHEN len(codes) = 0 THEN 'passed' ELSE 'failed' END AS status FROM c")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named failures of each row, sorted, and its status."""
    return _audited(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join("codes", ",").alias("failures"), F.when(F.size("codes") == 0, "passed").otherwise("failed").alias("status"))


@query(f"{_CODES} SELECT code, count(*) AS n, count(DISTINCT l_orderkey) AS keys FROM (SELECT l_orderkey, unnest(codes) AS code FROM c) GROUP BY code")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by reason: attempts and different keys."""
    codes = _audited(spark, sf_dir).select("l_orderkey", F.explode("codes").alias("code")).groupBy("code", "l_orderkey").agg(F.count("*").alias("n"))
    return codes.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("keys"))


@query("""
WITH q AS (SELECT user_id, avg((value BETWEEN 0 AND 80)::INT::DOUBLE) AS in_bounds, avg((event_type <> 'error')::INT::DOUBLE) AS valid, quantile_cont(value, 0.99) AS p99, min(value) AS low, max(value) AS high FROM events GROUP BY user_id)
SELECT user_id, round(in_bounds, 6) AS in_bounds, round(valid, 6) AS valid, round(p99, 6) AS p99, CASE WHEN valid < 0.5 OR low < -0.05 THEN 'failed' WHEN in_bounds < 0.8 OR p99 > 100 THEN 'warning' ELSE 'passed' END AS verdict FROM q""")
def qc_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on a sequence's shares and quantiles."""
    events = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_type") != "error").alias("valid"))
    share = lambda c: F.avg(c.cast("int"))
    facts = events.groupBy("user_id").agg(share(F.col("value").between(0, 80)).alias("in_bounds"), share(F.col("valid")).alias("valid"), F.min("value").alias("low"))
    found = facts.join(quantile.grouped(events, ["user_id"], "value", {"p99": 0.99}), "user_id", "left")
    verdict = F.when((F.col("valid") < 0.5) | (F.col("low") < -0.05), "failed").when((F.col("in_bounds") < 0.8) | (F.col("p99") > 100), "warning").otherwise("passed")
    return found.select("user_id", *[F.round(c, 6).alias(c) for c in ("in_bounds", "valid", "p99")], verdict.alias("verdict"))


_PLAN = """
WITH cur AS (SELECT o_orderkey AS id, o_totalprice AS size, o_orderdate AS mtime FROM orders WHERE o_orderkey % 11 <> 0),
prev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size, o_orderdate AS mtime, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0)
"""


@query(f"""{_PLAN} SELECT coalesce(cur.id, prev.id) AS id, CASE WHEN cur.id IS NULL THEN 'missing' WHEN prev.id IS NULL THEN 'new' WHEN cur.size = prev.size AND cur.mtime = prev.mtime AND prev.status = 'F' THEN 'reuse' WHEN cur.size = prev.size AND cur.mtime = prev.mtime THEN 'audit' ELSE 'changed' END AS action FROM cur FULL JOIN prev USING (id)""")
def incremental_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental scan does with each id, given its last snapshot."""
    orders = table(spark, sf_dir, "orders")
    now = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"))
    shifted = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    last = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), shifted.alias("was_size"), F.col("o_orderdate").alias("was_mtime"), F.col("o_orderstatus").alias("status"))
    return planned(now.withColumn("_now", F.lit(True)), last.withColumn("_last", F.lit(True)))


def planned(now: DataFrame, last: DataFrame) -> DataFrame:
    """id and action from a scan (id, size, mtime) and the snapshot before (id, was_size, was_mtime, status)."""
    same = (F.col("size") == F.col("was_size")) & (F.col("mtime") == F.col("was_mtime"))
    action = F.when(F.col("_now").isNull(), "missing").when(F.col("_last").isNull(), "new").when(same & (F.col("status") == "F"), "reuse").when(same, "audit").otherwise("changed")
    return now.join(last, "id", "full_outer").select("id", action.alias("action"))


@query("""
WITH h AS (SELECT user_id, max(ts) AS beat, (SELECT max(ts) FROM events) AS now FROM events WHERE event_type <> 'error' GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce(epoch(now - beat) > 86400, true) AS stale FROM u LEFT JOIN h USING (user_id)""")
def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases whose heartbeat is missing or older than a day."""
    events = table(spark, sf_dir, "events")
    beats = events.where("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("beat"))
    now = events.agg(F.max("ts").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("beat").cast("timestamp"))
    return events.select("user_id").distinct().join(beats, "user_id", "left").crossJoin(F.broadcast(now)).select("user_id", F.coalesce(age > 86_400_000_000, F.lit(True)).alias("stale"))


@query("""
WITH f AS (SELECT count(*) AS n, count(*) FILTER (doc_id IS NULL) AS no_id, count(*) - count(DISTINCT doc_id) AS dup, count(*) FILTER (length(text) <> n_chars) AS wrong FROM documents)
SELECT 'present' AS name, n > 0 AS ok, n::VARCHAR AS detail FROM f UNION ALL SELECT 'ids', n > 0 AND no_id = 0, CASE WHEN n > 0 THEN no_id::VARCHAR ELSE 'skipped: present' END FROM f
UNION ALL SELECT 'unique', n > 0 AND no_id = 0 AND dup = 0, CASE WHEN n > 0 AND no_id = 0 THEN dup::VARCHAR ELSE 'skipped: ids' END FROM f UNION ALL SELECT 'sizes', n > 0 AND wrong = 0, CASE WHEN n > 0 THEN wrong::VARCHAR ELSE 'skipped: present' END FROM f""")
def intake_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a batch, one row each; a check whose premise failed fails as skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text") != F.col("n_chars"), F.lit(False)).alias("wrong"))
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("wrong").alias("wrong"))
    facts = by_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("doc_id").alias("ids"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"))
    dup, some, named = F.col("n") - F.col("ids"), F.col("n") > 0, (F.col("n") > 0) & (F.col("no_id") == 0)
    row = lambda name, ok, premise, skipped, value: F.struct(F.lit(name).alias("name"), ok.alias("ok"), F.when(premise, value.cast("string")).otherwise(f"skipped: {skipped}").alias("detail"))
    rows = [row("present", some, F.lit(True), "", F.col("n")), row("ids", named, some, "present", F.col("no_id")), row("unique", named & (dup == 0), named, "ids", dup), row("sizes", some & (F.col("wrong") == 0), some, "present", F.col("wrong"))]
    return facts.select(F.inline(F.array(*rows)))


@query("""
WITH m AS (SELECT doc_id, list_filter(['text', CASE WHEN doc_id % 2 = 0 THEN 'pose' END, CASE WHEN doc_id % 5 = 0 THEN 'radar' END, CASE WHEN doc_id % 7 = 0 THEN 'raw' END], lambda x: x IS NOT NULL) AS have FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(['pose', 'text'], lambda x: NOT list_contains(have, x))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda x: x = 'raw')), ',') AS forbidden,
array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(['pose', 'text', 'radar', 'raw'], x))), ',') AS unexpected FROM m""")
def modality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modalities that an input mode requires, forbids or does not know."""
    at = lambda n, name: F.when(F.col("doc_id") % n == 0, F.lit(name))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.map_from_arrays(have := F.array_compact(F.array(F.lit("text"), at(2, "pose"), at(5, "radar"), at(7, "raw"))), have).alias("modalities"))
    names = F.map_keys("modalities")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    told = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select("doc_id", told(F.array_except(words("pose", "text"), names)).alias("missing"), told(F.array_intersect(names, words("raw"))).alias("forbidden"), told(F.array_except(names, words("pose", "text", "radar", "raw"))).alias("unexpected"))


@query("""
WITH x AS (SELECT item_id AS id, sha256(text) AS sha, length(text) AS size FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT 999999, 'none', 0), s AS (SELECT item_id AS id, sha256(text) AS sha, length(text) AS size FROM benchmark)
SELECT s.id AS id, x.id IS NOT NULL AS excluded FROM s LEFT JOIN x ON s.id = x.id AND s.sha = x.sha AND s.size = x.size UNION ALL SELECT x.id, NULL FROM x ANTI JOIN s USING (id, sha, size)""")
def verified_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions hold if hash and size agree; one that meets nothing shows as null."""
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("sha"), F.length("text").alias("size"))
    listed = samples.where("id % 4 = 0").unionByName(spark.createDataFrame([(999999, "none", 0)], "id long, sha string, size int"))
    hit = samples.join(listed.withColumn("listed", F.lit(True)), ["id", "sha", "size"], "left").select("id", F.col("listed").isNotNull().alias("excluded"))
    return hit.unionByName(listed.join(samples, ["id", "sha", "size"], "left_anti").select("id", F.lit(None).cast("boolean").alias("excluded")))


#: (rule, glob); later rules win.
GLOBS = (("include", "*example.com*"), ("include", "*example.net/en/*"), ("forbid", "*utm_source=*"), ("exclude", "http://m.*"))


@query("""
SELECT page_id, CASE WHEN url GLOB 'http://m.*' THEN 'exclude' WHEN url GLOB '*utm_source=*' THEN 'forbid' WHEN url GLOB '*example.com*' OR url GLOB '*example.net/en/*' THEN 'include' ELSE 'none' END AS rule FROM pages""")
def glob_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the globs that a path fits decides."""
    rule = F.lit("none")
    for name, glob in GLOBS:
        rule = F.when(F.col("url").rlike(fnmatch.translate(glob).replace("(?>", "(?:").replace(r"\Z", "$").replace(r"\z", "$")), F.lit(name)).otherwise(rule)
    return table(spark, sf_dir, "pages").select("page_id", rule.alias("rule"))


@query("""
WITH g AS (SELECT s_suppkey AS rule_id, '*/' || ['en', 'fr', 'de', 'es'][1 + s_suppkey % 4] || '/' || s_suppkey || ['', '?*', '/*', '*'][1 + s_suppkey % 3] AS pat FROM supplier UNION ALL SELECT -1, '*#*' UNION ALL SELECT -2, '*.net/*'),
f AS (SELECT page_id, rule_id FROM pages JOIN g ON url GLOB pat)
SELECT page_id, count(rule_id) AS fits, max(rule_id)::BIGINT AS last FROM pages LEFT JOIN f USING (page_id) GROUP BY page_id""")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a table of globs, one for each supplier: how many fit and which decides."""
    k = F.col("s_suppkey")
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    glob = F.concat(F.lit("*/"), pick(["en", "fr", "de", "es"], k % 4), F.lit("/"), k.cast("string"), pick(["", "?*", "/*", "*"], k % 3))
    made = table(spark, sf_dir, "supplier").select(k.cast("long").alias("rule_id"), glob.alias("glob"))
    wide = spark.range(2).select((-F.col("id") - 1).alias("rule_id"), F.when(F.col("id") == 0, "*#*").otherwise("*.net/*").alias("glob"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = rules.fitting(pages, "url", made.unionByName(wide)).groupBy("page_id").agg(F.count("*").alias("fits"), F.max("rule_id").alias("last"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("fits", F.lit(0)).cast("long").alias("fits"), "last")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no::INT AS line_no, regexp_extract(line, 'token = "[0-9a-f]{40}"') AS found FROM l WHERE regexp_matches(line, 'token = "[0-9a-f]{40}"')""")
def forbidden_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with forbidden content, by number. Texts without any are not cut into lines."""
    pattern = 'token = "[0-9a-f]{40}"'
    lines = table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(pattern)).select("doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("line", pattern, 0).alias("found"))


@query("""
WITH o AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (before > ts) AS out_of_order, min(event_id) FILTER (before > ts) AS first FROM o GROUP BY user_id""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come before their predecessor, by sequence."""
    lagged = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(W.partitionBy("user_id").orderBy("event_id")))
    wrong = F.col("before") > F.col("ts")
    return lagged.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("out_of_order"), F.min(F.when(wrong, F.col("event_id"))).alias("first"))


@query("""
WITH s AS (SELECT d.doc_id, l.quality, l.toxic, length(d.text) = d.n_chars AS sized FROM documents d LEFT JOIN labels l USING (doc_id)),
t AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'unfinished' WHEN NOT sized THEN 'quarantined' WHEN toxic = 1 THEN 'skipped' ELSE 'completed' END AS state FROM s)
SELECT state, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY state""")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by their terminal state; those without one are unfinished."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") == F.col("n_chars")).alias("sized"))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "unfinished").when(~F.col("sized"), "quarantined").when(F.col("toxic") == 1, "skipped").otherwise("completed")
    counts = joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("state", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""
WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), k AS (SELECT round_even(i * (n - 1) / 19.0, 0)::BIGINT AS pos FROM range(20) r(i), (SELECT count(*) AS n FROM documents))
SELECT doc_id, n_chars FROM o SEMI JOIN k USING (pos)""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows evenly spaced in the order of ids, both ends included."""
    rows = with_ordinal(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"])
    n = rows.agg(F.count("*").alias("n"))
    places = spark.range(20).crossJoin(F.broadcast(n)).select(F.bround(F.col("id") * (F.col("n") - 1) / 19.0, 0).cast("long").alias("ordinal")).distinct()
    return rows.join(F.broadcast(places), "ordinal", "left_semi").select("doc_id", "n_chars")


@query("""
WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, n, CASE WHEN row_number() OVER (ORDER BY n DESC, l_suppkey) <= 5 THEN 'now' ELSE 'pending' END AS due FROM g""")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work by size, the longest first; five are due, the rest is pending."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), "l_suppkey").limit(5).select("l_suppkey", F.lit("now").alias("due"))
    return sizes.join(F.broadcast(first), "l_suppkey", "left").select("l_suppkey", "n", F.coalesce("due", F.lit("pending")).alias("due"))


@query("""
WITH f AS (SELECT event_type, value FROM events WHERE value > 50 ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT event_type, count(*) AS n, round(max(value), 6) AS worst FROM f GROUP BY event_type""")
def last_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred failures, by kind."""
    last = table(spark, sf_dir, "events").where("value > 50").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("worst"))


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('17:' || event_id::VARCHAR)) AS i FROM events) SELECT user_id, event_id FROM r WHERE i = 1""")
def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each sequence, by a seeded hash: the same on every run."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.md5(F.concat(F.lit("17:"), F.col("event_id").cast("string")).cast("binary"))).alias("event_id"))
