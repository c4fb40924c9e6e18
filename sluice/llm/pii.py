"""Personal data: patterns propose spans, checksums confirm, context scores.

Regular expressions propose spans of seven kinds. Range and checksum tests
(IP parts, Luhn for cards, digit counts for phones, mod-97 for IBANs, ranges for
social security numbers) confirm them, without retries. Words just before and
after a span then raise or lower its score, which is given in tenths. Spans of
the base kinds always stand; spans of the kinds that the method adds stand from
COUNT_FROM on, so an unmarked social security number or an IBAN called a serial
number does not count. Redaction goes by the score of all. All of it is
DataFrame expressions on the row, without a shuffle.

Positions are code points, the end exclusive. Work grows with the text and a
little more than with its spans: they are added up in blocks of about the
square root of their number. Defined cases: null and empty texts have no spans;
repeated rows are judged each; of spans alike in start the kind first listed
comes first; an empty table gives no rows; other columns of the input are
ignored (or kept, by :func:`redacted`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns. Where a kind's pattern could start inside a run of its own
#: characters, it is only tried where the run starts or the last match ended;
#: possessive loops neither back up nor recurse, so long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{16}|(?:password|passwd|secret|token|api_key)=[A-Za-z0-9]{8,64})(?![A-Za-z0-9_])",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = ("email", "ip", "card", "phone")
#: A text without this cannot match, and is not searched for the kind.
NEEDS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"-[0-9]{2}-", "secret": r"AKIA|=[A-Za-z0-9]{8}",
}
#: Score of a confirmed span, in tenths, before its context is looked at.
SCORES = {"email": 9, "ip": 6, "card": 8, "phone": 7, "iban": 6, "ssn": 3, "secret": 8}
#: Words near a span that speak for or against personal data, whole and in lower case.
SPEAKS_FOR = {
    "email": ("mail", "email", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "login", "client", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "account"),
    "phone": ("call", "phone", "telephone", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("key", "secret", "access", "login", "credentials"),
}
SPEAKS_AGAINST = {
    "email": ("noreply", "example"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "serial", "invoice", "tracking"),
    "phone": ("version", "order", "serial", "score"),
    "iban": ("serial", "part", "model", "order"),
    "ssn": ("serial", "part", "model", "order"),
    "secret": ("example", "placeholder", "dummy"),
}
CONTEXT_CHARS = 40
#: Tenths that a word for a span adds, and one against it takes.
RAISE, LOWER = 2, 3
#: Tenths from which spans of the added kinds count.
COUNT_FROM = 5
#: Tenths from which redaction replaces a span.
REDACT_FROM = 4
#: Characters that redaction rewrites at a time.
BLOCK_CHARS = 4_096
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PIECES = "array<struct<gap:string,match:string,after:string>>"
_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,score:int>>"


def context_pattern(words: tuple[str, ...]) -> str:
    """Any of the words, not within longer ones."""
    return f"(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)"


def _luhn(match: Column) -> Column:
    """True for 14 to 19 digits that pass Luhn."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    places = F.when(n.between(14, 19), F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))))
    return F.coalesce(F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def _mod97(match: Column) -> Column:
    """True for 15 to 34 characters that pass the IBAN checksum."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _ip_parts(match: Column) -> Column:
    plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _confirms(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _ip_parts(match)
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return _mod97(match) if kind == "iban" else F.lit(True)


def _score(kind: str, piece: Column) -> Column:
    """Tenths: the kind's score, with the words between this match and its neighbours of the kind."""
    near = F.translate(F.concat(F.substring(piece["gap"], -CONTEXT_CHARS, CONTEXT_CHARS), F.lit(" "), F.substring(piece["after"], 1, CONTEXT_CHARS)), CAPITALS, SMALL)
    step = lambda words, by: F.when(near.rlike(context_pattern(words)), by).otherwise(0)
    return F.least(F.lit(10), F.lit(SCORES[kind]) + step(SPEAKS_FOR[kind], RAISE) + step(SPEAKS_AGAINST[kind], -LOWER))


def _width(piece: Column) -> Column:
    return (F.length(piece["gap"]) + F.coalesce(F.length(piece["match"]), F.lit(0))).cast("long")


def _blocks(pieces: Column) -> Column:
    """The pieces in blocks of about the square root of their number."""
    each = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / each).cast("int") - 1), lambda k: F.slice(pieces, k * each + 1, each))


def _starts(blocks: Column) -> Column:
    """Where each block of pieces starts."""
    widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, p: a + _width(p)))
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(widths, none, lambda a, w: F.struct((a["upto"] + w).alias("upto"), F.concat(a["starts"], F.array(a["upto"])).alias("starts")))["starts"]


def _spans_of(kind: str, blocks: Column, starts: Column) -> Column:
    """Confirmed spans of a kind that count."""
    empty, number = F.array().cast(_SPANS), KINDS.index(kind)

    def step(acc: Column, piece: Column) -> Column:
        start, end = acc["upto"] + F.length(piece["gap"]), acc["upto"] + _width(piece)
        score = _score(kind, piece)
        span = F.array(F.struct(start.cast("long").alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score")))
        stands = piece["match"].isNotNull() & _confirms(kind, piece["match"])
        if kind not in BASE_KINDS:
            stands &= score >= COUNT_FROM
        return F.struct(end.alias("upto"), F.when(stands, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    of_block = lambda b: F.aggregate(b["blocks"], F.struct(b["starts"].alias("upto"), empty.alias("found")), step)["found"]
    return F.coalesce(F.flatten(F.transform(F.arrays_zip(blocks.alias("blocks"), starts.alias("starts")), of_block)), empty)


def with_spans(docs: DataFrame, text: str = "text", name: str = "pii_spans") -> DataFrame:
    """``docs`` and all spans that count, by start and kind, in column ``name``."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(*kept, *[F.when(body.rlike(NEEDS[k]), F.regexp_extract_all(body, F.lit(p), F.lit(0))).alias(f"_m_{k}") for k, p in PATTERNS.items()])
    hit = lambda k: F.size(f"_m_{k}") > 0
    found = found.select(*kept, *[F.col(f"_m_{k}") for k in KINDS], *[F.when(hit(k), F.split(body, p, -1)).alias(f"_g_{k}") for k, p in PATTERNS.items()])
    after = lambda k: F.slice(f"_g_{k}", F.lit(2), F.size(f"_g_{k}"))
    pieces = [F.when(hit(k), F.arrays_zip(F.col(f"_g_{k}").alias("gap"), F.col(f"_m_{k}").alias("match"), after(k).alias("after"))).cast(_PIECES).alias(f"_p_{k}") for k in KINDS]
    found = found.select(*kept, *pieces)
    found = found.select(*kept, *[F.when(F.col(f"_p_{k}").isNotNull(), _blocks(F.col(f"_p_{k}"))).alias(f"_b_{k}") for k in KINDS])
    found = found.select(*kept, *[F.col(f"_b_{k}") for k in KINDS], *[_starts(F.col(f"_b_{k}")).alias(f"_s_{k}") for k in KINDS])
    return found.select(*kept, F.sort_array(F.concat(*[_spans_of(k, F.col(f"_b_{k}"), F.col(f"_s_{k}")) for k in KINDS])).alias(name))


def detected(docs: DataFrame) -> DataFrame:
    """Spans of every document: doc_id, counts by kind, digest of the base spans, all spans and their scores in tenths."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter("pii_spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"), scores.alias("scores"))


def redacted(docs: DataFrame, threshold: int = REDACT_FROM) -> DataFrame:
    """``docs`` with every span of ``threshold`` tenths or more replaced by its kind.

    Spans that overlap become one mark, of the first one's kind. n_chars
    follows the text; a null text stays null. The text is rewritten in blocks
    of BLOCK_CHARS characters: a block writes the marks that start in it.
    """
    found = with_spans(docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("text")), name="_pii")
    found = found.withColumn("_due", F.filter("_pii", lambda s: s["score"] >= threshold))
    text, due = F.col("text"), F.col("_due")

    def rewritten(k: Column) -> Column:
        begin, block = k * BLOCK_CHARS, F.substring(text, k * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS))
        before = F.array_max(F.transform(F.filter(due, lambda s: s["start"] < begin), lambda s: s["end"]))
        mine = F.filter(due, lambda s: (s["start"] >= begin) & (s["start"] < begin + BLOCK_CHARS))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(acc["block"], acc["upto"] - begin + 1, s["start"] - acc["upto"])
            out = F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
            return F.struct(acc["block"].alias("block"), F.greatest(acc["upto"], s["end"]).alias("upto"), F.when(s["start"] >= acc["upto"], out).otherwise(acc["out"]).alias("out"))

        start = F.struct(block.alias("block"), F.greatest(begin, F.coalesce(before, F.lit(0).cast("long"))).alias("upto"), F.array().cast("array<string>").alias("out"))
        end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(acc["block"], acc["upto"] - begin + 1, F.lit(BLOCK_CHARS)))
        return F.aggregate(mine, start, step, end)

    places = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / BLOCK_CHARS))
    found = found.withColumn("_new", F.when(F.size(due) > 0, F.array_join(F.transform(places, rewritten), "")))
    made = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("_new").isNull(), F.col("row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
