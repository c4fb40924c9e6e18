"""Text: normal forms, classes of characters, tokenizers and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as Han: five blocks, not the Unicode script.
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]"
#: Characters that are not lexical: punctuation, separators, controls.
NOT_LEXICAL = r"[\p{P}\p{Z}\p{C}]"
SPACES = r"[\s\x1C-\x1F\x85\p{Z}]+"


def collapsed(text: Column) -> Column:
    """Trimmed of all Unicode white space, runs of it as one space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def code_points(text: Column) -> Column:
    """A text's code points, as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def code_point_label(character: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(character))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def is_unsafe_path(path: Column) -> Column:
    """Absolute paths and those that climb with dots."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return flat.rlike(r"^/") | flat.rlike(r"(^|/)\.\.(/|$)") | (F.length(flat) == 0)


def tokens_none(text: Column) -> Column:
    return F.filter(F.split(collapsed(text), " "), lambda t: t != "")


#: The public tokenization rules "13a" and "international" of
#: machine-translation scoring, as (pattern, replacement) in their order.
RULES_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
RULES_INTERNATIONAL = ((r"(\P{N})(\p{P})", "$1 $2 "), (r"(\p{P})(\P{N})", " $1 $2"), (r"(\p{S})", " $1 "))


def _ruled(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return tokens_none(text)


#: What rule 13a replaces first, in this order.
PLAIN_13A = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(text: Column) -> Column:
    """Tokens with punctuation set off; marks of skipped text, hyphens at line ends and entities resolved."""
    for found, made in PLAIN_13A:
        text = F.replace(text, F.lit(found), F.lit(made))
    return _ruled(F.concat(F.lit(" "), text, F.lit(" ")), RULES_13A)


def tokens_international(text: Column) -> Column:
    """Tokens with Unicode punctuation and symbols set off, but not between digits."""
    return _ruled(text, RULES_INTERNATIONAL)


#: The blocks that rule "zh" sets off, as code points. Its two blocks beyond 16 bits
#: are read as those of their first four digits, which results depend on.
HAN_TOKENS = r"[\x{3400}-\x{4DB5}\x{4E00}-\x{9FA5}\x{9FA6}-\x{9FBB}\x{F900}-\x{FA2D}\x{FA30}-\x{FA6A}\x{FA70}-\x{FAD9}\x{2001}-\x{2A6D}\x{2F81}-\x{2FA1}\x{FF00}-\x{FFEF}\x{2E80}-\x{2EFF}\x{3000}-\x{303F}\x{31C0}-\x{31EF}\x{2F00}-\x{2FDF}\x{2FF0}-\x{2FFF}\x{3100}-\x{312F}\x{31A0}-\x{31BF}\x{FE10}-\x{FE1F}\x{FE30}-\x{FE4F}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{3200}-\x{32FF}\x{3300}-\x{33FF}]"


def tokens_han(text: Column) -> Column:
    """Tokens with every Chinese character, full-width form and CJK sign set off; the rest by the rules of 13a alone."""
    return _ruled(F.regexp_replace(F.trim(text), f"({HAN_TOKENS})", " $1 "), RULES_13A)


TOKENIZERS = {"none": tokens_none, "13a": tokens_13a, "intl": tokens_international, "zh": tokens_han}


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of ``n`` tokens, each joined with spaces."""
    starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
