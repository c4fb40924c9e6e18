"""Fill-in-the-middle: documents cut at two token boundaries and put together in another order.

A text is decoded once to an array of code points. A token is a run of the
letters A-Z and a-z or any other single character, so a token begins wherever
two neighbours are not both letters: ``flatnonzero`` of that comparison gives
all boundaries, two ranks chosen by the document's hash pick the cuts among
them, and the three slices are encoded again. Nothing is shuffled, and a worker
holds the array of one text at a time.

Defined cases: a null text counts as empty; empty texts and texts that hold a
sentinel stay plain; a null doc_id is hashed as an empty string; repeated rows
are cut alike, each for itself; other columns of the input, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are cut, and of 100 of these so many put the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
SEED = 1
#: Characters of outputs that a worker holds before it passes them on.
HELD_CHARS = 1 << 22


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where the tokens of a text of these code points begin, and its end."""
    lower = points | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(begins), len(points))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that a document's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, doc_id: int | None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, characters of prefix and middle (none if plain) and output of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = boundaries(points)
    n = len(edges) - 1
    first, second, whole, order = draws(doc_id, seed)
    if not n or whole % 100 >= CUT_SHARE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = edges[sorted((first % (n + 1), second % (n + 1)))].tolist()
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (points[:a], points[a:b], points[b:]))
    if order % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_RESULT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every document."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id = doc_id.as_py()
                rows.append((doc_id, *cut(text.as_py(), doc_id, seed)))
                held += len(rows[-1][-1])
                if held > HELD_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut_all, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made of: no part holds a mark, so the marks tell the parts."""
    parts = F.split(output, "|".join(re.escape(mark) for mark in (PREFIX, SUFFIX, MIDDLE)))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of :func:`transformed` with digests in place of the output, and of the text restored from it."""
    made = transformed(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
