"""Quality classifier by co-training of a text view and a metadata view.

Two classifiers see a document: one its words and characters, the other what is
known about it (source, language, stated length, host of its url), nothing of
which is in the text. Each starts from the labelled sample. In every round each
view, calibrated on held-out labels, labels for the other view the share of all
other documents that it is surest of, of both kinds: its highest and its lowest
quantile, in the kinds' proportions. A pseudo-label weighs as much as the
calibrated probability goes beyond the kind's base rate, so a view that knows
little teaches little. At the end the calibrated views are combined, again on
held-out labels, and all documents are scored.

A view is a linear discriminant. It needs only counts, sums and products of the
rows of each kind, so pseudo-labelled rows are summed up where they lie and
their number has no bound: together they weigh as much as the labelled rows.
Only the labelled sample is bounded: at most LABELLED_ROWS rows, of the least id
hashes. All other documents, with or without label, are the pool. Features count
all words of a text.

Defined cases: null and empty texts are scored by their metadata and empty
words; null or missing language, source, url or length count as a value of
their own; labels that are null or name no document are ignored, and of labels
that disagree on a document the lower one holds; without labels of both kinds
all documents score 0.5 and are kept; repeated rows are scored each; rows
without id are scored and not learned from; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.memory import Run, released
from sluice.llm.sampling import hash_sample
from sluice.plans.lineage import durable

LABELLED_ROWS = 12_000
ROUNDS = 3
#: Share of the pool's rows of a kind that a view labels for the other in the first round; it grows by as much each round.
SHARE = 0.1
#: Bins of a view's logit, between -LOGIT and LOGIT, by which its quantiles are found.
BINS = 4_096
LOGIT = 30.0
RIDGE = 0.01
KEEP_FROM = 0.5
SHAPES = 32
#: Marks that may stand around a word of letters.
MARKS = ".,;:!?\"'()"
#: Words of these scripts (Latin, Greek, Cyrillic) are told apart by Arrow, which knows other letters of the rest of Unicode than Python.
AGREED = r"^[\x00-\x7f\x{c0}-\x{1c4}\x{1f4}-\x{24f}\x{370}-\x{379}\x{37b}-\x{52f}]*$"
#: Rows, and bytes of their texts, whose features are worked out before they go on.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2_048, 2 << 20
HASHED = {"lang": 16, "source": 32, "host": 32}
#: Powers of two from which a stated length counts once more.
LENGTH_STEPS = tuple(range(4, 18, 2))


@functools.lru_cache(1 << 16)
def _shape(end: str, alpha: bool) -> int:
    """The slot of a word's last three characters: letters of words of letters only, else what kinds of characters they are."""
    return xxhash.xxh32_intdigest(end.lower() if alpha else "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in end)) % SHAPES


def _word_kinds(words: pa.Array) -> np.ndarray:
    """Of different words, in one number each: characters, whether all are capitals, whether some are no letters, and the shape's slot."""
    letters = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    known = pc.match_substring_regex(words, AGREED)
    plain, known = words.filter(known), known.to_numpy(zero_copy_only=False)
    alpha = pc.utf8_is_alpha(plain)
    bare = pc.replace_substring(pc.ascii_trim(plain, characters=MARKS), "-", "")
    ends = pc.binary_join_element_wise(pc.if_else(alpha, "a", "-"), pc.utf8_slice_codeunits(plain, start=-3), "").dictionary_encode()
    loud, mixed, slot = np.zeros((3, len(words)), np.int64)
    loud[known], mixed[known] = pc.utf8_is_upper(plain).to_numpy(zero_copy_only=False), ~pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
    slot[known] = np.array([_shape(e[1:], e[0] == "a") for e in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
    rest = [(w.isupper(), not w.strip(MARKS).replace("-", "").isalpha(), _shape(w[-3:], w.isalpha())) for w in words.filter(pa.array(~known)).to_pylist()]
    loud[~known], mixed[~known], slot[~known] = np.array(rest, np.int64).reshape(-1, 3).T
    return ((letters << 1 | loud & (letters > 1)) << 1 | mixed) * SHAPES + slot


def text_matrix(texts: pa.Array) -> np.ndarray:
    """The text view of every row: shares of characters and words by kind, repetition, word shapes.

    All words count. Each different word of the rows is looked at once.
    """
    texts = pc.fill_null(texts, "")
    rows, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    codes = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets, offsets[1:])])
    long = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)

    split = pc.utf8_split_whitespace(texts)
    words, row = split.flatten(), np.repeat(np.arange(rows), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    there = pc.not_equal(words, "")  # a text that begins or ends with space has an empty part there
    coded, row = words.filter(there).dictionary_encode(), row[there.to_numpy(zero_copy_only=False)]
    at, different = coded.indices.to_numpy(), len(coded.dictionary)
    kinds = _word_kinds(coded.dictionary)[at]
    letters, loud, mixed, shape = kinds // SHAPES >> 2, kinds // SHAPES >> 1 & 1, kinds // SHAPES & 1, kinds % SHAPES
    sums = lambda weights: np.bincount(row, weights, rows)
    counted = sums(None)
    n = np.maximum(counted, 1)
    again = np.bincount(row[1:][(at[1:] == at[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    pairs = np.sort(row * max(different, 1) + at)
    vocabulary = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // max(different, 1), minlength=rows)
    shapes = np.bincount(row * SHAPES + shape, minlength=rows * SHAPES).reshape(rows, SHAPES)

    lines = codes[:, 10] + 1
    upper, digits, dots = codes[:, 65:91].sum(axis=1), codes[:, 48:58].sum(axis=1), codes[:, [33, 46, 63]].sum(axis=1)
    signs = codes[:, 33:48].sum(axis=1) + codes[:, 58:65].sum(axis=1) + codes[:, 91:97].sum(axis=1) + codes[:, 123:127].sum(axis=1)
    base = [*(c / long for c in (upper, digits, dots, signs, codes[:, 124], codes[:, 33])), sums(loud) / n, sums(mixed) / n, again / n, vocabulary / n]
    base += [np.log1p(counted) / 10, sums(letters) / n / 10, np.log1p(lines) / 5, lines / n, pc.count_substring(texts, "\n\n").to_numpy(zero_copy_only=False) / lines]
    return np.hstack([np.stack(base, axis=1), shapes / n[:, None]])


def text_features(text: str) -> np.ndarray:
    """The text view of one text."""
    return text_matrix(pa.array([text], pa.string()))[0]


def metadata_matrix(lang: pa.Array, source: pa.Array, n_chars: pa.Array, url: pa.Array) -> np.ndarray:
    """The metadata view of every row: language, source, host and stated length; it does not see the text."""
    lengths = n_chars.to_numpy(zero_copy_only=False)
    known = ~np.isnan(lengths)
    size = np.log2(np.maximum(np.where(known, lengths, 0.0), 0.0) + 1)
    parts = [np.stack([known, size / 20, *(np.maximum(0.0, size - s) / 20 for s in LENGTH_STEPS)], axis=1)]
    host = pc.utf8_lower(pc.struct_field(pc.extract_regex(url, r"://(?P<host>[^/?#]*)"), "host"))
    for name, values in (("lang", lang), ("source", source), ("host", host)):
        coded = values.dictionary_encode(null_encoding="encode")
        slots = np.array([xxhash.xxh32_intdigest(f"{name}={v}") % HASHED[name] for v in coded.dictionary.to_pylist()], np.int64)
        parts.append(np.eye(HASHED[name])[slots[coded.indices.to_numpy()]])
    return np.hstack(parts)


SEEN = ("text", "lang", "source", "n_chars", "url")
KINDS = {c: pa.float64() if c == "n_chars" else pa.string() for c in SEEN}


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch of one row or more."""
    text, *rest = [batch.column(c).cast(KINDS[c]) if c in batch.schema.names else pa.nulls(batch.num_rows, KINDS[c]) for c in SEEN]
    return text_matrix(text), metadata_matrix(*rest)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so few rows and bytes of text that their words fit in memory; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.string())), 0).to_numpy(zero_copy_only=False)) if "text" in batch.schema.names else np.zeros(batch.num_rows)
    k = 0
    while k < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BYTES_AT_ONCE, side="right"))
        end = max(k + 1, min(end, k + ROWS_AT_ONCE))
        yield batch.slice(k, end - k)
        k = end


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression, by Newton steps."""
    wide = np.hstack([x, np.ones((len(x), 1))])
    weights, penalty = np.zeros(wide.shape[1]), ridge * np.eye(wide.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ weights, -LOGIT, LOGIT)))
        step = np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + penalty, wide.T @ (y - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class View:
    """A view's direction and calibration (slope, constant)."""

    direction: np.ndarray
    calibration: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x @ self.direction) * self.calibration[0] + self.calibration[1], -LOGIT, LOGIT)


@dataclass
class Model:
    """Both views and the weights that combine their calibrated scores."""

    text: View
    metadata: View
    weights: np.ndarray

    def score(self, words: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(words), self.metadata.logit(meta)
        both = np.clip(a * self.weights[0] + b * self.weights[1] + self.weights[2], -LOGIT, LOGIT)
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


class Sums:
    """Weights, sums and products of the rows of both kinds (bad, good)."""

    def __init__(self, width: int):
        self.mass, self.first, self.second = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))

    def add(self, kind: int, x: np.ndarray, weight: np.ndarray) -> None:
        self.mass[kind] += weight.sum()
        self.first[kind] += weight @ x
        self.second[kind] += (x * weight[:, None]).T @ x

    def flat(self) -> np.ndarray:
        return np.concatenate([self.mass, self.first.ravel(), self.second.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, width: int) -> Sums:
        out = cls(width)
        out.mass, out.first, out.second = flat[:2], flat[2 : 2 + 2 * width].reshape(2, width), flat[2 + 2 * width :].reshape(2, width, width)
        return out

    def scaled(self, most: np.ndarray) -> Sums:
        """These sums with at most the mass ``most`` of each kind."""
        share = np.minimum(1.0, most / np.maximum(self.mass, 1e-300))
        out = Sums(self.first.shape[1])
        out.mass, out.first, out.second = self.mass * share, self.first * share[:, None], self.second * share[:, None, None]
        return out

    def __add__(self, other: Sums) -> Sums:
        return Sums.of(self.flat() + other.flat(), self.first.shape[1])


def discriminant(sums: Sums) -> np.ndarray:
    """The direction that tells the kinds apart best for the spread within them."""
    means = sums.first / np.maximum(sums.mass, 1e-12)[:, None]
    within = (sums.second - sums.mass[:, None, None] * means[:, :, None] * means[:, None, :]).sum(axis=0) / max(sums.mass.sum(), 1e-12)
    scale = np.sqrt(np.maximum(np.diag(within), 0)) + 1e-6
    even = within / scale[:, None] / scale[None, :] + RIDGE * np.eye(len(scale))
    return np.linalg.solve(even, (means[1] - means[0]) / scale) / scale


def _view(sums: Sums, held_x: np.ndarray, held_y: np.ndarray) -> View:
    direction = discriminant(sums)
    calibration = fit_logistic((held_x @ direction)[:, None], held_y, ridge=0.01)
    if calibration[0] <= 0:
        calibration = np.array([0.0, np.log(held_y.mean() / (1 - held_y.mean()))])
    return View(direction, calibration)


#: From both views and the round: for each view the sums of what the other labels for it.
Teach = Callable[[list[View], int], list[Sums]]


def co_trained(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, teach: Teach, rounds: int = ROUNDS) -> Model:
    """A model of both views. ``held`` marks the labelled rows for calibration."""
    base, tests = [], [v[held] for v in labelled]
    for v in labelled:
        sums = Sums(v.shape[1])
        for kind in (0, 1):
            sums.add(kind, v[~held & (y == kind)], np.ones(int((~held & (y == kind)).sum())))
        base.append(sums)
    views = [_view(s, t, y[held]) for s, t in zip(base, tests)]
    for turn in range(rounds):
        taught = teach(views, turn)
        views = [_view(s + more.scaled(s.mass), t, y[held]) for s, more, t in zip(base, taught, tests)]
    both = np.stack([v.logit(t) for v, t in zip(views, tests)], axis=1)
    weights = fit_logistic(both, y[held], ridge=0.1)
    for place in (0, 1):
        # a view that would count against itself does not count
        if weights[place] < 0:
            rest = fit_logistic(both[:, [1 - place]], y[held], ridge=0.1)
            weights = np.insert(rest, place, 0.0)
    return Model(views[0], views[1], weights)


def _bin(logit: np.ndarray) -> np.ndarray:
    return np.clip(((logit + LOGIT) * (BINS / (2 * LOGIT))).astype(np.int64), 0, BINS - 1)


def cuts(counts: np.ndarray, good: float, share: float) -> tuple[int, int]:
    """The bins up to which a view says bad, and from which it says good.

    Each takes its kind's share of the rows, in whole bins, and at least its
    outermost bin with rows; the two never meet.
    """
    total, upto = counts.sum(), np.cumsum(counts)
    filled = np.flatnonzero(counts)
    if len(filled) < 2:
        return -1, BINS
    low = max(int(filled[0]), int(np.searchsorted(upto, share * (1 - good) * total, side="right")) - 1)
    high = min(int(filled[-1]), BINS - int(np.searchsorted(np.cumsum(counts[::-1]), share * good * total, side="right")))
    return (low, high) if low < high else (int(filled[0]), int(filled[-1]))


def pseudo_weight(p: np.ndarray, kind: int, good: float) -> np.ndarray:
    """How far a calibrated probability goes beyond the kind's base rate, from 0 to 1."""
    return np.clip((p - good) / (1 - good) if kind else (good - p) / good, 0.0, 1.0)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A view's rows, which are bytes of floats or lists."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(rows, -1).astype(float)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(float)


def _logit_bins(views: list[View]):
    """How many rows of a partition each view's bins hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                for v, name in enumerate(("words", "meta")):
                    found[v] += np.bincount(_bin(views[v].logit(_matrix(batch.column(name), batch.num_rows))), minlength=BINS)
        yield _sum_rows(dict(enumerate(found)))

    return count


def _lessons(views: list[View], limits: list[tuple[int, int]], good: float, widths: tuple[int, int]):
    """What each view teaches the other with the rows of a partition, as sums."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Sums(w) for w in widths]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [_matrix(batch.column(c), batch.num_rows) for c in ("words", "meta")]
            for v in (0, 1):
                logit = views[v].logit(x[v])
                place, p = _bin(logit), _sigmoid(logit)
                for kind, at in ((0, place <= limits[v][0]), (1, place >= limits[v][1])):
                    sums[1 - v].add(kind, x[1 - v][at], pseudo_weight(p[at], kind, good))
        yield _sum_rows({v: s.flat() for v, s in enumerate(sums)})

    return gather


SUMS = "view int, sums array<double>"


def _sum_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(float) for x in sums.values()], pa.list_(pa.float64()))], names=["view", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for v, flat in zip(batch.column("view").to_pylist(), batch.column("sums")):
            sums[v] = sums.get(v, 0.0) + flat.values.to_numpy()
    yield _sum_rows(sums)


def _sums(pool: DataFrame, of: Run, widths: tuple[int, int]) -> list[np.ndarray]:
    """Both views' sums over all rows: two rows leave a partition, and a few tasks add them up before the driver does."""
    sums = [np.zeros(w) for w in widths]
    for r in pool.mapInArrow(released(of), SUMS).repartition(8).mapInArrow(_added, SUMS).collect():
        sums[r["view"]] += np.array(r["sums"])
    return sums


def teacher(pool: DataFrame, good: float, widths: tuple[int, int]) -> Teach:
    """Labels all rows of ``pool`` (both views) that a view is surest of, on Spark."""

    def teach(views: list[View], turn: int) -> list[Sums]:
        limits = [cuts(c, good, SHARE * (turn + 1)) for c in _sums(pool, _logit_bins(views), (BINS, BINS))]
        flat = _sums(pool, _lessons(views, limits, good, widths), tuple(len(Sums(w).flat()) for w in widths))
        return [Sums.of(f, w) for f, w in zip(flat, widths)]

    return teach


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and what the views read; columns that are missing are null."""
    kinds = {"n_chars": "double"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in SEEN])


def _bytes(x: np.ndarray) -> pa.Array:
    """A matrix's rows as bytes of floats, which move between Spark and Python as they are."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and both views of every row of ``docs``."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(_bytes, _features(part))], names=["doc_id", "words", "meta"])

    return _rows(docs).mapInArrow(released(see), "doc_id long, words binary, meta binary")


def fitted(features: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> Model | None:
    """A model from a bounded sample of the labelled rows of ``features`` and all other rows."""
    told = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality")).where("l_id is not null and quality in (0, 1)").groupBy("l_id").agg(F.min("quality").alias("quality"))
    ids = features.select(F.col("doc_id").alias("l_id")).where("l_id is not null").distinct()
    known = durable(told.join(ids, "l_id", "left_semi"))
    # at most labelled_rows ids
    wanted = durable(hash_sample(known, "l_id", labelled_rows))
    rows = features.join(F.broadcast(wanted), F.col("doc_id") == F.col("l_id")).select("l_id", "quality", "words", "meta")
    found = rows.groupBy("l_id").agg(*[F.any_value(c).alias(c) for c in ("quality", "words", "meta")]).toPandas().sort_values("l_id")
    y = found["quality"].to_numpy(float)
    held = np.array([xxhash.xxh32_intdigest(str(i)) % 4 == 0 for i in found["l_id"]], bool)
    if not all(len(set(part)) == 2 for part in (y[held], y[~held])):
        return None
    views = [np.stack([np.frombuffer(x, np.float32) for x in found[c]]).astype(float) for c in ("words", "meta")]
    pool = features.where("doc_id is not null").join(F.broadcast(wanted.select("l_id")), F.col("doc_id") == F.col("l_id"), "left_anti")
    return co_trained((views[0], views[1]), y, held, teacher(pool, float(y.mean()), (views[0].shape[1], views[1].shape[1])), rounds)


def _scores(model: Model | None, rows: int, views: Callable[[], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.full(rows, 0.5),) * 3 if model is None or not rows else model.score(*views())


def scored(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, the scores of both views, score and keep of every row of ``docs``."""
    features = durable(featured(docs))
    model = fitted(features, labels, **params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(model, batch.num_rows, lambda b=batch: tuple(_matrix(b.column(c), b.num_rows) for c in ("words", "meta")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names=["doc_id", "text_score", "metadata_score", "score"])

    out = features.mapInArrow(released(score), "doc_id long, text_score double, metadata_score double, score double")
    return out.withColumn("keep", F.col("score") >= KEEP_FROM)


def kept(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    model = fitted(durable(featured(docs)), labels, **params)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                marks = _scores(model, part.num_rows, lambda b=part: tuple(m.astype(np.float32).astype(float) for m in _features(b)))[2] >= KEEP_FROM
                yield part.filter(pa.array(marks))

    # the rows' own columns are read, so that a text is moved once
    return docs.mapInArrow(released(keep), docs.schema)
