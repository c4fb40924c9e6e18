"""Conversation structure repair: cheapest edits that make turns alternate.

A conversation is sound if its roles read ``(s?(ua)+)?`` by their initials. An
edit keeps a row, renames its role, deletes it or inserts an empty one; the
edits of a conversation are paths through a graph of (row, state of that
pattern), whose arcs carry costs. Least costs from the start forward and from
the end backward tell which arcs lie on a cheapest path (those whose two costs
and own cost add up to the total). From the set of all states that the letters
so far lead to on such arcs, the least letter that any of them offers comes
next, so the edits found are the least of all cheapest ones.

Rows are put in order by ranges of (conversation, turn, role, digest of the
text), so that a long conversation lies in many ranges, and only a letter for
each row goes on: segments of at most SEGMENT rows of one conversation. A
segment's effect is a table of costs from state to state; these tables, one
for each segment, are folded forward and backward, and so are the frontiers
that each set of states would turn into. All other work is done by segment.
What meets for one conversation is thus much smaller than the letters of its
own edits. Texts are moved once, next to the edits, for the digest of the
repaired rows, through which they stream in order.

Defined cases: a null role or text is a single space; a null turn comes first
and has no part in gaps; null conversation ids are one conversation; rows of
the same turn are taken by role and then by the digest of their text; a role
is told by its first character, so other names than system, user and assistant
are kept where that fits; conversations all of whose rows are lost are
returned by :func:`judged`; repeated rows are rows of their own; other columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.lineage import durable

SPACE = " \t\n\x0b\x0c\r"
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of one segment, at most, as a power of two.
SEGMENT_BITS = 10
#: States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES, ACCEPTING = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only user or assistant turn that may follow a state.
FOLLOWS = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
_ALL = range(STATES)

#: A row's letter: what its role's initial and its fault allow. Lower case: sound; upper case: truncated; "-": must go.
KINDS = "suaoSUAO-"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after the damage that each one's key decides."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text"), (F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return given.where("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _name(conv_id: Column) -> Column:
    """A conversation's id as text, a single space if it is null."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def _told(rows: DataFrame) -> DataFrame:
    """What is needed of rows but their text, in order (``place``), each with its fault and letter."""
    last = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(F.length(last) == 0, "blank").when(~F.substring(last, -1, 1).rlike("[.!?]"), "truncated").otherwise("")
    same = F.sha2(F.concat_ws(":", _name(F.col("conv_id")), F.length("role"), "role", "text"), 256)
    initial = F.substring("role", 1, 1)
    told = rows.select(*_key(), "conv_id", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"), same.alias("same"), F.monotonically_increasing_id().alias("salt"))
    by = ["conv", "turn", "role", "digest", "salt"]
    placed = durable(told.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt").withColumn("place", F.monotonically_increasing_id()))
    # copies of a text within a conversation: few rows, counted before they are shuffled
    repeated = placed.where("fault <> 'blank'").groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    fault = F.when((F.col("fault") != "blank") & (F.col("place") > F.col("first")), "duplicate").otherwise(F.col("fault"))
    letter = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    return placed.join(repeated, "same", "left").select("conv", "conv_id", "turn", "role", "digest", "initial", "place", fault.alias("fault"), letter.alias("letter"))


def _key() -> list[Column]:
    """What puts a row in its place: rows that agree in all of it are equal."""
    return [_name(F.col("conv_id")).alias("conv"), F.col("turn"), F.col("role"), F.sha2("text", 256).alias("digest")]


def _min_plus(letters: str, costs: list[int]) -> list[int]:
    """Least costs of the states after some rows, from those before them."""
    for letter in letters:
        costs = _row(letter, _inserted(costs))
    return costs


def _inserted(costs: list[int]) -> list[int]:
    """Costs with any rows inserted here: at most two in a row are of use."""
    a, b, c, d = costs
    c = min(c, min(a, b, d) + INSERT)
    return [a, b, c, min(d, c + INSERT)]


def _row(letter: str, costs: list[int]) -> list[int]:
    out = [c + DELETE for c in costs]
    for state, (into, cost, _) in _steps(letter):
        out[into] = min(out[into], costs[state] + cost)
    return out


def _steps(letter: str) -> list[tuple[int, tuple[int, int, str]]]:
    """The arcs, but deletion, by which a row leads from state to state: (from, (into, cost, K or R))."""
    return _STEPS[letter]


def _arcs(letter: str) -> list[tuple[int, tuple[int, int, str]]]:
    if letter == "-":
        return []
    more = TRUNCATED if letter.isupper() else 0
    kept = [(q, (NEXT[q, letter.lower()], more, "K")) for q in _ALL if (q, letter.lower()) in NEXT]
    return kept + [(q, (AFTER[q], RENAME + more, "R")) for q in _ALL]


_STEPS = {letter: _arcs(letter) for letter in KINDS}


def _backward(letters: str, ends: list[int]) -> list[list[int]]:
    """For each place between rows, from the first to the last: least costs from a state there, before insertions, to the end."""
    costs = [_until(ends)]
    for letter in reversed(letters):
        after = costs[-1]
        before = [after[q] + DELETE for q in _ALL]
        for state, (into, cost, _) in _steps(letter):
            before[state] = min(before[state], after[into] + cost)
        costs.append(_until(before))
    return costs[::-1]


def _until(costs: list[int]) -> list[int]:
    """Least costs onward if rows may be inserted first."""
    a, b, c, d = costs
    c = min(c, d + INSERT)
    d, a, b = min(d, c + INSERT), min(a, c + INSERT), min(b, c + INSERT)
    return [a, b, c, d]


def transfer(letters: str) -> list[int]:
    """A segment's effect: least costs from each state (first) to each, as one list; insertions after it are the next one's."""
    return [c for q in _ALL for c in _min_plus(letters, [0 if p == q else FAR for p in _ALL])]


def travelled(letters: str, begins: list[int], ends: list[int], total: int, frontier: int, last: bool) -> tuple[str, int]:
    """The least letters of a segment's cheapest edits from a set of states (as bits), and the set that they lead to.

    ``begins`` are costs from the start to the segment's first row, ``ends`` those from its end on, before insertions.
    """
    onward = _backward(letters, ends)
    costs, out = list(begins), []
    for at in range(len(letters) + 1):
        costs, here = _inserted(costs), onward[at]
        fits = lambda q, into, cost, then: frontier >> q & 1 and costs[q] + cost + then[into] == total
        after = onward[at + 1] if at < len(letters) else None
        while True:
            deleted = sum(1 << q for q in _ALL if after and fits(q, q, DELETE, after))
            if deleted:
                out.append("D")
                frontier = deleted
                break
            if after is None and (not last or any(frontier >> q & 1 and costs[q] == total for q in ACCEPTING)):
                break
            added = 0
            for q in _ALL:
                if fits(q, AFTER[q], INSERT, here):
                    added |= 1 << AFTER[q]
            if added:
                out.append("I")
                frontier = added
                continue
            offered = [(name, into) for q, (into, cost, name) in _steps(letters[at]) if fits(q, into, cost, after)]
            name = min(offered)[0]
            out.append(name)
            frontier = 0
            for n, into in offered:
                frontier |= (n == name) << into
            break
        if at < len(letters):
            costs = _row(letters[at], costs)
    return "".join(out), frontier


START, END = [0, FAR, FAR, FAR], [0 if q in ACCEPTING else FAR for q in _ALL]


def solved(letters: str) -> tuple[str, int]:
    """The edits of a conversation of one segment, and their cost."""
    total = _backward(letters, END)[0][0]
    return travelled(letters, START, END, total, 1, True)[0], total


def folded(effects: list[list[int]]) -> tuple[list[list[int]], list[list[int]], int]:
    """For each of a conversation's segments the costs before it and after it, and the total, from all their effects."""
    across = lambda costs, effect: [min(c + effect[STATES * p + q] for p, c in enumerate(_inserted(costs))) for q in _ALL]
    back = lambda effect, costs: _until([min(effect[STATES * p + q] + costs[q] for q in _ALL) for p in _ALL])
    begins, ends = [START], [_until(END)]
    for effect in effects[:-1]:
        begins.append(across(begins[-1], effect))
    for effect in effects[:0:-1]:
        ends.append(back(effect, ends[-1]))
    return begins, ends[::-1], back(effects[0], ends[-1])[0]


def ways(letters: str, begins: list[int], ends: list[int], total: int, last: bool) -> list[int]:
    """For each set of states (as bits) that may be a segment's first frontier, the set that it turns into."""
    onward, costs, out = _backward(letters, ends)[0], _inserted(begins), [0] * (1 << STATES)
    tight = [q for q in _ALL if costs[q] + onward[q] == total]
    for n in range(1, len(tight) + 1):
        for some in combinations(tight, n):
            frontier = sum(1 << q for q in some)
            out[frontier] = travelled(letters, begins, ends, total, frontier, last)[1]
    return out


_COSTS = T.ArrayType(T.LongType())
_SOLVED = T.StructType([T.StructField("edits", T.StringType()), T.StructField("cost", T.LongType())])
_FOLDED = T.StructType([T.StructField("begins", T.ArrayType(_COSTS)), T.StructField("ends", T.ArrayType(_COSTS)), T.StructField("total", T.LongType())])


@F.pandas_udf(_SOLVED)
def _solved(letters: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([solved(x) for x in letters], columns=["edits", "cost"])


@F.pandas_udf(_COSTS)
def _transfer(letters: pd.Series) -> pd.Series:
    return pd.Series([transfer(x) for x in letters], dtype=object)


@F.pandas_udf(_FOLDED)
def _folded(effects: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([folded([e.tolist() for e in some]) for some in effects], columns=["begins", "ends", "total"])


@F.pandas_udf(_COSTS)
def _ways(letters: pd.Series, begins: pd.Series, ends: pd.Series, total: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([ways(x, b.tolist(), e.tolist(), t, z) for x, b, e, t, z in zip(letters, begins, ends, total.tolist(), last)], dtype=object)


@F.pandas_udf(T.StringType())
def _travelled(letters: pd.Series, begins: pd.Series, ends: pd.Series, total: pd.Series, frontier: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([travelled(x, b.tolist(), e.tolist(), t, f, z)[0] for x, b, e, t, f, z in zip(letters, begins, ends, total.tolist(), frontier.tolist(), last)], dtype=object)


def _by_conversation(segments: DataFrame, *columns: str) -> DataFrame:
    """conv and the array ``all`` of its segments' columns, in order; a few numbers for each segment."""
    return segments.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("segment", *columns))).alias("all"))


def _edited(told: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """conv, segment, rows (in order), edits and cost (of the whole conversation) of each segment."""
    row = F.struct("place", "letter", "initial", "turn", "role", "digest")
    segments = told.groupBy("conv", F.shiftright("place", bits).alias("segment")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    segments = segments.withColumn("letters", F.array_join(F.transform("rows", lambda r: r["letter"]), ""))
    spans = told.groupBy("conv").agg(F.shiftright(F.min("place"), bits).alias("first"), F.shiftright(F.max("place"), bits).alias("end"))
    segments = durable(segments.join(spans, "conv").withColumn("last", F.col("segment") == F.col("end")))
    one = segments.where("first = end").withColumn("done", _solved("letters")).select("conv", "segment", "rows", "done.edits", "done.cost")

    many = segments.where("first <> end")
    effects = _by_conversation(many.withColumn("effect", _transfer("letters")), "effect")
    costs = effects.select("conv", F.col("all.segment").alias("segments"), _folded("all.effect").alias("f"))
    each = costs.select("conv", F.col("f.total").alias("total"), F.explode(F.arrays_zip("segments", "f.begins", "f.ends")).alias("e")).select("conv", "total", F.col("e.segments").alias("segment"), F.col("e.begins").alias("begins"), F.col("e.ends").alias("ends"))
    costed = durable(many.join(each, ["conv", "segment"]))
    turned = _by_conversation(costed.withColumn("ways", _ways("letters", "begins", "ends", "total", "last")), "ways")
    first = F.array(F.lit(1).cast("bigint"))
    frontiers = F.aggregate("all", first, lambda seen, s: F.concat(seen, F.array(F.get(s["ways"], F.element_at(seen, -1).cast("int")))))
    met = turned.select("conv", F.explode(F.arrays_zip(F.col("all.segment").alias("segment"), F.slice(frontiers, 1, F.size("all")).alias("frontier"))).alias("e")).select("conv", "e.segment", "e.frontier")
    long = costed.join(met, ["conv", "segment"]).select("conv", "segment", "rows", _travelled("letters", "begins", "ends", "total", "frontier", "last").alias("edits"), F.col("total").alias("cost"))
    return durable(one.unionByName(long))


def _illegal(pairs: Column) -> Column:
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))


def _summary(edited: DataFrame) -> DataFrame:
    """conv, illegal, cost and audit of each conversation."""
    n = F.size("rows")
    within = F.zip_with(F.slice("rows", 1, n - 1), F.slice("rows", 2, n - 1), lambda a, b: F.concat(a["initial"], b["initial"]))
    told = edited.withColumn("odd", _illegal(within)).withColumn("opens", F.get("rows", F.lit(0))["initial"]).withColumn("closes", F.element_at("rows", -1)["initial"])
    whole = told.groupBy("conv").agg(F.max("cost").alias("cost"), F.sum("odd").alias("odd"), F.array_sort(F.collect_list(F.struct("segment", "edits", "opens", "closes"))).alias("all"))
    m = F.size("all")
    between = F.zip_with(F.slice("all", 1, m - 1), F.slice("all", 2, m - 1), lambda a, b: F.concat(a["closes"], b["opens"]))
    return whole.select("conv", (F.col("odd") + _illegal(between)).cast("long").alias("illegal"), "cost", F.array_join("all.edits", "").alias("audit"))


EDIT, ROW = 0, 1
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("conv", pa.string()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])


class _Lines:
    """Rows of one conversation after another, gathered into batches of a bounded size."""

    def __init__(self) -> None:
        self.conv: str | None = None
        self.state = self.at = self.held = 0
        self.pending, self.later = "", ""
        self.rows: list[tuple] = []

    def begins(self, conv: str) -> None:
        if conv != self.conv:
            self.conv, self.state, self.at, self.pending, self.later = conv, 0, 0, "", ""

    def add(self, role: str, text: str, into: int) -> None:
        self.rows.append((None if self.conv == " " else int(self.conv), self.conv, self.at, role, text))
        self.state, self.at, self.held = into, self.at + 1, self.held + len(text) + 16

    def insert(self, letters: str) -> None:
        for _ in range(letters.count("I")):
            self.add(ROLES[FOLLOWS[self.state]], "", AFTER[self.state])

    def edit(self, letters: str) -> None:
        kept = letters.strip("I")
        if self.pending or kept == "D":
            self.later += "I" * letters.count("I")
            if not self.pending:
                self.insert(self.later)
                self.later = ""
        else:
            self.insert(letters[: letters.index(kept)])
            self.pending, self.later = kept, letters[letters.index(kept) + 1 :]

    def row(self, role: str, text: str) -> None:
        if self.pending == "K":
            self.add(role, text, NEXT[self.state, role[:1]])
        elif self.pending == "R":
            self.add(ROLES[FOLLOWS[self.state]], text, AFTER[self.state])
        if self.pending:
            self.insert(self.later)
            self.pending, self.later = "", ""

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _REPAIRED)], schema=_REPAIRED)
        self.rows, self.held = [], 0
        return made


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from edits and rows that come in order, an edit before the row that it is about."""
    lines = _Lines()
    for batch in batches:
        columns = [batch.column(n) for n in ("conv", "kind", "edit", "role", "text")]
        for conv, kind, edit, role, text in zip(*columns):
            lines.begins(conv.as_py())
            if kind.as_py() == EDIT:
                lines.edit(edit.as_py())
            elif lines.pending:
                lines.row(role.as_py(), text.as_py())
            if lines.held > 1 << 22:
                yield lines.batch()
    if lines.rows:
        yield lines.batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv and the digest of its lines ``role:text``; only the digest so far is held."""
    at, digest = None, None
    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch.column(n) for n in ("conv", "role", "text"))):
            line = f"{role.as_py()}:{text.as_py()}".encode()
            if conv.as_py() != at:
                if digest:
                    done.append((at, digest.hexdigest()))
                at, digest = conv.as_py(), hashlib.sha256(line)
            else:
                digest.update(b"\n")
                digest.update(line)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])


def _merged(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Edits and rows of each conversation in one partition, in order."""
    piece = F.regexp_extract_all("edits", F.lit("I*[DKR](?:I+$)?"), F.lit(0))
    pieces = edited.select("conv", F.explode(F.arrays_zip("rows", piece.alias("edit"))).alias("e")).select("conv", "e.rows.turn", "e.rows.role", "e.rows.digest", "e.rows.place", "e.edit").where("edit <> 'D'")
    edits = pieces.select("conv", "turn", "role", "digest", F.lit(EDIT).alias("kind"), "place", "edit", F.lit(None).cast("string").alias("text"))
    texts = rows.select(*_key(), F.lit(ROW).alias("kind"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("edit"), "text")
    return edits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind", "place")


def _given(rows: DataFrame) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))


def repaired(rows: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """conv_id, at (from 0), role and text of the rows that the cheapest edits leave and insert."""
    given = _given(rows)
    made = _merged(given, _edited(_told(given), bits)).mapInArrow(_written, "conv_id long, conv string, at long, role string, text string")
    return made.drop("conv")


def audited(rows: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation."""
    given = _given(rows)
    told = _told(given)
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = told.groupBy("conv", "conv_id").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    edited = _edited(told, bits)
    digests = _merged(given, edited).mapInArrow(lambda batches: _hashed(_written(batches)), "conv string, repaired_sha256 string")
    met = facts.join(_summary(edited), "conv", "left").join(digests, "conv", "left")
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


EMPTY = hashlib.sha256(b"").hexdigest()


def judged(table: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """:func:`audited` of the table's conversations after damage, with those that lost all rows."""
    found = audited(damaged(table), bits)
    every = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = every.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("e.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
