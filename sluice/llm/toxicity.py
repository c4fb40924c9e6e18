"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, harm, intent, the kinds of targets, negation,
report, the words of phrases; contractions become two) and a text a string of
symbols in which clause ends and pauses are symbols too. Small transducers find
phrases of insult, threats, nouns that insult only someone whom they name,
negation, reported speech and targets. They are composed, arc by arc as texts
ask for them, into one machine whose arcs carry the weights of what they write.

A threat needs its parts in order: someone who speaks for himself or for them,
an intent, a verb of harm and a person; or the verb at a clause's beginning
before a person; or a wish that someone die. Another object cancels it. What a
negation or a report governs ends with the clause, a pause or a "but". A noun
like "trash" insults only next to the one it is said of. A clause writes each
kind once, and nouns without an owner count once a text.

The lexicon of insults is a stated list and terms learned from labels: words
and word beginnings that cover the toxic training documents and next to no
other, found greedily, most coverage first, until nothing more is covered. The
weights start from stated ones and are fitted to labels, in order and apart by
a margin: aimed counts more than bare, bare more than reported, reported more
than negated. One bare word of the stated list stays below 0.5; a learned term,
which labels speak for, need not. Only labels of rows outside the held-out fifth (by crc32 of the
id) are read, of at most TOXIC_ROWS toxic and CLEAN_ROWS other documents, those
of the least id hashes; of a repeated id one text, the least, is read.

Defined cases: null and empty texts hold no clause and get the constant's
score; null ids count as an empty text for the fold; labels that are null or
name no document are ignored, of labels that disagree the higher one holds;
repeated rows are scored each; other columns are ignored; an empty table gives
no rows, and without labels the stated weights hold.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.sampling import hash_sample
from sluice.plans.lineage import durable

TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
FOLDS = 5
#: Learned terms: least support, and least share of toxic among their documents.
SUPPORT = 2
PRECISION = 0.97
#: Learned terms that a toxic training document has before it counts as covered.
COVER = 4
PREFIXES = (4, 5, 6, 7)
#: Words whose symbols a Python worker keeps.
WORDS_KEPT = 200_000

INSULTS = frozenset(
    "arschloch asshole bastard bitch connard conne cretin creep depp disgusting dumb dumbass dummkopf dumm estupido estúpido fool freak "
    "gilipollas hideous idiot idiota idiote idioten imbecile imbécile jerk loser losers moron morons pathetic pendejo repulsive "
    "salaud scum scumbag stupid useless vermin wichser worthless wretched ugly".split()
)
#: Other symbols and their words, the first that has a word decides.
SYMBOLS = {
    "noun": "garbage rubbish trash pig pigs swine rat rats snake clown clowns cow dog dogs monkey müll schwein ordure porc basura cerdo".split(),
    "harm": "annihilate beat beaten burn crush destroy erschlagen hang hanged harm hunt hurt kill killed matar murder punish shoot shot slaughter slit smash stab stabbed strangle töten tuer umbringen verletzen".split(),
    "die": "die sterben mourir morir".split(),
    "i": "i we ich wir je nous yo nosotros someone somebody".split(), "they": "they sie ellos".split(),
    "you": "you u ya yourself yourselves du dich dir ihr euch tu te toi vous tú usted ustedes".split(),
    "your": "your yours dein deine euer ton votre su".split(),
    "person": "he she him them himself herself themselves everyone everybody people those these".split(),
    "intent": "will gonna going shall werde werden vais va voy vamos want wanna".split(),
    "wish": "hope wish deserve deserves should hoffe espère espero".split(),
    "be": "be is are am was were get bist ist es est eres re s m".split(), "a": "a an such just so really total ein eine un une una".split(),
    "the": "the this that my our his its some no any der das den le la les el los".split(),
    "negation": "not never nobody none nicht kein keine nie pas jamais nunca ni n't".split(),
    "report": "said says say called calls quoted wrote writes claimed claims reported alleged according sagte dit dijo".split(),
    "piece": "piece waste".split(), "of": ["of"], "space": "space air shit crap".split(), "shut": ["shut"], "up": ["up"],
    "pause": ", but though however yet aber sondern mais pero".split(),
}
#: What a clause can hold, and the weights before fitting.
PRIOR = {
    "term": 3.5, "insult": 2.2, "insult_aimed": 3.6, "insult_negated": 0.8, "insult_reported": 1.5, "noun": 0.3,
    "threat": 1.2, "threat_aimed": 3.6, "threat_negated": 0.2, "threat_reported": 0.7,
}
HOLDS = tuple(PRIOR)
#: From least to most, each at least a margin above the one before.
ORDER, MARGIN = ("negated", "reported", "", "aimed"), 0.25
PRIOR_CONSTANT = -3.0
#: So far below 0.5, in odds, a single bare word stays.
BELOW = 0.2
RIDGE = 0.3
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: A word, a pause, or a clause's end.
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|,|[.!?;:\n|]+")
#: Endings of contractions, as words of their own; "n't" takes the n along.
ENDINGS = {"ll": "will", "re": "are", "s": "is", "m": "am", "d": "would", "ve": "have"}
END = "end"
OTHER = "other"
ALPHABET = ("term", "insult", *SYMBOLS, OTHER, END)

State = tuple | str
Arcs = dict[tuple[State, str], tuple[State, tuple[str, ...]]]


class Transducer:
    """A finite-state machine: (state, symbol) to (state, symbols written).

    Without an arc for a symbol the machine stays in its state and writes the
    symbol; ``forget`` names states that it leaves then.
    """

    def __init__(self, arcs: Arcs, forget: Iterable[State] = (), start: State = "start"):
        self.arcs, self.forget, self.start = arcs, frozenset(forget), start

    def step(self, state: State, symbol: str) -> tuple[State, tuple[str, ...]]:
        return self.arcs.get((state, symbol)) or ((self.start if state in self.forget else state), (symbol,))

    def __call__(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out += written
        return out


class Cascade:
    """Machines composed into one: each reads what the one before writes. Arcs are made when they are first asked for."""

    def __init__(self, parts: Iterable[Transducer]):
        self.parts = tuple(parts)
        self.start = tuple(p.start for p in self.parts)
        self.arcs: Arcs = {}

    def step(self, state: State, symbol: str) -> tuple[State, tuple[str, ...]]:
        found = self.arcs.get((state, symbol))
        if found is None:
            states, written = list(state), (symbol,)
            for k, part in enumerate(self.parts):
                then: tuple[str, ...] = ()
                for s in written:
                    states[k], more = part.step(states[k], s)
                    then += more
                written = then
            found = self.arcs[state, symbol] = (tuple(states), written)
        return found

    def __call__(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for symbol in symbols:
            state, written = self.step(state, symbol)
            out += written
        return out


def phrases() -> Transducer:
    """Insults of several words; a phrase, once begun, is one or is dropped."""
    arcs: Arcs = {("start", "piece"): ("piece", ()), ("start", "shut"): ("shut", ()), ("piece", "of"): ("of", ()), ("shut", "up"): ("start", ("insult",))}
    for word in ("space", "insult", "term", "noun"):
        arcs["of", word] = ("start", ("insult",))
    for state in ("piece", "of", "shut"):
        for symbol in ALPHABET:
            arcs.setdefault((state, symbol), arcs.get(("start", symbol), ("start", (symbol,))))
    return Transducer(arcs)


TARGETS = ("you", "person", "they")
#: Words between a verb of harm and its person, at most.
BETWEEN = 2


def threats() -> Transducer:
    """Threats: agent, intent, harm and person in order, harm and person at the beginning, or a wish that someone die.

    Persons are passed on as targets; verbs, agents and wishes are not passed on.
    """
    striking = [f"strikes{k}" for k in range(BETWEEN + 1)]
    states = ("start", "plain", "agent", "intends", "harms", "victim", "doomed", "passive", "wished", *striking)
    arcs: Arcs = {}
    for state in states:
        # what a state makes of a symbol if nothing below says otherwise
        calm = "plain" if state in ("start", "plain", "harms", *striking) else state
        for symbol in ("i", "intent", "wish", "harm", "die", "be", "a", "the"):
            arcs[state, symbol] = (calm, (symbol,) if symbol in ("be", "a", "the") else ())
        for symbol in (OTHER, "of", "up", "space", "your", "noun", "insult", "term"):
            arcs[state, symbol] = (calm, (symbol,))
        for symbol in ("pause", END):
            arcs[state, symbol] = ("start", (symbol,))
        arcs[state, "i"] = ("wished" if state == "wished" else "agent", ())
        arcs[state, "they"] = ("agent", ("they",))
        arcs[state, "you"], arcs[state, "person"] = ("victim", ("you",)), ("plain", ("person",))
    # speaker or they, then an intent, then the verb
    arcs["agent", "intent"], arcs["agent", "wish"] = ("intends", ()), ("wished", ())
    arcs["agent", "harm"] = ("harms", ())
    arcs["harms", "you"] = ("victim", ("threat", "you"))
    arcs["intends", "harm"], arcs["intends", "i"] = ("strikes0", ()), ("intends", ())
    for symbol in ("you", "person"):
        arcs["intends", symbol] = ("intends", (symbol,))
    # the verb at the beginning
    arcs["start", "harm"] = (striking[-1], ())
    arcs["start", "wish"] = ("wished", ())
    for k, state in enumerate(striking):
        for symbol in TARGETS:
            arcs[state, symbol] = ("plain", ("threat", symbol))
        if k < BETWEEN:
            for symbol in (OTHER, "of"):
                arcs[state, symbol] = (striking[k + 1], (symbol,))
    # someone who shall die, or be harmed
    for symbol in ("intent", "wish"):
        arcs["victim", symbol] = ("doomed", ())
    arcs["victim", "wish"] = ("doomed", ())
    arcs["wished", "you"] = ("doomed", ("you",))
    arcs["wished", "person"] = ("doomed", ("person",))
    arcs["doomed", "die"] = ("plain", ("threat",))
    arcs["doomed", "harm"] = ("strikes0", ())
    arcs["doomed", "be"] = ("passive", ())
    arcs["passive", "harm"] = ("plain", ("threat",))
    # to hope for harm to someone
    arcs["wished", "harm"] = ("strikes0", ())
    return Transducer(arcs)


def nouns() -> Transducer:
    """A noun next to the one it is said of is an insult; forms of "be" and articles may stand between."""
    arcs: Arcs = {}
    for state in ("start", "who"):
        for symbol in TARGETS:
            arcs[state, symbol] = ("who", ("target",))
        arcs[state, "your"] = ("start", ("target",))
        for symbol in ("be", "a"):
            arcs[state, symbol] = (state, ())
        for symbol in ("the", OTHER, "of", "up", "space"):
            arcs[state, symbol] = ("start", ())
        for symbol in ("term", "insult", "threat", "negation", "report", "pause", END):
            arcs[state, symbol] = ("who" if (state, symbol) in (("who", "negation"), ("who", "insult"), ("who", "term")) else "start", (symbol,))
    arcs["start", "noun"], arcs["who", "noun"] = ("start", ("noun",)), ("start", ("insult",))
    return Transducer(arcs)


def changed(marker: str, made: str) -> Transducer:
    """From the marker to the clause's end or a pause insults and threats become ``made``."""
    arcs: Arcs = {("start", marker): (made, ()), (made, marker): (made, ()), (made, END): ("start", (END,)), (made, "pause"): ("start", ("pause",)), (made, "term"): (made, (f"insult_{made}",)), (made, "noun"): (made, ())}
    for kind in ("insult", "threat"):
        for before in (kind, f"{kind}_negated"):
            arcs[made, before] = (made, (f"{kind}_{made}",))
    return Transducer(arcs)


def aimed() -> Transducer:
    """Targets aim the bare insults and threats of their clause, before or after; each kind is written once a clause.

    A state is what the clause has: a target, and kinds written or waiting. A
    learned term that is aimed is an insult that is.
    """
    bare = ("term", "insult", "threat")
    made = {"term": "insult_aimed", "insult": "insult_aimed", "threat": "threat_aimed"}
    said = tuple(h for h in HOLDS if h.endswith(("_negated", "_reported")))
    arcs: Arcs = {}
    states, due = {"start"}, ["start"]
    while due:
        state = due.pop()
        has = frozenset() if state == "start" else frozenset(state)
        for symbol in ("target", *bare, *said, "pause", END):
            to, out = has, ()
            if symbol == END:
                waiting = [k for k in bare if k in has and "target" not in has]
                # of a term and a listed word the term speaks for both
                to, out = frozenset(), (*(k for k in waiting if not (k == "insult" and "term" in waiting)), END)
            elif symbol == "pause":
                pass
            elif symbol == "target":
                to = has | {"target"}
                out = tuple(dict.fromkeys(made[k] for k in bare if k in has)) if "target" not in has else ()
            elif symbol in bare:
                to = has | {symbol}
                out = (made[symbol],) if "target" in has and not any(k in has for k in bare if made[k] == made[symbol]) else ()
            else:
                to, out = has | {symbol}, () if symbol in has else (symbol,)
            name: State = tuple(sorted(to)) or "start"
            arcs[state, symbol] = (name, out)
            if name not in states:
                states.add(name)
                due.append(name)
    return Transducer(arcs)


def once(kind: str) -> Transducer:
    """Of a kind only the first in a text is passed on."""
    return Transducer({("start", kind): ("seen", (kind,)), ("seen", kind): ("seen", ())})


PARTS = (phrases(), threats(), nouns(), changed("negation", "negated"), changed("report", "reported"), aimed(), once("noun"))


class Weighted:
    """The composed machine with numbers for its states: each arc has its weight and what it writes."""

    def __init__(self, weights: dict[str, float]):
        self.machine, self.weights = Cascade(PARTS), weights
        self.states = {self.machine.start: 0}
        self.names = [self.machine.start]
        self.arcs: list[dict[str, tuple[int, float, tuple[int, ...]]]] = [{}]

    def _arc(self, state: int, symbol: str) -> tuple[int, float, tuple[int, ...]]:
        to, out = self.machine.step(self.names[state], symbol)
        if to not in self.states:
            self.states[to] = len(self.names)
            self.names.append(to)
            self.arcs.append({})
        held = [h for h in out if h in PRIOR]
        made = self.arcs[state][symbol] = (self.states[to], sum(self.weights.get(h, 0.0) for h in held), tuple(HOLDS.index(h) for h in held))
        return made

    def read(self, symbols: Iterable[str]) -> tuple[float, np.ndarray]:
        """The path's weight, and how many clauses hold each kind."""
        state, total, held = 0, 0.0, np.zeros(len(HOLDS))
        for symbol in symbols:
            state, weight, out = self.arcs[state].get(symbol) or self._arc(state, symbol)
            total += weight
            for h in out:
                held[h] += 1
        return total, held


@dataclass
class Lexicon:
    """Learned terms: words, and beginnings of words."""

    words: frozenset[str]
    beginnings: frozenset[str]

    def symbols(self, token: str) -> tuple[str, ...]:
        """A token's symbols: a contraction has those of its two words."""
        if token in self.words or any(token[:k] in self.beginnings for k in PREFIXES if len(token) >= k):
            return ("term",)
        head, mark, tail = token.partition("'")
        if mark and tail == "t" and head.endswith("n"):
            stem = {"wo": "will", "ca": "can", "sha": "shall"}.get(head[:-1], head[:-1])
            return (*self.symbols(stem), "negation")
        if mark and tail in ENDINGS:
            return (*self.symbols(head), *self.symbols(ENDINGS[tail]))
        if token in INSULTS:
            return ("insult",)
        return (KNOWN.get(token, OTHER if WORD.match(token) else END),)


KNOWN = {w: symbol for symbol, words in reversed(SYMBOLS.items()) for w in words}
#: Without one of these a text holds nothing.
TELLING = frozenset(("term", "insult", "noun", "harm", "die", "piece", "shut"))


class _Symbols(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[token] = self.lexicon.symbols(token)
        return value


def read(text: str, machine: Weighted, known: dict[str, tuple[str, ...]]) -> tuple[float, np.ndarray]:
    """The weight of a text's path and the kinds that its clauses hold."""
    symbols = [s for w in TOKEN.findall(text.lower().replace("’", "'")) for s in known[w]]
    if TELLING.isdisjoint(symbols):
        return 0.0, np.zeros(len(HOLDS))
    return machine.read([*symbols, END])


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the folds; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms in toxic and other documents."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if mark else other).update(terms(text or ""))
    for names in (list(toxic), [t for t in other if t not in toxic]):
        yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "toxic": pa.array([toxic[t] for t in names], pa.int64()), "other": pa.array([other[t] for t in names], pa.int64())})


def terms(text: str) -> set[str]:
    """A text's words, and their beginnings, which end in a star."""
    words = set(WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def covering(hits: list[list[int]], names: list[str], cover: int = COVER, support: int = SUPPORT) -> list[str]:
    """Terms that cover the documents (lists of their terms), greedily.

    Each time the term in most documents that still lack terms is taken; of
    equal ones the longer, as it reaches fewer other words, then the first.
    """
    of_term, need, gain = defaultdict(list), [cover] * len(hits), Counter()
    for d, found in enumerate(hits):
        for t in found:
            of_term[t].append(d)
            gain[t] += 1
    heap = [(-n, -len(names[t]), t) for t, n in gain.items()]
    heapq.heapify(heap)
    taken = []
    while heap:
        n, length, t = heapq.heappop(heap)
        if gain[t] < support:
            continue
        if -n != gain[t]:
            heapq.heappush(heap, (-gain[t], length, t))
            continue
        taken.append(names[t])
        for d in of_term[t]:
            if need[d]:
                need[d] -= 1
                if not need[d]:
                    gain.subtract(hits[d])
        gain[t] = 0
    return taken


def _learned(rows: DataFrame) -> Lexicon:
    """Terms that cover the toxic rows, the most coverage first."""
    counts = rows.mapInArrow(_terms, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # terms of at most TOXIC_ROWS texts
    nouns_begin = {n[:k] + "*" for n in SYMBOLS["noun"] for k in PREFIXES} | set(SYMBOLS["noun"])
    names = sorted(t for r in counts.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("other")))).select("term").collect() if (t := r["term"]) not in nouns_begin)
    place = {t: i for i, t in enumerate(names)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(place[t] for t in terms(text or "") if t in place) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32()))], names=["hits"])

    # at most TOXIC_ROWS rows of small arrays
    hits = [list(r["hits"]) for r in rows.where("toxic = 1").select("text").mapInArrow(incidence, "hits array<int>").collect()]
    taken = covering(hits, names)
    return Lexicon(frozenset(t for t in taken if not t.endswith("*")), frozenset(t[:-1] for t in taken if t.endswith("*")))


@dataclass
class Model:
    """A lexicon and the weights of what clauses hold (the last is the constant)."""

    lexicon: Lexicon
    weights: np.ndarray


def _newton(x: np.ndarray, y: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(prior)), x.T @ (y - p) - RIDGE * (weights - prior))
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def in_order(values: list[float], mass: list[float]) -> list[float]:
    """The nearest values (by mass) that do not fall and are not below 0: pooled neighbours."""
    pools: list[list[float]] = []
    for v, m in zip(values, mass):
        pools.append([v, m, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, m1, n1), (b, m2, n2) = pools[-2:]
            pools[-2:] = [[(a * m1 + b * m2) / (m1 + m2), m1 + m2, n1 + n2]]
    return [max(v, 0.0) for v, _, n in pools for _ in range(int(n))]


def _constant(total: np.ndarray, y: np.ndarray, constant: float) -> float:
    """The constant that goes with given sums of weights."""
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(total + constant, -30, 30)))
        constant += float(np.clip(((y - p).sum() - RIDGE * (constant - PRIOR_CONSTANT)) / ((p * (1 - p)).sum() + RIDGE), -2, 2))
    return constant


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, drawn to the stated ones and put in order, and the constant that goes with them.

    Kinds that no training row holds keep their stated odds.
    """
    prior = np.array([*PRIOR.values(), PRIOR_CONSTANT])
    weights = _newton(np.hstack([x, np.ones((len(x), 1))]), y, prior, prior)
    seen = (x > 0).sum(axis=0)
    at = HOLDS.index
    for _ in range(4):
        unseen = np.flatnonzero(seen == 0)
        weights[unseen] = np.maximum(prior[unseen] + PRIOR_CONSTANT - weights[-1], 0.0)
        for kind in ("insult", "threat"):
            places = [at(f"{kind}_{o}" if o else kind) for o in ORDER]
            weights[places] = in_order(weights[places].tolist(), [float(seen[p]) + 0.1 for p in places])
            # one bare word stays below the middle, and what is less stays below it
            top = max(-weights[-1] - BELOW, 3 * MARGIN)
            for k, p in enumerate(places[:3]):
                weights[p] = min(max(weights[p], k * MARGIN), top - (2 - k) * MARGIN)
            weights[places[3]] = max(weights[places[3]], weights[places[2]] + MARGIN, BELOW - weights[-1])
        weights[at("term")] = max(weights[at("term")], weights[at("insult")])
        weights[at("noun")] = min(max(weights[at("noun")], 0.0), PRIOR["noun"])
        weights[-1] = _constant(x @ weights[:-1], y, weights[-1])
    return weights


def _reader(model: Model, keep: tuple[str, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, machine = _Symbols(model.lexicon), Weighted(dict(zip(HOLDS, model.weights.tolist())))
        for batch in batches:
            found = [read(t or "", machine, known) for t in batch.column("text").to_pylist()]
            totals, holds = pa.array([f[0] for f in found], pa.float64()), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), totals, holds], names=[*keep, "total", "holds"])

    return count


def fitted(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Lexicon and weights from labels outside the held-out fold."""
    told = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("l_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("l_id")) != 0))
    told = durable(told.groupBy("l_id").agg(F.max("toxic").alias("toxic")))
    wanted = hash_sample(told.where("toxic = 1"), "l_id", toxic_rows).unionByName(hash_sample(told.where("toxic = 0"), "l_id", clean_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.col("text").cast("string").alias("text"))
    # at most toxic_rows + clean_rows ids, and one text of each
    rows = texts.join(F.broadcast(wanted), "l_id").groupBy("l_id", "toxic").agg(F.min("text").alias("text"))
    rows = durable(rows.dropDuplicates(["text", "toxic"]))
    prior = Model(_learned(rows), np.array([*PRIOR.values(), PRIOR_CONSTANT]))
    found = rows.select("text", "toxic").mapInArrow(_reader(prior, ("toxic",)), "toxic int, total double, holds array<double>").toPandas()
    return Model(prior.lexicon, fit_weights(np.array(found["holds"].to_list(), float).reshape(-1, len(HOLDS)), found["toxic"].to_numpy(float)))


def scored(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted and holds (clauses by kind, as in HOLDS) of every row of ``docs``."""
    model = fitted(docs, labels, **params)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_reader(model, ("doc_id", "held_out")), "doc_id long, held_out boolean, total double, holds array<double>")
    out = found.withColumn("score", 1 / (1 + F.exp(-(F.col("total") + float(model.weights[-1])))))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "holds")
