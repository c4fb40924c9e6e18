"""Conversation repair against a brute-force search over edits, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sluice.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, conv string, place int"


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        for _ in range(0 if harm == 0 else 2 if harm == 3 else 1):
            yield conv, turn, role, text


def cheapest(rows):
    """(cost, audit, lines) by relaxing (cost, audit) over rows and states "", "s", "u", "a", inserting until nothing changes."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def relax(found):
        changed = True
        while changed:
            changed = False
            for q, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    into = follow.get((q, role[0]))
                    if into and (into not in found or (cost + 5, audit + "I") < found[into][:2]):
                        found[into] = (cost + 5, audit + "I", (*lines, role + ":"))
                        changed = True
        return found

    for role, text, fault in rows:
        best, after = relax(best), {}
        for q, (cost, audit, lines) in best.items():
            offers = [(q, cost + 2, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (into := follow.get((q, role[:1]))):
                    offers.append((into, cost + more, "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (into := follow.get((q, name[0]))):
                        offers.append((into, cost + 1 + more, "R", (*lines, f"{name}:{text}")))
            for into, c, letter, made in offers:
                if into not in after or (c, audit + letter) < after[into][:2]:
                    after[into] = (c, audit + letter, made)
        best = after
    return min((v for q, v in relax(best).items() if q in ("", "a")), key=lambda v: v[:2])


def brute(rows):
    every, by = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in hurt(rows):
        by[conv].append((turn, role, text))
    for conv in every:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults, told = set(), [], []
        for turn, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            told.append((role, text, faults[-1]))
        cost, audit, lines = cheapest(told)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        yield conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(rng, n, longest=14):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("system" if turn == 0 and rng.random() < 0.5 else ("user", "assistant")[turn % 2])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "Why?", "é ok", "cut", " \t", f"t{rng.randrange(50)}.", f"t{rng.randrange(9)}. \n"])))
    return rows


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def compared(spark, rows, bits):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in dialogue.judged(table, bits).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("bits", [0, 2, 10])
def test_equals_brute_force(spark, bits):
    compared(spark, conversations(random.Random(bits), 60), bits)


def test_edge_cases(spark):
    rows = [(None, None, None, None), (None, 3, "user", None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 0, None, "x."), (1, 2, "", "y!"), (2, 5, "other", "é" * 50_000), (2, 5, "assistant", "ok."), (2, 5, "assistant", "ok."), (3, -4, "unknown", "Fine."), (3, 9, "agent", "Done."), (4, 0, "system", "Only.")]
    lost = [(c, 0, "user", "gone.") for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost
    compared(spark, rows + lost, 10)
    compared(spark, rows, 1)


def test_one_long_conversation(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{t}.", f"{t % 40}!"])) for t in range(3000)]
    compared(spark, rows, 5)


def test_empty_table(spark):
    assert dialogue.judged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_alternate(spark):
    rows = conversations(random.Random(9), 40)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    by = defaultdict(list)
    for r in dialogue.repaired(table).collect():
        by[r["conv_id"]].append((r["at"], r["role"]))
    for found in by.values():
        assert [a for a, _ in sorted(found)] == list(range(len(found)))
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, role in sorted(found)))
