"""Repaired conversations against a dynamic programme over whole conversations."""

import hashlib
import random
import re

import pytest

from faultline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place long, row long"
KEPT = {"": "su", "s": "u", "u": "a", "a": "u"}
NEW = {"": "user", "s": "user", "u": "assistant", "a": "user"}
SPACE = " \t\n\x0b\x0c\r"


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(turns):
    """(cost, audit, turns) by a table of states, inserts relaxed between turns."""

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, kept) in list(best.items()):
                role = NEW[state]
                new = (cost + 5, audit + "I", [*kept, (role, "")])
                if role[0] not in best or new < best[role[0]]:
                    best[role[0]] = new
        return best

    best = inserts({"": (0, "", [])})
    for (role, text), fault in zip(turns, faults(turns), strict=True):
        after = {}
        for state, (cost, audit, kept) in best.items():
            options = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault else 0
                if role[:1] and role[:1] in KEPT[state]:
                    options.append((role[0], stays, "K", [(role, text)]))
                options.append((NEW[state][0], stays + 1, "R", [(NEW[state], text)]))
            for to, more, letter, row in options:
                new = (cost + more, audit + letter, [*kept, *row])
                if to not in after or new < after[to]:
                    after[to] = new
        best = inserts(after)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    """conv_id to the row of the contract; rows in order of their turns."""
    talks, out = {}, {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in talks.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest()))
        turns, at = [x[1:] for x in own], [x[0] for x in own if x[0] is not None]
        found, initials = faults(turns), [r[:1] for r, _ in turns]
        cost, audit, kept = brute_edits(turns)
        whole = "\n".join(f"{r}:{t}" for r, t in kept)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
        out[conv] = (
            max(at) - min(at) + 1 - len(set(at)) if at else 0,
            *(found.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(whole.encode()).hexdigest(),
        )
    return out


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)
    found, repaired = repair.repair_conversations(frame)
    digests = {r.conv_id: r.sha256 for r in repair.conversation_digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, empty))
        for r in found.collect()
    }


def talk(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux", "a"]
    texts = ["One.", "Two!", "Three? \n", "cut off", "", " \t", None, "é. ", "Four.", "Five.\x0b"]
    long = [f"{k} said." for k in range(200)]
    rows = []
    for k in range(n):
        role = ("user", "assistant")[k % 2] if rng.random() < 0.6 else rng.choice(roles)
        text = rng.choice(long) if rng.random() < 0.5 else rng.choice(texts)
        rows.append((conv, None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 1, 9]), role, text))
    return rows


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = [r for conv in range(300) for r in talk(rng, conv, rng.randrange(1, 14))]
    rows += talk(rng, None, 9) + [(900, None, None, None)] * 3 + [(901, 4, "user", "word. " * 100000)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [3, 64])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "FAN_IN", 3)
    rng = random.Random(chunk)
    rows = [r for conv, n in enumerate([1, 2, 30, 64, 65, 129, 700]) for r in talk(rng, conv, n)]
    assert got(spark, rows) == brute(rows)


def test_cheapest_between_states():
    """Searches of a chunk against all edit sequences up to a length."""
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(4)
        codes = "".join(rng.choice("suua-") + rng.choice("....btd") for _ in range(n))
        every = {}

        def walk(i, state, cost, audit):
            if i == n:
                every[state] = min(every.get(state, (99, "")), (cost, audit))
            if audit.count("I") < 2:
                walk(i, repair.SPOKEN[state], cost + 5, audit + "I")
            if i < n:
                walk(i + 1, state, cost + 2, audit + "D")
                if codes[2 * i + 1] in ".t":
                    stays = 5 * (codes[2 * i + 1] == "t")
                    if (state, codes[2 * i]) in repair.KEPT:
                        walk(i + 1, repair.KEPT[state, codes[2 * i]], cost + stays, audit + "K")
                    walk(i + 1, repair.SPOKEN[state], cost + stays + 1, audit + "R")

        for entry in range(4):
            every.clear()
            walk(0, entry, 0, "")
            for goal in range(4):
                found = repair.cheapest(codes, entry, goal)
                assert (found and (found[0], found[1].translate(repair.ASCII))) == every.get(goal)


def test_empty_table(spark):
    assert got(spark, []) == {}
