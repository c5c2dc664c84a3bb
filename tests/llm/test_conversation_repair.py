"""Conversation repair against plain searches: all edit sequences of short ones, whole audits per state for longer ones."""

import hashlib
import itertools
import random
import re

import pytest

from veilframe.llm import conversation_repair as C

LEGAL = re.compile(r"(s?(ua)+)?")
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}


def every_audit(rows):
    """(cost, audit, lines) of all edit sequences with at most two insertions in a gap; rows: (initial, fault)."""
    ways = [""] + ["I", "II"]
    for gaps in itertools.product(ways, repeat=len(rows) + 1):
        for letters in itertools.product("KRD", repeat=len(rows)):
            if any(x != "D" and f in (1, 2) for x, (_, f) in zip(letters, rows)):
                continue
            audit = "".join(g + x for g, x in zip(gaps, letters)) + gaps[-1]
            choices = [("u", "a") if x in "RI" else None for x in audit]
            for free in itertools.product("ua", repeat=sum(c is not None for c in choices)):
                free, at, roles, cost = list(free), 0, "", 0
                for x in audit:
                    cost += COSTS[x]
                    if x == "I":
                        roles += free.pop(0)
                        continue
                    initial, fault = rows[at]
                    at += 1
                    cost += 3 * (x != "D" and fault == 3)
                    roles += "" if x == "D" else free.pop(0) if x == "R" else initial
                if LEGAL.fullmatch(roles):
                    yield cost, audit


def plain_repair(rows):
    """(cost, audit) by keeping the least whole audit of every state."""
    best = {"": (0, "")}

    def after(state, role):
        new = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
        return new.get(role)

    def inserted(states):
        for _ in range(2):
            grown = dict(states)
            for q, (c, a) in states.items():
                for role in "ua":
                    n = after(q, role)
                    if n is not None:
                        grown[n] = min(grown.get(n, (c + 3, a + "I")), (c + 3, a + "I"))
            states = grown
        return states

    for initial, fault in rows:
        # Insertions are tried from every state apart, so an audit that is worse now but leaves later is not lost.
        new = {}
        for q0, start in best.items():
            for q, (c, a) in inserted({q0: start}).items():
                ways = [(q, c + 4, a + "D")]
                if fault not in (1, 2):
                    ways += [(after(q, r), c + 3 + 3 * (fault == 3), a + "R") for r in "ua"] + [(after(q, initial), c + 3 * (fault == 3), a + "K")]
                for n, c2, a2 in ways:
                    if n is not None:
                        new[n] = min(new.get(n, (c2, a2)), (c2, a2))
        best = new
    ended = [w for q, start in best.items() for n, w in inserted({q: start}).items() if n in ("", "a")]
    return min(ended)


def code(initial, fault):
    return "suax".index(initial) * 4 + fault


def cost_of(rows, pieces, state):
    out, total = "".join(pieces) + C.ENDING[state], 0
    at = 0
    for x in out:
        total += COSTS[x]
        if x != "I":
            total += 3 * (x != "D" and rows[at][1] == 3)
            at += 1
    return total, out


def test_all_short_conversations():
    kinds = [(i, f) for i in "suax" for f in (0, 3)] + [("u", 1)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert cost_of(rows, *C.edits(bytes(code(*r) for r in rows))) == min(every_audit(rows)), rows


def test_longer_conversations():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 40))]
        assert cost_of(rows, *C.edits(bytes(code(*r) for r in rows))) == plain_repair(rows)


def test_segments_compose_like_turns():
    rng = random.Random(6)
    for _ in range(100):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(1, len(codes) + 1), min(len(codes), 5)) + [0, len(codes)])
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        whole = [C._segment(p) for p in parts]
        states = C.crossings([(C._four(w["costs"]), C._four(w["places"])) for w in whole], 0, C.ENDS)
        inside = [C.edits(p, a, C._only(b))[0] for p, a, b in zip(parts, [0, *states], states)]
        assert ("".join(x for i in inside for x in i), states[-1]) == ("".join(C.edits(codes)[0]), C.edits(codes)[1])


def plain_rows(rows):
    """The result by the contract's words; rows (conv, turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, facts = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        facts.append((role[:1] if role[:1] in ("s", "u", "a") else "x", 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, audit = plain_repair(facts)
    state, at, lines = "", 0, []
    for x in audit:
        wanted = "assistant" if state == "u" else "user"
        if x != "I":
            _, _, role, text = rows[at]
            at += 1
        if x == "D":
            continue
        role, text = (wanted, "") if x == "I" else (wanted, text) if x == "R" else (role, text)
        lines.append(f"{role}:{text}")
        state = role[0]
    known = [r[1] for r in rows if r[1] is not None]
    firsts = [r[2][:1] for r in rows]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(sum(f == k for _, f in facts) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "system", "tool", ""]),
                         rng.choice(["One.", "Two?", "three", "four!  ", "", " \n", "né.", "One."])))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (70, None, "user", "a"), (71, 1, "user", "word " * 50_000 + ".")]
    return rows + rows[:40]


@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_conversations_of_any_length(frame, most):
    rows = conversations()
    out = C.repair_conversations(frame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, `a.b` int"),
                                 most_turns=most, segment_bits=2)
    got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert len(got) == out.count()
    for conv in {r[0] for r in rows}:
        assert got[conv] == plain_rows([r for r in rows if r[0] == conv]), conv


def test_nulls_and_empty_tables(frame):
    out = C.repair_conversations(frame([(1, 1, None, None), (1, 2, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in out] == [(1, *plain_rows([(1, 1, " ", " "), (1, 2, "user", "Hi.")]))]
    empty = frame([], "conv_id long, turn long, role string, text string")
    assert C.repair_conversations(empty).count() == 0 and C.damaged(empty).count() == 0


def test_damage(frame):
    import zlib
    rows = [(c, t, "assistant", "A. b! c?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = C.damaged(frame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
