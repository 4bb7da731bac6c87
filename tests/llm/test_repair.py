import hashlib
import itertools
import random

from vitrine.llm import repair

ROLES = {"S": "system", "U": "user", "A": "assistant", "O": "tool"}


def steps(state, symbol):
    """Everything that may be done next: letter, cost, state; symbol None: no row is left."""
    out = [("I", 5, 3 if state == 2 else 2)]
    if symbol is None:
        return out
    out.append(("D", 2, state))
    if symbol in repair.BLANK + repair.DUPLICATE:
        return out
    cut = 5 if symbol in repair.CUT else 0
    out.append(("R", 1 + cut, 3 if state == 2 else 2))
    role = repair._ROLE[symbol]
    if role == "S" and state == 0:
        out.append(("K", cut, 1))
    if role == "U" and state != 2:
        out.append(("K", cut, 2))
    if role == "A" and state == 2:
        out.append(("K", cut, 3))
    return out


def cheapest(symbols):
    """Least (cost, edits) by trying every way with at most two inserts in a row."""
    best = {(0, 0): (0, "")}  # place, state
    for at in range(len(symbols) + 1):
        for _ in range(3):
            for state in range(4):
                if (at, state) in best:
                    cost, audit = best[at, state]
                    for letter, more, to in steps(state, None):
                        new = (cost + more, audit + letter)
                        if new < best.get((at, to), (10**9, "")):
                            best[at, to] = new
        if at < len(symbols):
            for state in range(4):
                if (at, state) in best:
                    cost, audit = best[at, state]
                    for letter, more, to in steps(state, symbols[at])[1:]:
                        new = (cost + more, audit + letter)
                        if new < best.get((at + 1, to), (10**9, "")):
                            best[at + 1, to] = new
    return min(best[len(symbols), s] for s in (0, 3) if (len(symbols), s) in best)


def enumerated(symbols):
    """The same over all edit strings, without sharing any part."""
    found = []
    for letters in itertools.product("DKRI", repeat=len(symbols) + 2):
        for length in range(len(symbols), len(symbols) + 3):
            state, cost, at = 0, 0, 0
            for letter in letters[:length]:
                ways = {x: (c, to) for x, c, to in steps(state, symbols[at] if at < len(symbols) else None)}
                if letter not in ways:
                    break
                cost, state, at = cost + ways[letter][0], ways[letter][1], at + (letter != "I")
            else:
                if at == len(symbols) and state in (0, 3):
                    found.append((cost, "".join(letters[:length])))
    return min(found)


def test_least_edits_are_ascii_least():
    draw = random.Random(1)
    letters = "".join(repair.SYMBOLS)
    for _ in range(60):
        symbols = "".join(draw.choices(letters, k=draw.randint(1, 4)))
        assert cheapest(symbols) == enumerated(symbols), symbols


def test_rules_and_blocks_give_what_the_rows_give():
    draw = random.Random(2)
    letters = "".join(repair.SYMBOLS)
    seqs = ["".join(draw.choices("UAUAUASXE" + letters, k=draw.randint(1, 40))) for _ in range(60)]
    grammar = repair.Grammar()
    for _ in range(4):
        counts = {}
        for seq in seqs:
            for pair in repair._pairs(grammar.compress(seq)):
                counts[pair] = counts.get(pair, 0) + 1
        grammar.rules += repair._apart(sorted(counts.items(), key=lambda x: (-x[1], x[0])), 6)
    evaluate = repair.Evaluator(grammar)
    assert max(len(grammar.compress(s)) for s in seqs) < 40
    for seq in seqs:
        ways = []
        for j, (cost, rope) in enumerate(evaluate.of_block(seq)[0]):
            if rope is not None and any(repair.inserts(j, e) is not None for e in repair.ENDS):
                ways.append((cost + 5 * len(repair.ending(j)), str(rope) + repair.ending(j)))
        assert min(ways) == cheapest(seq)


def brute(rows):
    """conv_id -> gaps, blank, duplicate, truncated, illegal, cost, audit, hash, from (conv_id, turn, role, text)."""
    out, own = {}, {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for conv, turns in own.items():
        turns.sort()
        symbols, seen, counts = "", set(), [0, 0, 0]
        for _, _, role, text in turns:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0
            seen.add((role, text))
            if fault:
                counts[fault - 1] += 1
            symbols += repair.SYMBOLS["sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3][fault]
        cost, audit = cheapest(symbols)
        lines, state, at = [], 0, 0
        for letter in audit:
            state_name = "assistant" if state == 2 else "user"
            if letter == "I":
                lines.append(f"{state_name}:")
                state = 3 if state == 2 else 2
                continue
            _, _, role, text = turns[at]
            if letter != "D":
                to = {x: s for x, _, s in steps(state, symbols[at])}[letter]
                lines.append(f"{role if letter == 'K' else state_name}:{text}")
                state = to
            at += 1
        named = [t for known, t, _, _ in turns if known]
        gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
        pairs = zip(turns, turns[1:])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs)
        out[conv] = (min(gaps, 2**63 - 1), *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(found, block):
    hashes = {r["_c"]: r["sha256"] for r in repair.digests(repair.repaired(found, block)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    names = {r["_c"]: r["conv_id"] for r in found.rows.select("_c", "conv_id").distinct().collect()}
    return {
        names[r["_c"]]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                         hashes.get(r["_c"], empty))
        for r in repair.verdicts(found).collect()
    }


def test_conversations_against_a_walk(spark):
    draw = random.Random(3)
    texts = ["Yes.", "No!", "open", "", " \n", "Why?", None, "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = [
        (conv, draw.choice([None, *range(12)]), draw.choices(roles, weights=[9, 9, 2, 1, 1, 1, 1])[0], draw.choice(texts))
        for conv in [*range(40), None] for _ in range(draw.randint(1, 9))
    ]
    rows += [(100, k, "user" if k % 2 == 0 else "assistant", f"turn {k // 7}.") for k in range(700)]  # many blocks
    rows += [(101, t, "user", "Far.") for t in (-(2**63), 2**63 - 1, None)]
    rows += [(102, 1, "user", "Same.")] * 50
    table = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block int, symbol string, pos int")
    want = brute(rows)
    assert result(repair.repair(table, block=16, rules=40), 16) == want
    assert result(repair.repair(table, block=256, window_rows=20), 256) == want
    assert repair.verdicts(repair.repair(table.limit(0))).count() == 0


def test_query_counts_conversations_that_lost_all_rows(spark):
    rows = [(k, 0, "user", "Hello.") for k in range(200)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.damage_and_repair(table).collect()
    assert sorted((r["conv_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    empty = [r for r in got if r["audit"] == ""]
    assert empty and all(r["cost"] == r["gaps"] == r["illegal"] == 0 for r in empty)
    assert {r["repaired_sha256"] for r in empty} == {hashlib.sha256(b"").hexdigest()}
    assert repair.damage_and_repair(table.limit(0)).count() == 0
