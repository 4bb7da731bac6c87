"""Repair of conversation structure: the cheapest edits that give roles `(system? (user assistant)+)?`.

Every row is a symbol of its role (by its first letter) and fault. Conversations are cut into blocks of `BLOCK` symbols;
Re-Pair finds the pairs that are frequent over the different blocks and turns them into rules, level by level. Each rule
has one min-plus matrix over the four states of the role automaton (start, after system, after user, after assistant):
the least cost from state to state and a rope of the edits that reach it. Matrices are computed once, bottom-up, from the
two sides of a rule, and serve every conversation; a block is a product of the few symbols left in it.

A conversation's blocks are joined by two passes over their matrices: costs to go from the last block to the first, then
the states from the first to the last. Both passes see 16 numbers and 16 ranks a block, one block at a time. Ties go to the
ASCII-least edits. Edits of equal cost over the same rows never begin one another (the letters alone fix the cost), so the
least rope of a part is part of the least whole, and ropes of one block can be compared by rank.

Edits: K keeps a row (5 if truncated), R changes its role to user or assistant (1 more than keeping), D deletes it (2;
blank and duplicate rows must go), I inserts an empty turn (5).

Defined cases: a null conversation id is a conversation of its own; null turns come first; rows of one turn are taken by
role, then text; a null role or text counts as one space here; roles of no known letter can only be changed or deleted,
an empty role too. Conversations without rows have no result here (the query gives them zeros). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..storage import materialise

BLOCK = 256
RULES = 512  # rules of the grammar at most; they only save work
PER_ROUND = 48
ROUNDS = 16
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STATES = 4
FAR = 1 << 50  # no way
_FIRST_RULE = 0x4E00  # rules are single characters from here on; symbols are letters
# Symbol letters: row is the role's initial (s, u, a, other), column the fault (none, blank, duplicate, truncated).
SYMBOLS = ["SBCT", "UVWX", "AEFG", "OPQR"]
BLANK, DUPLICATE, CUT = ("".join(s[k] for s in SYMBOLS) for k in (1, 2, 3))
_LEGAL = {("S", "U"), ("U", "A"), ("A", "U")}
_ROLE = {symbol: symbols[0] for symbols in SYMBOLS for symbol in symbols}
_KEY = "_c"
_BLANKS = " \t\n\x0b\x0c\r"


# Ropes and matrices ----------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Rope:
    """A string as a tree of shared parts."""

    left: Rope | None = None
    right: Rope | None = None
    letters: str = ""

    def parts(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            rope = waiting.pop()
            if rope.left is None:
                yield rope.letters
            else:
                waiting += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.parts())

    def __lt__(self, other: Rope) -> bool:
        """Letter by letter; ropes compared here do not begin one another."""
        own = (c for part in self.parts() for c in part)
        theirs = (c for part in other.parts() for c in part)
        for a, b in zip(own, theirs):
            if a != b:
                return a < b
        return False


Entry = tuple[int, Rope | None]
Matrix = list[list[Entry]]


def following(state: int) -> int:
    """The state after the only role that may be inserted or given in `state`."""
    return ASSISTANT if state == USER else USER


def inserts(state: int, target: int) -> int | None:
    """How many inserted turns lead from one state to another; none may be needed."""
    steps = 0
    while state != target:
        state, steps = following(state), steps + 1
        if steps > 3:
            return None
    return steps


def after_keep(state: int, role: str) -> int | None:
    if role == "S":
        return SYSTEM if state == START else None
    if role == "U":
        return None if state == USER else USER
    return ASSISTANT if role == "A" and state == USER else None


def of_symbol(symbol: str) -> Matrix:
    """Inserts before a row, then what is done to it."""
    role, cut = _ROLE[symbol], TRUNCATED if symbol in CUT else 0
    out: Matrix = [[(FAR, None)] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for before in range(STATES):
            steps = inserts(i, before)
            if steps is None:
                continue
            ways = [(before, DELETE, "D")]
            if symbol not in BLANK + DUPLICATE:
                ways.append((following(before), REROLE + cut, "R"))
                if (kept := after_keep(before, role)) is not None:
                    ways.append((kept, cut, "K"))
            for j, cost, letter in ways:
                cost, rope = cost + INSERT * steps, Rope(letters="I" * steps + letter)
                if cost < out[i][j][0] or cost == out[i][j][0] and rope < out[i][j][1]:
                    out[i][j] = (cost, rope)
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for i in range(STATES):
        row = []
        for j in range(STATES):
            best: Entry = (FAR, None)
            for k in range(STATES):
                left, right = a[i][k], b[k][j]
                cost = left[0] + right[0]
                if cost >= FAR or cost > best[0]:
                    continue
                rope = Rope(left[1], right[1])
                if cost < best[0] or rope < best[1]:
                    best = (cost, rope)
            row.append(best)
        out.append(row)
    return out


# Grammar ---------------------------------------------------------------------------------------------------------


@dataclass
class Grammar:
    rules: list[str] = field(default_factory=list)  # the two characters of each rule, in order of creation

    def name(self, rule: int) -> str:
        return chr(_FIRST_RULE + rule)

    def compress(self, text: str) -> str:
        for k, pair in enumerate(self.rules):
            if pair in text:
                text = text.replace(pair, self.name(k))
        return text

    def matrices(self) -> dict[str, Matrix]:
        """One matrix a symbol and rule, bottom-up."""
        found = {symbol: of_symbol(symbol) for symbols in SYMBOLS for symbol in symbols}
        for k, (left, right) in enumerate(self.rules):
            found[self.name(k)] = product(found[left], found[right])
        return found


def _pairs(text: str) -> Iterator[str]:
    """Adjacent pairs; those of one repeated character do not overlap."""
    at = 0
    while at < len(text) - 1:
        yield text[at : at + 2]
        if text[at] == text[at + 1] and at + 2 < len(text) and text[at + 2] == text[at]:
            at += 1
        at += 1


def _apart(counts: list[tuple[str, int]], room: int) -> list[str]:
    """Frequent pairs that can be replaced together: no character begins one pair and ends another."""
    first, last, chosen = set(), set(), []
    for pair, _ in counts:
        a, b = pair
        if len(chosen) < room and a not in last and b not in first and (a != b or a not in first | last):
            chosen.append(pair)
            first.add(a), last.add(b)
    return chosen


def re_pair(blocks: DataFrame, rules: int = RULES) -> Grammar:
    """Rules from `blocks` (seq, times): pair counts come from all blocks, only the most frequent pairs reach the driver."""
    grammar = Grammar()
    for _ in range(ROUNDS):
        so_far = Grammar(list(grammar.rules))

        def counted(batches: Iterator[pa.RecordBatch], so_far: Grammar = so_far) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for seq, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for pair in _pairs(so_far.compress(seq)):
                        counts[pair] += times
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "times"])

        found = (
            blocks.select("seq", "times").mapInArrow(counted, "pair string, times long").groupBy("pair")
            .agg(F.sum("times").alias("times")).where("times > 1").orderBy(F.desc("times"), "pair").limit(4 * PER_ROUND)
            .collect()
        )
        room = min(PER_ROUND, rules - len(grammar.rules))
        new = _apart([(r["pair"], r["times"]) for r in found], room)
        if not new:
            break
        grammar.rules += new
    return grammar


class Evaluator:
    def __init__(self, grammar: Grammar):
        self.grammar, self.known = grammar, grammar.matrices()
        self.of_block = lru_cache(maxsize=20_000)(self._of_block)

    def _of_block(self, seq: str) -> Matrix:
        first, *others = self.grammar.compress(seq)
        out = self.known[first]
        for symbol in others:
            out = product(out, self.known[symbol])
        return out

    def summary(self, seq: str) -> tuple[list[int], list[int]]:
        """The 16 costs, and for each state the ranks of its four ropes."""
        costs, ranks = [], []
        for row in self.of_block(seq):
            costs += [cost for cost, _ in row]
            order = sorted((j for j in range(STATES) if row[j][1] is not None), key=lambda j: str(row[j][1]))
            ranks += [order.index(j) if j in order else STATES for j in range(STATES)]
        return costs, ranks


# Rows and blocks -------------------------------------------------------------------------------------------------


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def faulty_rows(rows: DataFrame, window_rows: int | None = None) -> DataFrame:
    """`rows` with the conversation's key `_c`, place `pos` (from 1) and `symbol`; written once."""
    clean = rows.select(
        "conv_id", conversation_key(F.col("conv_id")).alias(_KEY), "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    placed = materialise(
        ranked(clean, [_KEY], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "pos", window_rows), "turns")
    # The first of equal rows is an aggregate with a map-side combine, and comes back by a key that no two rows share.
    seen = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    first = placed.groupBy(_KEY, seen.alias("_seen")).agg(F.min("pos").alias("pos")).select(
        _KEY, "pos", F.lit(True).alias("_first"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(_BLANKS)), -1, 1)
    fault = (
        F.when(last == "", 2).when(F.col("_first").isNull(), 3).when(~last.isin(".", "!", "?"), 4).otherwise(1)
    )
    initial = F.substring("role", 1, 1)
    letters = F.when(initial == "s", SYMBOLS[0]).when(initial == "u", SYMBOLS[1]).when(initial == "a", SYMBOLS[2])
    symbol = F.substring(letters.otherwise(SYMBOLS[3]), fault, F.lit(1))
    return materialise(
        placed.join(first, [_KEY, "pos"], "left").select("conv_id", _KEY, "pos", "turn", "role", "text", symbol.alias("symbol")),
        "faults")


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block: its symbols in order."""
    number = F.floor((F.col("pos") - 1) / F.lit(block)).cast("long")
    inside = F.array_sort(F.collect_list(F.struct("pos", "symbol")))  # `block` elements at most
    return rows.groupBy(_KEY, number.alias("block")).agg(
        F.array_join(F.transform(inside, lambda x: x["symbol"]), "").alias("seq"))


_SUMMARY = f"{_KEY} string, block long, seq string, costs array<long>, ranks array<int>"


def summaries(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = Evaluator(grammar)
        for batch in batches:
            costs, ranks = zip(*map(evaluate.summary, batch.column(2).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(costs, pa.list_(pa.int64())),
                 pa.array(ranks, pa.list_(pa.int32()))], [_KEY, "block", "seq", "costs", "ranks"])

    return blocks.select(_KEY, "block", "seq").mapInArrow(summed, _SUMMARY)


def _at_end() -> list[int]:
    """Costs to go behind the last row: only inserts."""
    ways = [[inserts(i, end) for end in ENDS] for i in range(STATES)]
    return [min(INSERT * n for n in own if n is not None) for own in ways]


def ending(state: int) -> str:
    """The inserts behind the last row."""
    return "I" * min(n for end in ENDS if (n := inserts(state, end)) is not None)


def costs_to_go(summed: DataFrame) -> DataFrame:
    """`to_go`: what the rest of the conversation costs from each state behind a block; blocks pass from last to first."""
    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, rest = None, _at_end()
        for batch in batches:
            out = []
            for key, costs in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if key != conversation:
                    conversation, rest = key, _at_end()
                out.append(rest)
                rest = [min(costs[STATES * i + j] + rest[j] for j in range(STATES)) for i in range(STATES)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "to_go"])

    sorted_back = summed.repartition(_KEY).sortWithinPartitions(_KEY, F.desc("block"))
    return sorted_back.mapInArrow(backward, _SUMMARY + ", to_go array<long>")


_PATH = f"{_KEY} string, block long, seq string, entry int, leave int, cost long, last boolean, illegal long"


def paths(to_go: DataFrame) -> DataFrame:
    """The states before and behind each block on the cheapest way, its part of the cost, and its illegal neighbours."""
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        conversation, state, before = None, START, ""
        waiting = None
        for batch in batches:
            for row in batch.to_pylist():
                if row[_KEY] != conversation:
                    if waiting:
                        yield (*waiting, True)
                    conversation, state, before, waiting = row[_KEY], START, "", None
                if waiting:
                    yield (*waiting, False)
                at = STATES * state
                ways = [(row["costs"][at + j] + row["to_go"][j], row["ranks"][at + j], j) for j in range(STATES)]
                leave = min(ways)[2]
                roles = before + "".join(_ROLE[c] for c in row["seq"])
                illegal = sum(pair not in _LEGAL for pair in zip(roles, roles[1:]))
                waiting = (row[_KEY], row["block"], row["seq"], state, leave, row["costs"][at + leave], illegal)
                state, before = leave, roles[-1]
        if waiting:
            yield (*waiting, True)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in walk(batches):
            held.append(row)
            if len(held) == 10_000:
                yield _path_batch(held)
                held = []
        yield _path_batch(held)

    return to_go.sortWithinPartitions(_KEY, "block").mapInArrow(forward, _PATH)


def _path_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, block, seq, entry, leave, cost, illegal, last = zip(*rows) if rows else ((),) * 8
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
    names = [_KEY, "block", "seq", "entry", "leave", "cost", "last", "illegal"]
    values = [keys, block, seq, entry, leave, cost, last, illegal]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)


def audits(ways: DataFrame, grammar: Grammar) -> DataFrame:
    """`ways` with `audit`, the edits of each block, those behind the last row included, and their whole cost."""
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = Evaluator(grammar)
        for batch in batches:
            rows = batch.to_pylist()
            ends = [ending(r["leave"]) if r["last"] else "" for r in rows]
            letters = [str(evaluate.of_block(r["seq"])[r["entry"]][r["leave"]][1]) + e for r, e in zip(rows, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                 pa.array([r["cost"] + INSERT * len(e) for r, e in zip(rows, ends)], pa.int64()), batch.column(7),
                 pa.array(letters, pa.string())], [_KEY, "block", "seq", "entry", "cost", "illegal", "audit"])

    # By block, so that a long conversation is spelled by many tasks.
    schema = f"{_KEY} string, block long, seq string, entry int, cost long, illegal long, audit string"
    return ways.repartition(_KEY, "block").mapInArrow(spelled, schema)


@dataclass
class Repair:
    rows: DataFrame  # conv_id, _c, pos, turn, role, text, symbol
    blocks: DataFrame  # _c, block, seq, entry, cost, illegal, audit
    grammar: Grammar


def repair(rows: DataFrame, block: int = BLOCK, rules: int = RULES, window_rows: int | None = None) -> Repair:
    """Finds the cheapest edits of all conversations in `rows` (conv_id, turn, role, text)."""
    known = faulty_rows(rows, window_rows)
    blocks = materialise(blocks_of(known, block), "blocks")
    grammar = re_pair(materialise(blocks.groupBy("seq").agg(F.count("*").alias("times")), "different-blocks"), rules)
    ways = materialise(paths(costs_to_go(summaries(blocks, grammar))), "ways")
    return Repair(known, materialise(audits(ways, grammar), "audits"), grammar)


def edits(found: Repair, block: int = BLOCK) -> DataFrame:
    """One row for each row: the roles inserted before and behind it, and its new role (null: deleted)."""
    names = {USER: "user", ASSISTANT: "assistant"}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, before, pos = row["entry"], [], row["block"] * block
                symbols = iter(row["seq"])
                for letter in row["audit"]:
                    if letter == "I":
                        state = following(state)
                        before.append(names[state])
                        continue
                    pos, symbol = pos + 1, next(symbols)
                    if letter != "D":
                        state = following(state) if letter == "R" else after_keep(state, _ROLE[symbol])
                    out.append([row[_KEY], pos, before, [], letter, names[state] if letter == "R" else None])
                    before = []
                out[-1][3] = before
            keys, at, ahead, behind, letters, roles = zip(*out) if out else ((),) * 6
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(at, pa.int64()), pa.array(ahead, lists), pa.array(behind, lists),
                 pa.array(letters, pa.string()), pa.array(roles, pa.string())],
                [_KEY, "pos", "before", "behind", "edit", "new_role"])

    schema = f"{_KEY} string, pos long, before array<string>, behind array<string>, edit string, new_role string"
    return found.blocks.select(_KEY, "block", "seq", "entry", "audit").mapInArrow(spread, schema)


def repaired(found: Repair, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, _c, pos (of the row they come from), step (order there), role, text, edit."""
    empty = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    own = F.when(F.col("edit") != "D", F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text", "edit")))
    turns = F.concat(F.transform("before", empty), F.coalesce(own, F.array()), F.transform("behind", empty))
    joined = found.rows.select("conv_id", _KEY, "pos", "role", "text").join(edits(found, block), [_KEY, "pos"])
    return joined.select("conv_id", _KEY, "pos", F.posexplode(turns).alias("step", "_turn")).select(
        "conv_id", _KEY, "pos", "step", "_turn.role", "_turn.text", "_turn.edit")


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 over `role:text` of each conversation's turns, joined by newlines. The hash is sequential by its nature: a
    conversation passes through one task as a stream, of which only the hash state is held."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, state, out = None, None, []
        for batch in batches:
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if key != conversation:
                    if state:
                        out.append((conversation, state.hexdigest()))
                    conversation, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], [_KEY, "sha256"])
                out = []
        if state:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conversation], pa.string()), pa.array([state.hexdigest()], pa.string())], [_KEY, "sha256"])

    in_order = turns.select(_KEY, "role", "text", "pos", "step").repartition(_KEY).sortWithinPartitions(_KEY, "pos", "step")
    return in_order.mapInArrow(hashed, f"{_KEY} string, sha256 string")


def verdicts(found: Repair) -> DataFrame:
    """One row a conversation with rows: gaps, fault counts, illegal neighbours, cost, audit."""
    def times(letters: str) -> Column:
        return F.sum(F.length(F.regexp_replace("seq", f"[^{letters}]", ""))).cast("long")

    turns = found.rows.where("turn is not null").groupBy(_KEY, "turn").agg(F.lit(1).alias("_one")).groupBy(_KEY).agg(
        F.max("turn").alias("_most"), F.min("turn").alias("_least"), F.count("*").alias("_different"))
    wide = F.col("_most").cast("decimal(21,0)") - F.col("_least").cast("decimal(21,0)") + 1 - F.col("_different")
    gaps = F.least(wide, F.lit((1 << 63) - 1).cast("decimal(21,0)")).cast("long")  # more than a long holds: the largest
    # The audit of a conversation is one value of the result, so its blocks' parts meet in one row.
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    summed = found.blocks.groupBy(_KEY).agg(
        times(BLANK).alias("blank"), times(DUPLICATE).alias("duplicate"), times(CUT).alias("truncated"),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"),
    )
    return summed.join(turns.select(_KEY, gaps.alias("gaps")), _KEY, "left").select(
        _KEY, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
        "audit")


# The damage of the registered query ------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows by crc32(`conv_id:turn`) % 20: 0 drops, 1 empties, 2 takes the marks `.!?`, 3 repeats, 4 makes a user's."""
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(space["conv_id"], F.lit(":"), space["turn"])) % 20
    rows = conversations.select("conv_id", "turn", space["role"].alias("role"), space["text"].alias("text"), kind.alias("_kind"))
    rows = rows.where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The registered result: every conversation's faults after the damage, its cheapest repair and the repaired text's hash."""
    found = repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct().select("conv_id", conversation_key(F.col("conv_id")).alias(_KEY))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        ids.join(verdicts(found), _KEY, "left").join(digests(repaired(found)), _KEY, "left").select(
            "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    )


# The same by a walk over the rows that keeps the least (cost, edits) of every state.
ORACLE_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT *, list_transform(range(0, 8 * length(k)), lambda i: ((ascii(k[i // 8 + 1]) >> (i % 8)::INT) & 1)::BIGINT) AS b FROM src),
kind AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
        lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) % 20 AS d FROM bits),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS z FROM kind WHERE d <> 0),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, z) AS pos,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, z) AS seen,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
faults AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) AS i0,
        CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
             WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
ins(a, b, letters, more, lines) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
        (0, 2, 'I', 5, 'user:' || chr(10)), (1, 2, 'I', 5, 'user:' || chr(10)), (3, 2, 'I', 5, 'user:' || chr(10)),
        (2, 3, 'I', 5, 'assistant:' || chr(10)), (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
        (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10))),
act(b, e, i, letter, more) AS (VALUES (0, 0, NULL, 'D', 2), (1, 1, NULL, 'D', 2), (2, 2, NULL, 'D', 2), (3, 3, NULL, 'D', 2),
        (0, 2, NULL, 'R', 1), (1, 2, NULL, 'R', 1), (3, 2, NULL, 'R', 1), (2, 3, NULL, 'R', 1),
        (0, 1, 's', 'K', 0), (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0)),
walk AS (SELECT DISTINCT c, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM faults
    UNION ALL
    SELECT w.c, w.pos + 1, act.e, min({'cost': best.cost + ins.more + act.more
               + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END,
           'audit': best.audit || ins.letters || letter,
           'lines': best.lines || ins.lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10)
               ELSE CASE act.e WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END})
    FROM walk w JOIN faults f ON f.c = w.c AND f.pos = w.pos + 1 JOIN ins ON ins.a = w.state JOIN act ON act.b = ins.b
    WHERE (act.i IS NULL OR act.i = f.i) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
    GROUP BY w.c, w.pos, act.e),
per AS (SELECT c, any_value(conv_id) AS conv_id, max(pos) AS rows,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c),
done AS (SELECT w.c, min({'cost': best.cost + more, 'audit': best.audit || letters, 'lines': best.lines || ins.lines}) AS best
         FROM walk w JOIN per ON per.c = w.c AND per.rows = w.pos JOIN ins ON ins.a = w.state AND ins.b IN (0, 3) GROUP BY w.c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(CASE WHEN coalesce(best.lines, '') = '' THEN '' ELSE left(best.lines, length(best.lines) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done ON done.c = per.c
"""
