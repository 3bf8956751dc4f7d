"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?, by rank-compressed dynamic programming.

An edit string has one macro edit a turn: a run of inserts and then what becomes of the turn, such as "IK" or "D". These codes are prefix-free, so two
strings over the same turns compare as their codes do, one after the other. A layer of the program therefore holds no strings: for each
state its cost and the rank of its string among the layer's, and a pointer to the parent state with the code; the string is rebuilt at the end. Layers that differ
by a cost only are one layer, so their steps are few and remembered.

A long conversation is cut into blocks. A block's table has cost and rank for each pair of states before and after it, so blocks are
run apart, their tables are chained in order, and each block then rebuilds its part for the states it got.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialize

#: Costs of edits; an undeleted truncated turn adds TRUNCATED.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Turns and characters of a block.
BLOCK_TURNS, BLOCK_CHARS = 4096, 1 << 20
BLANK = " \t\n\x0b\x0c\r"
_LONGEST = (1 << 63) - 1
# States: what the repaired turns so far end with. Nothing, the system turn, a user turn, an assistant turn.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_INSERTED = {_NONE: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
#: Inserts that lead from a state to an accepted one.
_ENDING = {_NONE: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
# Of a turn: can't stay (blank or duplicate), is truncated; the initial of its role is the third part.
Kind = tuple[bool, bool, str]
Layer = tuple  # for each state (cost above the layer's least, rank), or None if no string leads there


@lru_cache(1 << 16)
def step(layer: Layer, kind: Kind) -> tuple[Layer, int, tuple]:
    """The layer after one more turn, the least cost added, and for each state (parent state, code)."""
    gone, cut, initial = kind
    best: list = [None] * 4

    def offer(state: int, cost: int, parent: int, code: str) -> None:
        key = (cost, layer[parent][1], code)
        if best[state] is None or key < best[state][0]:
            best[state] = (key, parent)

    for parent, held in enumerate(layer):
        if held is None:
            continue
        state = parent
        for inserts in range(3):
            cost, run = held[0] + INSERT * inserts, "I" * inserts
            offer(state, cost + DELETE, parent, run + "D")
            if not gone:
                stay = cost + TRUNCATED * cut
                if initial == "s" and state == _NONE:
                    offer(_SYSTEM, stay, parent, run + "K")
                elif initial == ("a" if state == _USER else "u"):
                    offer(_INSERTED[state], stay, parent, run + "K")
                offer(_INSERTED[state], stay + REROLE, parent, run + "R")
            state = _INSERTED[state]
    least = min(b[0][0] for b in best if b)
    ranks = {key: k for k, key in enumerate(sorted(b[0][1:] for b in best if b))}
    after = tuple(b and (b[0][0] - least, ranks[b[0][1:]]) for b in best)
    return after, least, tuple(b and (b[1], b[0][2]) for b in best)


def _begun(state: int) -> Layer:
    return tuple((0, 0) if k == state else None for k in range(4))


def table(kinds: list[Kind], begins: bool) -> tuple[list[int], list[int]]:
    """Cost and rank of a block's best string from state k // 4 to state k % 4; cost -1 if there is none. A block that begins its conversation has one first state."""
    costs, ranks = [-1] * 16, [0] * 16
    for first in (_NONE,) if begins else range(4):
        layer, total = _begun(first), 0
        for kind in kinds:
            layer, more, _ = step(layer, kind)
            total += more
        for last, held in enumerate(layer):
            if held:
                costs[4 * first + last], ranks[4 * first + last] = total + held[0], held[1]
    return costs, ranks


def chained(tables: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """The cheapest cost over a conversation's blocks, each block's first and last state, and the inserts after its last turn."""
    layer, parents = {_NONE: (0, 0)}, []
    for costs, ranks in tables:
        best = {}
        for first, (cost, rank) in layer.items():
            for last in range(4):
                if costs[4 * first + last] >= 0:
                    offer = (cost + costs[4 * first + last], rank, ranks[4 * first + last], first)
                    if last not in best or offer < best[last]:
                        best[last] = offer
        order = {key: k for k, key in enumerate(sorted(b[1:3] for b in best.values()))}
        layer = {last: (b[0], order[b[1:3]]) for last, b in best.items()}
        parents.append({last: b[3] for last, b in best.items()})
    cost, _, inserts, state = min((cost + INSERT * _ENDING[s], rank, _ENDING[s], s) for s, (cost, rank) in layer.items())
    states = []
    for parent in reversed(parents):
        states.append((parent[state], state))
        state = parent[state]
    return cost, states[::-1], inserts


def rebuilt(kinds: list[Kind], roles: list[str], texts: list[str], first: int, last: int, inserts: int) -> tuple[str, list[tuple[str, str]]]:
    """A block's edits' initials and repaired turns (role, text), from its first state to its last; inserts: those that follow."""
    layer, pointers = _begun(first), []
    for kind in kinds:
        layer, _, parents = step(layer, kind)
        pointers.append(parents)
    codes, state = [], last
    for parents in reversed(pointers):
        state, code = parents[state]
        codes.append(code)
    turns, state, name = [], first, {_USER: "user", _ASSISTANT: "assistant"}

    def put(role: str | None, text: str) -> None:
        nonlocal state
        state = _SYSTEM if role is not None and role[:1] == "s" else _INSERTED[state]
        turns.append((name[state] if role is None else role, text))

    for code, role, text in zip(reversed(codes), roles, texts, strict=True):
        for _ in range(len(code) - 1):
            put(None, "")
        if code[-1] != "D":
            put(role if code[-1] == "K" else None, text)
    for _ in range(inserts):
        put(None, "")
    return "".join(reversed(codes)) + "I" * inserts, turns


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after the damage that crc32(conv_id:turn) % 20 chooses; a null counts as one space, in the hash too.

    0 drops the row (copies 0, role and text null), 1 empties its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes its role user. Repeated
    rows are damaged alike. Other columns aren't read.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("h"))
    there = lambda c: F.when(F.col("h") != 0, c)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    return rows.select("conv_id", there(F.col("turn")).alias("turn"), there(role).alias("role"), there(text).alias("text"), copies.cast("long").alias("copies"))


_KEY = ["conv_id", "turn", "role_start", "text_start", "role", "digest"]
_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long"
_RESULT = f"conv_id long, {_TOTALS}, cost long, audit string, repaired_sha256 string"
_BLOCK = f"conv_id long, at long, begins boolean, lone boolean, costs array<long>, ranks array<int>, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, n long, kinds array<string>, roles array<string>, texts array<string>, {_TOTALS.replace(' long', '_ long').replace('gaps_', 'gaps')}, cost long, audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns of the damaged rows in order, with the flags of each. Equal rows are one with a count before they are shuffled.

    A turn is new if it is the first of its role and text: those firsts are grouped in the same way and sorted in before their
    turns, so neither a long conversation nor a text that fills it is one task's work. The range is dealt by bounded prefixes.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    left = F.rtrim("text", F.lit(BLANK))
    rows = rows.withColumns({"blank": left == "", "cut": ~F.right(left, F.lit(1)).isin(".", "!", "?"), "role_start": F.left("role", F.lit(64)), "text_start": F.left("text", F.lit(64)), "digest": F.unhex(F.sha2("text", 256))})
    first = F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn"))["turn"]
    firsts = rows.where("NOT blank").groupBy("conv_id", "role", "role_start", "text_start", "digest").agg(first.alias("turn"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(firsts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartitionByRange("conv_id", "turn", "role_start", "text_start").sortWithinPartitions(*_KEY, "kind").select(*_KEY, "kind", "text", "copies", "blank", "cut")


class _Block:
    """Turns of one conversation, as they come."""

    def __init__(self, conv_id, begins: bool):
        self.conv_id, self.begins = conv_id, begins
        self.kinds: list[Kind] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str | None, fault: str) -> None:
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        self.illegal += bool(self.roles) and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        gone = fault in ("blank", "duplicate")
        self.kinds.append((gone, fault == "truncated", role[:1] if role[:1] in ("s", "u", "a") else ""))
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.chars += len(self.texts[-1])


def _clamped(n: int) -> int:
    return min(n, _LONGEST)


def _blocks(batches: Iterator[pa.RecordBatch], turns: int, chars: int) -> Iterator[tuple[_Block, bool]]:
    """Blocks of sorted rows, and whether each is a whole conversation; the first and the last conversation may go on in other partitions."""
    block, first, marked = None, True, None
    for batch in batches:
        for conv_id, turn, role_start, text_start, role, digest, kind, text, copies, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block is None or conv_id != block.conv_id:
                if block is not None:
                    yield block, block.begins
                    first = False
                block = _Block(conv_id, begins=not first)
            if kind == 0:
                marked = (conv_id, turn, role, digest)
                continue
            if role is None:  # a conversation's dropped rows
                continue
            fault = "blank" if blank else "duplicate" if marked != (conv_id, turn, role, digest) else "truncated" if cut else ""
            marked = None
            for copy in range(copies):
                if len(block.kinds) >= turns or block.chars >= chars:
                    yield block, False
                    block = _Block(conv_id, begins=False)
                block.add(turn, role, text, "duplicate" if copy and not blank else fault)
    if block is not None:
        yield block, False


def _sha(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def _summed(blocks: list[dict]) -> dict:
    """A conversation's totals from those of its blocks, in order."""
    total = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    role = last = first = None
    for b in blocks:
        if b["n"]:
            total["illegal"] += role is not None and role[:1] + b["first_role"][:1] not in ("su", "ua", "au")
            role = b["last_role"]
        if b["first_turn"] is not None:
            total["turns"] -= last is not None and b["first_turn"] == last
            first, last = b["first_turn"] if first is None else first, b["last_turn"]
    gaps = 0 if first is None else last - first + 1 - total.pop("turns")
    return {"gaps": _clamped(gaps), **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


def repaired(rows: DataFrame, block_turns: int = BLOCK_TURNS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and the repaired turns (role, text) of every conversation of rows.

    rows: conv_id, turn, role, text, copies, as damaged() makes them; copies 0 only names its conversation. Turns are taken by turn
    (nulls first), equal ones by role, then text (by their first 64 characters, then the whole role and the text's digest). Null conv_ids are one conversation; null roles and texts
    with copies over 0 count as one space; empty tables give no row. Other columns aren't read.

    A conversation is one row however long it is, as its result is; it is sorted, repaired and rebuilt in blocks of block_turns
    turns or block_chars characters over many tasks, and only its finished pieces meet, in order. The sorted blocks are written once to the shared folder.
    """
    spark = rows.sparkSession
    told = lambda c: F.when(F.col("copies") > 0, F.coalesce(c, F.lit(" ")))
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), "copies")

    def cut(batches):
        part = TaskContext.get().partitionId() << 40
        for n, (block, whole) in enumerate(_blocks(batches, block_turns, block_chars)):
            costs, ranks = table(block.kinds, block.begins)
            row = {k: getattr(block, k) for k in ("conv_id", "begins", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")}
            row |= {"at": part + n, "lone": whole, "n": len(block.kinds), "first_role": block.roles[0] if block.roles else None, "last_role": block.roles[-1] if block.roles else None}
            if whole:
                row |= {f"{k}_" if k != "gaps" else k: v for k, v in _summed([row]).items()}
                cost, states, inserts = chained([(costs, ranks)])
                audit, turns = rebuilt(block.kinds, block.roles, block.texts, *states[0], inserts)
                row |= {"cost": cost, "audit": audit, "repaired_sha256": _sha(turns), "repaired": [{"role": r, "text": t} for r, t in turns]}
            else:
                row |= {"costs": costs, "ranks": ranks, "kinds": [f"{a:d}{b:d}{c}" for a, b, c in block.kinds], "roles": block.roles, "texts": block.texts}
            yield row

    blocks = materialize(spark, _ordered(rows).mapInArrow(_batched(cut, _BLOCK), _BLOCK), "turns")
    names = ("blank", "duplicate", "truncated", "illegal")
    done = blocks.where("lone").select("conv_id", "gaps", *[F.col(f"{k}_").alias(k) for k in names], "cost", "audit", "repaired_sha256", "repaired")

    held = ["conv_id", "at", "costs", "ranks", "first_turn", "last_turn", "turns", *names, "first_role", "last_role", "n"]

    def choose(batches):
        for group in _groups(batches, held):
            cost, states, inserts = chained([(b["costs"], b["ranks"]) for b in group])
            totals = _summed(group)
            for k, (b, (first, last)) in enumerate(zip(group, states, strict=True)):
                end = k + 1 == len(group)
                yield {"at": b["at"], "first": first, "last": last, "inserts": inserts if end else 0, **({**totals, "cost": cost} if end else {})}

    chosen = blocks.where("NOT lone").select(*held).repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_batched(choose, _CHOSEN), _CHOSEN)

    def pieces(batches):
        for batch in batches:
            for b in batch.to_pylist():
                kinds = [(k[0] == "1", k[1] == "1", k[2:]) for k in b["kinds"]]
                audit, turns = rebuilt(kinds, b["roles"], b["texts"], b["first"], b["last"], b["inserts"])
                yield {k: b[k] for k in ("conv_id", "at", "gaps", *names, "cost")} | {"audit": audit, "repaired": [{"role": r, "text": t} for r, t in turns]}

    parts = blocks.where("NOT lone").select("conv_id", "at", "kinds", "roles", "texts").join(chosen, "at").mapInArrow(_batched(pieces, _PIECE), _PIECE)

    def ended(batches):
        # The pieces of a conversation pass one after the other; what is kept of them is its result and a running hash.
        now, audit, turns, digest = None, [], [], hashlib.sha256()
        for batch in batches:
            for b in batch.to_pylist():
                if now is not None and now["conv_id"] != b["conv_id"]:
                    yield now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "repaired": turns}
                    audit, turns, digest = [], [], hashlib.sha256()
                now = b
                audit.append(b["audit"])
                for t in b["repaired"]:
                    digest.update(f"{chr(10) if turns else ''}{t['role']}:{t['text']}".encode())
                    turns.append(t)
        if now is not None:
            yield now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "repaired": turns}

    final = f"{_RESULT}, repaired array<struct<role: string, text: string>>"
    met = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_batched(ended, final), final)
    return done.unionByName(met)


_CHOSEN = f"at long, first int, last int, inserts int, {_TOTALS}, cost long"
_PIECE = f"conv_id long, at long, {_TOTALS}, cost long, audit string, repaired array<struct<role: string, text: string>>"


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """The small rows of each conversation's blocks, sorted."""
    group: list[dict] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = dict(zip(names, row, strict=True))
            if group and group[0]["conv_id"] != b["conv_id"]:
                yield group
                group = []
            group.append(b)
    if group:
        yield group


def _batched(f, ddl: str, rows: int = 64):
    """f over batches, its dictionaries as batches of few rows."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        out = []
        for row in f(batches):
            out.append(row)
            if len(out) >= rows:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return run
