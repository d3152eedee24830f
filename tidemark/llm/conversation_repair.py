"""Conversation structure repair: the cheapest edits that give roles `(s?(ua)+)?`, and an audit of them.

A conversation's rows are read in order of turn (nulls first; rows of one turn by the MD5 of role and text). Before
each row, and at the end, user and assistant rows with an empty text may be inserted; each row is kept, given another
role or deleted. A dynamic program over the roles read so far keeps one cheapest edit sequence per state. Sequences
are nodes linked to their prefix, so candidates share what they have in common; a node carries binary-lifting
ancestors and a rolling hash of its letters. Of two equally cheap sequences the ASCII-least counts: a search for the
longest common prefix jumps back over ancestors with different hashes, and equal hashes are verified letter by
letter until the linked prefixes meet, so a collision cannot decide.

Scale: rows are ordered by one range-partitioned sort, which cuts a conversation of any size into pieces of bounded
rows and characters. Conversations inside one task are settled there. The others become pieces, and each piece is
solved for all four states it may be entered in: costs, audits, and the order of its audits. A conversation's pieces
are then composed by the same program, in which a letter is an audit's order, on rows without texts; the chosen
audits are applied piece by piece. What is left in one task per conversation is what its result asks for: one audit
and one SHA-256, fed piece by piece.

Nulls of any column but conv_id and turn count as one space; a null conv_id is a conversation of its own; a null turn
counts as one space where it is part of the damage key and goes first in order. Repeated rows stay and are
duplicates. A conversation without rows after damage has zeros, an empty audit and the empty string's hash. Without
rows the result is empty. Extra columns stay aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: A piece of a conversation ends at so many rows or characters.
PIECE_ROWS, PIECE_CHARS = 2048, 1 << 20
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Nothing yet, a system row, a user row, an assistant row was the last one.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
_FROM_USER = (START, SYSTEM, ASSISTANT)
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


class Edits:
    """A persistent store of sequences: a node is one letter after another node; node 0 is the empty sequence."""

    def __init__(self) -> None:
        self.letters, self.length, self.hashes, self.ancestors = [""], [0], [0], [()]

    def add(self, node: int, letter) -> int:
        up, at = [node], 0
        while at < len(self.ancestors[up[-1]]):
            up.append(self.ancestors[up[-1]][at])
            at += 1
        self.letters.append(letter)
        self.length.append(self.length[node] + 1)
        self.hashes.append((self.hashes[node] * _BASE + hash(letter) + 7) % _MODULUS)
        self.ancestors.append(tuple(up))
        return len(self.letters) - 1

    def _at_length(self, node: int, length: int) -> int:
        for step in reversed(range(len(self.ancestors[node]))):
            if step < len(self.ancestors[node]) and self.length[node] - (1 << step) >= length:
                node = self.ancestors[node][step]
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether x's letters come before y's."""
        if x == y:
            return False
        shared = min(self.length[x], self.length[y])
        a, b = self._at_length(x, shared), self._at_length(y, shared)
        if self.hashes[a] != self.hashes[b]:
            for step in reversed(range(len(self.ancestors[a]))):
                if step < len(self.ancestors[a]):
                    up, other = self.ancestors[a][step], self.ancestors[b][step]
                    if self.hashes[up] != self.hashes[other]:
                        a, b = up, other
        differ = None  # the earliest difference; equal hashes before it are verified
        while a != b:
            if self.letters[a] != self.letters[b]:
                differ = (self.letters[a], self.letters[b])
            a, b = self.ancestors[a][0], self.ancestors[b][0]
        return differ[0] < differ[1] if differ else self.length[x] < self.length[y]

    def sequence(self, node: int) -> list:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ancestors[node][0]
        return out[::-1]


Best = dict[int, tuple[int, int]]


def offer(edits: Edits, best: Best, state: int, cost: int, node: int) -> None:
    held = best.get(state)
    if held is None or cost < held[0] or cost == held[0] and edits.less(node, held[1]):
        best[state] = (cost, node)


def inserted(edits: Edits, best: Best) -> Best:
    """The states after any insertions. Inserting a whole pair leads back to the same state and never pays."""
    out = dict(best)
    for state in _FROM_USER:
        if state in best:
            cost, node = best[state]
            offer(edits, out, USER, cost + INSERT_COST, edits.add(node, INSERT))
    if USER in out:
        cost, node = out[USER]
        offer(edits, out, ASSISTANT, cost + INSERT_COST, edits.add(node, INSERT))
    return out


def kept_state(state: int, initial: str) -> int | None:
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def edited(edits: Edits, best: Best, initial: str, fault: str) -> Best:
    """The states after one more row."""
    out: Best = {}
    for state, (cost, node) in inserted(edits, best).items():
        offer(edits, out, state, cost + DELETE_COST, edits.add(node, DELETE))
        if fault in ("blank", "duplicate"):
            continue
        extra = TRUNCATED_COST if fault == "truncated" else 0
        after = kept_state(state, initial)
        if after is not None:
            offer(edits, out, after, cost + extra, edits.add(node, KEEP))
        offer(edits, out, ASSISTANT if state == USER else USER, cost + extra + REROLE_COST, edits.add(node, REROLE))
    return out


def finished(edits: Edits, best: Best) -> tuple[int, int]:
    """(cost, node) of the cheapest complete sequence."""
    ends: Best = {}
    for state, (cost, node) in inserted(edits, best).items():
        if state in (START, ASSISTANT):
            offer(edits, ends, START, cost, node)
    return ends[START]


def applied(audit: Iterable[str], rows: list[tuple[str, str]], state: int = START) -> list[dict]:
    """The rows after the edits, entered in a state."""
    out, left = [], iter(rows)
    for letter in audit:
        given = "assistant" if state == USER else "user"
        if letter == INSERT:
            role, text = given, ""
        else:
            role, text = next(left)
            if letter == DELETE:
                continue
            if letter == REROLE:
                role = given
        out.append({"role": role, "text": text})
        state = kept_state(state, role[:1])
    return out


def fault_of(role: str, text: str, seen: bool) -> str:
    visible = _VISIBLE.findall(text)[-1:]
    if not visible:
        return "blank"
    return "duplicate" if seen else "" if visible[0] in ".!?" else "truncated"


def digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: Ids and turns travel as text: pandas would make floating-point numbers of a column with nulls.
LINES = "array<struct<role:string,text:string>>"
ROWS = "array<struct<turn:string,role:string,text:string>>"
RESULT = "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS) + f", audit string, repaired {LINES}"
DIGEST = "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def settle(conv_id, rows: list[tuple]) -> tuple:
    """The result row of a conversation whose (turn, role, text) rows are all at hand."""
    seen, faults = set(), []
    edits = Edits()
    best: Best = {START: (0, 0)}
    for _, role, text in rows:
        mark = digest(role, text)
        fault = fault_of(role, text, mark in seen)
        seen.add(mark)
        faults.append(fault)
        best = edited(edits, best, role[:1], fault)
    cost, node = finished(edits, best)
    audit = edits.sequence(node)
    turns = {int(t) for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal_pairs([r[:1] for _, r, _ in rows]), cost, "".join(audit),
            applied(audit, [(r, t) for _, r, t in rows]))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the stated damage: rows dropped, emptied, cut, repeated, given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("_damage"))
    text = F.when(F.col("_damage") == 1, "").when(F.col("_damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("_damage <> 0").withColumns({
        "text": text, "role": F.when(F.col("_damage") == 4, "user").otherwise(F.col("role")),
        "_copy": F.explode(F.when(F.col("_damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))}).select(
        "conv_id", "turn", "role", "text")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted over all partitions; a conversation may go on in the next partition."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_mark")]
    marked = rows.withColumns({"_mark": F.md5(F.concat_ws("\x1f", "role", "text")), "_tie": F.monotonically_increasing_id()})
    return marked.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text")


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv_id, rows, whether they start and end the conversation within this task); an empty one at the end."""
    at, held, size, starts, first = None, [], 0, True, True
    for frame in frames:
        for conv_id, turn, role, text in zip(frame["conv_id"], frame["turn"], frame["role"], frame["text"]):
            if first:
                at, first = conv_id, False
            if conv_id != at or len(held) >= PIECE_ROWS or size >= PIECE_CHARS:
                yield at, held, starts, conv_id != at
                starts, at, held, size = conv_id != at, conv_id, [], 0
            held.append((turn, role, text))
            size += len(text) + len(role)
    if held:
        yield at, held, starts, True


def _settled_or_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result rows, and pieces of conversations that are long or may go on in another task."""
    part, number, first, last, out = TaskContext.get().partitionId(), 0, None, None, []
    names = names_of(RESULT)

    def frame(found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["part", "piece", "rows", *names]).astype(
            {c: "Int64" for c in ("part", "piece", *COUNTS)})

    def as_piece(piece: tuple) -> tuple:
        nonlocal number
        number += 1
        rows = [{"turn": t, "role": r, "text": x} for t, r, x in piece[1]]
        return (part, number, rows, piece[0], *[None] * (len(names) - 1))

    previous = None
    for piece in _pieces(frames):
        if previous is not None:
            conv_id, rows, starts, ends = previous
            inner = number > 0 and starts and ends  # the task's first conversation may have begun before it
            out.append((None, None, None, *settle(conv_id, rows)) if inner else as_piece(previous))
        previous = piece
        if len(out) >= 256:
            yield frame(out)
            out = []
    if previous is not None:
        out.append(as_piece(previous))
    if out:
        yield frame(out)


SUMMARY = ("conv_id string, part long, piece long, first_initial string, last_initial string, first_turn string, last_turn string, "
           "turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, ranks array<int>, "
           "audits array<string>")


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece solved for every state it may be entered in: 4 x 4 costs, audits, and the audits' order by entry."""
    for frame in frames:
        out = []
        for conv_id, part, piece, rows, repeated in zip(
                *[frame[c] for c in ("conv_id", "part", "piece", "rows", "repeated")]):
            again = set(repeated) if repeated is not None else set()
            faults = [fault_of(r["role"], r["text"], i in again) for i, r in enumerate(rows)]
            initials = [r["role"][:1] for r in rows]
            costs, ranks, audits = [], [], []
            for entry in STATES:
                edits = Edits()
                best: Best = {entry: (0, 0)}
                for initial, fault in zip(initials, faults):
                    best = edited(edits, best, initial, fault)
                found = {s: "".join(edits.sequence(node)) for s, (_, node) in best.items()}
                order = sorted(found.values())
                costs += [best[s][0] if s in best else None for s in STATES]
                ranks += [order.index(found[s]) if s in found else None for s in STATES]
                audits += [found.get(s) for s in STATES]
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            out.append((conv_id, part, piece, initials[0], initials[-1], turns[0] if turns else None,
                        turns[-1] if turns else None, len(set(turns)), faults.count("blank"), faults.count("duplicate"),
                        faults.count("truncated"), illegal_pairs(initials), costs, ranks, audits))
        yield pd.DataFrame(out, columns=names_of(SUMMARY))


CHOICE = ("conv_id string, part long, piece long, choice int, tail string, gaps long, blank long, duplicate long, truncated long, "
          "illegal long, cost long")


def _by_conversation(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows of frames sorted by conv_id, with whether a conversation starts; a None at the very end."""
    at, any_row = None, False
    for frame in frames:
        for row in zip(*[frame[c] for c in columns]):
            yield row, not any_row or row[0] != at
            at, any_row = row[0], True
    yield None, True


def _composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece of a conversation, which of its 16 audits the cheapest whole sequence takes.

    The same program over pieces: a piece's letter is its audit's order among those of one entry state. Equal
    prefixes of letters mean equal audits and so one entry state, and no audit of a piece is a prefix of another.
    """
    columns = names_of(SUMMARY)[:-1]
    edits, best, ids, entered, totals = Edits(), {}, [], [0], None
    for row, new in _by_conversation(frames, columns):
        if new and ids:
            ends: Best = {}
            closing = Edits()
            for state, (cost, node) in best.items():
                for end, (extra, last) in inserted(closing, {state: (0, 0)}).items():
                    if end in (START, ASSISTANT):
                        # Insertions come last, and only sequences with the same pieces would be told apart by them.
                        held = ends.get(0)
                        if held is None or cost + extra < held[0] or cost + extra == held[0] and edits.less(node, held[1]):
                            ends[0] = (cost + extra, node)
                            tail = "".join(closing.sequence(last))
            cost, node = ends[0]
            choices = []
            while node:
                choices.append(entered[node])
                node = edits.ancestors[node][0]
            low, high, turns, *counts = totals
            gaps = 0 if low is None else high - low + 1 - turns
            found = [(*i, c, None, *[None] * 6) for i, c in zip(ids, choices[::-1])]
            found[-1] = (*ids[-1], choices[0], tail, gaps, *counts, cost)
            frame = pd.DataFrame(found, columns=names_of(CHOICE))
            yield frame.astype({c: "Int64" for c in COUNTS})
        if row is None:
            return
        (conv_id, part, piece, first_initial, last_initial, first_turn, last_turn, turns, blank, duplicate, truncated,
         illegal, costs, ranks) = row
        known = isinstance(first_turn, str)
        if new:
            edits, best, ids, entered, totals = Edits(), {START: (0, 0)}, [], [0], [None, None, 0, 0, 0, 0, 0]
        else:
            totals[6] += last_one + first_initial not in ("su", "ua", "au")
        last_one = last_initial
        if known:
            shared = totals[1] is not None and totals[1] == int(first_turn)
            totals[0] = int(first_turn) if totals[0] is None else totals[0]
            totals[1] = int(last_turn)
            totals[2] += int(turns) - shared
        totals[3:7] = [totals[3] + blank, totals[4] + duplicate, totals[5] + truncated, totals[6] + illegal]
        ids.append((conv_id, part, piece))
        after: Best = {}
        for entry, (cost, node) in best.items():
            for state in STATES:
                extra = costs[4 * entry + state]
                if extra is not None and not pd.isna(extra):
                    added = edits.add(node, int(ranks[4 * entry + state]))
                    entered.append(4 * entry + state)
                    offer(edits, after, state, cost + int(extra), added)
        best = after


def _pieces_applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        lines = [applied(audit, [(r["role"], r["text"]) for r in rows], choice // 4) + (
            applied(tail, [], choice % 4) if isinstance(tail, str) else [])
            for audit, rows, choice, tail in zip(*[frame[c] for c in ("audit", "rows", "choice", "tail")])]
        out = frame.drop(columns=["rows", "choice"])
        out["repaired"] = lines
        yield out


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv_id", "audit", "repaired", "tail", *COUNTS]
    audit, some, running, last = [], False, hashlib.sha256(), None
    for row, new in _by_conversation(frames, columns):
        if new and last is not None:
            yield pd.DataFrame([(last[0], *last[4:], "".join(audit) + last[3], running.hexdigest())], columns=names_of(
                DIGEST)).astype({c: "Int64" for c in COUNTS})
            audit, some, running = [], False, hashlib.sha256()
        if row is None:
            return
        audit.append(row[1])
        for line in row[2]:
            running.update((("\n" if some else "") + f"{line['role']}:{line['text']}").encode())
            some = True
        last = row


def _seen_before(pieces: DataFrame) -> DataFrame:
    """(part, piece, repeated): places within a piece whose role and text stand earlier in the conversation."""
    place = F.struct("part", "piece", "at")
    rows = pieces.select("conv_id", "part", "piece", F.posexplode("rows").alias("at", "row")).select(
        "conv_id", "part", "piece", "at",
        F.md5(F.concat(F.length("row.role").cast("string"), F.lit(":"), "row.role", "row.text")).alias("mark"))
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark")).agg(F.min(place).alias("first"))
    return rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark"))).where(
        place > F.col("first")).groupBy("part", "piece").agg(F.collect_list("at").alias("repeated"))


PIECE = ["conv_id", "part", "piece", "tail", *COUNTS, "audit", "repaired"]


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired (conv_id, turn, role, text) rows, in order, as (conv_id, part, piece, audit, `repaired` role and text).

    A conversation settled at once is one row without part and piece. Of a longer one each piece is a row, in order
    of part and piece; faults and cost are on its last row, whose `tail` are the insertions after its last turn.
    """
    found = written(in_order(conversations).mapInPandas(
        _settled_or_pieces, f"part long, piece long, rows {ROWS}, {RESULT}"))
    settled = found.where("rows IS NULL").withColumn("tail", F.lit("")).select(*PIECE)
    pieces = found.where("rows IS NOT NULL").select("conv_id", "part", "piece", "rows")
    solved = written(pieces.join(_seen_before(pieces), ["part", "piece"], "left").mapInPandas(_summaries, SUMMARY))
    chosen = solved.drop("audits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInPandas(
        _composed, CHOICE)
    audits = chosen.join(solved.select("part", "piece", "audits"), ["part", "piece"]).withColumn(
        "audit", F.get("audits", F.col("choice"))).drop("audits")
    repaired = audits.join(pieces.drop("conv_id"), ["part", "piece"]).mapInPandas(
        _pieces_applied, f"conv_id string, part long, piece long, tail string, {', '.join(f'{c} long' for c in COUNTS)}, "
                         f"audit string, repaired {LINES}")
    return settled.unionByName(repaired.select(*PIECE))


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: faults, cost, the whole audit and the SHA-256 of its `role:text` lines."""
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    single = repaired.where("part IS NULL").withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n"), 256))
    longer = repaired.where("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    both = single.select(*names_of(DIGEST)).unionByName(longer.mapInPandas(_hashed, DIGEST))
    return both.withColumn("conv_id", F.col("conv_id").cast("long"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = digests(repair(damaged(conversations))).withColumnRenamed("conv_id", "_conv")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
