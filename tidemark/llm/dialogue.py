"""Repair of conversations: the cheapest edits after which roles alternate, by search from both ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from math import inf
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged

#: Rows of a conversation that are searched at once; longer conversations are cut into pieces of so many.
PIECE = 256
#: Bytes of text after which a piece ends, too.
PIECE_BYTES = 4 << 20
DELETE, CHANGE, CUT_OFF = 3, 2, 1
BLANKS = " \t\n\v\f\r"
#: What has been said: nothing, a system row, a user's or an assistant's row last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States that a conversation may end in, and the state after an inserted or changed row.
COMPLETE, NEXT = (NOTHING, ASSISTANT), (USER, USER, ASSISTANT, USER)
#: State after a kept row, by the state before it and the first letter of its role.
KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


class Item(NamedTuple):
    """A row of a conversation, or ``forced`` rows in a row that must go; ``cut`` if it breaks off."""

    role: str
    text: str
    forced: int
    cut: bool


def _forward(items: list[Item], i: int, state: int, closed: bool) -> Iterator[tuple[str, int, int, int]]:
    """Edits possible before item i: (their letters, cost, next item, next state)."""
    if i < len(items):
        item = items[i]
        if item.forced:
            yield "D" * item.forced, DELETE * item.forced, i + 1, state
        else:
            yield "D", DELETE, i + 1, state
            kept = KEEP.get((state, item.role[:1]))
            if kept is not None:
                yield "K", CUT_OFF * item.cut, i + 1, kept
            yield "R", CHANGE + CUT_OFF * item.cut, i + 1, NEXT[state]
    elif closed:
        return
    yield "I", CHANGE, i, NEXT[state]


def _backward(items: list[Item], i: int, state: int, closed: bool) -> Iterator[tuple[str, int, int, int]]:
    """Edits that lead to ``state`` before item i: (their letters, cost, item and state before them)."""
    before = [s for s in range(4) if NEXT[s] == state]
    if i < len(items) or not closed:
        for s in before:
            yield "I", CHANGE, i, s
    if i:
        item = items[i - 1]
        if item.forced:
            yield "D" * item.forced, DELETE * item.forced, i - 1, state
        else:
            yield "D", DELETE, i - 1, state
            for s in range(4):
                if KEEP.get((s, item.role[:1])) == state:
                    yield "K", CUT_OFF * item.cut, i - 1, s
            for s in before:
                yield "R", CHANGE + CUT_OFF * item.cut, i - 1, s


def cheapest(
    items: list[Item], entry: int, exits: tuple[int, ...], closed: bool = False
) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits from ``entry`` to one of ``exits``, the least letters of those.

    Dijkstra's search goes on from both ends of the lattice of (items done, state), at the end that has the
    cheaper next node. A node's first settling has its least cost and the least letters: edits
    that cost nothing lead to a later item, and among equal costs nodes come by item. Edits are known by
    their letters, so no cheapest way to a node begins with another. When the next nodes of both ends
    together cost more than the best crossing, every cheapest way has crossed at a node or edge, and
    the least of their whole letters is kept. With ``closed`` nothing is inserted after the last item.
    """
    done: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([(0, 0, "", entry)], [(0, -len(items), "", state) for state in exits])
    best = None
    while heaps[0] or heaps[1]:
        ahead, behind = (heap[0][0] if heap else inf for heap in heaps)
        if best is not None and behind > 0 and ahead + behind > best[0]:
            break
        side = int(behind < ahead)
        cost, i, letters, state = heappop(heaps[side])
        i = abs(i)
        mine, other = done[side], done[1 - side]
        if (i, state) in mine:
            continue
        mine[i, state] = cost, letters
        steps = [("", 0, i, state), *(_backward if side else _forward)(items, i, state, closed)]
        for letter, weight, j, t in steps:
            way = letter + letters if side else letters + letter
            if (j, t) in other:
                cost_on, letters_on = other[j, t]
                whole = cost + weight + cost_on, letters_on + way if side else way + letters_on
                best = whole if best is None else min(best, whole)
            if (j, t) not in mine:
                heappush(heaps[side], (cost + weight, -j if side else j, way, t))
    return best


def rewritten(items: list[Item], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave, beginning in ``state``."""
    at = iter(items)
    gone = 0
    for letter in letters:
        if gone:
            gone -= 1
            continue
        if letter == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        item = next(at)
        if letter == "D":
            gone = max(item.forced - 1, 0)
        elif letter == "K":
            state = KEEP[state, item.role[:1]]
            yield item.role, item.text
        else:
            state = NEXT[state]
            yield ROLE[state], item.text


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): conversations with faults, by the crc32 of ``conv_id:turn``.

    Of twenty values 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks,
    3 repeats it, 4 makes it the user's. Nulls in conv_id:turn, role and text are one space.
    """
    blank = F.lit(" ")
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), blank) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.filter("fault != 0").select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("times"),
    )


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_ROWS = "rows array<struct<role: string, text: string, forced: bigint, cut: boolean>>"
_ITEM = pa.struct([("role", pa.string()), ("text", pa.string()), ("forced", pa.int64()), ("cut", pa.bool_())])
_WAY = pa.struct([("entry", pa.int64()), ("leaves", pa.int64()), ("cost", pa.int64()), ("letters", pa.string())])


class _Piece:
    """Rows of a conversation as they come in order, with what is counted in them."""

    def __init__(self, conv_id, nth: int, begins: bool):
        self.conv_id, self.nth, self.begins, self.items, self.bytes = conv_id, nth, begins, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None

    def add(self, turn, role: str, text: str, times: int, is_first: bool) -> None:
        body = text.strip(BLANKS)
        cut = bool(body) and body[-1] not in ".!?"
        kept = int(bool(body) and is_first)
        if not body:
            self.blank += times
        else:
            self.duplicate += times - kept
            self.truncated += cut * kept
        if kept:
            self.items.append(Item(role, text, 0, cut))
            self.bytes += len(text)
        if times > kept:
            self.items.append(Item("", "", times - kept, False))
        letter = role[:1]
        self.illegal += times - 1
        if self.last is None:
            self.first = letter
        elif self.last + letter not in LEGAL:
            self.illegal += 1
        self.last = letter
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, part: int, whole: bool, keep_rows: bool) -> dict:
        ways, letters, digest, cost, gaps = [], None, None, None, None
        if whole:
            cost, letters = cheapest(self.items, NOTHING, COMPLETE)
            lines = (f"{role}:{text}" for role, text in rewritten(self.items, letters, NOTHING))
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        else:
            for entry in range(4):
                for leaves in range(4):
                    way = cheapest(self.items, entry, (leaves,), closed=True)
                    if way is not None:
                        ways.append((entry, leaves, *way))
        return {
            "conv_id": self.conv_id, "part": part, "nth": self.nth, "whole": whole,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "gaps": gaps, "letters": letters, "digest": digest,
            "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first": self.first, "last": self.last,
            "ways": [dict(zip(("entry", "leaves", "cost", "letters"), way, strict=True)) for way in ways],
            "rows": [item._asdict() for item in self.items] if keep_rows or not whole else [],
        }


def _arrow_type(name: str, conv_id: pa.DataType) -> pa.DataType:
    if name == "conv_id":
        return conv_id
    if name in ("letters", "digest", "first", "last"):
        return pa.string()
    return {"whole": pa.bool_(), "ways": pa.list_(_WAY), "rows": pa.list_(_ITEM)}.get(name, pa.int64())


def _table(rows: list[dict], conv_id: pa.DataType) -> pa.RecordBatch:
    names = list(rows[0])
    columns = [pa.array([row[n] for row in rows], _arrow_type(n, conv_id)) for n in names]
    return pa.record_batch(columns, names=names)


def _pieces(rows: DataFrame, conversations: DataFrame, keep_rows: bool) -> DataFrame:
    """Pieces of all conversations in the order of turns; a whole one of at most PIECE rows is solved.

    ``rows`` are counted where all of conv_id, turn, role and text are equal. Where a conversation has a role and
    text first is found by grouping; a mark goes ahead of that row. Rows, marks and one more mark for each
    conversation are dealt out by ranges and sorted, so that a long conversation lies in several ranges.
    Conversations at the ends of a range, and long ones, are given piece by piece.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    key = ["conv_id", "turn", "role", "digest"]
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    counted = counted.select(*key[:3], digest, F.lit(2).alias("kind"), "text", "times")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marks = counted.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("at"))
    marks = marks.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", F.lit(1).alias("kind"))
    present = conversations.groupBy("conv_id").agg(F.lit(0).alias("kind"))
    every = counted.unionByName(marks, True).unionByName(present, True)
    every = every.repartitionByRange(*key).sortWithinPartitions(*key, "kind")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, kind = TaskContext.get().partitionId(), -1, None
        piece, mark, edge, out = None, None, True, []
        for batch in batches:
            kind = batch.column(0).type
            for conv_id, turn, role, digest, sort, text, times in zip(
                *(column.to_pylist() for column in batch.columns), strict=True
            ):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        out.append(piece.row(part, piece.begins and not edge, keep_rows))
                        edge = False
                    nth += 1
                    piece = _Piece(conv_id, nth, True)
                if sort == 1:
                    mark = conv_id, turn, role, digest
                elif sort == 2:
                    if len(piece.items) >= PIECE or piece.bytes >= PIECE_BYTES:
                        out.append(piece.row(part, False, keep_rows))
                        nth += 1
                        piece = _Piece(conv_id, nth, False)
                    piece.add(turn, role, text, times, mark == (conv_id, turn, role, digest))
                if len(out) >= 1000 or (out and out[-1]["ways"]):
                    yield _table(out, kind)
                    out = []
        if piece is not None:
            out.append(piece.row(part, False, keep_rows))
            yield _table(out, kind)

    id_type = conversations.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {id_type}, part bigint, nth bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, cost bigint, gaps bigint, letters string, digest string, turns bigint, first_turn bigint, "
        "last_turn bigint, first string, last string, "
        f"ways array<struct<entry: bigint, leaves: bigint, cost: bigint, letters: string>>, {_ROWS}"
    )
    return every.mapInArrow(cut, schema)


def _joined(pieces: list[dict]) -> Iterator[dict]:
    """Each piece's entry state and letters on the cheapest way through all, with the counts of all.

    Goes back from the end with the cost still to come from each state. Ways of one entry never begin with
    one another, as each ends with an item, so among equal costs the letters of a piece decide.
    """
    ahead = [cheapest([], state, COMPLETE) for state in range(4)]
    tails = [letters for _, letters in ahead]
    rest = [cost for cost, _ in ahead]
    taken = []
    for piece in reversed(pieces):
        best: list = [None] * 4
        for way in piece["ways"]:
            found = way["cost"] + rest[way["leaves"]], way["letters"], way["leaves"]
            entry = way["entry"]
            best[entry] = found if best[entry] is None else min(best[entry], found)
        taken.append(best)
        rest = [inf if found is None else found[0] for found in best]
    total = {name: sum(piece[name] for piece in pieces) for name in _COUNTS[:3]}
    total["cost"] = rest[NOTHING]
    total["illegal"] = sum(piece["illegal"] for piece in pieces)
    turns, last, first_turn, last_turn = 0, None, None, None
    for piece in pieces:
        if piece["first"] is not None:
            total["illegal"] += last is not None and last + piece["first"] not in LEGAL
            last = piece["last"]
        if piece["first_turn"] is not None:
            turns += piece["turns"] - (piece["first_turn"] == last_turn)
            first_turn = piece["first_turn"] if first_turn is None else first_turn
            last_turn = piece["last_turn"]
    total["gaps"] = 0 if first_turn is None else last_turn - first_turn + 1 - turns
    state = NOTHING
    for nth, (piece, best) in enumerate(zip(pieces, reversed(taken), strict=True)):
        _, letters, leaves = best[state]
        if nth == len(pieces) - 1:
            letters += tails[leaves]
        yield {"part": piece["part"], "nth": piece["nth"], "entry": state, "letters": letters, **total}
        state = leaves


def _chosen(pieces: DataFrame) -> DataFrame:
    """The pieces that are not whole, with the way to take through each and the counts of their conversation."""
    names = ("part", "nth", "entry", "letters", *_COUNTS, "gaps")

    def choose(group: pa.Table) -> pa.Table:
        found = list(_joined(sorted(group.to_pylist(), key=lambda piece: (piece["part"], piece["nth"]))))
        return pa.table([pa.array([row[n] for row in found], _arrow_type(n, pa.null())) for n in names], names=list(names))

    torn = pieces.filter("NOT whole")
    lean = ["part", "nth", *_COUNTS[:4], "turns", "first_turn", "last_turn", "first", "last", "ways"]
    ways = (
        torn.select("conv_id", *lean).groupBy("conv_id")
        .applyInArrow(choose, ", ".join(f"{n} {'string' if n == 'letters' else 'bigint'}" for n in names))
    )
    return torn.select("conv_id", "part", "nth", "rows").join(ways, ["part", "nth"])


def repaired(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Faults of every conversation, the cheapest edits that mend it, and a digest of what they leave.

    ``conversations`` have conv_id, turn (a whole number), role and text. ``rows`` are the same rows with
    ``times``, how often each comes, and without nulls in role and text; by default those of ``conversations``,
    once each, nulls being one space. Every conv_id of ``conversations`` gets one row, null too.

    A conversation's rows come by turn, nulls first, then by role, then by the SHA-256 of the text; equal rows
    follow each other. A row's first fault counts: blank, duplicate (its role and text came before),
    truncated (its last character that is no blank is none of ``.!?``). Edits make the first letters of the
    roles s?(ua)+, or leave nothing: K keeps a row, R makes it the user's or the assistant's for 2, D deletes it
    for 3, I inserts an empty row of either for 2. Blank rows and duplicates must be deleted; a truncated
    row that stays costs 1. Of the cheapest edits the ASCII-least letters are the audit.

    Columns: conv_id, gaps (turns left out between the least and the greatest), blank, duplicate, truncated,
    illegal (neighbours whose letters are not su, ua or au), cost, audit, repaired_sha256 (of the lines
    ``role:text`` that are left). Without rows counts are 0 and texts empty. Extra columns are not read, and an
    empty table gives an empty one. A conversation is held PIECE rows at a time; only its audit, and
    the state of its digest, which has to pass all its lines in turn, are of the conversation as a whole.
    """
    pieces = staged(_pieces(_plain(conversations) if rows is None else rows, conversations, False), "pieces")
    whole = pieces.filter("whole").select(
        "conv_id", "gaps", *_COUNTS, F.col("letters").alias("audit"), F.col("digest").alias("repaired_sha256")
    )
    torn = _chosen(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    names = whole.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letters, digest, started, kind = None, [], None, False, pa.null()

        def result() -> pa.RecordBatch:
            row = {**{n: now[n] for n in names[:7]}, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.record_batch([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names=names)

        for row in chain.from_iterable(_small(batch) for batch in batches):
            kind = row.pop("type")
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield result()
                now, letters, digest, started = row, [], hashlib.sha256(), False
            letters.append(row["letters"])
            for role, text in rewritten([Item(**item) for item in row["rows"]], row["letters"], row["entry"]):
                digest.update(("\n" * started + f"{role}:{text}").encode())
                started = True
        if now is not None:
            yield result()

    return whole.unionByName(torn.mapInArrow(finish, whole.schema))


def _small(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        (row,) = batch.slice(at, 1).to_pylist()
        yield {**row, "type": batch.schema.field("conv_id").type}


def _plain(conversations: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    role, text = (F.coalesce(F.col(c), blank).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role, text, F.lit(1).cast("long").alias("times"))


def repaired_rows(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, part, nth, place, role, text): the rows that the edits of ``repaired`` leave, in that order.

    The edited conversations themselves, for the input and the cases that ``repaired`` describes.
    """
    pieces = staged(_pieces(_plain(conversations) if rows is None else rows, conversations, True), "pieces")
    ready = pieces.filter("whole").select("conv_id", "part", "nth", "rows", F.lit(NOTHING).cast("long").alias("entry"), "letters")
    every = ready.unionByName(_chosen(pieces).select(ready.columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(_small(batch) for batch in batches):
            left = list(rewritten([Item(**item) for item in row["rows"]], row["letters"], row["entry"]))
            n = len(left)
            yield pa.record_batch(
                [
                    pa.array([row["conv_id"]] * n, row["type"]), pa.array([row["part"]] * n, pa.int64()),
                    pa.array([row["nth"]] * n, pa.int64()), pa.array(range(n), pa.int64()),
                    pa.array([role for role, _ in left], pa.string()), pa.array([text for _, text in left], pa.string()),
                ],
                names=["conv_id", "part", "nth", "place", "role", "text"],
            )

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return every.mapInArrow(write, f"conv_id {kind}, part bigint, nth bigint, place bigint, role string, text string")
