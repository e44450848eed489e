"""Repair of conversations by a Viterbi search whose edits are given out as survivors coalesce.

A conversation is sound when the initials of its roles read s?(ua)+ or it is empty.  Its rows
pass through four states (nothing, system, user, assistant); the cheapest way into each state
survives, ties by the text of the edits.  Survivors hang on a tree of backpointers that counts
its references: once all share an ancestor, the edits up to it are certain, their rows are
given out and forgotten.  Survivors that cannot win any more go, so memory holds the
undecided rows alone, however long the conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing kept yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one role that may be written from a state.
WRITTEN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
SOUND = (NOTHING, ASSISTANT)
#: What reaching a state may save at most over being in another: (better, worse) to the cost of
#: acting in `better` on what `worse` might do next.
REACH = {
    (ASSISTANT, SYSTEM): 0, (ASSISTANT, NOTHING): DELETE, (USER, SYSTEM): INSERT, (USER, NOTHING): INSERT + DELETE,
    (ASSISTANT, USER): INSERT, (USER, ASSISTANT): INSERT, (SYSTEM, NOTHING): 2 * INSERT + DELETE,
}
SPACE = " \t\n\x0b\x0c\r"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def moves(initial: str, delete: bool) -> list[tuple[int, int, str, int]]:
    """(from, to, edits, cost) of a row; insertions stand before the edit of the row.  Before a
    deletion they are left to the next row, which costs the same and reads less."""
    found = [(p, p, "D", DELETE) for p in range(4)]
    if delete:
        return found
    for p in range(4):
        state, edits, cost = p, "", 0
        for _ in range(3):
            if initial == "s" and state == NOTHING:
                found.append((p, SYSTEM, edits + "K", cost))
            if initial == ("a" if state == USER else "u"):
                found.append((p, WRITTEN[state], edits + "K", cost))
            found.append((p, WRITTEN[state], edits + "R", cost + REROLE))
            state, edits, cost = WRITTEN[state], edits + "I", cost + INSERT
    return found


MOVES = {(c, d): moves(c, d) for c in "sua-" for d in (False, True)}


class Node:
    """Edits of one row, the survivor before, and the live nodes that follow."""

    __slots__ = ("parent", "edits", "heirs")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.heirs = parent, edits, set()
        if parent is not None:
            parent.heirs.add(self)


def before(a: Node, more_a: str, b: Node, more_b: str) -> bool:
    """Whether the edits up to `a` and `more_a` read less than those up to `b` and `more_b`,
    from the last ancestor that both share; both have as many rows behind them."""
    parts_a, parts_b = [more_a], [more_b]
    while a is not b:
        parts_a.append(a.edits)
        parts_b.append(b.edits)
        a, b = a.parent, b.parent
    return "".join(reversed(parts_a)) < "".join(reversed(parts_b))


def _release(node: Node) -> None:
    while not node.heirs and node.parent is not None:
        node.parent.heirs.discard(node)
        node = node.parent


class Repair:
    """The search over one conversation's rows, in order."""

    def __init__(self):
        self.root = Node(None, "")
        self.survivors: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        self.pending: deque[tuple] = deque()
        self.state, self.most_pending = NOTHING, 0

    def add(self, row: tuple, initial: str, delete: bool, truncated: bool) -> Iterator[tuple]:
        """Take a row (turn, role, text); give the rows that are certain now, as `_given` has them."""
        self.pending.append(row)
        self.most_pending = max(self.most_pending, len(self.pending))
        best: dict[int, tuple[int, Node, str]] = {}
        extra = TRUNCATED if truncated and not delete else 0
        for p, q, edits, cost in MOVES[initial if initial in ("s", "u", "a") else "-", delete]:
            if p in self.survivors:
                total, node = self.survivors[p]
                total += cost + (extra if edits != "D" else 0)
                had = best.get(q)
                if had is None or total < had[0] or total == had[0] and before(node, edits, had[1], had[2]):
                    best[q] = total, node, edits
        for (better, worse), gap in REACH.items():
            if better in best and worse in best and best[better][0] + gap < best[worse][0]:
                del best[worse]
        old, self.survivors = self.survivors, {q: (total, Node(node, edits)) for q, (total, node, edits) in best.items()}
        for _, node in old.values():
            _release(node)
        while len(self.root.heirs) == 1:
            (self.root,) = self.root.heirs
            self.root.parent = None
            yield from self._given(self.root.edits)

    def end(self) -> tuple[int, Iterator[tuple]]:
        """The least cost, and the rows that were not yet certain."""
        found = None
        for p, (total, node) in self.survivors.items():
            state, edits = p, ""
            for _ in range(3):
                if state in SOUND and (found is None or total < found[0] or total == found[0] and before(node, edits, found[1], found[2])):
                    found = total, node, edits
                state, edits, total = WRITTEN[state], edits + "I", total + INSERT
        total, node, edits = found
        rest = [edits]
        while node is not self.root:
            rest.append(node.edits)
            node = node.parent
        return total, self._given("".join(reversed(rest)))

    def _given(self, edits: str) -> Iterator[tuple]:
        """(edit, turn, role, text); a deleted row has its role and text as they were."""
        for e in edits:
            if e == "I":
                self.state = WRITTEN[self.state]
                yield e, None, ROLE[self.state], ""
                continue
            turn, role, text = self.pending.popleft()
            if e == "K":
                self.state = SYSTEM if role[:1] == "s" else WRITTEN[self.state]
            elif e == "R":
                self.state = WRITTEN[self.state]
                role = ROLE[self.state]
            yield e, turn, role, text


class Talk:
    """One conversation as it passes: its counts, its repair, and the digest of the repaired rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.repair, self.digest = conv_id, Repair(), hashlib.sha256()
        self.audit: list[str] = []
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.places = 0
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, cut: bool) -> list[tuple]:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        duplicate = seen and not blank
        truncated = cut and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        return self._taken(self.repair.add((turn, role, text), role[:1], blank or duplicate, truncated))

    def _taken(self, rows: Iterable[tuple]) -> list[tuple]:
        out = []
        for edit, turn, role, text in rows:
            self.audit.append(edit)
            place = None
            if edit != "D":
                self.digest.update(f"{chr(10) if self.places else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                place, self.places = self.places, self.places + 1
            out.append((self.conv_id, place, turn, role, text, edit))
        return out

    def end(self) -> tuple[tuple, list[tuple]]:
        cost, rows = self.repair.end()
        rows = self._taken(rows)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()), rows


def _pass(summaries: bool):
    schema = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (x.split() for x in (SUMMARY if summaries else REPAIRED).split(", "))])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk: Talk | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text, blank, seen, cut in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "seen", "cut"))):
                if talk is None or conv != talk.conv_id:
                    if talk is not None:
                        summary, rows = talk.end()
                        out += [summary] if summaries else rows
                    talk = Talk(conv)
                rows = talk.add(turn, role, text, blank, seen, cut)
                out += () if summaries else rows
            yield frame(out)
        if talk is not None:
            summary, rows = talk.end()
            yield frame([summary] if summaries else rows)

    return run


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation one after another, with their faults.  One shuffle by conv_id serves the
    window that marks repeats as well; sorts spill, so no conversation is held in memory."""
    own = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]).repartition("conv_id")
    again = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    own = own.withColumn("seen", F.row_number().over(again) > 1)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    own = own.withColumns({"blank": last == "", "cut": ~last.isin(".", "!", "?")})
    return own.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "seen")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn long; role, text string): gaps, the
    faults blank, duplicate, truncated, illegal, the least cost, audit (K keep, R rerole, D
    delete, I insert; of equally cheap edits the least as text) and the digest of the repaired rows.

    Rows go by turn, nulls first, then role and text.  Null role or text: one space.  Null
    conv_id: a conversation of its own.  Empty and long texts, ties and repeated rows follow the rules of
    faults.  An empty table gives no rows; other columns are not read.
    """
    return _in_order(rows).mapInArrow(_pass(True), SUMMARY)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The edited rows: conv_id, place (in the repaired conversation; null: deleted), turn (null:
    inserted), role, text, edit.  Odd rows as in `repair`."""
    return _in_order(rows).mapInArrow(_pass(False), REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults planted by crc32 of conv_id:turn (nulls: one space) modulo 20:
    0 drops the row, 1 empties its text, 2 removes its full stops, ! and ?, 3 repeats it, 4
    makes its role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("conv_id", "turn", "role", "text")
