"""Cheapest repair of conversations by square-root checkpointed dynamic
programming.

A conversation's turns are kept, given another role, deleted, or new ones are
inserted between them, so that the roles read ``(s?(ua)+)?`` by their initials
at the least cost.  The roles written so far matter by one of four states
(nothing, s, u, a), so the cost of the best way from a place to the end is a
vector of four numbers.

* Turns of a conversation are in order within one sorted partition and pass
  through the task as a stream.  A stretch of turns is held at a time; the cost
  vectors within it are computed backward from the vector behind it, then the
  walk goes forward through it and writes the ASCII-least of the cheapest edits.
* A conversation of up to ``BLOCK_BYTES`` is one stretch, and behind it is the
  end.  Of a longer one, an earlier pass stores the vectors behind its
  stretches only: checkpoints.  A stretch then has about the square root of the
  conversation's size, so stretches and checkpoints weigh the same, and a task
  never holds more than that, however long the conversation is.
* The checkpoints themselves are computed in parallel: each stretch is reduced
  to its 4 x 4 matrix of costs from state to state (without texts), and the
  matrices of a conversation are multiplied (min, +) from its end.

The digest of a repaired conversation is one SHA-256 over its text, which has
to read it in order: one stream, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesight.llm.common import staged

BLOCK_BYTES = 1 << 22     # bytes of texts of a stretch, and of a conversation without checkpoints
TURN_BYTES = 1024         # what a turn counts beside its text

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs
SPACES = " \t\n\x0b\x0c\r"

#: states: 0 nothing written, 1 after s, 2 after u, 3 after a.  FOLLOWS: the state
#: after a turn of class s, u, a or other, FILL: after the user or assistant turn that fits
FOLLOWS = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
FILL = (2, 2, 3, 2)
NEVER = 1 << 60
END = (0, INSERT * 2, INSERT, 0)     # cost behind the last turn, by state

Costs = tuple[int, int, int, int]


def _before(kind: int, after: Costs) -> Costs:
    """Costs before a turn, insertions in front of it included."""
    role, status = kind % 4, kind // 4
    out = []
    for s in range(4):
        best = after[s] + DELETE
        if status < 2:
            extra = TRUNCATED * status
            best = min(best, after[FILL[s]] + REROLE + extra)
            if FOLLOWS[s][role] is not None:
                best = min(best, after[FOLLOWS[s][role]] + KEEP + extra)
        out.append(best)
    for s in (2, 3, 2, 1, 0):
        out[s] = min(out[s], out[FILL[s]] + INSERT)
    return tuple(out)


def _backward(kinds: list[int], end: Costs) -> list[Costs]:
    """Costs before each turn of a stretch, and behind the last."""
    out = [end]
    for kind in reversed(kinds):
        out.append(_before(kind, out[-1]))
    return out[::-1]


def _walk(kinds: list[int], costs: list[Costs], state: int, last: bool) -> Iterator[tuple[str, int | None, int]]:
    """(edit, place of the turn or None, state afterwards) of the ASCII-least
    cheapest edits: of two equally cheap ones D goes before I, K and R."""
    for i, kind in enumerate(kinds):
        role, status = kind % 4, kind // 4
        extra, after = TRUNCATED * (status == 1), costs[i + 1]
        while True:
            cost = costs[i][state]
            if cost == after[state] + DELETE:
                yield "D", i, state
                break
            if cost == costs[i][FILL[state]] + INSERT:
                state = FILL[state]
                yield "I", None, state
                continue
            if status < 2 and FOLLOWS[state][role] is not None and cost == after[FOLLOWS[state][role]] + KEEP + extra:
                state = FOLLOWS[state][role]
                yield "K", i, state
                break
            state = FILL[state]
            yield "R", i, state
            break
    while last and costs[-1][state]:
        state = FILL[state]
        yield "I", None, state


ROLE_OF = {2: "user", 3: "assistant"}


def _no_space(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kind, weight) with nulls of role and text as
    one space.  kind: class of the role (s, u, a, other) plus 4 if truncated, or
    8 if the turn has to go (blank, or said before: see ``_ordered``)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = _no_space(F.col("text"))
    status = F.when(bare == "", 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("kind", (cls + 4 * status).cast("int")).withColumn("weight", F.octet_length("text").cast("long") + TURN_BYTES)


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` in one partition for each conversation, with ``again``: the role
    and text were seen earlier.  Order: turn (nulls first), role, text."""
    said = Window.partitionBy("conv_id", "said").orderBy(F.col("turn").asc_nulls_first())
    key = F.struct(F.xxhash64("role", "text"), F.xxhash64(F.lit(1), "role", "text"))
    dealt = rows.withColumn("said", key).repartition("conv_id")
    return dealt.withColumn("again", F.row_number().over(said) > 1).drop("said")


def checkpoints(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """(conv_id, stretch, costs, size): cost vectors behind the stretches of the
    conversations longer than ``block_bytes``; None if there are none.  Stretch:
    bytes of earlier turns // size."""
    slim = rows.select("conv_id", "turn", "role", "text", "kind", "weight")
    size = F.greatest(F.lit(block_bytes), F.ceil(F.sqrt(F.sum("weight").cast("double") * TURN_BYTES))).cast("long")
    sizes = slim.groupBy("conv_id").agg(F.sum("weight").alias("total"), size.alias("size"))
    sizes = staged(sizes.where(F.col("total") > block_bytes).select(F.col("conv_id").alias("long_id"), "size"), "long")
    if sizes.isEmpty():
        return None
    of_long = slim.join(sizes, F.col("conv_id").eqNullSafe(F.col("long_id")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    so_far = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = Window.partitionBy("conv_id").orderBy(*order)
    kind = F.when(F.col("again"), F.col("kind") % 4 + 8).otherwise(F.col("kind"))
    placed = _ordered(of_long).select("conv_id", "size", kind.cast("int").alias("kind"), F.coalesce(F.sum("weight").over(so_far), F.lit(0)).alias("before"), F.row_number().over(place).alias("place"))
    stretch = F.floor(F.col("before") / F.col("size")).cast("long")
    placed = placed.select("conv_id", "size", stretch.alias("stretch"), "place", "kind")

    def matrix(table: pa.Table) -> pa.Table:
        kinds = table.sort_by("place").column("kind").to_pylist()
        ends = [tuple(0 if s == t else NEVER for s in range(4)) for t in range(4)]
        cells = [c for end in ends for c in _backward(kinds, end)[0]]      # column by column
        return pa.table({"conv_id": table.column("conv_id")[:1], "size": table.column("size")[:1], "stretch": table.column("stretch")[:1], "cells": pa.array([cells], pa.list_(pa.int64()))})

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("stretch", "descending")])
        costs, out = END, []
        for cells in table.column("cells").to_pylist():
            out.append(list(costs))
            costs = tuple(min(cells[4 * t + s] + costs[t] for t in range(4)) for s in range(4))
        return table.drop_columns(["cells"]).append_column("costs", pa.array(out, pa.list_(pa.int64())))
    conv = rows.schema["conv_id"].dataType.simpleString()
    by_stretch = placed.groupBy("conv_id", "stretch").applyInArrow(matrix, f"conv_id {conv}, size long, stretch long, cells array<long>")
    behind = by_stretch.groupBy("conv_id").applyInArrow(chain, f"conv_id {conv}, size long, stretch long, costs array<long>")
    return staged(behind, "checkpoints")


class _Conversation:
    """Edits and counts of one conversation, its turns given one after another."""

    def __init__(self, conv_id, marks: list[tuple[int, list[int], int]], edits: bool):
        self.conv_id, self.edits = conv_id, [] if edits else None
        self.behind = {stretch: tuple(costs) for stretch, costs, _ in marks}
        self.size = marks[0][2] if marks else None
        self.held, self.bytes, self.stretch, self.state, self.cost = [], 0, 0, 0, None
        self.audit, self.hash, self.written = [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def take(self, turn, role, text, kind, weight, again) -> None:
        status = kind // 4
        if again and status < 2:
            self.duplicate += 1
            kind = kind % 4 + 8
        elif status:
            self.blank += status == 2
            self.truncated += status == 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.size is not None and self.bytes // self.size != self.stretch:
            self._solve(False)
            self.stretch = self.bytes // self.size
        self.held.append((turn, role, text, kind))
        self.bytes += weight

    def _solve(self, last: bool) -> None:
        kinds = [x[3] for x in self.held]
        costs = _backward(kinds, END if last else self.behind[self.stretch])
        if self.cost is None:
            self.cost = costs[0][0]
        for edit, i, self.state in _walk(kinds, costs, self.state, last):
            self.audit.append(edit)
            turn, role, text, _ = self.held[i] if i is not None else (None, None, "", None)
            if edit in "IR":
                role = ROLE_OF[self.state]
            if edit != "D":
                self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode())
                self.written += 1
            if self.edits is not None:
                self.edits.append((self.conv_id, len(self.audit) - 1, edit, turn, role, text))
        self.held = []

    def close(self) -> tuple:
        self._solve(True)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
EDITS = ["place", "edit", "turn", "role", "text"]
HELD_EDITS = 4096


def _repaired(turns: DataFrame, edits: bool, block_bytes: int) -> DataFrame:
    rows = marked(turns.where("present") if "present" in turns.columns else turns)
    marks = checkpoints(rows, block_bytes)
    conv = turns.schema["conv_id"].dataType.simpleString()
    none = lambda kind: F.lit(None).cast(kind)
    stream = rows.select("conv_id", F.lit(2).alias("tag"), "turn", "role", "text", "kind", "weight", none("array<long>").alias("costs"))
    blank = lambda df, tag: df.select("conv_id", F.lit(tag).alias("tag"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("int").alias("kind"), none("long").alias("weight"), none("array<long>").alias("costs"))
    if "present" in turns.columns:
        stream = stream.union(blank(turns.where("not present"), 0))
    if marks is not None:
        stream = stream.union(marks.select("conv_id", F.lit(1).alias("tag"), F.col("stretch").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("int").alias("kind"), F.col("size").alias("weight"), "costs"))
    ordered = _ordered(stream).sortWithinPartitions("conv_id", "tag", F.col("turn").asc_nulls_first(), "role", "text")
    types = ["long"] * 6 + ["string"] * 2
    schema = f"conv_id {conv}, " + (", ".join(f"{c} {t}" for c, t in zip(EDITS, ("long", "string", "long", "string", "string"), strict=True)) if edits else ", ".join(f"{c} {t}" for c, t in zip(SUMMARY, types, strict=True)))

    def run(it):
        def batch_of(values):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*values, strict=True), arrow, strict=True)], names=names)
        arrow, names, now, marks, done = None, [c.split()[0] for c in schema.split(", ")], None, [], []
        for batch in it:
            if arrow is None:
                arrow = [batch.schema.field("conv_id").type] + ([pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if edits else [pa.int64()] * 6 + [pa.string()] * 2)
            for conv_id, tag, turn, role, text, kind, weight, costs, again in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "tag", "turn", "role", "text", "kind", "weight", "costs", "again")], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        result = now.close()
                        done += now.edits if edits else [result]
                    now, marks = _Conversation(conv_id, [], edits), []
                if tag == 1:
                    marks.append((turn, costs, weight))
                    now = _Conversation(conv_id, marks, edits) if len(marks) == 1 else now
                    now.behind[turn] = tuple(costs)
                elif tag == 2:
                    now.take(turn, role, text, kind, weight, again)
                if edits and now.edits:
                    done += now.edits
                    now.edits.clear()
                if len(done) >= HELD_EDITS:
                    yield batch_of(done)
                    done = []
        if now is not None:
            result = now.close()
            done += now.edits if edits else [result]
        if done:
            yield batch_of(done)
    return ordered.select("conv_id", "tag", "turn", "role", "text", "kind", "weight", "costs", "again").mapInArrow(run, schema)


def repair(turns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation of ``turns`` (conv_id, turn, role,
    text; further columns are ignored, but for ``present``: rows where it is
    false only name their conversation).

    Order: turn (nulls first), role, text.  Null roles and texts count as one
    space.  A turn is blank without a character beyond space and 09 to 0D, a
    duplicate where its role and text stood earlier, truncated where its last
    such character is none of ``.!?``; its first fault counts.  Blank and
    duplicate turns are deleted (2 each); Keep costs 0, Rerole 1, Delete 2,
    Insert (empty text) 5, and a truncated turn that stays 5.  audit: initials
    of the cheapest edits, ties to the ASCII-least.  Roles other than s..., u...
    and a... (an empty one too) cannot stay as they are.  gaps: turn numbers
    missing between the smallest and the largest.  Rows with a null conv_id are
    one conversation.  Without turns: zeros, no edits, the digest of nothing."""
    return _repaired(turns, False, block_bytes)


def repaired_turns(turns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the edits of ``repair`` with the
    turns themselves, in their order; deleted ones (D) included, inserted ones
    (I) without turn."""
    return _repaired(turns, True, block_bytes)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with planted faults and ``present``,
    false for dropped turns.  The fault of a turn is crc32("conv_id:turn") % 20:
    0 dropped, 1 without text, 2 without ``.!?``, 3 twice, 4 with role user,
    5 to 19 none.  Nulls count as one space, in the key too."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("fault") != 0, text).alias("text"), (F.col("fault") != 0).alias("present"), copies.alias("copy")).drop("copy")
