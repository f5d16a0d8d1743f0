"""Conversations repaired at least cost: bidirectional Dijkstra over the edit lattice.

A node of a conversation's lattice is (rows consumed, last role emitted); edges are the edits: keep, rerole, delete, insert. A repaired
conversation's role initials read ``(s?(ua)+)?``. A forward search from the start and a reverse search from the accepting ends take turns
by the lower heap top until no cheaper meeting is possible; then every crossing of equal cost is finished, and among all cheapest
repairs the one with the least audit in ASCII order is walked: first inside the forward side, over nodes from which a crossing can be
reached, then on the reverse side.

Two streams do the work, both dealt by conversation and sorted by turn. The first sees narrow rows only (an initial, flags, a digest of role and
text) and yields one plan per conversation; the second meets the plan and then the rows, and hashes the repaired text as it passes. No
text is held; a task holds some 100 bytes for each row of the conversation at hand, which its audit, one value, holds as well.

Defined cases: null role or text reads as one space, a null conv_id is a conversation, a null turn comes first and makes no gap; rows of one
turn are ordered by a digest of role and text; repeated rows are duplicates; long texts are hashed as they are; a conversation without
rows gets zeros and the hash of the empty text; an empty table gives no rows; extra columns are not read. A role is known by its first
character; an empty role fits nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Costs of the edits, and what a repaired conversation may hold.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. The role that may be put in next, and what follows it.
_PUT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_BEFORE = {2: (0, 1, 3), 3: (2,)}
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_BACK = {(1, "s"): (0,), (2, "u"): (0, 1, 3), (3, "a"): (2,)}
_ACCEPTING = (0, 3)
_LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\x0b\x0c\r"

#: A row of the lattice: its initial, whether it must go, what keeping it costs.
Row = tuple[str, bool, int]
Node = tuple[int, int]


def _edges(rows: list[Row], node: Node) -> list[tuple[str, Node, int]]:
    """Edits from a node in ASCII order: (letter, node, cost)."""
    i, q = node
    out = [("I", (i, _NEXT[q]), INSERT)]
    if i < len(rows):
        initial, must_go, extra = rows[i]
        out.insert(0, ("D", (i + 1, q), DELETE))
        if not must_go:
            if (q, initial) in _STEP:
                out.append(("K", (i + 1, _STEP[q, initial]), extra))
            out.append(("R", (i + 1, _NEXT[q]), REROLE + extra))
    return out


def _edges_into(rows: list[Row], node: Node) -> list[tuple[Node, int]]:
    """Nodes with an edit into a node, and its cost."""
    i, q = node
    out = [((i, p), INSERT) for p in _BEFORE.get(q, ())]
    if i:
        initial, must_go, extra = rows[i - 1]
        out.append(((i - 1, q), DELETE))
        if not must_go:
            out += [((i - 1, p), extra) for p in _BACK.get((q, initial), ())]
            out += [((i - 1, p), REROLE + extra) for p in _BEFORE.get(q, ())]
    return out


class _Side:
    """One direction of the search: distances, the heap, and what is settled."""

    def __init__(self, starts: list[Node], neighbours: Callable[[Node], list[tuple[Node, int]]]) -> None:
        self.dist, self.heap, self.done = dict.fromkeys(starts, 0), [(0, n) for n in starts], set()
        self.neighbours = neighbours

    def top(self) -> float:
        while self.heap and self.heap[0][1] in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, other: _Side, best: float) -> float:
        """Settle the nearest node; the cheapest meeting with the other side so far."""
        d, node = heappop(self.heap)
        self.done.add(node)
        for near, cost in self.neighbours(node):
            if d + cost < self.dist.get(near, float("inf")):
                self.dist[near] = d + cost
                heappush(self.heap, (d + cost, near))
            if near in other.dist:
                best = min(best, d + cost + other.dist[near])
        return best


def repair(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, of equal ones the least audit."""
    start, ends = (0, 0), [(len(rows), q) for q in _ACCEPTING]
    ahead = _Side([start], lambda node: [(to, cost) for _, to, cost in _edges(rows, node)])
    back = _Side(ends, lambda node: _edges_into(rows, node))
    best = 0 if start in ends else float("inf")
    reached = -1
    while (a := ahead.top()) + (b := back.top()) < best:
        if a <= b:
            reached = a
            best = ahead.settle(back, best)
        else:
            best = back.settle(ahead, best)
    reached = max(reached, 0)
    while ahead.top() <= reached:  # all nodes as near as the farthest settled one
        best = ahead.settle(back, best)
    while back.top() < best - reached:  # every node beyond them on a cheapest repair
        best = back.settle(ahead, best)
    return int(best), _least(rows, ahead, back, best)


def _least(rows: list[Row], ahead: _Side, back: _Side, best: float) -> str:
    """Least audit over all cheapest repairs, which each leave the forward side once."""
    inf = float("inf")

    def crosses(node: Node, to: Node, cost: int) -> bool:
        return to not in ahead.done and ahead.dist[node] + cost + back.dist.get(to, inf) == best

    def accepts(node: Node) -> bool:
        return node[0] == len(rows) and node[1] in _ACCEPTING

    leads = [
        n
        for n in ahead.done
        if (accepts(n) and ahead.dist[n] == best) or any(crosses(n, to, cost) for _, to, cost in _edges(rows, n))
    ]
    good = set(leads)
    while leads:
        node = leads.pop()
        for near, cost in _edges_into(rows, node):
            if near in ahead.done and near not in good and ahead.dist[near] + cost == ahead.dist[node]:
                good.add(near)
                leads.append(near)
    audit, node, crossed = [], (0, 0), False
    while not (accepts(node) and (back.dist[node] == 0 if crossed else ahead.dist[node] == best)):
        for letter, to, cost in _edges(rows, node):
            if crossed:
                fits = back.dist.get(to, inf) + cost == back.dist[node]
            elif to in ahead.done:
                fits = to in good and ahead.dist[node] + cost == ahead.dist[to]
            else:
                fits = crosses(node, to, cost)
            if fits:
                crossed = crossed or to not in ahead.done
                audit.append(letter)
                node = to
                break
        else:
            raise AssertionError("no cheapest repair from here")
    return "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32(conv_id:turn) mod 20 stands for; copies is 0 for dropped rows."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


class _Conversation:
    """What the first stream knows of a conversation."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.seen: set[bytes] = set()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last_turn = None

    def add(self, turn: int | None, initial: str, empty: bool, cut: bool, digest: bytes) -> None:
        again = digest in self.seen
        self.seen.add(digest)
        self.blank += empty
        self.duplicate += again and not empty
        cut = cut and not again and not empty
        self.truncated += cut
        if self.rows:
            self.illegal += self.rows[-1][0] + initial not in _LEGAL
        self.rows.append((initial, empty or again, TRUNCATED * cut))
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn

    def plan(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = repair(self.rows)
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_RESULT = f"{_PLAN}, repaired_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
#: Finished conversations, or characters of their audits, that are handed on together.
_HELD, _HELD_AUDITS = 4096, 1 << 22


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, held, size = [f.split()[0] for f in schema.split(", ")], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=False)], names)

    for row in rows:
        held.append(row)
        size += len(row[7])
        if len(held) >= _HELD or size > _HELD_AUDITS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns), strict=True)


def _judged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The plan of each conversation of sorted narrow rows."""
    now, name = None, None
    for conv_id, turn, digest, initial, empty, cut, copies in rows:
        if now is None or conv_id != name:
            if now is not None:
                yield now.plan(name)
            now, name = _Conversation(), conv_id
        for _ in range(copies):
            now.add(turn, initial, empty, cut, digest)
    if now is not None:
        yield now.plan(name)


class _Hash:
    """The repaired text of a conversation, hashed row by row along its audit."""

    def __init__(self, plan: tuple):
        self.plan, self.left = plan, iter(plan[7])
        self.sha, self.q, self.first = hashlib.sha256(), 0, True

    def _emit(self, role: str, text: str, q: int) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first, self.q = False, q

    def _put(self, text: str) -> None:
        self._emit(_PUT[self.q], text, _NEXT[self.q])

    def row(self, role: str, text: str) -> None:
        letter = next(self.left)
        while letter == "I":
            self._put("")
            letter = next(self.left)
        if letter == "R":
            self._put(text)
        elif letter == "K":
            self._emit(role, text, _STEP[self.q, role[:1]])

    def result(self) -> tuple:
        for _ in self.left:  # only insertions are left
            self._put("")
        return *self.plan, self.sha.hexdigest()


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Plans with the hash of the repaired text; each plan comes before the rows of its conversation."""
    now = None
    for *plan, _, _, role, text, copies in rows:
        if role is None:
            if now is not None:
                yield now.result()
            now = _Hash(tuple(plan))
            continue
        for _ in range(copies):
            now.row(role, text)
    if now is not None:
        yield now.result()


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and repair of each conversation of (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256. Rows with 0 copies only name their conversation."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    marked = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), _digest(role, text).alias("digest"), role, text, "copies"
    )
    solid = F.rtrim(F.col("text"), F.lit(_BLANKS))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    narrow = marked.select(
        "conv_id",
        "turn",
        "digest",
        F.substring("role", 1, 1).alias("initial"),
        (solid == "").alias("empty"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
        "copies",
    )
    plans = (
        narrow.repartition("conv_id")
        .sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _batches(_judged(_rows(batches)), _PLAN), _PLAN)
    )
    met = plans.unionByName(marked, allowMissingColumns=True)
    names = [f.split()[0] for f in _PLAN.split(", ")]
    return (
        met.select(*names, "turn", "digest", "role", "text", "copies")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("role").isNotNull(), *order[1:])
        .mapInArrow(lambda batches: _batches(_hashed(_rows(batches)), _RESULT), _RESULT)
    )
