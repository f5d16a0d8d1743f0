"""Repeated passages of 100 bytes or more, by a family of suffix indexes with geometric levels.

The index holds a sparse suffix array: of any 100 bytes at least one suffix begins inside that the index knows,
chosen by the smallest fingerprint of the 40 bytes at its head (winnowing), about one suffix in 30 bytes, and
equal passages choose equal places. Suffixes are ordered by that fingerprint, which keeps equal heads
adjacent, all that a merge scan needs, and deals them into key ranges of equal size. Each range holds its own
family: documents come in batches by doc_id; a batch is sorted, merge-scanned against every existing
level for heads and for whole contexts (everything within 100 bytes around the head) seen before, becomes a level itself, and
two levels of one size class are merged into the next.

A suffix whose whole context occurred earlier makes all 100-byte strings around it repeats. Where a head is known
but its context is not, which happens at the ends of repeated passages only, the strings around it are compared one
by one, again by fingerprint. So the result is exact: a byte is removed if and only if a 100-byte string that starts earlier
(smaller doc_id, or earlier in the same document) covers it. Fingerprints of strings have 72 bits or more.

Texts and keys travel by :mod:`corpusmap.llm.blocks`: a passage that every document has costs an entry per block.

Defined cases: null is the empty text; a null doc_id comes before all others; rows that repeat a doc_id count as equally
early, so neither removes the other's text; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusmap.llm.blocks import Layout, expand, in_blocks, joined_reply, layout, questions, replies, squeeze, tidily
from corpusmap.llm.words import U64, buffer_of, byte_table, mix, row_slices

LENGTH = 100
HEAD = 40
#: Batches in which a key range takes up its documents.
BATCHES = 8
#: Bytes fingerprinted at once.
_SLICE = 1 << 19
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)
_NULL = -(1 << 63)


@lru_cache(maxsize=4)
def _steps(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, base, U64)]), dtype=U64)


class Prints:
    """Fingerprints of any range of a batch of bytes, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        room = 1 << max(12, int(len(data) + 1).bit_length())
        self.back = _steps(room, _BACK)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(
                [[U64(0)], np.cumsum(byte_table(5)[data] * _steps(room, _STEP)[: len(data)], dtype=U64)]
            )

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[i : i + width] for each i; the array's end is short of values."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def chosen(data: np.ndarray, offsets: np.ndarray, prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """(place, fingerprint of the head) of the suffixes the index holds."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    top = U64(2**64 - 1)
    heads = np.full(n, top, U64)
    inside = at + HEAD <= end
    heads[inside] = np.minimum(prints.of(at[inside], at[inside] + HEAD), top - U64(1))
    lowest = _slide(heads, LENGTH - HEAD + 1, np.minimum)
    lowest[at + LENGTH > end] = 0
    reach = LENGTH - HEAD
    padded = np.concatenate([np.zeros(reach, U64), lowest])
    highest = _slide(padded, reach + 1, np.maximum)[:n]  # over the windows that hold the place
    place = np.flatnonzero((heads == highest) & inside)
    return place, heads[place]


class Suffixes:
    """The chosen suffixes of a block, ordered by head, context, document and place; texts in slices."""

    def __init__(self, table: pa.Table, plan: Layout):
        data, offsets = buffer_of(table.column("text"))
        self.data, self.offsets = data, offsets
        ids = table.column("doc_id").fill_null(_NULL).to_numpy()
        parts = []
        for a, b in row_slices(offsets, _SLICE):
            o = offsets[a : b + 1]
            base = o[0]
            prints = Prints(data[o[0] : o[-1]])
            place, head = chosen(data[o[0] : o[-1]], o - base, prints)
            row = np.searchsorted(o - base, place, "right") - 1
            begin = np.maximum(o[row] - base, place + HEAD - LENGTH)
            end = np.minimum(o[row + 1] - base, place + LENGTH)
            context = mix(prints.of(begin, end) ^ mix((place - begin).astype(U64) * U64(1000) + (end - place).astype(U64)))
            whole = end - begin >= LENGTH
            parts.append((plan.trim(head)[whole], context[whole] >> U64(16), (row + a)[whole], (place + base)[whole]))
        self.head, self.context, self.row, self.place = (
            np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts, strict=True)
        ) if parts else (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.doc = ids[self.row]
        self.inner = self.place - offsets[self.row]
        order = np.lexsort((self.inner, self.doc, self.context, self.head))
        for name in ("head", "context", "row", "place", "doc", "inner"):
            setattr(self, name, getattr(self, name)[order])
        n = len(self.head)
        new = np.ones(n, bool)
        new[1:] = (self.head[1:] != self.head[:-1]) | (self.context[1:] != self.context[:-1])
        self.first = np.flatnonzero(new)  # of each context, its earliest place
        self.group = np.cumsum(new) - 1


class Family:
    """Levels of a key range: sorted (head, context) fingerprints of documents seen so far."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray]] = []

    def seen(self, full: np.ndarray) -> np.ndarray:
        """Which of the sorted contexts are in a level: a merge scan of each."""
        out = np.zeros(len(full), bool)
        for _, level in self.levels:
            at = np.searchsorted(level, full)
            at[at == len(level)] = 0
            out |= level[at] == full
        return out

    def add(self, full: np.ndarray) -> None:
        """A batch's sorted array as a level; levels of one size class merge."""
        if not len(full):
            return
        self.levels.append((int(len(full)).bit_length(), full))
        while len(self.levels) > 1 and self.levels[-2][0] <= self.levels[-1][0]:
            _, b = self.levels.pop()
            _, a = self.levels.pop()
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            self.levels.append((int(len(both)).bit_length(), both))


def _codes(head: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
    """1: the context occurred earlier; 2: another context has the head; 0: neither."""
    context = extra[0].astype(U64) << U64(16) | extra[1].astype(U64)
    doc, inner = extra[2], extra[3]
    full = mix(head ^ mix(context))
    order = np.lexsort((inner, doc))
    code = np.zeros(len(head), np.uint8)
    family = Family()
    bounds = np.linspace(0, len(order), BATCHES + 1).astype(np.int64)
    for i in range(1, BATCHES):  # a batch ends with a document
        while bounds[i] < len(order) and bounds[i] > bounds[i - 1] and doc[order[bounds[i]]] == doc[order[bounds[i] - 1]]:
            bounds[i] += 1
        bounds[i] = max(bounds[i], bounds[i - 1])
    for a, b in zip(bounds[:-1], np.maximum(bounds[1:], bounds[:-1]), strict=True):
        batch = order[a:b]
        batch = batch[np.argsort(full[batch], kind="stable")]  # suffix array; document order in ties
        f, d, p = full[batch], doc[batch], inner[batch]
        new = np.ones(len(f), bool)
        new[1:] = f[1:] != f[:-1]
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(f)))
        later = (d > np.repeat(d[at], sizes)) | (p > np.repeat(p[at], sizes))
        known = np.repeat(family.seen(f[at]), sizes)
        code[batch[later | known]] = 1
        family.add(f[at])
    # Heads with more than one context, over all batches.
    order = np.lexsort((context, head))
    h, c = head[order], context[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    if len(at):
        sizes = np.diff(np.append(at, len(h)))
        last = np.append(at[1:], len(h)) - 1
        many = np.empty(len(h), bool)
        many[order] = np.repeat(c[at] != c[last], sizes)
        code[(code == 0) & many] = 2
    return [code]


_KINDS = [np.uint32, np.uint16, np.int64, np.int32]
_WINDOWS = "part int, block int, keys binary, more binary, doc binary, row binary, start binary"


def removed_ranges(texts: DataFrame, plan: Layout) -> tuple[DataFrame, DataFrame]:
    """(texts in blocks, ranges to remove by block: row, begin, end as packed arrays)."""
    dealt = in_blocks(texts, ["doc_id", "text"], plan)

    def ask(table: pa.Table):
        s = Suffixes(_ordered(table), plan)
        at = s.first
        context = s.context[at]
        return s.head[at], [
            (context >> U64(16)).astype(np.uint32),
            (context & U64(0xFFFF)).astype(np.uint16),
            s.doc[at],
            s.inner[at].astype(np.int32),
        ]

    answers = replies(questions(dealt, plan, ask), plan, _codes, _KINDS)

    def windows(table: pa.Table, got: pa.Table) -> pa.Table:
        """Ranges of repeated contexts, and the strings to compare one by one, by key range."""
        if not len(table):
            return pa.Table.from_batches([], _schema(_WINDOWS))
        table = _ordered(table)
        s = Suffixes(table, plan)
        (code,) = joined_reply(got, [np.uint8])
        code = code[s.group] if len(s.group) else code
        earliest = s.first[s.group] if len(s.group) else s.first
        later = (s.doc > s.doc[earliest]) | (s.inner > s.inner[earliest])
        code = np.where(later, 1, code)
        low = np.maximum(s.offsets[s.row], s.place + HEAD - LENGTH)
        high = np.minimum(s.offsets[s.row + 1], s.place + LENGTH)
        base = s.offsets[s.row]
        once = code == 1
        block = table.column("block")[0].as_py()
        rows = [(-1 - block, block, b"", b"", squeeze(s.row[once].astype(np.int32)), squeeze((low - base)[once].astype(np.int32)), squeeze((high - base)[once].astype(np.int32)))]
        # The strings around heads that are known with other contexts.
        some = np.flatnonzero(code == 2)
        count = high[some] - low[some] - LENGTH + 1
        start = np.repeat(low[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        # Strings around a repeated context repeat an earlier one that is compared in their place.
        known = np.zeros(len(s.data) + 1, np.int32)
        np.add.at(known, low[once], 1)
        np.add.at(known, high[once] - LENGTH + 1, -1)
        start = np.unique(start)
        start = start[np.cumsum(known)[start] == 0]
        if len(start):
            row = np.searchsorted(s.offsets, start, "right") - 1
            key = np.zeros(len(start), U64)
            for a, b in row_slices(s.offsets, _SLICE):
                lo, hi = np.searchsorted(start, [s.offsets[a], s.offsets[b]])
                if hi > lo:
                    base_at = s.offsets[a]
                    prints = Prints(s.data[base_at : s.offsets[b]])
                    key[lo:hi] = prints.of(start[lo:hi] - base_at, start[lo:hi] - base_at + LENGTH)
            more = (mix(key) & U64(0xFFFFFFFF)).astype(np.uint32)
            order = np.argsort(key, kind="stable")
            key, more, row, start = key[order], more[order], row[order], start[order]
            ids = table.column("doc_id").fill_null(_NULL).to_numpy()
            for p, a, b in zip(*plan.runs(key), strict=True):
                rows.append(
                    (p, block, plan.pack(key[a:b]), squeeze(more[a:b]), squeeze(ids[row[a:b]]), squeeze(row[a:b].astype(np.int32)), squeeze((start[a:b] - s.offsets[row[a:b]]).astype(np.int32)))
                )
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(_WINDOWS), strict=True)],
            schema=_schema(_WINDOWS),
        )

    asked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda a, b: tidily(windows, a, b), _WINDOWS
    )

    def settle(table: pa.Table) -> pa.Table:
        """Ranges per block of the strings that start earlier elsewhere; other ranges pass."""
        schema = _schema("block int, row binary, begin binary, end binary")
        if table.column("part")[0].as_py() < 0:
            return pa.Table.from_arrays([table.column(c).combine_chunks() for c in ("block", "doc", "row", "start")], schema=schema)
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        keys = [plan.unpack(k) for k in cols["keys"]]
        size = [len(k) for k in keys]
        key = np.concatenate(keys) ^ np.concatenate([expand(x, np.uint32) for x in cols["more"]]).astype(U64)
        doc, row, start = (
            np.concatenate([expand(x, kind) for x in cols[c]])
            for c, kind in (("doc", np.int64), ("row", np.int32), ("start", np.int32))
        )
        order = np.lexsort((start, doc, key))
        k, d, p = key[order], doc[order], start[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(k)))
        later = np.empty(len(k), bool)
        later[order] = (d > np.repeat(d[at], sizes)) | (p > np.repeat(p[at], sizes))
        out = ([], [], [], [])
        for block, a, b in zip(cols["block"], np.cumsum(size) - size, np.cumsum(size), strict=True):
            hit = np.flatnonzero(later[a:b]) + a
            if len(hit):
                for col, v in zip(out, (block, squeeze(row[hit]), squeeze(start[hit]), squeeze(start[hit] + np.int32(LENGTH))), strict=True):
                    col.append(v)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ranges = asked.groupBy("part").applyInArrow(
        lambda table: tidily(settle, table), "block int, row binary, begin binary, end binary"
    )
    return dealt, ranges


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a block in an order of their own, the same in every pass."""
    ids = table.column("doc_id").fill_null(_NULL).to_numpy()
    prints = np.array([hash_of(t) for t in table.column("text")], dtype="S16")
    return table.take(pa.array(np.lexsort((prints, ids))))


def hash_of(text: pa.Scalar) -> bytes:
    return hashlib.blake2b(text.as_buffer() if text.is_valid else b"", digest_size=8).hexdigest().encode()


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges: begins and ends of its maximal runs."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(begin)) - 1]


def remove_repeats(docs: DataFrame, kept_text: bool = False) -> DataFrame:
    """Per row of (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end) and,
    if asked for, ``kept``, the bytes that stay, and ``rest``, a struct of the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if kept_text and others else []
    texts = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *rest
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = layout(total, 0.08)
    dealt, ranges = removed_ranges(texts, plan)
    schema = T.StructType.fromDDL(
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<begin:int,end:int>>" + (", kept binary" if kept_text else "")
    )
    if rest:
        schema = schema.add("rest", texts.schema["rest"].dataType)

    carried = bool(rest)

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        table = _ordered(table)
        pieces = [
            np.concatenate([expand(x.as_py(), np.int32) for x in got.column(c)] or [np.zeros(0, np.int32)])
            for c in ("row", "begin", "end")
        ]
        order = np.argsort(pieces[0], kind="stable")
        row, begin, end = (p[order] for p in pieces)
        first = np.searchsorted(row, np.arange(len(table) + 1))
        out: list[list] = [[] for _ in range(7)]
        for i, (doc_id, text) in enumerate(zip(table.column("doc_id"), table.column("text"), strict=True)):
            raw = text.as_buffer().to_pybytes()
            a, b = merged(begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]])
            kept = raw
            if len(a):
                cuts = np.stack([np.append(0, b), np.append(a, len(raw))], 1)
                kept = b"".join(raw[x:y] for x, y in cuts)
            values = (
                doc_id.as_py(),
                len(raw),
                len(raw) - len(kept),
                len(a),
                hashlib.sha256(kept).hexdigest(),
                [{"begin": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)],
                kept,
            )
            for col, v in zip(out, values, strict=True):
                col.append(v)
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        n = 7 if kept_text else 6
        made = pa.table([pa.array(c, k) for c, k in zip(out[:n], kinds[:n], strict=True)], names=names[:n])
        return made.append_column("rest", table.column("rest")) if carried else made

    return dealt.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(
        lambda a, b: tidily(finish, a, b), schema
    )
