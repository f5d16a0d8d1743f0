"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

Words are points of ``DIMS`` letter counts. One replaced letter moves a point by at most one count down and one up (L1 distance two
or, within one bucket of rare letters, zero), one inserted letter by one up; so near words lie in small boxes of their own length and
of the next. A k-d tree per length cuts the vocabulary into cells of about ``CELL_WORDS`` words: cells that are too large are
split by medians of a sample until none is left, wherever points can be told apart. Each word is sent to the cells that its box reaches,
once per pair of cells; inside a cell a finer tree with tight boxes leaves few candidates, whose letters are then compared in order.
What leaves a cell is, per word, the number of near words and the best of them, never pairs.

The driver holds the tree, a node for every ``CELL_WORDS`` / 8 words at most. Words are counted where the texts are read; texts do not move.

Defined cases: null and empty texts have no words; a null doc_id counts as the text ''; very long texts and very long words are taken
whole; repeated rows count each; equal counts are ordered by code point; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusmap.functions.ordering import hash_key, hash_unit
from corpusmap.llm.words import buffer_of, lower_table, row_slices
from corpusmap.sources.scratch import discard, materialize, materialize_observed

# Every so many (document, word) hashes a letter goes; shortest word, fewest occurrences, how many times as frequent a form is.
DAMAGE, MIN_LETTERS, MIN_COUNT, FORM_RATIO = 97, 5, 3, 2
DIMS = 32
CELL_WORDS = 4096
#: Points of a cell that choose its medians, and points of a leaf of the tree inside a cell.
SAMPLE, LEAF = 1024, 24
#: Pairs whose counts or letters are compared at once.
_AT_ONCE = 1 << 16


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each range of bytes, continued from ``before``."""
    out = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-length, kind="stable")
    long_ = int((length > 64).sum())
    for i in order[:long_]:
        out[i] = np.uint32(zlib.crc32(data[start[i] : start[i] + length[i]], int(before[i]))) ^ np.uint32(0xFFFFFFFF)
    order, table = order[long_:], _crc_table()
    ends = np.searchsorted(-length[order], -np.arange(int(length[order[0]]) if len(order) else 0), side="left")
    for j, n in enumerate(ends):
        at = order[:n]
        c = out[at]
        out[at] = table[(c ^ data[start[at] + j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return out ^ np.uint32(0xFFFFFFFF)


def _counted(doc_ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Damaged words of at least ``MIN_LETTERS`` letters of a batch of texts, with their counts."""
    low = lower_table()[data]
    lead = low == 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else
    keep = (low >= 97) & (low <= 122) | lead
    keep[1:] |= lead[:-1]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    edges = offsets[:-1][offsets[:-1] < len(low)]
    begins[edges] = keep[edges]
    body = low[keep]
    heads = np.flatnonzero(begins[keep])
    length = np.diff(np.append(heads, len(body)))
    letters = length - np.add.reduceat(lead[keep], heads) if len(heads) else length
    doc = np.searchsorted(offsets, np.flatnonzero(begins), side="right") - 1
    use = np.flatnonzero(letters >= MIN_LETTERS)
    heads, length, letters, doc = heads[use], length[use], letters[use], doc[use]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in doc_ids], np.uint32)
    hashes = _crcs(body, heads, length, prefix[doc])
    hit = hashes % DAMAGE == 0
    cut = []
    for a, n, k, h in zip(heads[hit], length[hit], letters[hit], hashes[hit], strict=True):
        if k > MIN_LETTERS:
            word = body[a : a + n].tobytes().decode()
            at = int(h) % int(k)
            cut.append(word[:at] + word[at + 1 :])
    heads, length = heads[~hit], length[~hit]
    places = np.concatenate([[0], np.cumsum(length)])
    chosen = np.zeros(len(body) + 1, np.int32)
    chosen[heads] += 1
    chosen[heads + length] -= 1
    text = body[np.cumsum(chosen[:-1]) > 0]
    words = pa.Array.from_buffers(
        pa.large_string(), len(length), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(text)]
    )
    found = pc.value_counts(pa.chunked_array([words, pa.array(cut, pa.large_string())]).combine_chunks())
    return found.field("values"), found.field("counts")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all damaged words of (doc_id, text) that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in row_slices(offsets, 8 << 20):
                words, n = _counted(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), n], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _spellings(column: pa.Array) -> list[bytes]:
    """Words as one byte per letter: none has letters beyond U+00FF."""
    return [w.encode("latin-1") for w in column.to_pylist()]


@lru_cache(maxsize=1)
def _dims() -> np.ndarray:
    """Dimension of each letter: a to z their own, the others in buckets."""
    d = 26 + np.arange(256) % (DIMS - 26)
    d[97:123] = np.arange(26)
    return d


def letter_counts(words: list[bytes]) -> np.ndarray:
    """A row of letter counts per word."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = _dims()[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), length)
    return np.bincount(row * DIMS + flat, minlength=len(words) * DIMS).reshape(len(words), DIMS).astype(np.int32)


@dataclass
class Cells:
    """k-d trees over letter counts, one per length that needs one. A node is split at ``dim``, counts up to ``cut`` going left,
    or is a cell (dim < 0). Lengths without a tree are one cell, numbered -length."""

    roots: dict[int, int] = field(default_factory=dict)
    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)

    def _leaf(self) -> int:
        for column in (self.dim, self.cut, self.left, self.right):
            column.append(-1)
        return len(self.dim) - 1

    def root(self, length: int) -> int:
        if length not in self.roots:
            self.roots[length] = self._leaf()
        return self.roots[length]

    def graft(self, cell: int, splits: list[tuple[int, int, int, int, int]]) -> None:
        """Replace a cell by the tree of (node, dim, cut, left, right), nodes numbered from 0, those absent being cells."""
        place = {0: cell}
        for node, dim, cut, left, right in sorted(splits):
            at = place[node]
            self.dim[at], self.cut[at] = dim, cut
            place[left] = self.left[at] = self._leaf()
            place[right] = self.right[at] = self._leaf()

    def own(self, length: int, points: np.ndarray) -> np.ndarray:
        """Cell of each point of one length."""
        if length not in self.roots:
            return np.full(len(points), -length)
        dim, cut = np.array(self.dim), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at = np.full(len(points), self.roots[length])
        alive = np.flatnonzero(dim[at] >= 0)
        while len(alive):
            node = at[alive]
            goes_left = points[alive, dim[node]] <= cut[node]
            at[alive] = np.where(goes_left, left[node], right[node])
            alive = alive[dim[at[alive]] >= 0]
        return at

    def reached(self, length: int, points: np.ndarray, down: int, up: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) wherever a cell of ``length`` holds counts that are at most ``down`` below and ``up`` above a point."""
        if length not in self.roots:
            return np.arange(len(points)), np.full(len(points), -length)
        found: list[tuple[np.ndarray, int]] = []
        stack = [(self.roots[length], np.arange(len(points)), {}, {})]
        while stack:
            node, alive, low, high = stack.pop()
            if low or high:
                lower = sum((np.maximum(points[alive, d] - v, 0) for d, v in high.items()), np.zeros(len(alive), int))
                upper = sum((np.maximum(v - points[alive, d], 0) for d, v in low.items()), np.zeros(len(alive), int))
                alive = alive[(lower <= down) & (upper <= up)]
            if not len(alive):
                continue
            if self.dim[node] < 0:
                found.append((alive, node))
                continue
            d, c = self.dim[node], self.cut[node]
            stack.append((self.left[node], alive, low, high | {d: min(c, high.get(d, c))}))
            stack.append((self.right[node], alive, low | {d: max(c + 1, low.get(d, 0))}, high))
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate([p for p, _ in found]), np.repeat([c for _, c in found], [len(p) for p, _ in found])


def median_split(points: np.ndarray) -> tuple[int, int] | None:
    """(dim, cut) that parts points most evenly; None if all are equal."""
    best = None
    for d in range(points.shape[1]):
        values, counts = np.unique(points[:, d], return_counts=True)
        if len(values) > 1:
            below = np.cumsum(counts)[:-1]
            at = int(np.argmin(np.abs(2 * below - len(points))))
            miss = abs(2 * int(below[at]) - len(points))
            if best is None or miss < best[0]:
                best = (miss, d, int(values[at]))
    return best and best[1:]


def _splits(points: np.ndarray, smallest: int) -> list[tuple[int, int, int, int, int]]:
    """Splits of a tree whose cells hold under twice ``smallest`` points where possible."""
    out, stack, used = [], [(0, points)], 1
    while stack:
        node, own = stack.pop()
        found = median_split(own) if len(own) >= 2 * smallest else None
        if found:
            dim, cut = found
            goes_left = own[:, dim] <= cut
            out.append((node, dim, cut, used, used + 1))
            stack += [(used, own[goes_left]), (used + 1, own[~goes_left])]
            used += 2
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    values, first = np.unique(length[order], return_index=True)
    for value, rows in zip(values, np.split(order, first[1:]), strict=True):
        yield int(value), rows


def _with_cells(words: DataFrame, cells: Cells) -> DataFrame:
    """(word, n, cell): the cell that holds each word."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = _spellings(batch.column("word"))
            cell = np.zeros(len(spelled), np.int64)
            for length, rows in _by_length(spelled):
                cell[rows] = cells.own(length, letter_counts([spelled[i] for i in rows]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["word", "n", "cell"])

    return words.mapInArrow(place, "word string, n long, cell long")


def fit_cells(words: DataFrame, limit: int = CELL_WORDS) -> Cells:
    """Trees whose cells hold at most ``limit`` of the words (word, n), except words that no letter count tells apart."""
    cells = Cells()
    lengths = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > limit)
    for row in lengths.collect():  # a row for every ``limit`` words at most, as below
        cells.root(row["length"])
    settled: set[int] = set()
    while True:
        sizes = _with_cells(words, cells).where("cell >= 0").groupBy("cell").count().where(F.col("count") > limit)
        large = [r for r in sizes.collect() if r["cell"] not in settled]
        if not large:
            return cells
        counts = {r["cell"]: r["count"] for r in large}
        rates = words.sparkSession.createDataFrame(
            [(c, SAMPLE / n, max(2, SAMPLE * limit // (4 * n))) for c, n in counts.items()], "cell long, rate double, smallest int"
        )
        # The rates are a row per large cell.
        chosen = _with_cells(words, cells).join(F.broadcast(rates), "cell").where(hash_unit(hash_key(F.col("word"), 7)) < F.col("rate"))

        def grow(table: pa.Table) -> pa.Table:
            points = letter_counts(_spellings(table.column("word")))
            rows = _splits(points, table.column("smallest")[0].as_py())
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            names = ["node", "dim", "cut", "left", "right"]
            return pa.table([pa.array([table.column("cell")[0].as_py()] * len(rows), pa.int64()), *columns], ["cell", *names])

        grown = chosen.groupBy("cell").applyInArrow(grow, "cell long, node long, dim long, cut long, left long, right long").collect()
        splits: dict[int, list] = {}
        for r in grown:
            splits.setdefault(r["cell"], []).append(tuple(r)[1:])
        for cell in counts:
            if cell in splits:
                cells.graft(cell, splits[cell])
            else:
                settled.add(cell)  # its sampled points are all equal


def _reaching(words: DataFrame, cells: Cells) -> DataFrame:
    """(cell, word, n, own): each word in its cell, and in every other cell that may hold a near word of its length, of two
    cells the higher number, or of the next length."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                spelled = _spellings(batch.column("word"))
                rows, where, own = [], [], []
                for length, members in _by_length(spelled):
                    points = letter_counts([spelled[i] for i in members])
                    home = cells.own(length, points)
                    point, cell = cells.reached(length, points, 1, 1)
                    other = cell > home[point]
                    longer, next_cell = cells.reached(length + 1, points, 0, 1)
                    rows += [members, members[point[other]], members[longer]]
                    where += [home, cell[other], next_cell]
                    own += [np.ones(len(members), bool), np.zeros(int(other.sum()) + len(longer), bool)]
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(where), pa.int64()), batch.column("word").take(at), batch.column("n").take(at), pa.array(np.concatenate(own))],
                        ["cell", "word", "n", "own"],
                    )

    return words.mapInArrow(send, "cell long, word string, n long, own boolean")


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one replaced letter, or by one that ``b``, longer by one, has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same = a == b[:, :-1]
    ahead = np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))
    same = (a == b[:, 1:])[:, ::-1]
    behind = np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))
    return ahead + behind >= a.shape[1]


def _candidates(points: np.ndarray, asked: np.ndarray, down: int, up: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, point) numbers of all pairs whose counts are at most ``down`` below and ``up`` above the asked ones, by a k-d tree."""
    stack = [(np.arange(len(points)), np.arange(len(asked)))]
    while stack:
        own, alive = stack.pop()
        box = points[own]
        low, high = box.min(axis=0), box.max(axis=0)
        keep = []
        for part in np.array_split(alive, -(-len(alive) * DIMS // (_AT_ONCE * DIMS)) or 1):
            q = asked[part]
            near = (np.maximum(q - high, 0).sum(axis=1) <= down) & (np.maximum(low - q, 0).sum(axis=1) <= up)
            keep.append(part[near])
        alive = np.concatenate(keep)
        if not len(alive):
            continue
        split = median_split(box) if len(own) > LEAF else None
        if split:
            goes_left = box[:, split[0]] <= split[1]
            stack += [(own[goes_left], alive), (own[~goes_left], alive)]
            continue
        for some in np.array_split(own, -(-len(own) // LEAF)):
            for part in np.array_split(alive, -(-len(alive) * len(some) // _AT_ONCE)):
                gap = points[some][None, :, :] - asked[part][:, None, :]
                near = (np.maximum(-gap, 0).sum(axis=2) <= down) & (np.maximum(gap, 0).sum(axis=2) <= up)
                i, j = np.nonzero(near)
                yield part[i], some[j]


def _near_in_cell(table: pa.Table) -> pa.Table:
    """Per word of a cell's words and its visitors: how many near words were found here, and the best."""
    n = table.column("n").to_numpy()
    own = table.column("own").to_numpy(zero_copy_only=False)
    spelled = _spellings(table.column("word"))
    rank = np.empty(len(spelled), np.int64)
    rank[sorted(range(len(spelled)), key=lambda i: (-n[i], spelled[i]))] = np.arange(len(spelled))
    held = np.flatnonzero(own)
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.string()), "best_n": pa.array([], pa.int64())})
    if not len(held):
        return empty
    length = len(spelled[held[0]])
    points, letters = letter_counts([spelled[i] for i in held]), _letters([spelled[i] for i in held], length)
    count = np.zeros(len(spelled), np.int64)
    best = np.full(len(spelled), len(spelled))
    for size in (length, length - 1):
        asked = np.array([i for i, w in enumerate(spelled) if len(w) == size], np.int64)
        if not len(asked):
            continue
        texts = [spelled[i] for i in asked]
        theirs = _letters(texts, size)
        for i, j in _candidates(points, letter_counts(texts), int(size == length), 1):
            a, b = asked[i], held[j]
            once = ~own[a] | (a < b)  # two words of the cell meet once
            i, j, a, b = i[once], j[once], a[once], b[once]
            ok = one_edit(theirs[i], letters[j])
            for x, y in ((a[ok], b[ok]), (b[ok], a[ok])):
                np.add.at(count, x, 1)
                np.minimum.at(best, x, rank[y])
    met = np.flatnonzero(count)
    if not len(met):
        return empty
    by_rank = np.argsort(rank)
    words, chosen = table.column("word").combine_chunks(), by_rank[best[met]]
    return pa.table(
        {"word": words.take(pa.array(met)), "n_near": count[met], "best": words.take(pa.array(chosen)), "best_n": n[chosen]}
    )


def near_words(words: DataFrame, cells: Cells) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words."""
    found = _reaching(words, cells).groupBy("cell").applyInArrow(
        _near_in_cell, "word string, n_near long, best string, best_n long"
    )
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", "first.best", (-F.col("first.minus")).alias("best_n"))
    )


def _with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word that has one, by pointers that double their reach in every round."""
    now, seen = materialize_observed(forms.select("word", F.col("form").alias("root")), "roots", n=F.count(F.lit(1)))
    while seen["n"]:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, seen = materialize_observed(
            now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")),
            "roots",
            n=F.count_if("went"),
        )
        discard(now)
        now = moved
    return now.select("word", "root")


def variants(docs: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """Words of (doc_id, text) with their near words: word, form, root, n, n_near, form_n."""
    words = materialize(word_counts(docs), "words")
    near = near_words(words, fit_cells(words, cell_words))
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    known = materialize(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _with_roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
