"""Hierarchical Pitman-Yor language model, sampled and applied by the whole cluster.

Each word is a context with a restaurant of its own, whose dishes are the words that follow it; all share one
parent, the unigram restaurant over a uniform base. A table of a context sends one customer to the parent. The
predictive probability of w after u is (c_uw - d t_uw + (b + d t_u) P(w)) / (b + c_u), P(w) being the parent's, c
customers and t tables.

Counts c are exact, over all training texts. A Gibbs sweep draws the tables of each dish anew given all other dishes: the
seatings of c customers at t tables weigh S(c, t) times the chances of t new tables in the restaurant that the others left
behind, with S the generalised Stirling numbers, so the draw is from the exact conditional (:func:`resample`).
Restaurants are sampled side by side, as in distributed Gibbs samplers for topic models, and the tables of every dish are kept
for the next sweep. Customers of a dish beyond the ``SOLO``-th sit down one after another in groups that double in size, with
the odds of the group's middle. ``SAMPLES`` chains give that many seatings, and a text's score is the log10 of the mean of
their predictive probabilities, summed over its tokens; the perplexity is 10 to the score a token, inverted.

First each task counts its texts' word pairs, and the counts meet by ranges of the pair's
hash, so frequent words make no hot spot: a range is one row of distinct pairs. Sweeps move those rows and sums per
word only. At the end blocks of texts (:mod:`corpusmap.llm.blocks`) ask for their pairs and words, a share of the blocks
after the other: ``PASSES`` passes read the texts, and each frees the disk of the one before.

Tokens: A-Z lower-cased, runs of bytes other than blank and the control characters from tab to carriage return, then
one end token per text.

Defined cases: null is the empty text, an end token alone; repeated rows count and score each; rows whose ``train`` is null
are not learnt from; unknown words have the parent's share of new dishes; without training texts every token has
probability 1; a very long text is a block of its own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmap.llm.blocks import (
    Layout,
    expand_all,
    in_blocks,
    layout,
    replies,
    reply_of,
    squeeze,
    tagged,
    tidily,
)
from corpusmap.llm.words import U64, Words, buffer_of, distinct, mix, nonspace_mask, row_slices
from corpusmap.sources.scratch import discard, free_shuffles, materialize

SAMPLES = 3
SWEEPS = 2
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 1.0
SOLO = 32
#: Distinct pairs that a task holds before it sends them.
HELD_PAIRS = 1 << 21
#: Shares of the blocks that are scored one after the other, since texts, questions and replies take most of the disk.
PASSES = 3
_END, _BEGIN = U64(0xE17D0C0DE1234567), U64(0xBE61A0C0DE765432)
_QUESTION = "part int, block int, keys binary, extra binary"


@dataclass(frozen=True)
class Plans:
    """Key ranges of word pairs and of words. Distinct words are few, and take whole keys."""

    pairs: Layout
    words: Layout

    @staticmethod
    def whole_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(context * U64(0x9E3779B97F4A7C15) + word)

    def pair_keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys of questions. Counts of words hang on those of pairs, so pairs are counted by their whole keys."""
        return self.pairs.trim(self.whole_keys(context, word))


class Tokens:
    """Tokens of texts: ``hash`` of each and of the one ``before``, ``begin`` (first token of each row), ``per_row``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = Words(data, offsets, nonspace_mask())
        n = len(offsets) - 1
        self.per_row = np.diff(found.first) + 1
        self.hash = np.empty(len(found) + n, U64)
        self.hash[np.arange(len(found)) + found.doc] = found.hash
        self.hash[found.first[1:] + np.arange(n)] = _END
        self.begin = found.first[:-1] + np.arange(n)
        self.before = np.empty_like(self.hash)
        self.before[1:] = self.hash[:-1]
        self.before[self.begin] = _BEGIN


class Block:
    """A block's tokens: ``word``, ``context`` and ``pair`` are places in the sorted distinct ``words``, ``pairs``."""

    def __init__(self, table: pa.Table, plans: Plans):
        t = Tokens(*buffer_of(table.column("text")))
        self.per_row = t.per_row
        self.row = np.repeat(np.arange(len(t.per_row)), t.per_row)
        # The end stands behind the tokens, for blocks' totals of texts.
        self.words, _, where = distinct(np.concatenate([t.hash, [_BEGIN, _END]]))
        self.word, self.begin, self.end = where[:-2], where[-2], where[-1]
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[t.begin] = self.begin
        self.pairs, first, self.pair = distinct(plans.pair_keys(t.before, t.hash))
        self.pair_word, self.pair_context = self.word[first], context[first]


def _by_two(first: np.ndarray, second: np.ndarray, below: int) -> np.ndarray:
    """Order by two places below ``below``: both and the row's number are sorted as one number where they fit into it."""
    bits, last = below.bit_length(), len(first).bit_length()
    if 2 * bits + last > 63:
        return np.lexsort((second, first))
    return np.sort(first << (bits + last) | second << last | np.arange(len(first))) & ((1 << last) - 1)


def _packed(context: np.ndarray, word: np.ndarray, *numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs as a list of words and steps in it, by context and word; a pair takes two or three bytes."""
    words, _, where = distinct(np.concatenate([context, word]))
    order = _by_two(where[: len(context)], where[len(context) :], len(words))
    c, w = where[order], where[order + len(context)]
    step = np.diff(c, prepend=0)
    ahead = np.where(step == 0, np.diff(w, prepend=0), w)
    ahead[:1] = w[:1]
    return words.tobytes(), squeeze(step, ahead & 255, ahead >> 8, *(n[order] for n in numbers))


def _unpacked(words: bytes, body: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words, [context, word, count]) with contexts and words as places."""
    step, low, high, count = expand_all(body, [np.int64] * 4)
    context, ahead = np.cumsum(step), low + 256 * high
    # Sums of the steps since the first word of each context.
    heads = np.flatnonzero(np.concatenate([[True], step[1:] != 0])) if len(step) else step
    total = np.cumsum(ahead)
    word = total - np.repeat(total[heads] - ahead[heads], np.diff(np.append(heads, len(step))))
    return np.frombuffer(words, U64), [context, word, count]


class Pairs:
    """A range of distinct training pairs by context and word, both places in the sorted ``words``."""

    def __init__(self, row: dict, plans: Plans):
        self.block = row["block"]
        self.words, (self.context, self.word, self.count) = _unpacked(row["words"], row["body"])
        self.keys = plans.pair_keys(self.words[self.context], self.words[self.word])

    def per_word(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(places, weights, len(self.words)).astype(np.int64)


def _merged(keys: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray, kind: str | None = None) -> tuple:
    """The same with each key once, in order, and the sums of its counts; the stable ``kind`` is fast on runs in order."""
    order = np.argsort(keys, kind=kind)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(count[order], at) if len(at) else count
    return k[at], context[order[at]], word[order[at]], total


def _told(plan: Layout, keys: np.ndarray, numbers: list[np.ndarray]) -> bytes:
    """Numbers by the bits of keys that travel, as steps between these; a key takes about three bytes.

    Pairs that the travelling bits do not tell apart have the sums of their numbers.
    """
    order, at, sums = _sums(keys, numbers, None)
    bits = (keys[order[at]] << U64(plan.part_bits)) >> U64(64 - 8 * plan.key_bytes)
    step = np.diff(bits.astype(np.int64), prepend=0)
    return squeeze(step & 0xFFFF, step >> 16, *sums)


def _heard(plan: Layout, raw: bytes, numbers: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys as :meth:`Layout.unpack` gives them, numbers) of :func:`_told`."""
    low, high, *rest = expand_all(raw, [np.int64] * (2 + numbers))
    return np.cumsum(low + (high << 16)).astype(U64) << U64(64 - 8 * plan.key_bytes), rest


def _pair_counts(plans: Plans):
    """Distinct pairs of a task's texts and their counts, by key range."""

    def send(keys, context, word, count) -> pa.RecordBatch:
        parts, begin, end = plans.pairs.runs(keys)
        rows = [_packed(context[a:b], word[a:b], count[a:b]) for a, b in zip(begin, end, strict=True)]
        columns = [pa.array(parts, pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["part", "words", "body"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64))
        for batch in batches:
            data, offsets = buffer_of(batch.column("text"))
            for a, b in row_slices(offsets):
                part = offsets[a : b + 1]
                t = Tokens(data[part[0] : part[-1]], part - part[0])
                new = _merged(plans.whole_keys(t.before, t.hash), t.before, t.hash, np.ones(len(t.hash), np.int64))
                held = _merged(*(np.concatenate(c) for c in zip(held, new, strict=True)), kind="stable")
                if len(held[0]) > HELD_PAIRS:
                    yield send(*held)
                    held = tuple(c[:0] for c in held)
        if len(held[0]):
            yield send(*held)

    return count


def _gather(plans: Plans):
    """One row for a range of pairs."""

    def gather(table: pa.Table) -> pa.Table:
        found = [_unpacked(r["words"], r["body"]) for r in table.to_pylist()]
        context, word, count = (
            np.concatenate(c) for c in zip(*((w[c], w[x], n) for w, (c, x, n) in found), strict=True)
        )
        _, context, word, count = _merged(plans.whole_keys(context, word), context, word, count)
        words, body = _packed(context, word, count)
        return pa.table(
            {"block": table.column("part")[:1], "words": pa.array([words], pa.binary()), "body": pa.array([body], pa.binary())}
        )

    return gather


@lru_cache(maxsize=4)
def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers up to ``SOLO``: [customers, tables]."""
    out = np.full((SOLO + 1, SOLO + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, SOLO + 1)
    for n in range(1, SOLO):
        with np.errstate(divide="ignore"):
            stay = out[n, 1:] + np.log(np.maximum(n - t * discount, 0))
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay)
    return out


def resample(
    keys: np.ndarray, customers: np.ndarray, spare: np.ndarray, prob: np.ndarray, discount: float, salt: int
) -> np.ndarray:
    """Tables of each dish, drawn given all others.

    ``spare`` is the weight of a new table before the dish has any (strength plus discount times the tables of the
    others), ``prob`` the parent's probability of the dish. Up to ``SOLO`` customers t tables have the weight
    S(c, t) spare (spare + d) ... (spare + (t - 1) d) prob^t; further customers follow as in :func:`seats`.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    few = np.minimum(customers, SOLO)
    with np.errstate(over="ignore"):
        draw = (mix(keys ^ U64(salt * 0xD1B54A32D192ED03 & (2**64 - 1))) >> U64(11)) * 2.0**-53
    order = np.argsort(few.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(few[order], np.arange(2, SOLO + 2))
    for c in range(2, SOLO + 1):
        mine = order[bounds[c - 2] : bounds[c - 1]]
        stirling = _log_stirling(discount)[c, 1 : c + 1, None]
        for at in np.split(mine, range(1 << 13, len(mine), 1 << 13)):
            # A row for each number of tables, a column for each dish.
            step = np.log(spare[at] + discount * np.arange(c)[:, None]) + np.log(prob[at])
            weight = stirling + np.cumsum(step, axis=0)
            weight = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
            out[at] = 1 + (weight[:-1] <= draw[at] * weight[-1]).sum(axis=0)
    many = np.flatnonzero(customers > SOLO)
    if len(many):
        out[many] = seats(
            keys[many], customers[many], (spare * prob)[many], discount, salt, discount * prob[many], out[many]
        )
    return out


def seats(
    keys: np.ndarray,
    customers: np.ndarray,
    new: np.ndarray,
    discount: float,
    salt: int,
    growth: np.ndarray | None = None,
    begun: np.ndarray | None = None,
) -> np.ndarray:
    """Tables after the customers of each dish sat down one by one; ``new`` is the weight of a new table, which
    grows by ``growth`` with each. With ``begun`` the first ``SOLO`` sit already, at that many tables.

    Each dish draws from a sequence of its own, begun at its key, so the result is the same in any company.
    """
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], new[order]
    more = np.zeros(len(c)) if growth is None else growth[order]
    tables = (np.minimum(c, 1) if begun is None else begun[order]).astype(np.float64)
    with np.errstate(over="ignore"):
        state = mix(keys[order] + U64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1)))

    def chance(n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            state[:n] *= U64(6364136223846793005)
            state[:n] += U64(1442695040888963407)
        return (state[:n] >> U64(11)) * 2.0**-53

    j = 1 if begun is None else SOLO
    while n := int(np.searchsorted(-c, -j)):  # dishes with a customer left
        weight = a[:n] + more[:n] * tables[:n]
        if j < SOLO:
            odds = weight / (np.maximum(j - discount * tables[:n], 1 - discount) + weight)
            tables[:n] += chance(n) < odds
            j += 1
            continue
        group = np.minimum(c[:n] - j, j)
        odds = weight / (np.maximum(j + group // 2 - discount * tables[:n], 1 - discount) + weight)
        mean = group * odds
        swing = np.sqrt(mean * (1 - odds)) * 3.46 * (chance(n) - 0.5)
        tables[:n] += np.clip(np.floor(np.where(mean > 10, mean + swing, mean) + chance(n)), 0, group)
        j *= 2
    out = np.empty(len(c), np.int64)
    out[order] = tables
    return out


def _sums(
    keys: np.ndarray, extra: list[np.ndarray], kind: str | None = "stable"
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(order, runs, sum of each array per run of equal keys); the stable ``kind`` is fast on keys in ordered runs."""
    order = np.argsort(keys, kind=kind)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return order, at, [np.add.reduceat(e[order].astype(np.int64), at) for e in extra]


def _back(order: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(at, len(order))))
    return out


def _owner(order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks one of the entries of each key."""
    out = np.zeros(len(order), np.uint8)
    out[order[at]] = 1
    return out


@dataclass(frozen=True)
class Totals:
    tokens: int
    words: int
    #: Customers and tables of the parent, per chain.
    customers: tuple[int, ...] = (0,) * SAMPLES
    tables: tuple[int, ...] = (0,) * SAMPLES
    #: Tables of the parent that its last seating was given.
    given: tuple[int, ...] = (0,) * SAMPLES

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)


def parent_tables(keys: np.ndarray, customers: np.ndarray, given: int, base: float, salt: int) -> np.ndarray:
    """The parent's seating of the customers that contexts sent it, given its tables of the sweep before."""
    spare = np.full(len(keys), PARENT_STRENGTH + PARENT_DISCOUNT * max(given - 1, 0))
    return resample(keys, customers, spare, np.full(len(keys), base), PARENT_DISCOUNT, salt)


def parent(totals: Totals, customers: np.ndarray, tables: np.ndarray, chain: int) -> np.ndarray:
    """The parent's probability of words."""
    spare = PARENT_STRENGTH + PARENT_DISCOUNT * totals.tables[chain]
    known = np.maximum(customers - PARENT_DISCOUNT * tables, 0)
    return (known + spare * totals.base) / (PARENT_STRENGTH + totals.customers[chain])


def _salt(kind: int, sweep: int, chain: int) -> int:
    return kind + 10_000_019 * (sweep * SAMPLES + chain)


def _owned_sums(table: DataFrame, kinds: list) -> list[int]:
    """Sums of the arrays of replies over the entries marked as owned, one per key; the mark is the last array."""

    def add(batches):
        total = np.zeros(len(kinds), np.int64)
        for batch in batches:
            for reply in batch.column(0).to_pylist():
                *arrays, own = expand_all(reply, kinds)
                mark = own.astype(bool)
                total += [*(int(a[mark].sum(dtype=np.int64)) for a in arrays), int((arrays[0][mark] > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in total], [f"s{i}" for i in range(len(kinds))])

    names = [f"s{i}" for i in range(len(kinds))]
    row = table.select("reply").mapInArrow(add, ", ".join(f"{n} long" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    return [row[n] or 0 for n in names]


#: Training tokens of a word, then per chain its tables as a context and its customers in the parent.
_SUMS = [np.int64] * (1 + 2 * SAMPLES)
#: The same; per chain the parent's tables, for one entry of each word; owner.
_STATE = [*_SUMS, *[np.int64] * SAMPLES, np.uint8]
#: What texts are told of a word: the sums, and per chain the parent's tables.
_KNOWN = [*_SUMS, *[np.int64] * SAMPLES]
#: Customers of a pair, and its tables in all chains together.
_PAIR = [np.int64, np.int64]


def _seat_parent(given: tuple[int, ...] | None, base: float, sweep: int):
    """Sums per word, and the parent's seating of the customers that its contexts send."""

    def answer(keys: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
        order, at, sums = _sums(keys, extra)
        key, own = keys[order][at], _owner(order, at)
        customers = sums[1 + SAMPLES :]
        if given is None:  # the start: a table for each word
            seated = [np.minimum(c, 1) for c in customers]
        else:
            seated = [parent_tables(key, c, given[s], base, _salt(31, sweep, s)) for s, c in enumerate(customers)]
        return [
            *(_back(order, at, v) for v in sums),
            *(_back(order, at, v) * own for v in seated),  # for the totals; others seat their words again
            own,
        ]

    return answer


def _word_table(plans: Plans, totals: Totals, sweep: int):
    """A row for a range of words, each word once: its state, and as ``reply`` what totals are summed from."""
    seat = _seat_parent(totals.tables, totals.base, sweep)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part, bits = rows[0]["part"], plans.words.part_bits
        keys = np.concatenate([plans.words.unpack(r["keys"]) for r in rows])
        parts = zip(*(expand_all(r["extra"], _SUMS) for r in rows), strict=True)
        found = seat(keys, [np.concatenate(p) for p in parts])
        mine = np.flatnonzero(found[-1])
        mine = mine[np.argsort(keys[mine])]
        found = [f[mine] for f in found]
        words = keys[mine] >> U64(bits) | U64(part << (64 - bits) if bits else 0)
        sums = found[: len(_SUMS)]
        # Seated by whole keys, as sweeps do; once here, not in every block of texts.
        seated = [
            parent_tables(words, c, totals.tables[s], totals.base, _salt(31, sweep, s)) for s, c in enumerate(sums[1 + SAMPLES :])
        ]
        out = _as_table([(-1 - part, -1, plans.words.pack(words), squeeze(*sums, *seated))])
        return out.append_column("reply", pa.array([squeeze(*found)], pa.binary()))

    return lambda table: tidily(gather, table)


def _questions_of(p: Pairs, chains: list[np.ndarray], plans: Plans) -> list[tuple]:
    """Rows of sums per word for the word ranges."""
    extra = [p.per_word(p.word, p.count), *(p.per_word(p.context, c) for c in chains), *(p.per_word(p.word, c) for c in chains)]
    parts, begin, end = plans.words.runs(p.words)
    return [
        (int(part), p.block, plans.words.pack(p.words[a:b]), squeeze(*(e[a:b] for e in extra)))
        for part, a, b in zip(parts, begin, end, strict=True)
    ]


def _as_table(rows: list[tuple]) -> pa.Table:
    kinds = {"part": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "extra": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})


def _start(plans: Plans):
    """A table for each pair, in all chains."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = Pairs(row, plans)
                yield from _as_table(_questions_of(p, [np.ones_like(p.count)] * SAMPLES, plans)).to_batches()

    return ask


def _sweep(plans: Plans, totals: Totals, sweep: int):
    """New tables of every pair, as a row of part -1, and the sums that follow from them.

    In the last sweep that row holds what texts ask for: keys, customers and the tables of all chains together.
    """

    def ask(table: pa.Table, got: pa.Table) -> pa.Table:
        if not len(table):
            return _as_table([])
        p = Pairs(table.to_pylist()[0], plans)
        state = reply_of(got, "state", _STATE)
        held = got.filter(pa.compute.equal(got.column("tag"), "seats")).column("reply")
        before = expand_all(held[0].as_py(), [np.int64] * SAMPLES) if len(held) else [np.ones_like(p.count)] * SAMPLES
        many = np.flatnonzero(p.count > 1)
        needed, place = np.unique(p.word[many], return_inverse=True)
        chains = []
        for s in range(SAMPLES):
            others = state[1 + s][p.context[many]] - before[s][many]
            customers = state[1 + SAMPLES + s][needed]
            seated = parent_tables(p.words[needed], customers, totals.given[s], totals.base, _salt(31, sweep - 1, s))
            prob = parent(totals, customers, seated, s)[place]
            tables = np.ones_like(p.count)
            tables[many] = resample(
                p.keys[many], p.count[many], STRENGTH + DISCOUNT * others, prob, DISCOUNT, _salt(7, sweep, s)
            )
            chains.append(tables)
        seated = (b"", squeeze(*chains))
        if sweep == SWEEPS:
            seated = (b"", _told(plans.pairs, p.keys, [p.count, sum(chains)]))
        return _as_table([(-1, p.block, *seated), *_questions_of(p, chains, plans)])

    return lambda a, b: tidily(ask, a, b)


def _ask(plans: Plans):
    """Pairs and words of a block of texts by range; those of words have parts below 0."""

    def ask(table: pa.Table) -> pa.Table:
        b, block = Block(table, plans), table.column("block")[0].as_py()
        pairs = [(int(p), block, plans.pairs.pack(b.pairs[i:j]), b"") for p, i, j in zip(*plans.pairs.runs(b.pairs), strict=True)]
        words = [(-1 - int(p), block, plans.words.pack(b.words[i:j]), b"") for p, i, j in zip(*plans.words.runs(b.words), strict=True)]
        return _as_table(pairs + words)

    return lambda table: tidily(ask, table)


def _answer(plans: Plans):
    """Replies to the questions of a range from its rows of block -1; keys that these lack have zeros."""

    def known_pairs(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
        if not rows:
            return np.zeros(0, U64), [np.zeros(0, np.int64) for _ in _PAIR]
        return _heard(plans.pairs, rows[0]["extra"], len(_PAIR))

    def known_words(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
        if not rows:
            return np.zeros(0, U64), [np.zeros(0, np.int64) for _ in _KNOWN]
        return plans.words.unpack(rows[0]["keys"]), expand_all(rows[0]["extra"], _KNOWN)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part = rows[0]["part"]
        plan, known, tag = (plans.pairs, known_pairs, "pairs") if part >= 0 else (plans.words, known_words, "words")
        keys, numbers = known([r for r in rows if r["block"] < 0])
        numbers = [np.append(n, 0) for n in numbers]
        rows = [r for r in rows if r["block"] >= 0]
        replied = []
        for row in rows:
            asked = plan.unpack(row["keys"])
            at = np.searchsorted(keys, asked)
            at[np.append(keys, ~U64(0))[at] != asked] = len(keys)
            replied.append(squeeze(*(n[at] for n in numbers)))
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows], pa.int32()),
                "part": pa.array([part if part >= 0 else -1 - part] * len(rows), pa.int32()),
                "reply": pa.array(replied, pa.binary()),
                "tag": pa.array([tag] * len(rows), pa.string()),
            }
        )

    return lambda table: tidily(answer, table)


def score(docs: DataFrame, train: str = "train") -> DataFrame:
    """Per row of (doc_id, text, train): n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(train).alias("train"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = (size[0] or 0) + 2 * size[1]
    plans = Plans(layout(total, 0.01), layout(total, 0.005, 8))
    counted = texts.where("train").select("text").mapInArrow(_pair_counts(plans), "part int, words binary, body binary")
    gather = _gather(plans)
    pairs = materialize(
        counted.groupBy("part").applyInArrow(lambda table: tidily(gather, table), "block int, words binary, body binary"),
        "pairs",
    )
    free_shuffles(spark)

    asked = materialize(pairs.mapInArrow(_start(plans), _QUESTION), "asked")
    state = materialize(replies(asked, plans.words, _seat_parent(None, 1.0, 0), _SUMS), "state")
    totals, seats = _totals(state, (0,) * SAMPLES), None
    discard(asked)
    free_shuffles(spark)
    for sweep in range(1, SWEEPS + 1):
        known = tagged(state=state)
        if seats is not None:
            known = known.unionByName(tagged(seats=seats.withColumnRenamed("extra", "reply")))
        drawn = pairs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_sweep(plans, totals, sweep), _QUESTION)
        asked = materialize(drawn, "asked")
        discard(state)
        if seats is not None:
            discard(seats)
        free_shuffles(spark)
        sent = asked.where("part >= 0")
        if sweep < SWEEPS:
            sums = replies(sent, plans.words, _seat_parent(totals.tables, totals.base, sweep), _SUMS)
        else:
            sums = sent.groupBy("part").applyInArrow(_word_table(plans, totals, sweep), f"{_QUESTION}, reply binary")
        state = materialize(sums, "state")
        totals = _totals(state, totals.tables)
        seats = materialize(asked.where("part < 0"), "seats")
        discard(asked)
        free_shuffles(spark)
    discard(pairs)

    known = [seats.select(F.col("block").alias("part"), F.lit(-1).alias("block"), "keys", "extra")]
    known.append(state.select("part", "block", "keys", "extra"))
    dealt = in_blocks(texts.select("doc_id", "text"), ["doc_id", "text"], plans.pairs)
    passes = min(PASSES, plans.pairs.blocks)
    out = None
    for share in range(passes):
        scored = _scored(dealt.where(F.col("block") % passes == share), known, plans, totals)
        if passes > 1:
            scored = materialize(scored, "scored")
            free_shuffles(spark)
        out = scored if out is None else out.unionByName(scored)
    if passes > 1:
        discard(seats)
        discard(state)
    return out


def _scored(dealt: DataFrame, known: list[DataFrame], plans: Plans, totals: Totals) -> DataFrame:
    """Figures of the texts of some blocks, whose questions meet the rows ``known`` of pairs and words."""
    asking = dealt.groupBy("block").applyInArrow(_ask(plans), _QUESTION)
    for table in known:
        asking = asking.unionByName(table)
    answers = asking.groupBy("part").applyInArrow(_answer(plans), "block int, part int, reply binary, tag string")
    finish = _finish(plans, totals)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda a, b: tidily(finish, a, b),
        f"doc_id {dict(dealt.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, perplexity double",
    )


def _totals(state: DataFrame, given: tuple[int, ...]) -> Totals:
    tokens, *rest = _owned_sums(state, _STATE)
    return Totals(tokens, rest[-1], tuple(rest[SAMPLES : 2 * SAMPLES]), tuple(rest[2 * SAMPLES : 3 * SAMPLES]), given)


def _finish(plans: Plans, totals: Totals):
    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(table, plans)
        n = len(table)
        per = lambda v: np.bincount(b.row, v, n)
        tokens, *state = reply_of(got, "words", _KNOWN)
        base = np.log10((tokens + 1.0) / (totals.tokens + 1.0 * (totals.words + 1)))
        # Followers of a context: of a word its training tokens, of the beginning the training texts.
        after = tokens.copy()
        after[b.begin] = tokens[b.end]
        count, tables = reply_of(got, "pairs", _PAIR)
        mean = count - DISCOUNT * tables / SAMPLES
        for s in range(SAMPLES):
            prob = parent(totals, state[SAMPLES + s], state[2 * SAMPLES + s], s)
            mean += (STRENGTH + DISCOUNT * state[s])[b.pair_context] * prob[b.pair_word] / SAMPLES
        mean /= STRENGTH + after[b.pair_context]
        score = per((np.log10(mean) if totals.tokens else np.zeros(len(mean)))[b.pair])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_tokens": pa.array(b.per_row.astype(np.int64)),
                "n_known": pa.array(per(tokens[b.word] > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, totals.tokens, np.int64)),
                "base_score": pa.array(per(base[b.word])),
                "score": pa.array(score),
                "perplexity": pa.array(10 ** (-score / b.per_row)),
            }
        )

    return finish
