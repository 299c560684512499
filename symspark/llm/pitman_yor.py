"""Language-model scoring with a hierarchical Pitman-Yor process over words.

Each word opens a restaurant for the words after it (a bigram context); the restaurants share their
parent, the word restaurant, whose parent is a spelling model: restaurants of byte contexts of length 2, 1
and 0 over a uniform base (Teh 2006; a nested process, Mochihashi et al. 2009). A table of a restaurant
is a customer of its parent. The empty word is the end of a text, which starts after a context of its own.

The FREQUENT commonest words have dishes and contexts of their own. All other words are one dish, "rare",
and one context; which of them it is comes from a restaurant of the rare words, again over the spelling
model, so that probabilities still sum to one over all strings and unknown words are spelt.

Seating is sampled by Gibbs sweeps. All customers of a dish leave and are seated again one by one, each at
a new table with probability mass / (mass + customers - discount * tables), where mass = (strength +
discount * tables of the restaurant) * the parent's probability. Within a sweep dishes are reseated side by side,
given the other dishes and the parents as the sweep before left them. Predictions are averaged over the sweeps kept.

Counts of word pairs are distributed, as many as the corpus has; only arrays as long as the list of frequent words, and
the 257^3 cells of the spelling model, reach the driver or are broadcast. Pairs that occur once in training and not elsewhere have
one customer at one table whatever the sweep: they are only counted, by context and by dish.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import array_rows, pack, sum_arrays, unpack
from .store import remove, save
from .textops import LOWER_TABLE, U64, cuts, list_array, mix, pieces, words_of_bytes

#: Discount and strength of the context restaurants, the word restaurants and the spelling restaurants.
CONTEXT_DISCOUNT, CONTEXT_STRENGTH = 0.75, 5.0
DISCOUNT, STRENGTH = 0.5, 10.0
SPELL_DISCOUNT, SPELL_STRENGTH = 0.3, 1.0
#: Gibbs sweeps in all, and how many of them at the end are averaged.
SWEEPS, KEPT = 4, 2
#: Words with dishes and contexts of their own, at most.
FREQUENT = 1 << 18
#: Commonest pairs whose probabilities are broadcast (16 bytes each) at most; the others are looked up in their buckets.
HOT_PAIRS = 1 << 18
#: Dishes from which on down they are seated one after the other rather than side by side; customers that are seated one by one before any jump.
FEW, FIRST = 64, 12
#: Bits of a dish in the code of a pair (FREQUENT and two more), and of a code.
DISH_BITS, CODE_BITS = 19, 38
_TIMES = 0x9E3779B97F & ((1 << CODE_BITS) - 1) | 1
_BACK, _CODE_MASK = U64(pow(_TIMES, -1, 1 << CODE_BITS)), U64((1 << CODE_BITS) - 1)
#: Rows whose sums travel together.
STRETCH = 8192
#: Tokens that a task packs at once, and that a bucket of pairs holds on average at most.
CHUNK, BUCKET = 1 << 20, 1 << 22
SYMBOLS = 257  # the bytes and the end of a word, which is also the context before its first byte
END_HASH = 0


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - np.log(product)


def _seat_on(c: float, a: float, discount: float, n: float, t: int, seed: int) -> int:
    """The same for one dish, from n customers at t tables on: customer by customer where tables open often, else by jumps."""
    draw, log_gamma = random.Random(seed).random, math.lgamma
    while n < c:
        shift = discount * t
        p = a / (a + n - shift)
        if p > 0.05:
            n += 1
            t += draw() < p
            continue
        goal = math.log(1 - draw()) + log_gamma(n - shift) - log_gamma(a + n - shift)
        if log_gamma(c - shift) - log_gamma(a + c - shift) >= goal:
            break
        low, wide = n, 1.0
        while (high := min(c, low + wide)) < c and log_gamma(high - shift) - log_gamma(a + high - shift) >= goal:
            low, wide = high, wide * 2
        while high - low > 1:
            middle = (low + high) // 2
            if log_gamma(middle - shift) - log_gamma(a + middle - shift) < goal:
                high = middle
            else:
                low = middle
        n, t = high, t + 1
    return t


def draw_tables(counts: np.ndarray, mass: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers are seated one by one.

    `mass` and the discount stand for the rest of the restaurant. With n customers at t tables the next one opens a table with probability mass / (mass + n - discount * t).
    Between two openings t stands still, so that the customer who opens the next table is drawn at once, by
    inverting the product of the chances that none does. `seeds` make the draw a function of the dish, so that a lost task
    repeats it exactly.
    """
    tables = np.minimum(counts, 1).astype(np.int64)
    live, step = np.flatnonzero(counts > 1), 0
    a, c, t = np.maximum(mass[live], 1e-300), counts[live].astype(np.float64), np.ones(len(live))
    for step in range(1, FIRST):  # the first customers one by one
        if not len(live):
            return tables
        u = ((mix(seeds[live] + U64(step)) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
        t += u * (a + step - discount * t) < a
        more = c > step + 1
        tables[live[~more]] = t[~more]
        live, a, c, t = live[more], a[more], c[more], t[more]
    tables[live] = t
    n = np.full(len(live), float(FIRST))
    while len(live):
        if len(live) <= FEW:
            tables[live] = [_seat_on(*x) for x in zip(c.tolist(), a.tolist(), [discount] * len(live), n.tolist(), tables[live].tolist(), seeds[live].tolist(), strict=True)]
            break
        step += 1
        u = ((mix(seeds[live] + U64(step)) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
        shift = discount * tables[live]
        goal = np.log(u) + _log_gamma(n - shift) - _log_gamma(a + n - shift)
        rest = lambda m, shift=shift, a=a: _log_gamma(m - shift) - _log_gamma(a + m - shift)
        opens = rest(c) < goal
        live, n, a, c, shift, goal = live[opens], n[opens], a[opens], c[opens], shift[opens], goal[opens]
        low, high = n.copy(), c.copy()  # nobody up to `low` opens a table; somebody up to `high` does
        while len(live) and (wide := high - low > 1).any():
            middle = np.where(wide, np.floor((low + high) / 2), high)
            under = rest(middle, shift, a) < goal
            low, high = np.where(under, low, middle), np.where(under, middle, high)
            low = np.where(wide, low, high - 1)
        n = high
        tables[live] += 1
        more = n < c
        live, n, a, c = live[more], n[more], a[more], c[more]
    return tables


class Spelling:
    """Predictive probabilities of the byte restaurants of one sweep."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, before: Spelling | None, sweep: int):
        d, s = SPELL_DISCOUNT, SPELL_STRENGTH
        uniform = np.full(SYMBOLS, 1.0 / SYMBOLS)
        old0 = before.p0 if before else uniform
        old1 = before.p1 if before else np.tile(uniform, (SYMBOLS, 1))
        ctx2, sym = keys // SYMBOLS, keys % SYMBOLS
        t2 = draw_tables(customers, self._mass(ctx2, customers, old1[ctx2 % SYMBOLS, sym], d, s), d, mix(keys.astype(U64) + U64(sweep << 40)))
        flat = (ctx2 % SYMBOLS) * SYMBOLS + sym
        c1 = np.bincount(flat, weights=t2, minlength=SYMBOLS * SYMBOLS).astype(np.int64)
        k1 = np.flatnonzero(c1)
        t1 = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        t1[k1] = draw_tables(c1[k1], self._mass(k1 // SYMBOLS, c1[k1], old0[k1 % SYMBOLS], d, s), d, mix(k1.astype(U64) + U64((sweep << 40) + 1)))
        c0 = t1.reshape(SYMBOLS, SYMBOLS).sum(axis=0)
        k0 = np.flatnonzero(c0)
        t0 = np.zeros(SYMBOLS, dtype=np.int64)
        t0[k0] = draw_tables(c0[k0], self._mass(np.zeros(len(k0), dtype=np.int64), c0[k0], uniform[k0], d, s), d, mix(k0.astype(U64) + U64((sweep << 40) + 2)))
        self.p0 = (np.maximum(c0 - d * t0, 0) + (s + d * t0.sum()) * uniform) / (s + c0.sum())
        c1, t1 = c1.reshape(SYMBOLS, SYMBOLS), t1.reshape(SYMBOLS, SYMBOLS)
        self.p1 = (np.maximum(c1 - d * t1, 0) + (s + d * t1.sum(axis=1, keepdims=True)) * self.p0) / (s + c1.sum(axis=1, keepdims=True))
        total = np.bincount(ctx2, weights=customers, minlength=SYMBOLS * SYMBOLS)
        tables = np.bincount(ctx2, weights=t2, minlength=SYMBOLS * SYMBOLS)
        self.back = (s + d * tables) / (s + total)
        self.keys, self.own = keys, (customers - d * t2) / (s + total[ctx2])

    @staticmethod
    def _mass(context: np.ndarray, customers: np.ndarray, base: np.ndarray, d: float, s: float) -> np.ndarray:
        """Mass for new tables of each dish, with the tables of its restaurant at the mean they would have."""
        total = np.bincount(context, weights=np.minimum(customers, np.maximum(1.0, customers.astype(np.float64) ** d)))
        return (s + d * total[context]) * base

    def log10(self, symbols: np.ndarray, contexts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of words given as symbols laid end to end; contexts: the two symbols before each as one number."""
        p = self.back[contexts] * self.p1[contexts % SYMBOLS, symbols]
        if len(self.keys):
            key = contexts * SYMBOLS + symbols
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p += np.where(self.keys[at] == key, self.own[at], 0)
        return np.add.reduceat(np.log10(p), starts)


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the words (bytes, then the end), the two symbols before each, and where each word starts."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    size = np.diff(bounds) + 1
    starts = np.cumsum(size) - size
    symbols = np.full(int(size.sum()), 256, dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[starts + size - 1] = False
    symbols[inside] = raw
    one, two = np.full(len(symbols), 256, dtype=np.int64), np.full(len(symbols), 256, dtype=np.int64)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    one[starts] = 256
    two[starts] = 256
    second = starts[size > 1] + 1
    two[second] = 256
    return symbols, two * SYMBOLS + one, starts


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a task's texts, and the ends of the texts, with their counts; a word's bytes are cut out once."""
    seen, parts, fresh, texts, ends = np.zeros(0, dtype=U64), [], [], [], 0
    for batch in batches:
        ends += batch.num_rows
        for i, j, data, bounds in pieces(batch.column(0)):
            spans = [(a, b, np.array([0, b - a])) for a, b in cuts(data)] if j - i == 1 else [(0, len(data), bounds)]
            for a, b, inner in spans:
                h, start, end, _ = words_of_bytes(data[a:b], inner)
                if not len(h):
                    continue
                value = np.sort(h)
                first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                parts.append((value[first], np.diff(np.append(first, len(value)))))
                value = value[first]
                new = value[~np.isin(value, seen, assume_unique=True)]
                at = np.flatnonzero(Lookup(new, 64)(h) < len(new))
                own, first = np.unique(h[at], return_index=True)
                low = data[a:b].tobytes().translate(LOWER_TABLE)
                texts.append(pa.array([low[x:y] for x, y in zip(start[at[first]].tolist(), end[at[first]].tolist(), strict=True)], type=pa.binary()))
                fresh.append(own)
                seen = np.sort(np.concatenate((seen, own)))
    if not ends:
        return
    fresh.append(np.array([END_HASH], dtype=U64))
    texts.append(pa.array([b""], type=pa.binary()))
    parts.append((fresh[-1], np.array([ends])))
    value, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
    # a word whose hash is that of the end would share its row, as words of one hash do
    own, first = np.unique(np.concatenate(fresh), return_index=True)
    words = pa.concat_arrays(texts).take(pa.array(first))
    for at in range(0, len(value), 50_000):
        to = at + 50_000
        yield pa.RecordBatch.from_arrays([pa.array(value[at:to].view(np.int64)), words[at:to], pa.array(counts[at:to])], names=["h", "word", "c"])


@dataclass
class Words:
    """The frequent words (hashes in rising order, counts) and the totals: N training tokens of V kinds, customers of the rare restaurant."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    rare: int

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The dish of each word: its place in the list, or the number of frequent words for a rare one."""
        if "_found" not in self.__dict__:
            self._found = Lookup(self.hashes, 64)
        return self._found(h)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_found"}


def parted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and dish of plain codes."""
    return (code >> U64(DISH_BITS)).astype(np.int64), (code & U64((1 << DISH_BITS) - 1)).astype(np.int64)


@dataclass
class Seating:
    """The context restaurants in one sweep: what dishes were drawn from (tables of each context and the parent's predictions as the sweep
    before left them, None in the first) and what came of it (the same, and the customers of each context)."""

    number: int
    tables_before: np.ndarray | None
    parent_before: np.ndarray | None
    customers: np.ndarray
    tables: np.ndarray
    parent: np.ndarray

    def pair_tables(self, code: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Tables of pairs as this sweep seats them; one each in the first."""
        if self.tables_before is None:
            return np.minimum(c, 1)
        u, w = parted(code)
        mass = (CONTEXT_STRENGTH + CONTEXT_DISCOUNT * self.tables_before[u]) * self.parent_before[w]
        return draw_tables(c, mass, CONTEXT_DISCOUNT, mix(code ^ U64(self.number * 0x9E3779B9 + 1)))

    def predict(self, code: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Probability of each pair's dish after its context; c: customers of the pair."""
        u, w = parted(code)
        own = np.where(c > 0, c - CONTEXT_DISCOUNT * self.pair_tables(code, c), 0)
        return (own + (CONTEXT_STRENGTH + CONTEXT_DISCOUNT * self.tables[u]) * self.parent[w]) / (CONTEXT_STRENGTH + self.customers[u])


@dataclass
class Rare:
    """The rare restaurant in one sweep: the spelling model its dishes were drawn from (None in the first), that model's mass
    outside the frequent words and the tables there were."""

    number: int
    spelling: Spelling | None
    outside: float
    tables: float

    def seats(self, h: np.ndarray, c: np.ndarray, words: pa.Array) -> np.ndarray:
        if self.spelling is None:
            return np.minimum(c, 1)
        base = np.zeros(len(h))
        many = np.flatnonzero(c > 1)
        if len(many):
            base[many] = 10.0 ** self.spelling.log10(*spell(words.take(pa.array(many)))) / self.outside
        return draw_tables(c, (STRENGTH + DISCOUNT * self.tables) * base, DISCOUNT, mix(h ^ U64(self.number * 0x9E37 + 7)))


@dataclass
class State:
    """A sweep kept: the context restaurants, the rare one, and the spelling model it leaves with its mass outside the frequent words and the rare restaurant's tables."""

    seating: Seating
    rare: Rare
    spelling: Spelling
    outside: float
    rare_tables: float

    def rare_back(self, customers: int) -> float:
        """What of the rare restaurant goes to the spelling model, for a word's share of the model's mass outside the frequent words."""
        return (STRENGTH + DISCOUNT * self.rare_tables) / (STRENGTH + customers) / self.outside

    def predict(self, code: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.seating.predict(code, c)


@contextmanager
def _shared(spark: SparkSession, value):
    """A broadcast for the jobs run inside, whose files go with them."""
    made = spark.sparkContext.broadcast(value)
    try:
        yield made
    finally:
        made.destroy()


def _tokens(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, last + 1; word hashes with an end after each text, the row of each, tokens of each row; bytes, start and end of the words."""
    for i, j, data, bounds in pieces(batch.column(text_at)):
        if j - i == 1:
            parts = [(a, words_of_bytes(data[a:b], np.array([0, b - a]))) for a, b in cuts(data)] or [(0, words_of_bytes(data, np.array([0, 0])))]
            h = np.concatenate([p[0] for _, p in parts])
            start, end = (np.concatenate([p[k] + a for a, p in parts]) for k in (1, 2))
            counts = np.array([len(h)])
        else:
            h, start, end, counts = words_of_bytes(data, bounds)
        ends = np.cumsum(counts)
        h = np.insert(h, ends, U64(END_HASH))
        start, end = np.insert(start, ends, 0), np.insert(end, ends, 0)
        yield i, j, h, np.repeat(np.arange(j - i), counts + 1), counts + 1, data.tobytes().translate(LOWER_TABLE), start, end


def mixed(code: np.ndarray) -> np.ndarray:
    """Codes dealt evenly over their range, a bijection; buckets are stretches of it."""
    return (code * U64(_TIMES)) & _CODE_MASK


def plain(code: np.ndarray) -> np.ndarray:
    return (code * _BACK) & _CODE_MASK


def _codes(ids: np.ndarray, counts: np.ndarray, frequent: int) -> np.ndarray:
    """Mixed codes of the pairs of a run of rows: each dish with the one before it, or with the start of a text."""
    before = np.empty(len(ids), dtype=np.int64)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = frequent + 1
    return mixed((before.astype(U64) << U64(DISH_BITS)) | ids.astype(U64))


def _edges(code: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among mixed codes in rising order, and the end of the last."""
    return np.append(np.searchsorted(code, np.array([-(-(b << CODE_BITS) // buckets) for b in range(buckets)], dtype=U64)), len(code))


class Lookup:
    """Places of evenly dealt numbers of `bits` bits in a rising list, or its length: a table by the first bits, then a short walk."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift = keys, U64(bits - min(bits, max(8, len(keys).bit_length() + 2)))
        slots = 1 << (bits - int(self.shift))
        self.first = np.searchsorted(keys >> self.shift, np.arange(slots + 1, dtype=U64)).astype(np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), len(self.keys), dtype=np.int64)
        if not len(self.keys):
            return out
        slot = (x >> self.shift).astype(np.int32)
        at, end = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            hit = self.keys[at] == x[todo]
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return out


_BLOBS = "bucket int, blob binary"


def _pair_rows(shared, buckets: int):
    """Pairs of a task's texts with their counts in training and elsewhere, packed by bucket."""

    def packed(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code = np.sort(np.concatenate(codes))  # with the training mark as the last bit
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n, code = np.diff(np.append(first, len(code))), code[first]
        taught, code = n * (code & U64(1)).astype(np.int64), code >> U64(1)
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        taught, n, code = np.add.reduceat(taught, first), np.add.reduceat(n, first), code[first]
        edges = _edges(code, buckets)
        for b in np.flatnonzero(np.diff(edges)):
            at = slice(edges[b], edges[b + 1])
            yield pa.RecordBatch.from_arrays([pa.array([b], type=pa.int32()), pa.array([pack(code[at], taught[at], n[at] - taught[at])], type=pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        codes, size = [], 0
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, h, row, counts, *_ in _tokens(batch, 0):
                codes.append((_codes(words.ids(h), counts, len(words.hashes)) << U64(1)) | train[i:j][row].astype(U64))
                size += len(h)
                if size >= CHUNK:
                    yield from packed(codes)
                    codes, size = [], 0
        if size:
            yield from packed(codes)

    return run


def _merged_pairs(frequent: int):
    """From the blobs of a bucket: its pairs of training with two customers or more, or one and another text; and, as arrays, what only was counted."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table["blob"]]
        code, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        taught, other = (np.bincount(inverse, weights=np.concatenate([p[k] for p in parts]).astype(np.float64)).astype(np.int64) for k in (1, 2))
        bucket = table["bucket"][0].as_py()
        single = (taught == 1) & (other == 0)
        u, w = parted(plain(code))
        arrays = [np.bincount(u[single], minlength=frequent + 2), np.bincount(w[single], minlength=frequent + 2), np.bincount(u, weights=taught, minlength=frequent + 2).astype(np.int64)]
        rows = array_rows(arrays)
        kept = (taught > 0) & ~single
        blob = pack(code[kept], taught[kept])
        return pa.table({"bucket": pa.array([bucket] + [None] * rows.num_rows, type=pa.int32()), "slot": pa.concat_arrays([pa.array([None], type=pa.int64()), rows.column(0)]), "blob": pa.concat_arrays([pa.array([blob], type=pa.binary()), rows.column(1)])})

    return run


def _seat_pairs(shared):
    """Tables by context and by dish that a sweep seats at the pairs kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Seating = shared.value
        size = len(state.parent)
        arrays = [np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)]
        for batch in batches:
            for blob in batch.column(1):
                code, c = unpack(blob.as_py())
                code = plain(code)
                t = state.pair_tables(code, c.astype(np.int64))
                for k, x in enumerate(parted(code)):
                    arrays[k] += np.bincount(x, weights=t, minlength=size).astype(np.int64)
        yield array_rows(arrays)

    return run


def _chunks(batch: pa.RecordBatch, most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for at in range(0, batch.num_rows, most):
        part = batch.slice(at, most)
        yield part.column(0).to_numpy().view(U64), part.column(2).to_numpy(), part.column(1)


def _spelling_rows(shared):
    """Customers of the spelling restaurants from the tables of the word restaurant and the rare one; under key -1 the tables of the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, state, word_tables = shared.value
        value, sums, total = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal value, sums, held
            value, inverse = np.unique(np.concatenate([value, *(x[0] for x in held)]), return_inverse=True)
            sums, held = np.bincount(inverse, weights=np.concatenate([sums, *(x[1] for x in held)]), minlength=len(value)), []

        for batch in batches:
            for h, c, text in _chunks(batch):
                dish = words.ids(h)
                rare = dish == len(words.hashes)
                tables = np.zeros(len(h), dtype=np.int64)
                at = np.flatnonzero(rare)
                tables[at] = state.seats(h[at], c[at], text.take(pa.array(at)))
                total += int(tables.sum())
                tables[~rare] = word_tables[dish[~rare]]
                symbols, contexts, starts = spell(text)
                key, inverse = np.unique(contexts * SYMBOLS + symbols, return_inverse=True)
                held.append((key, np.bincount(inverse, weights=np.repeat(tables, np.diff(np.append(starts, len(symbols)))), minlength=len(key))))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    settle()
        settle()
        n = sums.astype(np.int64)
        value, n = np.append(value[n > 0], -1), np.append(n[n > 0], total)
        yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _rare_rows(shared):
    """(h, c, own): what the rare restaurant itself gives to a rare word, averaged over the sweeps kept; 0 for frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rares = shared.value
        for batch in batches:
            for h, c, text in _chunks(batch):
                rare = (words.ids(h) == len(words.hashes)) & (c > 0)
                at = np.flatnonzero(rare)
                own, some = np.zeros(len(h)), text.take(pa.array(at))
                for r in rares:
                    own[at] += (c[at] - DISCOUNT * r.seats(h[at], c[at], some)) / (STRENGTH + words.rare) / len(rares)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(own)], names=["h", "c", "own"])

    return run


@dataclass
class LanguageModel:
    """Tables in the shared folder, of words (h, c, own) and of packed pairs by bucket; the frequent words; the sweeps kept."""

    words: DataFrame
    pairs: DataFrame
    buckets: int
    frequent: Words
    states: list[State]

    @property
    def tokens(self) -> int:
        return self.frequent.tokens

    @property
    def kinds(self) -> int:
        return self.frequent.kinds


def _above(counts: list[tuple[int, int]], most: int) -> int:
    """The least bin such that the bins from it on hold at most `most`."""
    least = total = 0
    for b, n in sorted(counts, reverse=True):
        total += n
        if total > most:
            return b + 1
        least = b
    return least


#: A count's bin: eight for each doubling.
BIN = "cast(floor(log2(c) * 8) as long)"


def _bin(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * 8).astype(np.int64)


def fit(texts: DataFrame, sweeps: int = SWEEPS, kept: int = KEPT, frequent: int = FREQUENT) -> LanguageModel:
    """Learn from the rows of (text STRING, train BOOLEAN) that are to train on.

    A null text is empty: its only token is its end. A null in `train` is false. Pairs of the other texts are only noted. With
    nothing to train on all mass is the spelling model's. Words are told apart by 64-bit hashes.
    """
    spark = texts.sparkSession
    texts = texts.select("text", F.coalesce("train", F.lit(False)).alias("train"))
    table = save(texts.where("train").select("text").mapInArrow(_word_rows, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c")), "lm-words")
    tokens, kinds = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = min(frequent, FREQUENT)
    cut = _above([tuple(r) for r in table.groupBy(F.expr(BIN).alias("b")).count().collect()], frequent)
    top = table.where(F.expr(BIN) >= cut).toArrow().combine_chunks().sort_by("h") if frequent else table.limit(0).toArrow()
    h = top["h"].to_numpy().view(U64)
    order = np.argsort(h)
    top_words = pa.concat_arrays(top["word"].chunks).take(pa.array(order)) if len(h) else pa.array([], type=pa.binary())
    counts = top["c"].to_numpy()[order].astype(np.int64)
    words = Words(h[order], counts, int(tokens), int(kinds), int(tokens) - int(counts.sum()))
    size = len(h) + 2
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(tokens) // BUCKET))
    with _shared(spark, words) as shared:
        blobs = texts.mapInArrow(_pair_rows(shared, buckets), _BLOBS)
        merged = save(blobs.groupBy("bucket").applyInArrow(_merged_pairs(len(h)), "bucket int, slot long, blob binary"), "lm-pairs")
    pairs = merged.where("bucket is not null").select("bucket", "blob")
    lone_of_context, lone_of_dish, customers = sum_arrays(merged.where("bucket is null"), [size] * 3)

    spelled = spell(top_words) if len(h) else None
    uniform = Spelling(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None, 0)

    def base_of(spelling: Spelling) -> tuple[np.ndarray, float]:
        """The spelling model's probability of each dish, the rare one's being all that is left."""
        out = np.zeros(size)
        if spelled:
            out[:-2] = 10.0 ** spelling.log10(*spelled)
        out[-2] = max(1 - out[:-2].sum(), 1e-9)
        return out, out[-2]

    states: list[State] = []
    base, outside = base_of(uniform)
    tables = dishes = spelling = None
    word_tables, rare_tables = np.zeros(size), 0.0
    for k in range(sweeps):
        seating, rare = Seating(k, tables, dishes, customers, None, base), Rare(k, spelling, outside, rare_tables)
        with _shared(spark, seating) as shared:
            by_context, by_dish = sum_arrays(pairs.mapInArrow(_seat_pairs(shared), "slot long, blob binary"), [size] * 2)
        tables, c1 = (lone_of_context + by_context).astype(np.int32), lone_of_dish + by_dish
        if k == 0:
            t1 = np.minimum(c1, 1)
        else:
            t1 = draw_tables(c1, (STRENGTH + DISCOUNT * word_tables.sum()) * base, DISCOUNT, mix(np.arange(size).astype(U64) + U64(k << 32)))
        with _shared(spark, (words, rare, t1.astype(np.int32))) as shared:
            rows = table.mapInArrow(_spelling_rows(shared), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        in_order = np.argsort(key[key >= 0])
        spelling = Spelling(key[key >= 0][in_order], n[key >= 0][in_order], spelling, k)
        base, outside = base_of(spelling)
        dishes = (np.maximum(c1 - DISCOUNT * t1, 0) + (STRENGTH + DISCOUNT * t1.sum()) * base) / (STRENGTH + c1.sum())
        seating.tables, seating.parent, word_tables, rare_tables = tables, dishes, t1, float(n[key < 0].sum())
        states = [*states[1 - kept :], State(seating, rare, spelling, outside, rare_tables)] if kept > 1 else [State(seating, rare, spelling, outside, rare_tables)]
    with _shared(spark, (words, [s.rare for s in states])) as shared:
        own = save(table.mapInArrow(_rare_rows(shared), "h long, c long, own double"), "lm-table")
    remove(table)
    return LanguageModel(own, pairs, buckets, words, states)


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(600, dtype=np.int64)
    for batch in batches:
        for blob in batch.column(1):
            total += np.bincount(_bin(unpack(blob.as_py())[1].astype(np.float64)), minlength=600)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array(total)], names=["b", "n"])


def _hot_rows(cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                code, c = unpack(blob.as_py())
                at = _bin(c.astype(np.float64)) >= cut
                yield pa.RecordBatch.from_arrays([pa.array(code[at].view(np.int64)), pa.array(c[at].view(np.int64))], names=["code", "c"])

    return run


def _averaged(states: list[Seating], code: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 of the averaged prediction of pairs given by mixed codes."""
    code = plain(code)
    return np.log10(sum(s.predict(code, c) for s in states) / len(states))


_DOCS = "at long, doc_id long, n_tokens long, known long, base double, score double, hs array<long>, ns array<int>, spelt array<double>, bucket int, at0 long, blob binary"


def _doc_rows(shared, buckets: int, columns: list[str]):
    """A row for each text: what the frequent words and the commonest pairs come to, and the other words as arrays to look up; and its other pairs, packed by bucket."""
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (x.split(" ") for x in _DOCS.split(", "))])

    def whole(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def packed(held: list[tuple[np.ndarray, np.ndarray]], at0: int, span: int) -> Iterator[pa.RecordBatch]:
        bits = U64(max(1, span.bit_length() + 1))
        key = np.sort(np.concatenate([(code << bits) | ((row - (at0 << 1)).astype(U64)) for code, row in held]))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        often, key = np.diff(np.append(first, len(key))), key[first]
        code, row = key >> bits, key & ((U64(1) << bits) - U64(1))
        edges = _edges(code, buckets)
        for b in np.flatnonzero(np.diff(edges)):
            at = slice(edges[b], edges[b + 1])
            yield whole(1, bucket=pa.array([b], type=pa.int32()), at0=pa.array([at0], type=pa.int64()), blob=pa.array([pack(code[at], row[at], often[at])], type=pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, spellings, hot, hot_score = shared.value
        hot = Lookup(hot, CODE_BITS)
        hot_score = np.append(hot_score, 0.0)
        denominator = words.tokens + words.kinds + 1
        word_base = np.append(np.log10((words.counts + 1) / denominator), 0.0)
        held, size, at0, last = [], 0, 0, 0
        for batch in batches:
            ats, train = (batch.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in ("at", "train"))
            for i, j, h, row, counts, low, start, end in _tokens(batch, columns.index("text")):
                n = j - i
                dish = words.ids(h)
                rare = dish == len(words.hashes)
                code = _codes(dish, counts, len(words.hashes))
                at = hot(code)
                score, rest = hot_score[at], at == len(hot.keys)
                if held and ats[j - 1] - at0 >= 1 << 24:  # rows and codes share 64 bits
                    yield from packed(held, at0, last - at0)
                    held, size = [], 0
                if not held:
                    at0 = int(ats[i])
                last = int(ats[j - 1])
                held.append((code[rest], (ats[i:j][row[rest]] << 1) | train[i:j][row[rest]].astype(np.int64)))
                size += int(rest.sum())
                value, inverse = np.unique(h[rare], return_inverse=True)
                _, first, often = np.unique(row[rare] * max(len(value), 1) + inverse, return_index=True, return_counts=True)
                where = np.flatnonzero(rare)[first]
                text = pa.array([low[x:y] for x, y in zip(start[where].tolist(), end[where].tolist(), strict=True)], type=pa.binary())
                letters = spell(text)
                spelt = sum(back * 10.0 ** spelling.log10(*letters) for back, spelling in spellings) / len(spellings) if len(where) else np.zeros(0)
                each = np.bincount(row[where], minlength=n)
                yield whole(
                    n, at=pa.array(ats[i:j]), doc_id=batch.column(columns.index("doc_id"))[i:j], n_tokens=pa.array(counts.astype(np.int64)), known=pa.array(np.bincount(row, weights=~rare, minlength=n).astype(np.int64)),
                    base=pa.array(np.bincount(row, weights=word_base[dish], minlength=n)), score=pa.array(np.bincount(row, weights=score, minlength=n)),
                    hs=list_array(h[where].view(np.int64), each, pa.int64()), ns=list_array(often.astype(np.int32), each, pa.int32()), spelt=list_array(spelt, each, pa.float64()),
                )
                if size >= CHUNK:
                    yield from packed(held, at0, last - at0)
                    held, size = [], 0
        if size:
            yield from packed(held, at0, last - at0)

    return run


def _bucket_scores(shared):
    """From a bucket's pairs of texts and of training: what they come to, by text. A pair that was only counted has one customer, if the text was trained on."""

    def run(table: pa.Table) -> pa.Table:
        states: list[Seating] = shared.value
        known_code, known_c, parts = np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), []
        for at0, blob in zip(table["at0"].to_pylist(), table["blob"], strict=True):
            columns = unpack(blob.as_py())
            if at0 is None:
                known_code, known_c = columns
            else:
                parts.append((columns[0], columns[1].astype(np.int64) + (at0 << 1), columns[2]))
        if not parts:
            return pa.table({"stretch": pa.array([], type=pa.int64()), "rows": pa.array([], type=pa.binary()), "sums": pa.array([], type=pa.binary())})
        code, row, often = (np.concatenate([p[k] for p in parts]) for k in range(3))
        value, inverse = np.unique(code, return_inverse=True)
        c = np.full(len(value), -1, dtype=np.int64)
        if len(known_code):
            at = np.minimum(np.searchsorted(known_code, value), len(known_code) - 1)
            c = np.where(known_code[at] == value, known_c[at].astype(np.int64), -1)
        alone = c < 0
        one = np.zeros(len(value))
        one[~alone] = _averaged(states, value[~alone], c[~alone])
        none = one.copy()
        for lp, k in ((one, 1), (none, 0)):
            lp[alone] = _averaged(states, value[alone], np.full(int(alone.sum()), k))
        lp = np.where((row & 1) == 1, one[inverse], none[inverse]) * often.astype(np.float64)
        at, inverse = np.unique(row >> 1, return_inverse=True)
        sums = np.bincount(inverse, weights=lp)
        stretch, first = np.unique(at // STRETCH, return_index=True)
        ends = np.append(first[1:], len(at))
        spans = list(zip(stretch.tolist(), first.tolist(), ends.tolist(), strict=True))
        return pa.table({"stretch": pa.array(stretch), "rows": pa.array([pack(at[a:b] - k * STRETCH) for k, a, b in spans], type=pa.binary()), "sums": pa.array([sums[a:b].tobytes() for _, a, b in spans], type=pa.binary())})

    return run


def _stretch_scores(table: pa.Table) -> pa.Table:
    """From what the buckets give to the texts of one stretch of rows: (at, s), a row for each text that has any."""
    stretch, sums, seen = table["stretch"][0].as_py(), np.zeros(STRETCH), np.zeros(STRETCH, dtype=bool)
    for rows, part in zip(table["rows"], table["sums"], strict=True):
        at = unpack(rows.as_py())[0].astype(np.int64)
        sums[at] += np.frombuffer(part.as_py(), dtype=np.float64)
        seen[at] = True
    at = np.flatnonzero(seen)
    return pa.table({"at": pa.array(at + stretch * STRETCH), "s": pa.array(sums[at])})


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` (doc_id, text and, if there, train; other columns ignored) as doc_id, n_tokens, n_known, base_score, score.

    Scores are log10 probabilities of whole texts, the end included, unknown words spelt; base_score is that of
    add-one unigrams, where all unknown words are one. `train` must say which rows the model was fitted on
    (without it: none): their pairs were counted, even those that no table keeps. Rows that repeat a
    doc_id, or lack one, are scored each; a null text is empty. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    words, states = model.frequent, model.states
    seatings = [s.seating for s in states]
    bins = [(r.b, r.n) for r in model.pairs.mapInArrow(_hot_counts, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where("n > 0").collect()]
    found = model.pairs.mapInArrow(_hot_rows(_above(bins, HOT_PAIRS)), "code long, c long").toArrow()
    hot = found["code"].to_numpy().view(U64)
    order = np.argsort(hot)
    hot, c = hot[order], found["c"].to_numpy()[order]
    train = F.coalesce("train", F.lit(False)) if "train" in docs.columns else F.lit(False)
    numbered = docs.select("doc_id", "text", train.alias("train"), F.monotonically_increasing_id().alias("at"))
    with _shared(spark, (words, [(s.rare_back(words.rare), s.spelling) for s in states], hot, _averaged(seatings, hot, c))) as shared:
        rows = save(numbered.mapInArrow(_doc_rows(shared, model.buckets, numbered.columns), _DOCS), "lm-docs")
    blobs = rows.where("blob is not null").select("bucket", "at0", "blob").union(model.pairs.select("bucket", F.lit(None).cast("long").alias("at0"), "blob"))
    with _shared(spark, seatings) as shared:
        found = save(blobs.groupBy("bucket").applyInArrow(_bucket_scores(shared), "stretch long, rows binary, sums binary"), "lm-scores")
    in_buckets = found.groupBy("stretch").applyInArrow(_stretch_scores, "at long, s double")
    texts = rows.where("blob is null")
    rest = texts.select("at", F.explode(F.arrays_zip("hs", "ns", "spelt")).alias("x")).select("at", F.col("x.hs").alias("h"), F.col("x.ns").alias("n"), F.col("x.spelt").alias("spelt"))
    looked = rest.join(model.words.withColumnsRenamed({"h": "h2"}), F.col("h") == F.col("h2"), "left").groupBy("at").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(words.tokens + words.kinds + 1)))).alias("base"),
        F.sum(F.col("n") * F.log10(F.coalesce("own", F.lit(0.0)) + F.col("spelt"))).alias("score"),
    )
    none = F.lit(None).cast("long")
    every = texts.select("at", "doc_id", "n_tokens", "known", "base", "score")
    every = every.union(looked.select("at", none, none, "known", "base", "score"))
    every = every.union(in_buckets.select("at", none, none, F.lit(0).cast("long"), F.lit(0.0), "s"))
    summed = every.groupBy("at").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", "n_tokens", "n_known", "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Scored rows with perplexity = 10 ** (-score / n_tokens)."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
