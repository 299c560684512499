"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold. Set sizes
are cut into bands [l, l/similarity]; a set takes part in the instance of its own band and in the next
one, so that any pair similar enough meets in an instance whose Hamming distance is at most k. An
instance deals the shingle domain into n1 partitions and each of them into n2 cells. Of two sets at
distance k at most k / (k2 + 1) partitions differ in more than k2 cells; in every other one some
n2 - k2 cells hold the same elements, and the hash of such a subset's content is a signature. A subset
without elements says nothing and has none. That loses no pair if a set has more partitions with over
k2 filled cells than may differ, for one of these then agrees and no subset of it is empty; n1 is chosen
so that few sets have not. Those few also have their first elements in hash order as signatures, so many
that two of them that link share one (prefix filter).

Exact copies are folded into classes first. Signatures only name candidates, and a common passage has
thousands that don't link. So the sets of a signature are first held against each other by sketches: a
bit for every hash value tells whether an odd number of elements fall on it, so that two sketches differ
in no more bits than the sets in elements, and a pair whose sketches differ in more than a link allows is
none. What remains is close to the links. The candidates of a connected group of it meet with their full
sets, are compared exactly (all links, block by block, nothing emitted but a spanning label and link
counts), and the links' components are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import remove, save, small
from .textops import U64, list_array, mix, pieces, shingle_hashes, word_hashes

#: Sets of a block; a candidate group is compared block against block, so that a task holds two blocks.
BLOCK = 512
#: Elements that a signature should stand for on average, in the smallest sets of an instance.
HELD = 3.0
#: Bits of the shortest sketch; a longer one has a bit for each element at least.
LEAST_BITS = 256
#: Sketches of a block; the sets of a signature are compared block against block.
SKETCHES = 4096
#: Sets of a signature up to which all its pairs are looked at side by side with those of other signatures.
FEW = 8
#: Parts of the signatures that are dealt one after the other; the files of one are gone before the next.
ROUNDS = 2


class Bands(NamedTuple):
    """Per instance: smallest size of the band that begins in it, Hamming distance k, partitions n1, cells n2 of each, and k2."""

    similarity: Fraction
    low: np.ndarray
    distance: np.ndarray
    outer: np.ndarray
    inner: np.ndarray
    slack: np.ndarray


def layout(distance: int, least: int) -> tuple[int, int, int]:
    """n1, n2 and k2 with the fewest signatures among those that hold enough elements; for sets of at least `least` elements."""
    best = (True, 0.0, distance + 1, 1, 0)
    for k2 in range(4):
        for n2 in (1,) if k2 == 0 else range(k2 + 1, k2 + 4):
            bad = distance // (k2 + 1)
            n1 = bad + 1
            while n1 * n2 <= 2 * least:
                cell = 1 - math.exp(-least / (n1 * n2))
                rich = sum(math.comb(n2, j) * cell**j * (1 - cell) ** (n2 - j) for j in range(k2 + 1, n2 + 1))
                if n1 * rich - 3 * math.sqrt(n1 * rich * (1 - rich)) > bad:
                    held = least * (n2 - k2) / (n1 * n2)
                    best = min(best, (held < HELD, -held if held < HELD else n1 * math.comb(n2, k2), n1, n2, k2))
                    break
                n1 += max(1, n1 // 32)
    return best[2:]


def size_bands(similarity: Fraction, top: int) -> Bands:
    low, rows, at, before, least = [], [], 1, 0, 1
    gap = (1 - similarity) / (1 + similarity)
    while True:  # the last instance is the one above the band of `top`
        end = max(at, int(Fraction(at) / similarity))
        k = int(gap * (max(before, 1) + end))  # of one set in the band below and one in this; covers two in the band below
        low.append(at)
        rows.append((k, *layout(k, least)))
        if at > top:
            return Bands(similarity, np.array(low), *np.array(rows, dtype=np.int64).T)
        before, least, at = end, at, end + 1


def _sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by text, sorted within each, and the set sizes."""
    h, counts = word_hashes(data, bounds)
    value, doc = shingle_hashes(h, counts, size)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.bincount(doc, minlength=len(counts))


def signatures(value: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets laid end to end (sorted within each): the signatures, and how many each set has."""
    docs = len(sizes)
    starts = np.cumsum(sizes) - sizes
    band = np.searchsorted(bands.low, sizes, side="right") - 1
    mixed = mix(value ^ U64(0x5851F42D4C957F2D))
    found, owner = [], []
    for step in (0, 1):
        inst = np.where(sizes > 0, band + step, 0)
        live = (sizes > 0) & (bands.distance[inst] > 0)  # with k = 0 only equal sets are linked, and those are one class already
        if not live.any():
            continue
        inner, slack, label = bands.inner[inst], bands.slack[inst], inst.astype(U64) << U64(48)
        cells = np.where(live, bands.outer[inst] * inner, 0)
        base = np.cumsum(cells) - cells
        doc = np.repeat(np.arange(docs), np.where(live, sizes, 0))
        use = np.repeat(live, sizes)
        cell = base[doc] + (((value[use] >> U64(32)) * cells[doc].astype(U64)) >> U64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        content, full = np.zeros(int(cells.sum()), dtype=U64), np.zeros(int(cells.sum()), dtype=bool)
        content[cell[edge]], full[cell[edge]] = np.add.reduceat(mixed[use], edge), True
        rich = np.zeros(docs, dtype=np.int64)
        for n2, k2 in {(int(a), int(b)) for a, b in zip(inner[live], slack[live], strict=True)}:
            mine = live & (inner == n2) & (slack == k2)
            of = np.repeat(mine, cells)
            inside, some = content[of].reshape(-1, n2), full[of].reshape(-1, n2)
            outer = np.where(mine, cells // n2, 0)
            who = np.repeat(np.arange(docs), outer)
            part = np.arange(len(who)) - np.repeat(np.cumsum(outer) - outer, outer)
            rich += np.bincount(who[some.sum(axis=1) > k2], minlength=docs)
            tag = label[who] + (part.astype(U64) << U64(6))
            for s, columns in enumerate(combinations(range(n2), n2 - k2)):
                keep = some[:, columns].any(axis=1)
                found.append(mix(inside[keep][:, columns].sum(axis=1, dtype=U64) ^ mix(tag[keep] + U64(s))))
                owner.append(who[keep])
        for d in np.flatnonzero(live & (rich <= bands.distance[inst] // (slack + 1))):
            n = int(sizes[d])
            first = value[starts[d] : starts[d] + n - math.ceil(bands.similarity * n) + 1]
            found.append(mix(mix(first) ^ mix(label[d : d + 1] + U64((1 << 48) - 1))))
            owner.append(np.full(len(first), d))
    if not found:
        return np.zeros(0, dtype=U64), np.zeros(docs, dtype=np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=docs)


def _identity(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set's elements and size, the class of its copies; 0 for an empty set."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(sizes), dtype=U64)
    if len(value):
        edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        one, two = np.add.reduceat(mix(value), edge), np.add.reduceat(mix(value * U64(0x9FB21C651E98DF25) + U64(1)), edge)
        out[who[edge]] = mix(one ^ mix(two + sizes[who[edge]].astype(U64)))
    return out


def sketches(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets laid end to end: their 64-bit words, and how many each set has (a power of two; none for an empty set)."""
    bits = np.where(sizes > 0, np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
    who = np.repeat(np.arange(len(sizes)), sizes)
    at = (mix(value + U64(0xA0761D6478BD642F)) & (bits[who] - 1).astype(U64)).astype(np.int64)
    odd = np.bincount((np.cumsum(bits) - bits)[who] + at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64), bits // 64


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in pieces(batch.column(1)):
                value, sizes = _sets(data, bounds, size)
                marks, words = sketches(value, sizes)
                sketch = list_array(marks.view(np.int64), words, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sizes, type=pa.int64()), pa.array(_identity(value, sizes).view(np.int64)), sketch], names=["doc_id", "n", "node", "sketch"])

    return run


def _signature_rows(size: int, similarity: Fraction, turn: int, top: int = 1 << 40):
    """The signatures of one of the rounds."""
    bands = size_bands(similarity, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                value, sizes = _sets(data, bounds, size)
                sig, each = signatures(value, sizes, bands)
                mine, node = sig % U64(ROUNDS) == turn, np.repeat(_identity(value, sizes).view(np.int64), each)
                yield pa.RecordBatch.from_arrays([pa.array(sig[mine].view(np.int64)), pa.array(node[mine])], names=["sig", "node"])

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in pieces(batch.column(0)):
                value, sizes = _sets(data, bounds, size)
                yield pa.RecordBatch.from_arrays([pa.array(_identity(value, sizes).view(np.int64)), list_array(value.view(np.int64), sizes, pa.int64())], names=["node", "items"])

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, cut anew so that no value of it is in two tables. Holds the rows of one value between batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[-1].column(0)[-1].as_py() != key[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and set: the sets of each signature that several have, keyed by a hash of these sets, so that signatures of the same sets are one key."""
    for table in _whole_keys(batches):
        sig, node = table["sig"].to_numpy(), table["node"].to_numpy()
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        many = np.diff(np.append(edge, len(sig)))
        key = mix(np.add.reduceat(mix(node.view(U64) + U64(0x8EBC6AF09C88C6E3)), edge) + many.astype(U64))
        once = np.zeros(len(edge), dtype=bool)
        once[np.unique(key, return_index=True)[1]] = True
        keep = np.repeat(once & (many > 1), many)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, many)[keep].view(np.int64)), pa.array(node[keep])], names=["key", "node"])


def _alike(similarity: Fraction):
    """From rows (key, node, n, sketch) sorted by key: edges (a, b) that connect all sets of a key whose sketches leave a link possible."""
    up, down = similarity.numerator, similarity.denominator

    def near(differ: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) * (down + up) <= sizes * (down - up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches):
            key, node, size = (table[c].to_numpy() for c in ("key", "node", "n"))
            column = table["sketch"].combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            flat, words = column.flatten().to_numpy().view(U64), np.diff(column.offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(words) - words

            def folded(rows: np.ndarray, width: int, flat=flat, words=words, start=start) -> np.ndarray:
                """The rows' sketches at the width of a shorter one: the parity of a bit of it is that of the bits that fall on it."""
                out = np.empty((len(rows), width), dtype=U64)
                for w in np.unique(words[rows]):
                    of = np.flatnonzero(words[rows] == w)
                    out[of] = np.bitwise_xor.reduce(flat[start[rows[of]][:, None] + np.arange(w)].reshape(len(of), -1, width), axis=1)
                return out

            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            many = np.diff(np.append(edge, len(key)))
            left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            few = np.repeat(many <= FEW, many)
            for step in range(1, FEW):
                one = np.flatnonzero((key[step:] == key[:-step]) & few[step:])
                width = np.minimum(words[one], words[one + step])
                for w in np.unique(width):
                    a = one[width == w]
                    a = a[near(folded(a, w) ^ folded(a + step, w), size[a] + size[a + step])]
                    left.append(a)
                    right.append(a + step)
            for at, m in zip(edge[many > FEW], many[many > FEW], strict=True):
                rows = np.arange(at, at + m)
                marks = folded(rows, int(words[rows].min()))
                ids, rest = np.arange(m), marks
                while len(ids):
                    front, ids, rest = [ids[0]], ids[1:], rest[1:]
                    while front and len(ids):
                        x = front.pop()
                        hit = near(rest ^ marks[x], size[rows[ids]] + size[at + x])
                        if hit.any():
                            right.append(rows[ids[hit]])
                            left.append(np.full(len(right[-1]), at + x))
                            front.extend(ids[hit])
                            ids, rest = ids[~hit], rest[~hit]
            pair = np.unique(np.stack([node[np.concatenate(left)], node[np.concatenate(right)]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return run


def _overlaps(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    m = len(items)
    if m <= 6:
        out = np.zeros((m, m), dtype=np.int64)
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(items[i], items[j], assume_unique=True))
        return out
    sizes = np.array([len(x) for x in items])
    value, row = np.concatenate(items), np.repeat(np.arange(m), sizes)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    column = np.cumsum(np.concatenate(([True], value[1:] != value[:-1]))) - 1
    shared = np.bincount(column) > 1  # an element of one set meets nobody
    new = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], new[column[keep]]
    out, width = np.zeros((m, m), dtype=np.float32), max(256, 4_000_000 // m)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, min(width, int(column[-1]) + 1 - at)), dtype=np.float32)
        block[row[i:j], column[i:j] - at] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _compare(similarity: Fraction):
    up, down = similarity.numerator, similarity.denominator

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, copies, side = table["node"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
        column = table["items"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, bounds = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
        items = [flat[bounds[i] : bounds[i + 1]] for i in range(len(rep))]
        sizes = np.array([len(x) for x in items], dtype=np.int64)
        common = _overlaps([x.view(U64) for x in items])
        linked = common * down >= up * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        # blocks i < j: a task for (i, j) counts only the pairs across, one for (i, i) those within
        across = side[:, None] != side[None, :] if side.min() != side.max() else np.ones_like(linked)
        counts = (linked & across) @ copies
        label, todo = np.full(len(rep), -1), list(np.argsort(rep, kind="stable"))
        for at in todo:
            if label[at] >= 0:
                continue
            front = np.array([at])
            label[at] = at
            while len(front):
                near = linked[front].any(axis=0) & (label < 0)
                front = np.flatnonzero(near)
                label[front] = at
        return pa.table({"node": pa.array(rep), "root": pa.array(rep[label]), "links": pa.array(counts.astype(np.int64))})

    return run


def _dealt(rows: DataFrame, block: int, *columns: str) -> DataFrame:
    """The columns with lo and hi: rows of groups of m members, in blocks of about `block`, once for each pair of blocks that theirs is in."""
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).select(*columns, "lo", "hi")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float | str | Fraction = "0.8", block: int = BLOCK, sketched: int = SKETCHES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    docs: doc_id (BIGINT) and text (STRING); other columns are ignored. Words are runs without ASCII
    whitespace, A-Z lower-cased. A text of fewer than `size` words is one shingle of all its words; a
    null, empty or blank text has none and links with nothing (it is its own component). Rows that repeat
    a doc_id are documents of their own, each with its own links; a null doc_id keeps its row with a null
    component unless copies have an id. An empty table gives an empty one. component_id: the smallest
    doc_id reachable by links, itself included. n_links: documents linked directly, copies included. Shingles
    and sets are compared by 64-bit hashes: two sets of one hash would count as copies.
    """
    similarity = Fraction(str(similarity)) if not isinstance(similarity, Fraction) else similarity
    rows = save(docs.select("doc_id", "text").mapInArrow(_describe(size), "doc_id long, n long, node long, sketch array<long>"), "jaccard-sets")
    some = rows.where("n > 0")
    classes = save(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-classes")
    marks, every = classes.select("node", "n", "sketch"), classes
    classes = every.select("node", "rep", "copies")
    # one text of each class goes on; signatures are many times the size of the ids, so they are made from the texts anew rather than kept
    others = save(some.select("doc_id").distinct().join(classes, F.col("doc_id") == F.col("rep"), "left_anti").select("doc_id"), "jaccard-copies")
    texts = docs.select("doc_id", "text").where("doc_id is not null").join(small(others), "doc_id", "left_anti")
    often = save(some.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id").distinct(), "jaccard-repeats")
    if often.count():  # whole rows that repeat are read once
        texts = texts.join(small(often), "doc_id", "left_anti").union(texts.join(small(often), "doc_id", "left_semi").distinct())
    rounds = []
    for turn in range(ROUNDS):
        spread = texts.select("text").mapInArrow(_signature_rows(size, similarity, turn), "sig long, node long")
        rounds.append(save(spread.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_shared, "key long, node long"), "jaccard-shared", free=True))
    shared = save(reduce(DataFrame.union, rounds).distinct(), "jaccard-keys", free=True)
    large = save(shared.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > sketched), "jaccard-large")
    held = _dealt(shared.join(small(large), "key", "left").join(marks, "node").withColumn("m", F.coalesce("m", F.lit(1))), sketched, "key", "node", "n", "sketch", "blocks")
    held = held.withColumn("key", F.when(F.col("blocks") > 1, F.xxhash64("key", "lo", "hi")).otherwise(F.col("key"))).select("key", "node", "n", "sketch")
    pairs = save(held.repartition("key").sortWithinPartitions("key").mapInArrow(_alike(similarity), "a long, b long").distinct(), "jaccard-pairs", free=True)
    groups = save(components(pairs), "jaccard-groups")
    counted = save(groups.groupBy("component").agg(F.count("*").alias("m")), "jaccard-sizes")
    member = groups.join(small(counted), "component").join(classes, "node").select("node", "rep", "component", "m", "copies")
    member = save(member, "jaccard-members")
    wanted = texts.join(small(save(member.select("rep").distinct(), "jaccard-wanted")), F.col("doc_id") == F.col("rep"), "left_semi")
    sets = wanted.select("text").mapInArrow(_set_rows(size), "node long, items array<long>").join(small(member), "node").dropDuplicates(["node"])
    dealt = _dealt(sets, block, "node", "items", "copies", "component", "block")
    found = save(dealt.groupBy("component", "lo", "hi").applyInArrow(_compare(similarity), "node long, root long, links long"), "jaccard-links", free=True)
    joined = save(components(found, "node", "root"), "jaccard-joined")
    least = save(joined.join(classes, "node").groupBy("component").agg(F.min("rep").alias("least")), "jaccard-least")
    links = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    own = joined.join(small(least), "component").select(F.col("node").alias("at"), "least")
    of_class = (
        classes.join(own, F.col("node") == F.col("at"), "left")
        .join(links, F.col("node") == F.col("linked"), "left")
        .select("node", F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    of_class = save(of_class, "jaccard-result")
    for done in (others, often, *rounds, shared, large, pairs, groups, counted, member, found, joined, least, every):
        remove(done)
    filled = rows.where("n > 0").join(small(of_class), "node").select("doc_id", "n", "component", "n_links")
    blank = rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return filled.union(blank).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "n_links")


def keep_one(docs: DataFrame, size: int = 5, similarity: float | str | Fraction = "0.8") -> DataFrame:
    """The documents, all columns kept, without those of which near_duplicates() names a smaller one.

    Rows that repeat a doc_id are one document: it goes if all its rows link to smaller ones, and of its
    equal texts one stays. Rows without a doc_id and blank texts stay.
    """
    found = near_duplicates(docs, size, similarity).where("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("goes"), F.count("*").alias("rows"))
    found = save(found.where("goes = 1 or rows > 1"), "jaccard-goes")
    gone, often = save(found.where("goes = 1").select("doc_id"), "jaccard-gone"), save(found.where("goes = 0").select("doc_id"), "jaccard-often")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if often.count():
        kept = kept.join(small(often), "doc_id", "left_anti").select(*docs.columns).union(kept.join(small(often), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
    return kept
