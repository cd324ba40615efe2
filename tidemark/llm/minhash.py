"""Operator 2: near-duplicate documents by an LSH forest over MinHash signatures.

Sets. Words are what stands between spaces and \\t..\\r, with A-Z in lower case; a document's set holds the 64-bit hashes of its distinct
shingles of `words` words (of all its words, if there are fewer). Documents whose sets are equal form a class at once, by two 64-bit sums over
the set; the smallest doc_id represents it, and only representatives go on.

Forest. A signature has ORDERS x DEPTH values. Each order sorts all representatives by its own DEPTH values, dealt by range, so that a
crowded region is spread over tasks. Rows that share LEAST_DEPTH values are a region; while a region has more than LEAF_ROWS rows it is
cut at the next value, so rows are compared with those of the longest common prefix, at a depth that adapts to how crowded the region is. All rows of a
leaf are compared by sketches (the signature's values, four bits each); rows that agree in as many as similarity 0.8 would give, less
4.5 standard deviations (a linked pair fails that with a probability of about 1e-5), are candidates. A leaf hands on its groups of
candidates, one row for each member, never pairs. Regions at the ends of partitions are put together in a small second pass.

Links. Candidates of all orders form clusters. A cluster's texts are sent to one task once, where all its rows are compared on full
sets; rows of the largest component found so far needn't be compared with each other, so a crowd of linked copies costs little, and a crowd
just under the threshold is compared in full.

Rest. Rows whose region was cut deeper, and clusters of more than CLUSTER_ROWS rows or CLUSTER_SHINGLES shingles, go an exact way: clusters are compared
in blocks of neighbours first, and then those rows are joined by shingles. Shingles have one order for all
sets, rare ones first (counted in a sample of SAMPLE_DOCS documents; any order gives the same result, a good one fewer pairs). Two sets of the
wanted similarity share one of the first n - ceil(n * similarity) + 1 shingles of their n, so those are dealt by shingle; pairs of different
components that meet there and can still reach the similarity by their sizes and places are confirmed on full sets,
unless their signatures agree on far less than similarity 0.8 gives (LEAST_ALIKE). A linked pair that shares LEAST_DEPTH values in no order is missed:
(1 - 0.8 ** LEAST_DEPTH) ** ORDERS, 5e-6 at the threshold and less above, unless other links join it.

Result. Documents of null or empty text have an empty set and are linked with nothing. Each row is linked by its own set: rows of one doc_id
with different texts can be in different components, named by the smallest doc_id among their rows. Rows of null doc_id are linked with nothing: component_id null, kept true. An empty table gives an empty result. Columns other
than doc_id and text don't matter. Equal similarity to the threshold links.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_joins, bounded_batches, mixed, slices, table, texts_of, written
from .components import components

ORDERS, DEPTH, LEAST_DEPTH = 12, 8, 2
#: A region of more rows is cut at the next value; rows of a leaf are all compared.
LEAF_ROWS = 4_096
#: What one task compares on full sets at once; larger clusters go the exact way.
CLUSTER_ROWS, CLUSTER_SHINGLES = 8_192, 4_000_000
#: Rows of the sorted orders, and of signatures, that one task handles.
ROWS_IN_A_TASK, SIGNATURES_IN_A_TASK = 300_000, 10_000
SLOTS = ORDERS * DEPTH
#: Documents and shingles that the order of shingles is taken from.
SAMPLE_DOCS, COMMON_SHINGLES = 20_000, 200_000
#: Four-bit values of a signature (of 96) that agree at least in a pair of the exact join; at similarity 0.8 or more, fewer agree with a
#: probability under 1e-12.
LEAST_ALIKE = 44

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_SLOT = _rng.integers(1, 1 << 63, size=SLOTS, dtype=np.uint64) | np.uint64(1)
_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin among them (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    rank = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()) + 1, _BASE, dtype=np.uint64))
        hashes = np.add.reduceat(_BYTE[data[inside]] * power[rank], first)
        hashes = mixed(hashes + sizes.astype(np.uint64) * _ODD)
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    hashes, first = word_hashes(texts)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, min(words, n)):
            rolled[: n - k] = mixed(rolled[: n - k] * _ODD + hashes[k:])  # rows near the end are never read whole
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                h = hashes[a]
                for k in range(a + 1, b):
                    h = mixed(h * _ODD + hashes[k : k + 1])[0]
                out.append(mixed(np.array([h]), int(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_sums(s: np.ndarray) -> tuple[int, int]:
    """Two sums of 64 bits that name a set."""
    with np.errstate(over="ignore"):
        return tuple(int(mixed(s, seed).sum(dtype=np.uint64).view(np.int64)) for seed in (1, 2))


def _least(s: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """MinHash values of a set, one for each slot."""
    least = np.full(len(slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 1024):
            np.minimum(least, (s[a : a + 1024, None] * slots[None, :]).min(axis=0), out=least)
    return mixed(least)


def signature(s: np.ndarray) -> np.ndarray:
    """SLOTS values of 16 bits; of equal sets, equal."""
    return (_least(s, _SLOT) >> np.uint64(48)).astype(np.uint16)


def packed(values: np.ndarray) -> np.ndarray:
    """Rows of four-bit values as rows of longs."""
    nibbles = (values & 15).astype(np.uint64).reshape(len(values), -1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def least_agreeing(n: int, similarity: float = 0.8) -> int:
    """How many of n four-bit values agree at least, for sets of this similarity."""
    p = similarity + (1 - similarity) / 16
    return int(np.ceil(n * (p - 4.5 * np.sqrt(p * (1 - p) / n))))


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"


def signatures(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, and the signature, of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = texts_of(batch, "text"), batch.column("doc_id")
            for a, b in slices(texts, 500_000):
                sets = shingle_sets(texts[a:b], words)
                sums = list(zip(*map(set_sums, sets), strict=True))
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SIGNED)


_KEY = ["tree", "hi", "lo", "id"]
_ROW = "tree int, hi long, lo long, id long, n long, sketch binary"
_FOUND = f"kind int, root long, {_ROW}"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
#: Kinds of what the forest gives: id is in the group of root; id stands in a region that was cut; a row at an end of a partition; the
#: region (tree, hi) goes on as one that was cut.
JOINED, CROWDED, END, CUT = 0, 1, 2, 3
_LOW = np.uint64(0x1111111111111111)


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each signature and order: its values in two longs, the row's id, the size of its set, and its sketch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(n, SLOTS)
        fours = sig.reshape(n, ORDERS, 2, 4).astype(np.uint64)
        keys = fours[..., 0] << np.uint64(48) | fours[..., 1] << np.uint64(32) | fours[..., 2] << np.uint64(16) | fours[..., 3]
        flat = keys.view(np.int64).reshape(n * ORDERS, 2)
        sketch = pa.array([r.tobytes() for r in packed(sig)], pa.binary())
        each = pa.array(np.repeat(np.arange(n), ORDERS))
        columns = [pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), n)), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)), *(c.take(each) for c in (batch.column("id"), batch.column("n"), sketch))]
        yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "n", "sketch"])


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the four-bit values of sketches (rows of longs) agree."""
    d = (x ^ y).view(np.uint64)
    d = (d | d >> np.uint64(1) | d >> np.uint64(2) | d >> np.uint64(3)) & _LOW
    return 16 * x.shape[1] - np.bitwise_count(d).sum(axis=1).astype(np.int64)


def grouped(m: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """The least row number of each row's group, for m rows; near(i) gives the rows linked with row i, itself included.

    After a few rows the largest group so far is fixed, and its rows are asked no more: whatever they are linked with outside it is asked itself.
    """
    label = np.arange(m)
    home = -1
    for i in range(m):
        if home >= 0 and label[i] == label[home]:
            continue
        met = np.unique(label[near(i)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
        if i == min(7, m - 1):
            home = int(np.bincount(label).argmax())
    return label


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row number of each row's group, for n rows and the links a - b."""
    label = np.arange(n)
    while len(a):
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots below smaller roots
        while not np.array_equal(up := label[label], label):
            label = up
    return label


class _Leaves:
    """Compares rows of whole regions by sketches."""

    def __init__(self, percent: int, most: int):
        self.percent, self.least, self.most = percent, least_agreeing(SLOTS, percent / 100), most

    def alike(self, x: slice | np.ndarray, y: slice | np.ndarray) -> np.ndarray:
        """Whether rows can be similar enough, by their sizes and sketches."""
        n, m = self.n[x], self.n[y]
        return (agreeing(self.sketch[x], self.sketch[y]) >= self.least) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))

    def run(self, rows: pa.Table, cut: Callable[[int, int], bool]) -> Iterator[pa.RecordBatch]:
        """Groups of candidates; cut(tree, region) says that a region was cut elsewhere."""
        tree, self.hi, self.lo, ids, self.n = (rows.column(c).to_numpy() for c in (*_KEY, "n"))
        size = len(ids)
        self.hi, self.lo = self.hi.view(np.uint64), self.lo.view(np.uint64)
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.int64).reshape(size, -1)
        region = self.hi >> np.uint64(64 - 16 * LEAST_DEPTH)
        begins = np.nonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (region[1:] != region[:-1])]))[0]
        sizes = np.diff(begins, append=size)
        label = np.arange(size)
        crowded = np.zeros(size, dtype=bool)
        few = min(16, self.most)
        rank = np.arange(size) - np.repeat(begins, sizes)
        x = np.nonzero((rank > 0) & np.repeat(sizes <= few, sizes))[0]
        links = []
        for d in range(1, few):
            x = x[rank[x] >= d]
            if not len(x):
                break
            links.append(x[self.alike(x, x - d)])
            links[-1] = np.stack([links[-1], links[-1] - d])
        if links:
            label = _joined(size, *np.concatenate(links, axis=1))
        for a, m in zip(begins.tolist(), sizes.tolist(), strict=True):
            over = m > self.most or cut(int(tree[a]), int(region[a]))
            crowded[a : a + m] = over
            if m > few:
                for x, y in self.leaves(a, a + m, LEAST_DEPTH) if m > self.most else [(a, a + m)]:
                    label[x:y] = x + grouped(y - x, lambda i, x=x, y=y: np.nonzero(self.alike(np.array([x + i]), slice(x, y)))[0])
        least = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        root = least[label]
        for kind, of in ((JOINED, root != ids), (CROWDED, crowded)):
            if len(at := np.nonzero(of)[0]):
                yield _found(kind, pa.array(root[at]), *(pa.nulls(len(at), t) for t in _TYPES[:3]), pa.array(ids[at]), *(pa.nulls(len(at), t) for t in _TYPES[4:]))

    def leaves(self, a: int, b: int, depth: int) -> Iterator[tuple[int, int]]:
        """Rows a..b cut at the next values until no part has too many rows; what agrees in all values is cut in blocks."""
        if b - a <= self.most:
            yield a, b
        elif depth == DEPTH:
            yield from ((x, min(b, x + self.most)) for x in range(a, b, self.most))
        else:
            values, k = (self.hi, depth) if depth < 4 else (self.lo, depth - 4)
            value = values[a:b] >> np.uint64(48 - 16 * k)
            at = [0, *(np.nonzero(value[1:] != value[:-1])[0] + 1).tolist(), b - a]
            for x, y in zip(at[:-1], at[1:], strict=True):
                yield from self.leaves(a + x, a + y, depth + 1)


def _found(kind: int, root: pa.Array, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(root), kind, np.int32)), root, *columns], names=["kind", "root", *_KEY, "n", "sketch"])


def _groups(batches: Iterator[pa.RecordBatch], percent: int, most: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by order and values: groups of candidates. The first and the last region of a partition can go on in another, so
    unless regions are whole they are handed on; those too large for that are cut here, and the region is named instead."""
    leaves = _Leaves(percent, most)
    cut: set[tuple[int, int]] = set()
    shift = np.uint64(64 - 16 * LEAST_DEPTH)

    def region(rows: pa.Table, at: int) -> tuple[int, int]:
        return rows.column("tree")[at].as_py(), int(np.uint64(rows.column("hi")[at].as_py() & (1 << 64) - 1) >> shift)

    def bounds(rows: pa.Table) -> np.ndarray:
        tree, hi = rows.column("tree").to_numpy(), rows.column("hi").to_numpy().view(np.uint64) >> shift
        return np.nonzero((tree[1:] != tree[:-1]) | (hi[1:] != hi[:-1]))[0] + 1

    def end(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows > most:
            first = rows.slice(0, 1).combine_chunks()
            yield _found(CUT, pa.nulls(1, pa.int64()), *(first.column(k).chunk(0) if k < 2 else pa.nulls(1, t) for k, t in enumerate(_TYPES)))
            yield from leaves.run(rows, lambda *_: True)
        elif rows.num_rows:
            rows = rows.combine_chunks()
            yield _found(END, pa.nulls(rows.num_rows, pa.int64()), *(c.chunk(0) for c in rows.columns))

    held: list[pa.RecordBatch] = []
    n_held, first = 0, not whole
    for batch in batches:
        if whole and batch.num_rows:
            marks = pc.is_null(batch.column("id"))
            named = pa.Table.from_batches([batch.filter(marks)])
            cut |= {region(named, k) for k in range(named.num_rows)}
            batch = batch.filter(pc.invert(marks))
        if not batch.num_rows:
            continue
        held.append(batch)
        n_held += batch.num_rows
        if n_held < 20_000:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        at = bounds(rows)
        if len(at) > first:
            start = int(at[0]) if first else 0
            if first:
                yield from end(rows.slice(0, start))
                first = False
            yield from leaves.run(rows.slice(start, int(at[-1]) - start), lambda *r: r in cut)
            rows = rows.slice(int(at[-1]))
        held, n_held = rows.to_batches(), 0
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    if whole:
        yield from leaves.run(rows, lambda *r: r in cut)
        return
    at = bounds(rows)
    start, stop = (int(at[0]) if first and len(at) else 0), (int(at[-1]) if len(at) else 0)
    if first and len(at):
        yield from end(rows.slice(0, start))
    if stop > start:
        yield from leaves.run(rows.slice(start, stop - start), lambda *r: r in cut)
    yield from end(rows.slice(stop))


def candidates(sigs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, n, sig): id, root of the groups of candidates in each leaf, and the ids of rows whose region was cut."""
    n = 4 + sigs.count() * ORDERS // ROWS_IN_A_TASK
    dealt = sigs.mapInArrow(_forest_rows, _ROW).repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY)
    found = written(dealt.mapInArrow(functools.partial(_groups, percent=percent, most=LEAF_ROWS, whole=False), _FOUND), "forest")
    region = F.shiftrightunsigned("hi", 64 - 16 * LEAST_DEPTH)
    ends = found.where(F.col("kind") >= END).select(*_KEY, "n", "sketch")
    ends = ends.repartition("tree", region).sortWithinPartitions("tree", region, F.col("id").isNotNull(), "hi", "lo", "id")
    found = found.unionByName(written(ends.mapInArrow(functools.partial(_groups, percent=percent, most=LEAF_ROWS, whole=True), _FOUND), "ends"))
    return found.where(F.col("kind") == JOINED).select("id", "root"), found.where(F.col("kind") == CROWDED).select("id").distinct()


def united(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least row number of each set's component; all sets are compared but those known to be of one component."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(s) for s in sets])[order]
    first = np.concatenate([[0], np.cumsum(size)])
    shingle, token = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(len(shingle), dtype=np.uint8)

    def near(i: int) -> np.ndarray:
        own = token[first[i] : first[i + 1]]
        a = int(np.searchsorted(100 * size, percent * size[i]))  # sets of other sizes can't be similar enough
        b = int(np.searchsorted(percent * size, 100 * size[i], "right"))
        mark[own] = 1
        both = np.add.reduceat(mark[token[first[a] : first[b]]], first[a:b] - first[a], dtype=np.int64)
        mark[own] = 0
        return a + np.nonzero(100 * both >= percent * (size[a:b] + size[i] - both))[0]

    label = grouped(len(sets), near)
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, label, order)
    out = np.empty(len(sets), dtype=np.int64)
    out[order] = least[label]
    return out


_MEMBER = "node long, rep long, f1 long, f2 long, cluster long, text string"


def compared(members: DataFrame, words: int, percent: int) -> DataFrame:
    """node, rep, root, least of members (_MEMBER) sorted by cluster in each partition: the least node and the least rep of each component in a
    cluster. A cluster too large for one task is compared in blocks of neighbours."""

    def flush(ids: list[tuple[int, int]], sets: list[np.ndarray]) -> pa.RecordBatch:
        node, rep = (np.array([i[k] for i in ids], dtype=np.int64) for k in (0, 1))
        label = united(sets, percent)
        columns = [node, rep]
        for of in (node, rep):
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, label, of)
            columns.append(least[label])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "rep", "root", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple[int, int]] = []
        sets: list[np.ndarray] = []
        seen: set[int] = set()
        held, total = None, 0
        for batch in batches:
            node, rep, f1, f2, cluster = (batch.column(c).to_pylist() for c in ("node", "rep", "f1", "f2", "cluster"))
            for x, y in slices(texts := texts_of(batch), 500_000):
                for i, s in zip(range(x, y), shingle_sets(texts[x:y], words), strict=True):
                    if node[i] in seen and cluster[i] == held or set_sums(s) != (f1[i], f2[i]):
                        continue  # a repeated row, or another text of the same doc_id
                    if ids and (cluster[i] != held or len(ids) == CLUSTER_ROWS or total + len(s) > CLUSTER_SHINGLES):
                        yield flush(ids, sets)
                        ids, sets, total = [], [], 0
                        if cluster[i] != held:
                            seen.clear()
                    ids.append((node[i], rep[i]))
                    sets.append(s)
                    seen.add(node[i])
                    held, total = cluster[i], total + len(s)
        if ids:
            yield flush(ids, sets)

    return members.mapInArrow(run, "node long, rep long, root long, least long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b, linked of each pair (a, b); texts has id, text. Each base text is read once, its partners one after the other."""
    base = pairs.select(F.col("a").alias("id")).distinct().join(texts, "id").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    partner = pairs.select("a", F.col("b").alias("id")).join(texts, "id").select("a", F.col("id").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_id, base_set = None, None
        for batch in batches:
            a, b, texts_ = batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts_of(batch)
            got: list[tuple[int, int, bool]] = []
            for x, y in slices(texts_, 500_000):
                for i, s in zip(range(x, y), shingle_sets(texts_[x:y], words), strict=True):
                    if b[i] is None:
                        base_id, base_set = a[i], s
                    elif a[i] == base_id and len(s) and len(base_set):
                        both = len(np.intersect1d(s, base_set, assume_unique=True))
                        got.append((a[i], b[i], 100 * both >= percent * (len(s) + len(base_set) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])

    dealt = base.unionByName(partner).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long, linked boolean")


def common_shingles(docs: DataFrame, words: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several documents of a bounded sample hold, sorted, and in how many; docs has id, text and about `count` rows."""
    part = int(1_000_000 * min(1.0, SAMPLE_DOCS / max(1, count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(t := texts_of(batch), 500_000):
                found, n = np.unique(np.concatenate(shingle_sets(t[a:b], words)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    some = docs.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < part)
    counted = some.select("id", "text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).collect()
    found, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
    order = np.argsort(found.view(np.uint64))
    return found.view(np.uint64)[order], n[order]


def prefix(s: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in the order of all sets, as many as one of them must be shared by any set similar enough."""
    found, n = common
    seen = np.zeros(len(s), dtype=np.int64)
    if len(found):
        at = np.minimum(np.searchsorted(found, s), len(found) - 1)
        seen = np.where(found[at] == s, n[at], 0)
    return s[np.lexsort((s, seen))[: len(s) + 1 - -(-percent * len(s) // 100)]]


_PLACE = "shingle long, n long, place int, id long, comp long"


def _meetings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shingle and size: a, b of the pairs of different components that can be similar enough."""
    held = None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        shingle, n, place, ids, comp = (rows.column(k).to_numpy() for k in range(5))
        begins = np.nonzero(np.diff(shingle, prepend=shingle[0] - 1 if shingle[0] > -(1 << 63) else 0))[0]
        apart = np.minimum.reduceat(comp, begins) != np.maximum.reduceat(comp, begins)
        x = np.nonzero(np.repeat(apart, np.diff(begins, append=len(shingle))))[0]
        d, found, size = 0, [], 0
        while len(x):
            d += 1
            x = x[x >= d]
            x = x[(shingle[x] == shingle[x - d]) & (100 * n[x - d] >= percent * n[x])]  # the sizes before are no larger
            y = x - d
            both = np.minimum(n[x] - place[x], n[y] - place[y])  # what they can share from here on
            at = x[(comp[x] != comp[y]) & (ids[x] != ids[y]) & ((100 + percent) * both >= percent * (n[x] + n[y]))]
            if len(at):
                found.append((np.minimum(ids[at], ids[at - d]), np.maximum(ids[at], ids[at - d])))
                size += len(at)
            if size > 100_000 or size and not len(x):
                made = np.unique(np.concatenate([np.stack(f, axis=1) for f in found]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[:, k])) for k in (0, 1)], names=["a", "b"])
                found, size = [], 0

    waiting: list[pa.RecordBatch] = []  # rows of one shingle that reach over batches
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[batch.num_rows - 1].as_py()
        waiting.append(batch)
        if batch.column(0)[0].as_py() == last and held == last:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        shingle = rows.column(0).to_numpy()
        cut = int(np.searchsorted(shingle, last))
        if cut:
            yield from pairs(rows.slice(0, cut))
        waiting, held = rows.slice(cut).to_batches(), last
    if waiting:
        yield from pairs(pa.Table.from_batches(waiting).combine_chunks())


def meeting(docs: DataFrame, comps: DataFrame, words: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """a, b of the pairs of rows (docs has id, text; comps has id, comp) of different components that share a shingle of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(t := texts_of(batch), 500_000):
                sets = shingle_sets(t[a:b], words)
                firsts = [prefix(s, percent, common).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(firsts, pa.binary())], names=["id", "n", "firsts"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts = [np.frombuffer(f, dtype=np.int64) for f in batch.column("firsts").to_pylist()]
            sizes = np.array([len(f) for f in firsts])
            each = pa.array(np.repeat(np.arange(len(firsts)), sizes))
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), batch.column("n").take(each), pa.array(place), batch.column("id").take(each), batch.column("comp").take(each)], names=["shingle", "n", "place", "id", "comp"])
            yield from (made.slice(k, 100_000) for k in range(0, made.num_rows, 100_000))

    firsts = docs.select("id", "text").mapInArrow(run, "id long, n long, firsts binary").where("firsts is not null and id is not null")
    rows = firsts.join(comps, "id").select("id", "comp", "n", "firsts").mapInArrow(spread, _PLACE)
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n").mapInArrow(functools.partial(_meetings, percent=percent), "a long, b long").distinct()


def alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which LEAST_ALIKE four-bit values of the signatures (id, sig) agree at least."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in packed(sig)], pa.binary())], names=["id", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.int64).reshape(-1, SLOTS // 16) for c in ("of_a", "of_b"))
            near = pa.array(agreeing(x, y) >= LEAST_ALIKE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    sketches = sigs.select("id", "sig").mapInArrow(pack, "id long, sketch binary")
    end = lambda c: sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"of_{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(run, "a long, b long")


def _classes(signed: DataFrame) -> DataFrame:
    """node, rep, f1, f2, n, sig of the distinct sets: rep is the smallest doc_id, and names the class unless it holds several sets."""
    some = 6 + signed.count() // SIGNATURES_IN_A_TASK
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))  # equal sets, equal signatures
    classes = written(classes.coalesce(some), "classes")
    several = classes.groupBy("rep").agg(F.count("*").alias("sets"), F.min(F.struct("f1", "f2")).alias("least")).where("sets > 1").drop("sets")
    if several.isEmpty():
        return classes.withColumn("node", F.col("rep"))
    named = classes.join(several, "rep", "left")
    return written(named.withColumn("node", F.when(F.coalesce(F.col("least") == F.struct("f1", "f2"), F.lit(True)), F.col("rep")).otherwise(F.xxhash64("f1", "f2", "rep"))).drop("least"), "classes")


def _own(members: DataFrame, words: int) -> DataFrame:
    """One row of each node, of a text that gives its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1, f2 = batch.column("f1").to_pylist(), batch.column("f2").to_pylist()
            for a, b in slices(t := texts_of(batch), 500_000):
                own = [set_sums(s) == (f1[i], f2[i]) for i, s in zip(range(a, b), shingle_sets(t[a:b], words), strict=True)]
                yield batch.slice(a, b - a).filter(pa.array(own))

    return members.mapInArrow(run, members.schema).dropDuplicates(["node"])


def _rest(members: DataFrame, links: DataFrame, sigs: DataFrame, words: int, percent: int) -> DataFrame:
    """node, root of links that join members (_MEMBER, where cluster can be null) of different components, by blocks and the exact join; known links come along."""
    for order in range(2):  # blocks of neighbours in two orders of the forest join most rows of a large cluster
        key = F.substring("sig", 1 + 2 * DEPTH * order, 2 * DEPTH)
        near = members.where("cluster is not null").join(sigs.select(F.col("id").alias("node"), "sig"), "node").withColumn("key", key)
        near = near.repartitionByRange("cluster", "key", "node").sortWithinPartitions("cluster", "key", "node").select(*members.columns)
        links = links.unionByName(compared(near, words, percent).where("node != root").select("node", "root"))
    links = written(links, "blocks")
    texts = members.select(F.col("node").alias("id"), "text")
    of = written(texts.select("id").join(components(links, "node", "root"), "id", "left").select("id", F.coalesce("component", "id").alias("comp")), "components")
    pairs = written(alike(meeting(texts, of, words, percent, common_shingles(texts, words, texts.count())), sigs), "rest")
    return links.unionByName(confirmed(pairs, texts, words, percent).where("linked").select(F.col("a").alias("node"), F.col("b").alias("root")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; one row of each component, its smallest doc_id, is kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    signed = written(signatures(docs, words, text), "signatures")
    classes = _classes(signed)
    sigs = classes.select(F.col("node").alias("id"), "n", "sig")
    links, crowded = candidates(sigs, percent)
    near = components(links, "id", "root").withColumnsRenamed({"id": "node", "component": "cluster"})
    near = written(classes.drop("sig").join(near, "node"), "near")
    large = near.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where((F.col("members") > CLUSTER_ROWS) | (F.col("shingles") > CLUSTER_SHINGLES)).select("cluster")
    every = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).alias("text"))

    def members(rows: DataFrame) -> DataFrame:
        rows = written(rows.select("node", "rep", "f1", "f2", "cluster"), "chosen").where(F.col("rep") > F.lit(-(1 << 63)))
        with bloom_joins(spark):  # few texts have a candidate; the filter keeps the others out of the shuffle (Spark wants a condition on the filtered side)
            return written(every.join(rows, "rep").select("node", "rep", "f1", "f2", "cluster", "text"), "members")

    together = members(near.join(large, "cluster", "left_anti"))
    of = written(compared(together.repartition("cluster").sortWithinPartitions("cluster"), words, percent), "compared")
    rest = near.join(large, "cluster").select("node", "cluster").unionByName(crowded.select(F.col("id").alias("node"), F.lit(None).cast("long").alias("cluster")))
    rest = written(rest.groupBy("node").agg(F.max("cluster").alias("cluster")), "rest")
    if not rest.isEmpty():
        links = of.where("node != root").select("node", "root")
        rest = written(_own(members(classes.drop("sig").join(rest, "node")), words), "rest")
        of = components(_rest(rest, links, sigs, words, percent), "node", "root").join(classes.select(F.col("node").alias("id"), "rep"), "id")
        of = written(of.select(F.col("id").alias("node"), "rep", F.col("component").alias("root")), "components")
        of = of.join(of.groupBy("root").agg(F.min("rep").alias("least")), "root")
    of = of.select("node", "least")
    classes = classes.select("node", "f1", "f2", F.col("n").alias("n_shingles"), "rep").join(of, "node", "left")
    classes = classes.select("f1", "f2", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, by shingles of four words and a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
