"""Operator 4: n-gram Jaccard join in the metric space of shingle sets, exact.

The Jaccard distance d = 1 - J is a metric; two sets link when d <= r = 1/4. Equal sets are one node.

1. Sketch: counts of all shingles in a table whose size follows the corpus up to a bound (every task adds up its own; a count may be
   too high, never too low below saturation). It fixes an order of shingles, rare ones first, that all documents share.
2. Pivots: nearly all texts are at distance 1 from any pivot, where no triangle says anything, so pivots are found through shared rare
   shingles. Two linked sets share one of the first n - ceil(3n/4) + 1 shingles of their order. These go to the owner of their
   hash. Among the sets that share one there, the least node is the pivot; the others, if size and places allow any
   link at all, join its region. So any two linked sets lie in a common region, though most documents lie in none.
3. Members of small regions leave if histograms of their shingles' classes show that they overlap too little with each other member.
   Regions over ``tile`` sets are divided, round by round, as tables: pivots are drawn from the region, every member's distance to
   each is measured, and it goes to the Voronoi cells of all pivots p with d(x, p) <= d(x, nearest) + 2r, which by the triangle
   inequality hold every partner of a set of that cell. A cell that is still too large is a region of the next round.
   A region that its pivots do not divide (a crowd of near copies: all within 2r of each other) is cut into rings by the distance to one pivot, and only
   rings whose distances differ by r or less are compared.
4. In a task, a region's first pivot decides its own links by their distances; the others are divided into cells again, or compared
   within windows of r along the pivot's distances, as matrix products. A tile gives its sets' components and numbers of links, never pairs.
5. Components of all regions are merged by min-label propagation with pointer jumping over a table of tree edges.

Copies count once per task in step 2. A hot shingle's list does not go to one owner: its pivot is found by a partially aggregated minimum.

Nodes are 64-bit sums over the sets' shingle hashes, compared over the whole corpus by a second, independent sum: sets that share a
node by chance get the second as their node, and the entries are made again.

Defined results: a null text is empty; without words the set is empty and links with nothing, not even its like; under five words
the whole sequence is the one shingle; copies are linked (same set); repeated rows and doc_ids are all reported; a null
doc_id belongs to its component but never names it unless all are null; an empty table gives an empty result; other columns
are ignored by ``jaccard_components`` and kept by ``one_of_each_component``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, fingerprint, fingerprint_filter, id_and_text, keep_rows, marked, materialize, slices, trim
from .hashing import WordHasher, mix, runs

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORDS = 5
RADIUS = 0.25
#: Cells of the sketch: at least and at most (powers of two), a byte each where it is broadcast; between them, one to four shingles.
CELL_BITS = 16, 22
#: Bits of a shingle that its list is known by, below its bucket: two shingles with one list only give candidates that fail.
LIST_BITS = 40
#: Entries (20 bytes each) that a bucket holds on average.
BUCKET_ENTRIES = 500_000
#: A shingle this much above the sketch's mean count is hot.
HOT = 1 << 16
TILE = 2048
#: Up to so many rows (40 bytes or so each) of places in tiles are broadcast.
BROADCAST_ROWS = 500_000
LEAF = 384
#: Pivots that are drawn to divide a region, and how many of its comparisons (sets squared) its cells together may still need.
PIVOTS = 64
DIVIDED = 0.5
#: Bits of a node that count (fewer only in tests).
NODE_MASK = (1 << 64) - 1
_SLICE = 2 << 20

_hasher: list[WordHasher] = []


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ascending in each, and where each text's begin, with the end of the last."""
    if not _hasher:
        _hasher.append(WordHasher(SEPARATORS))
    words, at = _hasher[0].hashes(texts)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), np.maximum(n - WORDS + 1, 0))
    first = np.arange(len(words))
    full = first + WORDS <= np.repeat(at[1:], n)
    found = runs(words, WORDS)[np.flatnonzero(full)]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):  # the whole sequence, told from shingles by its length
        whole = np.array([mix(runs(words[at[i] : at[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short], np.uint64)
        found, row = np.concatenate([found, whole]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(n) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


def nodes_of(sets: np.ndarray, at: np.ndarray, shared: np.ndarray, mask: int = NODE_MASK) -> tuple[np.ndarray, np.ndarray]:
    """The node of each set, and the second sum that tells sets apart; 0 for empty ones. ``shared`` nodes (ascending) stand for several sets: theirs is the second sum."""
    n = np.diff(at)
    nodes = np.maximum(mix(_sums(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at) ^ n.astype(np.uint64)) & np.uint64(mask), np.uint64(1))
    checks = mix(_sums(mix(sets * np.uint64(0xDA942042E4DD58B5) + np.uint64(0x14057B7EF767814F)), at) + n.astype(np.uint64))
    nodes = np.where(np.isin(nodes, shared), checks, nodes) if len(shared) else nodes
    return np.where(n > 0, nodes, np.uint64(0)), checks


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def cell_bits(docs: DataFrame) -> int:
    """So many that a cell has one to four shingles (about six bytes of text each), within bounds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(CELL_BITS[1], max(CELL_BITS[0], (int(size) // 24).bit_length()))


def sketch_counts(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """The sketch as levels (eight to a doubling), and the number of all shingles."""
    parts = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        total, held, n, every = np.zeros(1 << bits, np.uint8), [], 0, 0

        def add() -> None:
            nonlocal held, n
            cells, more = np.unique(np.concatenate(held), return_counts=True)
            total[cells] = np.minimum(more + total[cells], 255)
            held, n = [], 0

        for whole in batches:
            for batch in slices(whole, limit=_SLICE):
                sets, _ = shingle_sets(batch.column("text"))
                held.append((sets >> np.uint64(64 - bits)).astype(np.uint32))
                n, every = n + len(sets), every + len(sets)
                if n > 4_000_000:
                    add()
        if held:
            add()
        packed = [zstandard.compress(x.tobytes(), 1) for x in np.split(total, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary()), pa.array([every] + [0] * (parts - 1), pa.int64())], names=["part", "counts", "n"])

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // parts, np.int64)
        for x in table["counts"]:
            total += np.frombuffer(zstandard.decompress(x.as_py()), np.uint8)
        levels = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "part int, counts binary, n long").groupBy("part").applyInArrow(add_up, "part int, levels binary, n long").collect()
    if not rows:
        return np.zeros(1 << bits, np.uint8), 0
    rows.sort(key=lambda r: r.part)
    return np.frombuffer(b"".join(bytes(r.levels) for r in rows), np.uint8), sum(r.n for r in rows)


ENTRY = np.dtype([("shingle", "<u8"), ("node", "<u8"), ("size", "<u4"), ("place", "<u4")])


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: the highest are nearly all zero, which compression removes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def pack_entries(entries: np.ndarray) -> bytes:
    """A message: gaps of ascending shingles, places, and numbers into a table of the sets."""
    entries = entries[np.argsort(entries["shingle"], kind="stable")]
    _, first, number = np.unique(entries["node"], return_index=True, return_inverse=True)
    sets = entries[first]
    arrays = (np.diff(entries["shingle"], prepend=np.uint64(0)), entries["place"], number.astype("<u4"), sets["node"], sets["size"])
    return np.array([len(entries), len(sets)], "<u8").tobytes() + zstandard.compress(b"".join(map(planes, arrays)), 1)


def unpack_entries(message: bytes) -> np.ndarray:
    n, m = np.frombuffer(message, "<u8", 2).tolist()
    raw, out = zstandard.decompress(message[16:]), np.zeros(n, ENTRY)
    number = from_planes(raw, "<u4", n, 12 * n)
    out["shingle"] = np.cumsum(from_planes(raw, "<u8", n), dtype=np.uint64)
    out["place"] = from_planes(raw, "<u4", n, 8 * n)
    out["node"] = from_planes(raw, "<u8", m, 16 * n)[number]
    out["size"] = from_planes(raw, "<u4", m, 16 * n + 8 * m)[number]
    return out


SENT = "kind int, doc_id long, fingerprint long, node long, twin long, n long, histogram binary, bucket int, entries binary"
_SENT = [(x.split()[0], x.split()[1]) for x in SENT.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each class of their lowest bits; more classes for larger sets. Two sets overlap by no more than the
    sum of the lesser counts. Empty for a set too large to count so."""
    bits = min(12, max(8, int(len(shingles)).bit_length() - 2))
    counts = np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def may_overlap(histograms: list[bytes], size: np.ndarray) -> np.ndarray:
    """Which sets have any other that they may link with, by their histograms."""
    keep = np.array([not h for h in histograms])
    if keep.any():
        return np.ones(len(size), bool)
    classes = min(map(len, histograms))
    counts = np.array([np.frombuffer(h, np.uint8).reshape(-1, classes).sum(0, dtype=np.uint16) for h in histograms])
    step = max(1, (4 << 20) // (len(size) * classes))
    for a in range(0, len(size), step):
        most = np.minimum(counts[a : a + step, None, :], counts[None, :, :]).sum(2, dtype=np.int64)
        room = 7 * most >= 3 * (size[a : a + step, None] + size[None, :])
        room[np.arange(len(room)), np.arange(a, a + len(room))] = False
        keep[a : a + step] |= room.any(1)
        keep |= room.any(0)
    return keep


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of ``n`` with a linked one: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def send(docs: DataFrame, levels: np.ndarray, buckets: int, hot_level: int, shared: np.ndarray) -> DataFrame:
    """Kind 0: a row for each document; kind 1: a chunk's entries for a bucket; kind 2: a hot entry (shingle in ``fingerprint``)."""
    bits, mask, shift = len(levels).bit_length() - 1, NODE_MASK, max(0, 64 - LIST_BITS - buckets.bit_length())

    def rows(kind: int, length: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * length, pa.int32()) if name == "kind" else columns.get(name, pa.nulls(length, _KINDS[t])) for name, t in _SENT], names=[name for name, _ in _SENT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def messages() -> pa.RecordBatch:
            entries = np.concatenate(held)
            held.clear()
            bucket = ((entries["shingle"] >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)
            entries["shingle"] >>= np.uint64(shift)
            order = np.argsort(bucket, kind="stable")
            known, firsts = np.unique(bucket[order], return_index=True)
            return rows(1, len(known), bucket=pa.array(known.astype(np.int32)), entries=pa.array([pack_entries(x) for x in np.split(entries[order], firsts[1:])], pa.binary()))

        for whole in batches:
            for batch in slices(whole, limit=_SLICE):
                sets, at = shingle_sets(batch.column("text"))
                (nodes, checks), n = nodes_of(sets, at, shared, mask), np.diff(at)
                if len(seen) > 200_000:
                    seen.clear()
                fresh = np.zeros(len(n), bool)
                for i, x in enumerate(nodes.tolist()):  # copies send once
                    if x and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                histograms = [histogram(sets[at[i] : at[i + 1]]) if new else None for i, new in enumerate(fresh)]
                yield rows(0, len(n), doc_id=batch.column("doc_id"), fingerprint=batch.column("fingerprint"), node=signed(nodes), twin=signed(checks), n=pa.array(n), histogram=pa.array(histograms, pa.binary()))
                row = np.repeat(np.arange(len(n)), n)
                level = levels[(sets >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((sets, level, row))
                place = np.arange(len(sets)) - at[row]
                use = fresh[row] & (place < (n - needed(n) + 1)[row])
                entries = np.zeros(int(use.sum()), ENTRY)
                entries["shingle"], entries["node"], entries["size"], entries["place"] = sets[order][use], nodes[row[use]], n[row[use]], place[use]
                hot = level[order][use] >= hot_level
                if hot.any():
                    yield rows(2, int(hot.sum()), fingerprint=signed(entries["shingle"][hot]), node=signed(entries["node"][hot]))
                    entries = entries[~hot]
                held.append(entries)
                if sum(map(len, held)) > 1_000_000:
                    yield messages()
        if any(map(len, held)):
            yield messages()
        trim()

    return materialize(docs.select("doc_id", "text", fingerprint()).mapInArrow(run, SENT), "entries")


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether entries of one shingle leave room for a link: 7 * overlap >= 3 * (size + size)."""
    room = 1 + np.minimum(a["size"].astype(np.int64) - 1 - a["place"], b["size"].astype(np.int64) - 1 - b["place"])
    return 7 * room >= 3 * (a["size"].astype(np.int64) + b["size"])


def owner_pairs(entries: np.ndarray) -> np.ndarray:
    """(pivot, node) for the sets that share a shingle."""
    # Of one set's entries in a list (two of its shingles may share it) the first place counts, which leaves the most room.
    entries = entries[np.lexsort((entries["place"], entries["node"], entries["shingle"]))]
    s, x = entries["shingle"], entries["node"]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
    entries = entries[keep]
    if not len(entries):
        return np.zeros((0, 2), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], entries["shingle"][1:] != entries["shingle"][:-1]]))
    sizes = np.diff(np.append(starts, len(entries)))
    found = [np.zeros((0, 2), np.uint64)]
    for k in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == k]
        for part in np.array_split(own, max(1, len(own) * k * k // 2_000_000)) if k <= 1500 else own[:, None]:
            lists = entries[part[:, None] + np.arange(k)]
            keep = np.ones(lists.shape, bool)
            if k <= 1500:  # two linked sets have room for it at their first common shingle
                room = may_link(lists[:, :, None], lists[:, None, :])
                room[:, np.arange(k), np.arange(k)] = False
                keep = room.any(2)
            first = np.argmax(keep, 1)  # nodes ascend in a list
            row, column = np.nonzero(keep)
            other = column != first[row]
            pivots = lists["node"][np.arange(len(lists)), first]
            found.append(np.stack([pivots[row[other]], lists["node"][row[other], column[other]]], 1))
    return np.unique(np.concatenate(found), axis=0)


def region_pairs(sent: DataFrame) -> DataFrame:
    """Distinct (pivot, node), the pivot itself left out."""

    def own(table: pa.Table) -> pa.Table:
        pairs = owner_pairs(np.concatenate([unpack_entries(x) for x in table["entries"].to_pylist()]))
        trim()
        return pa.table({"pivot": signed(pairs[:, 0]), "node": signed(pairs[:, 1])})

    cold = sent.where("kind = 1").select("bucket", "entries").groupBy("bucket").applyInArrow(own, "pivot long, node long")
    hot = sent.where("kind = 2").select(F.col("fingerprint").alias("shingle"), "node")
    pivots = hot.groupBy("shingle").agg(F.min("node").alias("pivot"))
    return cold.unionByName(hot.join(pivots, "shingle").where("node <> pivot").select("pivot", "node")).distinct()


def pack_set(shingles: np.ndarray) -> bytes:
    """Gaps of ascending shingles, in planes for Spark's own compression."""
    return planes(np.diff(shingles, prepend=np.uint64(0)))


def unpack_set(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed, "<u8", len(packed) // 8), dtype=np.uint64)


def candidate_sets(docs: DataFrame, sent: DataFrame, nodes: DataFrame, shared: np.ndarray) -> DataFrame:
    """(node, shingles) of the given nodes, made again from one text of each; a node may come from several tasks."""
    chosen = sent.where("kind = 0").select("node", "fingerprint").join(nodes, "node").groupBy("node").agg(F.min("fingerprint").alias("fingerprint"))
    passed = marked(docs.select("text", fingerprint()), fingerprint_filter(chosen.select("fingerprint")), "inner").select("text")
    mask = NODE_MASK

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, limit=_SLICE):
                found, at = shingle_sets(batch.column("text"))
                own = nodes_of(found, at, shared, mask)[0].tolist()
                fresh = []
                for i, x in enumerate(own):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([signed(np.array([own[i] for i in fresh], np.uint64)), pa.array([pack_set(found[at[i] : at[i + 1]]) for i in fresh], pa.binary())], names=["node", "shingles"])

    return passed.mapInArrow(sets, "node long, shingles binary")


def overlaps(columns: list[np.ndarray], width: int, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sizes of intersections of two lists of sets, given as column numbers."""
    out = np.zeros((len(rows), len(others)), np.float32)
    step = max(256, (4 << 20) // max(1, max(len(rows), len(others))))

    def dense(which: np.ndarray, low: int) -> np.ndarray:
        block = np.zeros((len(which), step), np.float32)
        for i, k in enumerate(which):
            c = columns[k]
            a, b = np.searchsorted(c, [low, low + step])
            block[i, c[a:b] - low] = 1
        return block

    for low in range(0, width, step):
        left = dense(rows, low)
        out += left @ (left if others is rows else dense(others, low)).T
    return out


def shared_columns(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as ascending numbers of the elements that another of them has, and how many such there are."""
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    columns = [np.sort(c[c >= 0]) for c in np.split(number, np.cumsum([len(s) for s in sets])[:-1])]
    return columns, int((counts > 1).sum())


def net(distance: np.ndarray) -> np.ndarray:
    """Which of the pivots stay: in their order, those farther than a window from all before them (cells of nearer ones would be copies)."""
    stay: list[int] = []
    for i in range(len(distance)):
        if not stay or distance[i, stay].min() > 2 * RADIUS:
            stay.append(i)
    return np.array(stay, np.int64)


def links(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets link with which, as a matrix."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    columns, width = shared_columns(sets)
    out = np.zeros((n, n), bool)

    def compare(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Sets the links of ``rows`` with ``others``; gives the distances."""
        both = overlaps(columns, width, rows, others)
        linked = 7 * both >= 3 * (size[rows][:, None] + size[others][None, :])
        out[np.ix_(rows, others)] |= linked
        out[np.ix_(others, rows)] |= linked.T
        return 1 - both / (size[rows][:, None] + size[others][None, :] - both)

    def join(rows: np.ndarray) -> None:
        pivots = rows[np.linspace(0, len(rows) - 1, min(PIVOTS, len(rows) // (LEAF // 2))).astype(np.int64)] if len(rows) > LEAF else rows[:1]
        distance = compare(rows, pivots)
        if len(rows) < 3:
            return
        if len(pivots) > 1:
            own = distance[:, net(distance[np.searchsorted(rows, pivots)])]
            window = own <= own.min(1, keepdims=True) + 2 * RADIUS + 1e-5
            if (window.sum(0) ** 2).sum() <= DIVIDED * len(rows) ** 2:
                for cell in window.T:
                    if cell.sum() > 1:
                        join(rows[cell])
                return
        # Partners differ by the radius at most in their distances to any pivot: compare along that which spreads the sets most.
        axis = distance[:, distance.std(0).argmax()]
        order = np.argsort(axis, kind="stable")
        rows, axis = rows[order], axis[order]
        for start in range(0, len(rows), LEAF):
            own = rows[start : start + LEAF]
            end = np.searchsorted(axis, axis[start + len(own) - 1] + RADIUS + 1e-5, "right")
            if start + 1 < end:
                compare(own, rows[start:end])

    join(np.arange(n))
    np.fill_diagonal(out, False)
    return out


def tile_components(nodes: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Tree edges (node, least node of its component)."""
    left, edges = np.ones(len(nodes), bool), []
    for i in np.argsort(nodes):
        if not left[i]:
            continue
        left[i] = False
        reached, front = [], linked[i] & left
        while front.any():
            left &= ~front
            reached.append(front)
            front = linked[front].any(0) & left
        edges += [(int(x), int(nodes[i])) for f in reached for x in nodes[f]]
    return edges


def work_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each key, sorted by key already; a node (of a kind) that several tasks have made comes once."""
    key, rows, same = None, [], [i for i, c in enumerate(columns) if c in ("kind", "node")]
    for batch in batches:
        for new, row in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if new != key:
                if rows:
                    yield key, rows
                key, rows = new, []
            if not rows or any(rows[-1][i] != row[i] for i in same):
                rows.append(row)
    if rows:
        yield key, rows


def narrowed(members: DataFrame, sent: DataFrame) -> DataFrame:
    """(pivot, node): the members of regions that may link with another of theirs, judged by histograms (a few hundred bytes a set)."""
    summaries = sent.where("kind = 0 AND histogram IS NOT NULL").select("node", "n", "histogram")
    work = members.join(summaries, "node").repartition("pivot").sortWithinPartitions("pivot", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pivot", "node"])

        for (pivot,), rows in work_groups(batches, ["pivot"], ["node", "n", "histogram"]):
            if len(rows) > 1:
                keep = may_overlap([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))
                out += [(pivot, r[0]) for r, k in zip(rows, keep, strict=True) if k]
            if len(out) > 50_000:
                yield made()
        yield made()

    return materialize(work.select("pivot", "node", "n", "histogram").mapInArrow(run, "pivot long, node long"), "members")


def cells_of(members: DataFrame, sizes: DataFrame, sets: DataFrame, tile: int, number: int) -> DataFrame:
    """(pivot, node, size, cells, axis): the Voronoi cells, with windows, that a member of a large region goes to, and its distance to one pivot.

    The pivots are the region's least set and about PIVOTS others drawn by hash; each part of a region gets them all, so no task holds a region.
    """
    rows = members.join(sizes, "pivot").withColumn("parts", F.ceil(F.col("size") / tile).cast("int"))
    draw = F.pmod(F.xxhash64("node", "pivot", F.lit(number)), F.col("size")) < PIVOTS
    pivots = rows.where(draw | (F.col("node") == F.col("first"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    both = pivots.select("pivot", "part", "size", F.lit(0).alias("kind"), "node").unionByName(parts.select("pivot", "part", "size", F.lit(1).alias("kind"), "node"))
    work = both.join(sets, "node").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for (region, _), rows in work_groups(batches, ["pivot", "part"], ["kind", "node", "size", "shingles"]):
            k = sum(r[0] == 0 for r in rows)
            columns, width = shared_columns([unpack_set(r[3]) for r in rows])
            size = np.array([len(r[3]) // 8 for r in rows], np.int64)
            own, others = np.arange(k, len(rows)), np.arange(k)
            if not len(own):
                continue
            every = np.concatenate([own, others])
            overlap = overlaps(columns, width, every, others)
            distance = 1 - overlap / (size[every][:, None] + size[others][None, :] - overlap)
            stay = net(distance[len(own) :])
            distance = distance[: len(own), stay]
            window = distance <= distance.min(1, keepdims=True) + 2 * RADIUS + 1e-5
            names = np.array([rows[i][1] for i in stay], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([region] * len(own), pa.int64()), pa.array([rows[i][1] for i in own], pa.int64()), pa.array([rows[i][2] for i in own], pa.int64()), pa.array([names[w].tolist() for w in window], pa.list_(pa.int64())), pa.array(distance[:, 0].astype(float))],
                names=["pivot", "node", "size", "cells", "axis"],
            )

    return materialize(work.select("pivot", "part", "kind", "node", "size", "shingles").mapInArrow(run, "pivot long, node long, size long, cells array<long>, axis double"), "cells")


def divided(members: DataFrame, sets: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Members (pivot, node) of large regions as those of cells of ``tile`` sets at most, and as those of crowds (pivot, node, axis), which no pivots divide."""
    small, crowds, number = [], [], 0
    while True:
        sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where(F.col("size") > tile)
        sizes = materialize(sizes, "large")
        small.append(members.join(sizes, "pivot", "left_anti").select("pivot", "node"))
        if sizes.isEmpty():
            break
        found = cells_of(members.join(sizes.select("pivot"), "pivot"), sizes, sets, tile, number)
        cells = found.select("pivot", "node", F.explode("cells").alias("cell"), "size")
        counts = cells.groupBy("pivot", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("size").cast("double").alias("size"))
        needed = counts.groupBy("pivot").agg(F.sum(F.col("n") * F.col("n")).alias("n"), F.max(F.col("size") * F.col("size")).alias("size"))
        whole = materialize(needed.where(F.col("n") > DIVIDED * F.col("size")).select("pivot"), "crowds")  # else the cells copy too much
        crowds.append(found.join(whole, "pivot").select("pivot", "node", "axis"))
        members = cells.join(whole, "pivot", "left_anti").select(F.xxhash64("pivot", "cell", F.lit(number)).alias("pivot"), "node")
        members, number = materialize(members, "divided"), number + 1
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    rings = sets.select(F.lit(0).cast("long").alias("pivot"), "node", F.lit(0.0).alias("axis")).limit(0)
    for more in crowds:
        rings = rings.unionByName(more)
    return out, rings


def tiles_of(members: DataFrame, crowds: DataFrame, tile: int) -> DataFrame:
    """(pivot, low, high, part, node): a region is one tile; of a crowd, cut into rings of about ``tile`` sets by the distance to a pivot,
    any two rings whose distances come within the radius are."""
    whole = members.select("pivot", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("part"), "node")
    if crowds.isEmpty():
        return whole
    steps = crowds.withColumn("step", F.floor(F.col("axis") * 4096))
    counts = steps.groupBy("pivot", "step").agg(F.count(F.lit(1)).alias("n"))  # 4097 rows a region at most
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("step")) - F.col("n")
    counts = counts.withColumn("before", before)
    rings = steps.join(counts, ["pivot", "step"]).withColumn("part", (F.floor(F.col("before") / tile) + F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile))).cast("int"))
    rings = materialize(rings.select("pivot", "node", "part", "axis"), "rings")
    spans = rings.groupBy("pivot", "part").agg(F.min("axis").alias("near"), F.max("axis").alias("far"))
    other = spans.select("pivot", F.col("part").alias("high"), F.col("near").alias("near2"), F.col("far").alias("far2"))
    apart = F.greatest(F.col("near2") - F.col("far"), F.col("near") - F.col("far2"))
    pairs = spans.join(other, "pivot").where((F.col("part") <= F.col("high")) & (apart <= RADIUS + 1e-5)).select("pivot", F.col("part").alias("low"), "high")
    of = pairs.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("part"))
    return whole.unionByName(rings.join(of, ["pivot", "part"]).select("pivot", "low", "high", "part", "node"))


def region_links(members: DataFrame, crowds: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """(node, root, n_links): tree edges of every tile, and numbers of links counted in one region each (root null)."""
    # All regions of a set: a pair counts in the least one that both are in.
    regions = members.unionByName(crowds.select("pivot", "node")).groupBy("node").agg(F.array_sort(F.collect_set("pivot")).alias("regions"))
    tiles = tiles_of(members, crowds, tile)
    if tiles.count() <= BROADCAST_ROWS:  # then sets go to their tiles at once; else they are shuffled to these rows first
        tiles, regions = F.broadcast(tiles), F.broadcast(regions)
    work = sets.join(tiles, "node").join(regions, "node").repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high", "node")

    def join(pivot: int, low: int, high: int, rows: list[tuple]) -> list[tuple]:
        nodes = np.array([r[1] for r in rows], np.int64)
        linked = links([unpack_set(r[2]) for r in rows])
        out = [(x, root, None) for x, root in tile_components(nodes, linked)]
        if low != high:  # pairs within a part count in that part's own tile
            part = np.array([r[0] for r in rows])
            linked &= part[:, None] != part[None, :]
        if linked.any():
            before = [np.array([p for p in r[3] if p < pivot], np.int64) for r in rows]
            if sum(len(b) > 0 for b in before) > 1:
                columns, width = shared_columns(before)
                every = np.arange(len(rows))
                linked &= overlaps(columns, width, every, every) == 0
            out += [(x, None, k) for x, k in zip(nodes.tolist(), linked.sum(1).tolist(), strict=True) if k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "root", "n_links"])

        for key, rows in work_groups(batches, ["pivot", "low", "high"], ["part", "node", "shingles", "regions"]):
            if len(rows) > 1:
                out += join(*key, rows)
            if len(out) > 10_000:
                yield made()
        yield made()
        trim()

    return materialize(work.select("pivot", "low", "high", "part", "node", "shingles", "regions").mapInArrow(run, "node long, root long, n_links long"), "links")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; edges (node, root)."""
    both = materialize(edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("root"), F.col("label").alias("said")), "root").groupBy("node").agg(F.min("said").alias("said"))
        step = labels.join(heard, "node").select("node", F.least("label", "said").alias("label"), F.col("label").alias("old"))
        step = materialize(step, "labels")
        # Jump: the label of one's label is in the same component.
        jumped = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("farther")), "label").select("node", "old", F.col("farther").alias("label"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def _components(docs: DataFrame, tile: int, hot: int) -> DataFrame:
    """(doc_id, fingerprint, n_shingles, component_id, n_links, node) of each document."""
    levels, total = sketch_counts(docs, cell_bits(docs))
    buckets = max(1, total // 4 // BUCKET_ENTRIES)
    hot_level = int(8 * np.log2(1 + total / len(levels) + hot))
    shared = np.zeros(0, np.uint64)
    while True:
        sent = send(docs, levels, buckets, hot_level, shared)
        # As many rows as 64 bits fail to tell sets apart: n * n / 2**65 of n sets.
        twins = sent.where("kind = 0 AND n > 0").groupBy("node").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").select("node").collect()
        if not twins:
            break
        shared = np.union1d(shared, np.array([r.node for r in twins], np.int64).view(np.uint64))
    pairs = materialize(region_pairs(sent), "pairs")
    members = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("node")).distinct())
    large = materialize(members.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile).select("pivot"), "large")
    if large.isEmpty():
        members = narrowed(members, sent)
        crowds = members.select("pivot", "node", F.lit(0.0).alias("axis")).limit(0)
    else:
        wide = materialize(members.join(large, "pivot"), "wide")
        sets = materialize(candidate_sets(docs, sent, wide.select("node").distinct(), shared), "sets")
        cells, crowds = divided(wide, sets, tile)
        members = narrowed(members.join(large, "pivot", "left_anti"), sent).unionByName(cells)
        members, crowds = materialize(members, "members"), materialize(crowds, "crowds")
    nodes = members.select("node").unionByName(crowds.select("node")).distinct()
    found = region_links(members, crowds, candidate_sets(docs, sent, nodes, shared), tile)
    labels = connected(found.where("root is not null").select("node", "root").distinct())
    degrees = found.where("n_links is not null").groupBy("node").agg(F.sum("n_links").alias("n_links"))

    rows = sent.where("kind = 0").select("doc_id", "fingerprint", "node", F.col("n").alias("n_shingles"))
    full = rows.where("n_shingles > 0")
    least = full.groupBy("node").agg(F.min("doc_id").alias("first"))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(component, "label").join(degrees, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "label"), "named")
    out = full.join(named, "node", "left")
    empty = rows.where("n_shingles = 0").select("*", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("label"))
    return out.unionByName(empty)


def jaccard_components(docs: DataFrame, tile: int = TILE, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable), n_links (to other shingle sets)."""
    return _components(id_and_text(docs), tile, hot).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each_component(docs: DataFrame, tile: int = TILE, hot: int = HOT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component one row with its smallest doc_id; all without words."""
    rows = _components(id_and_text(docs), tile, hot).where("label is not null").select("label", "doc_id", "fingerprint")
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("fingerprint").alias("c"))
    groups = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).where("n > 1").drop("n"), "groups")
    classes = rows.join(groups, "label").groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max((first == F.col("first")).cast("int")).alias("stay")).where("stay < n")
    return keep_rows(docs, materialize(classes.drop("n"), "classes"))
