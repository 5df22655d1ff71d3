"""Operator 2: hierarchical multi-length packing.

Each task packs its own documents, block by block: a document of the longest context size or more gives full
windows; what is left of it is routed to the shortest tier that holds it. Tiers are packed from the longest down:
a document opens a window of its tier, and the gap is filled with the largest fitting documents of shorter
tiers (of its own at last); the last one is cut. What a block cannot fill goes on to the next block, and the end of the
last block is laid out as windows of falling powers of two. So every sequence has a power of two as its length,
and none needs padding. Sequences of one tier are gathered into step groups of equal token counts; what is over at a task's
end is dealt to the least loaded group, longest first.

Defined results: a null or empty text is the end id alone; a repeated row is packed as often as it occurs, a null doc_id stays
null; an empty table gives an empty result; other columns are ignored. No row is shuffled, and a task holds one block.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import encoder
from .common import id_and_text, slices, trim

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
TIERS = (512, 1024, 2048, 4096)
#: Chunks that a worker keeps, and bytes of text that it encodes at a time: it shares its executor with a grown heap.
KEPT_CHUNKS = 200_000
SLICE = 3 << 20
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


class Rest:
    """The part of a document that is not yet in a window."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, ids: np.ndarray):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, 0, len(ids)

    def __len__(self) -> int:
        return self.total - self.start

    def cut(self, n: int) -> tuple:
        """Takes the next ``n`` ids off as a piece."""
        a, b = self.start, self.start + n
        self.start = b
        return self.doc_id, a, n, zlib.crc32(np.ascontiguousarray(self.ids[a:b])), self.total


class Pool:
    """Rests by length."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.rests: list[Rest] = []

    def add(self, rest: Rest) -> None:
        i = bisect.bisect_right(self.lengths, len(rest))
        self.lengths.insert(i, len(rest))
        self.rests.insert(i, rest)

    def pop(self, i: int) -> Rest:
        del self.lengths[i]
        return self.rests.pop(i)


class Packer:
    """Sequences, as lists of pieces, out of documents."""

    def __init__(self, tiers: Sequence[int] = TIERS):
        self.tiers = sorted(tiers)
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("context sizes are powers of two")
        self.pool = Pool()

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        rest = Rest(doc_id, ids)
        while len(rest) >= self.tiers[-1]:
            yield [rest.cut(self.tiers[-1])]
        if len(rest):
            self.pool.add(rest)

    def fill(self, window: int) -> list[tuple]:
        """A full window: the longest rest that fits, then what fits the gap best; the last one is cut."""
        pieces, gap = [], window
        while gap:
            i = bisect.bisect_right(self.pool.lengths, gap) - 1
            rest = self.pool.pop(max(i, 0))
            pieces.append(rest.cut(min(gap, len(rest))))
            gap -= pieces[-1][2]
            if len(rest):
                self.pool.add(rest)
        return pieces

    def pack(self) -> Iterator[list[tuple]]:
        """Full windows of every tier, longest first, while there are rests of that tier and enough ids."""
        total = sum(self.pool.lengths)
        for k in range(len(self.tiers) - 1, -1, -1):
            window, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while total >= window and self.pool.lengths[-1] > below:
                yield self.fill(window)
                total -= window

    def end(self) -> Iterator[list[tuple]]:
        """All that is left, in windows of falling powers of two."""
        yield from self.pack()
        total = sum(self.pool.lengths)
        while total:
            window = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            yield self.fill(window)
            total -= window


class Steps:
    """Step groups of ``tokens`` ids each."""

    def __init__(self, tokens: int):
        self.tokens, self.open, self.groups = tokens, {}, 0

    def add(self, sequence: list[tuple]) -> Iterator[tuple[int, int, list[tuple]]]:
        """(group, tier, sequence) of a tier's group as soon as that is full."""
        tier = sum(p[2] for p in sequence)
        waiting = self.open.setdefault(tier, [])
        waiting.append(sequence)
        if len(waiting) * tier >= self.tokens:
            yield from ((self.groups, tier, s) for s in waiting)
            self.groups += 1
            waiting.clear()

    def end(self) -> Iterator[tuple[int, int, list[tuple]]]:
        left = sorted(((t, s) for t, w in self.open.items() for s in w), key=lambda x: -x[0])
        loads = [(0, self.groups + i) for i in range(-(-sum(t for t, _ in left) // self.tokens))]
        for tier, sequence in left:
            load, group = loads[0]
            heapq.heapreplace(loads, (load + tier, group))
            yield group, tier, sequence


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: Sequence[int] = TIERS, block_tokens: int = 1 << 20, step_tokens: int = 1 << 16) -> DataFrame:
    """One row for each piece of each document; a sequence's pieces lie gapless from offset 0 and fill a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, end_id, KEPT_CHUNKS)
        packer, steps, task, number = Packer(tiers), Steps(step_tokens), TaskContext.get().partitionId() << 33, 0

        def rows(sequences: Iterator[list[tuple]], over: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal number
            columns: list[list] = [[] for _ in _FIELDS]

            def put(group: int, tier: int, sequence: list[tuple]) -> None:
                nonlocal number
                at = 0
                for piece in sequence:
                    for column, x in zip(columns, (*piece, task + number, at, tier, task + group), strict=True):
                        column.append(x)
                    at += piece[2]
                number += 1

            for sequence in sequences:
                for x in steps.add(sequence):
                    put(*x)
            for x in steps.end() if over else ():
                put(*x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if f == "tier" else pa.int64()) for c, f in zip(columns, _FIELDS, strict=True)], names=_FIELDS)

        def taken() -> Iterator[list[tuple]]:
            held = 0
            for whole in batches:
                for batch in slices(whole, limit=SLICE):
                    ids, ends = tokens.encode(batch.column("text"))
                    start = 0
                    for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                        yield from packer.add(doc_id, ids[start:end])
                        held += (end - start) % packer.tiers[-1]
                        start = end
                    if held >= block_tokens:
                        yield from packer.pack()
                        held = sum(packer.pool.lengths)
                        for rest in packer.pool.rests:  # lets go of the batch
                            rest.ids = rest.ids.copy()
                    yield []
                trim()

        some: list[list[tuple]] = []
        for sequence in taken():
            if sequence:
                some.append(sequence)
            else:
                yield from rows(iter(some))
                some = []
        yield from rows(packer.end(), over=True)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
