"""Operator 6: benchmark decontamination by pigeonhole edit matching.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z; of scripts written without spaces, each character is a word
and the wide punctuation is none. An item of W words may occur with up to k = max(0, min(W // 5, W // 4 - 1)) words inserted, deleted
or replaced. Split into k + 1 pieces, one of which then occurs unchanged; each piece has four words at least, and its first four are
looked up in every document. Around each hit, Myers' bit-parallel algorithm gives the least distance of the item to any run of the
document's words. An item of one to three words is its own piece and looked up whole.

Defined results: null or empty texts and items without a word match nothing; items of one to seven words match unchanged only (so an
item of one common word is found in every document with that word); each row of a document that occurs twice, and each of two equal
items, is reported; empty tables give an empty result; other columns are ignored by ``contamination`` and kept by ``uncontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, id_and_text
from .hashing import WordHasher, runs

PIECE = 4
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
SCHEMA = "doc_id long, item_id long, distance int, budget int, item_words int, start_word long"
#: Characters of scripts without spaces between words; the long vowel marks belong to no script.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}\p{Javanese}\p{Balinese}\x{30FC}\x{FF70}])"
#: The wide space and wide punctuation, which separate words as their ASCII likes do.
WIDE = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{303D}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"
#: Items whose pieces a worker holds at a time; more are matched in as many passes as needed.
BLOCK_ITEMS = 50_000


def budget(words: int) -> int:
    return max(0, min(words // 5, words // PIECE - 1))


def edit_distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least Levenshtein distance of ``pattern`` to a run of ``text``, and where that run ends."""
    m = len(pattern)
    high, mask = 1 << (m - 1), (1 << m) - 1
    equal: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        equal[symbol] = equal.get(symbol, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text):
        eq = equal.get(symbol, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (mask & ~(horizontal | plus)), plus & horizontal
        score += bool(up & high) - bool(down & high)
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | (mask & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def spaced(texts: pa.Array) -> pa.Array:
    """``texts`` with spaces around each character of a script without, and for wide punctuation."""
    texts = texts.cast(pa.large_string())
    for pattern, apart in ((UNSPACED, r" \1 "), (WIDE, " ")):
        if pc.any(pc.match_substring_regex(texts, pattern)).as_py():
            texts = pc.replace_substring_regex(texts, pattern, apart)
    return texts


def spans(diagonals: set[int], length: int, k: int) -> list[tuple[int, int]]:
    """Where an item of ``length`` words may lie within ``k`` edits, if its first word is about at one of the ``diagonals``; those that touch are joined."""
    out: list[tuple[int, int]] = []
    for d in sorted(diagonals):
        low, high = d - k, d + length + k
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


class Pieces:
    """Where pieces of ``n`` words occur, by the hash of their words."""

    def __init__(self, n: int, keys: list[int], places: list[tuple[int, int]]):
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.n, self.keys = n, np.array(keys, np.uint64)[order]
        self.places = np.array(places, np.int64).reshape(-1, 2)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & np.uint64((1 << 20) - 1)] = True

    def find(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each hit, in the order of words: its row, its first word, the item and the piece's start in it."""
        found = runs(words, self.n)
        maybe = np.flatnonzero(self.seen[found & np.uint64((1 << 20) - 1)])
        low, high = np.searchsorted(self.keys, found[maybe], "left"), np.searchsorted(self.keys, found[maybe], "right")
        rows = np.searchsorted(at, maybe, "right") - 1
        real = (high > low) & (maybe + self.n <= at[rows + 1])
        rows, maybe, low, n = rows[real], maybe[real], low[real], (high - low)[real]
        at_key = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else low, n) + np.arange(n.sum())
        items, starts = self.places[at_key].T
        return np.repeat(rows, n), np.repeat(maybe, n), items, starts


class Matcher:
    """Finds items in batches of texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hasher = WordHasher(SEPARATORS)
        words, at = self.hasher.hashes(spaced(pa.array([t for _, t in items], pa.string())))
        self.items, pieces = [], {}
        for (item_id, _), a, b in zip(items, at, at[1:], strict=False):
            own = words[a:b]
            if not len(own):
                continue
            k, n = budget(len(own)), min(len(own), PIECE)
            keys, places = pieces.setdefault(n, ([], []))
            for i in range(k + 1):
                start = i * len(own) // (k + 1)
                keys.append(runs(own[start : start + n], n)[0])
                places.append((len(self.items), start))
            self.items.append((item_id, own.tolist(), k))
        self.pieces = [Pieces(n, *found) for n, found in sorted(pieces.items())]

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item_id, distance, budget, words, first word) of every item in every text, the best place of each."""
        words, at = self.hasher.hashes(spaced(texts))
        out, candidates = [], {}
        for pieces in self.pieces:
            rows, firsts, items, starts = pieces.find(words, at)
            if pieces.n < PIECE:  # found whole: the first place of each
                _, first = np.unique(rows * len(self.items) + items, return_index=True)
                for row, place, item in zip(rows[first].tolist(), (firsts - at[rows])[first].tolist(), items[first].tolist(), strict=True):
                    out.append((row, self.items[item][0], 0, 0, pieces.n, place))
                continue
            for row, item, diagonal in zip(rows.tolist(), items.tolist(), (firsts - starts).tolist(), strict=True):
                candidates.setdefault((row, item), set()).add(diagonal)
        for (row, item), diagonals in candidates.items():
            item_id, pattern, k = self.items[item]
            best = None
            # Windows that touch are one, so no word of a text is compared twice with an item, however often its pieces occur.
            for low, high in spans(diagonals, len(pattern), k):
                start, until = max(int(at[row]), low), min(int(at[row + 1]), high)
                distance, end = edit_distance(pattern, words[start:until].tolist())
                if distance <= k and (best is None or distance < best[0]):
                    best = distance, max(0, start + end - len(pattern) - int(at[row]))
                    if not distance:
                        break
            if best:
                out.append((row, item_id, best[0], k, len(pattern), best[1]))
        return out


def matchers(benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> Iterator[Matcher]:
    """Matchers of bounded size that together hold all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // block_items))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Matcher([(r.item_id, r.text) for r in own.collect()])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def contamination(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and item found in it; one pass over the documents for each block of items."""

    def search(matcher: Matcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            for batch in _parts(batches):
                if hits := matcher.hits(batch.column("text")):
                    rows, *columns = zip(*hits, strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return id_and_text(docs).mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(search, matchers(benchmark, block_items)))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item occurs."""
    bounded_batches(docs)
    for matcher in matchers(benchmark, block_items):

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            claim("decontamination")
            for batch in _parts(batches):
                texts = batch.column("text").cast(pa.string()).fill_null("")
                hit = {row for row, *_ in matcher.hits(texts)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
