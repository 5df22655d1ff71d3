"""Operator 7: token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A chunk's symbols form a linked list; a heap holds the adjacent pairs that the vocabulary can merge, best rank
first, leftmost first among equals. Each pop merges one pair, and the count is the initial symbols less the
merges. A symbol outside the vocabulary counts one token for each of its UTF-8 bytes (byte fallback).

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows count each for itself; an empty
table gives an empty result; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import ChunkStore, split
from .common import claim, droppers, id_and_text, slices

#: The sign that stands for a space in the vocabulary.
MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Texts in which a run of spaces (or the sign itself) could merge across a single space.
_RUNS = rf"^ |  |{MARK}"


class PieceVocabulary:
    """Pieces and ranks read from a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        order = sorted(ids, key=lambda i: (-model.get_score(i), i))
        self.rank: dict[str, int] = {}
        score, rank = None, 0
        for i in order:  # equal scores are equal ranks
            if model.get_score(i) != score:
                score, rank = model.get_score(i), rank + 1
            self.rank[model.id_to_piece(i)] = rank
        #: No piece goes on behind a space's sign, so a text falls apart before each of them.
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.rank)

    def count(self, text: str) -> int:
        """Tokens of ``text``, in which spaces are already written as the sign."""
        n = len(text)
        if n == 0:
            return 0
        rank = self.rank.get
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != size:
                continue  # one of the two has merged meanwhile
            symbols[left], symbols[right] = a + b, None
            merges += 1
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                if (r := rank(symbols[left] + symbols[following])) is not None:
                    heapq.heappush(heap, (r, left, following, size + len(symbols[following])))
            if (previous := before[left]) >= 0 and (r := rank(symbols[previous] + symbols[left])) is not None:
                heapq.heappush(heap, (r, previous, left, size + len(symbols[previous])))
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in self.rank)


class TokenCounter:
    """Token counts of whole texts; the counts of chunks between spaces are kept within a bound."""

    def __init__(self, path: str, limit: int = 400_000):
        self.vocabulary, self.store = PieceVocabulary(path), ChunkStore(limit)

    def chunk(self, chunk: str) -> list[int]:
        return [self.vocabulary.count(MARK + chunk)]

    def text(self, text: str) -> int:
        """A whole text by itself."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.vocabulary.separable:
            return self.vocabulary.count(text)
        return sum(self.vocabulary.count(x) for x in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text))

    def counts(self, texts: pa.Array) -> np.ndarray:
        store = self.store
        store.forget()
        single = pc.match_substring_regex(texts, _RUNS) if self.vocabulary.separable else pa.array([True] * len(texts))
        chunks, ends, distinct = split(pc.if_else(single, "", texts))
        numbers = store.numbers(distinct, lambda c: [self.chunk(x) for x in c])
        per_chunk = store.flat[store.ends[numbers] - 1].astype(np.int64)
        out = np.add.reduceat(per_chunk[chunks], np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
        out[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        for i in np.flatnonzero(single.to_numpy(zero_copy_only=False)):
            out[i] = self.text(texts[int(i)].as_py())
        return out


_counters: dict[str, TokenCounter] = {}
droppers.append(_counters.clear)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every text; one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(f"counts {model}")
        counter = _counters.get(model) or _counters.setdefault(model, TokenCounter(model))
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text")
                tokens = counter.counts(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, SCHEMA)
