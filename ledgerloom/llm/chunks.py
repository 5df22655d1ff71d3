"""Text split at spaces, each distinct chunk handled once.

Words repeat, so what a tokenizer does to a chunk is kept: a batch of texts becomes an array of chunk numbers,
and per-chunk results are gathered with numpy. ``ChunkStore`` bounds what is kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim, droppers

#: White space of any tokenizer's definition, for RE2.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A run of white space that crosses a single space, or the start of a special token's string.
CROSSING = rf"[{_SPACE}] [{_SPACE}]|  |<\|"


class ChunkStore:
    """Integer sequences by chunk: at most ``limit`` chunks of at most ``longest`` characters stay from batch to batch; the rest live for one batch."""

    def __init__(self, limit: int = 400_000, longest: int = 40):
        self.limit, self.longest = limit, longest
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.n = self.kept = 0

    def forget(self) -> None:
        """Drops what was only for the last batch."""
        self.n = self.kept

    def add(self, sequences: Sequence[Sequence[int]]) -> int:
        """Appends; gives the number of the first."""
        first, lengths = self.n, np.fromiter(map(len, sequences), np.int64, len(sequences))
        at = int(self.ends[first - 1]) if first else 0
        total = at + int(lengths.sum())
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(sequences) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[at:total] = np.fromiter((x for s in sequences for x in s), np.uint32, total - at)
        self.ends[first : first + len(sequences)] = at + np.cumsum(lengths)
        self.n += len(sequences)
        return first

    def numbers(self, chunks: list[str], encode: Callable[[list[str]], Sequence[Sequence[int]]]) -> np.ndarray:
        """The number of each of ``chunks`` (distinct), new ones through ``encode``."""
        get = self.known.get
        out = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        # Those to keep come first, so that forget() drops only the others.
        keep = [i for i in missing if len(chunks[i]) <= self.longest][: max(0, self.limit - len(self.known))] if self.n == self.kept else []
        kept = set(keep)
        order = [*keep, *(i for i in missing if i not in kept)]
        first = self.add(encode([chunks[i] for i in order]))
        out[order] = np.arange(first, first + len(order))
        self.known.update((chunks[i], first + k) for k, i in enumerate(keep))
        self.kept += len(keep)
        return out

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        return self.ends[numbers] - np.where(numbers > 0, self.ends[numbers - 1], 0)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``numbers`` one after the other, and where each ends."""
        n = self.lengths(numbers)
        ends = np.cumsum(n)
        at = np.repeat(self.ends[numbers] - ends, n)
        at += np.arange(len(at))
        return self.flat[at], ends


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Chunk numbers of all texts, where each text's end, and the distinct chunks; every text has one chunk at least."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)), coded.dictionary.to_pylist()


# Fixed value: how a pre-tokenizer that drops white space and lower-cases splits words.
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word's marks before white space: a pre-token of their own, under WORDS_PATTERN as in byte-level tokenizers.
MARKS = r"([\p{L}\p{N}])([.,;:!?$&*#%]+)( |\n|$)"
#: New words that the library gets at a time.
TOGETHER = 20_000
#: Stands before a chunk that follows without a space (a private character; texts that hold it are encoded whole).
JOINED = "\ue000"


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them without added special tokens, ``end_id`` behind each text.

    Chunks between single spaces are encoded by the library once and kept. Texts in which a token could cross
    a chunk's border (runs of white space, strings of special tokens) go to the library whole.

    Chunks are cut finer, at line breaks and before marks, where the tokenizer is known to split there: if it splits words by WORDS_PATTERN and
    lower-cases, or is byte-level with its own pattern. New words of letters alone are then encoded many at a time, as the vocabulary tells
    where each ends (its suffix) or begins (its space).
    """

    def __init__(self, path: str, end_id: int, limit: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.store = Tokenizer.from_file(path), ChunkStore(limit)
        self.spaced = len(self.library.encode(" ", add_special_tokens=False).ids) > 0  # a space belongs to the chunk behind it
        self.end = self.store.add([[end_id]])
        self.store.kept = 1
        own = json.loads(self.library.to_str())
        kinds = json.dumps(own["normalizer"]), json.dumps(own["pre_tokenizer"])
        suffix, vocabulary = own["model"].get("end_of_word_suffix"), self.library.get_vocab()
        first = own["pre_tokenizer"] or {}
        #: Which ids end a word, or (byte-level) begin one with its space; None if chunks are not cut finer.
        self.ends_word = self.begins_word = None
        if suffix and '"Lowercase"' in kinds[0] and json.dumps(WORDS_PATTERN) in kinds[1] and not self.spaced:
            self.ends_word = self._mask(vocabulary, lambda t: t.endswith(suffix))
        elif first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and own["normalizer"] is None and self.spaced:
            self.begins_word = self._mask(vocabulary, lambda t: t.startswith("\u0120"))

    @staticmethod
    def _mask(vocabulary: dict[str, int], fits: Callable[[str], bool]) -> np.ndarray:
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for t, i in vocabulary.items() if fits(t)]] = True
        return out

    def words(self, chunks: list[str]) -> list[Sequence[int]]:
        """Ids of chunks, words of letters alone in one text."""
        spaced = self.begins_word is not None
        out: list[Sequence[int]] = [()] * len(chunks)
        plain = pc.match_substring_regex(pa.array(chunks, pa.string()), r"\A\p{L}+\z").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain)
        done = np.zeros(len(chunks), bool)
        for part in (at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)):
            together = (" " if spaced else "") + " ".join([chunks[i] for i in part])
            ids = np.array(self.library.encode(together, add_special_tokens=False).ids, np.int64)
            begin = np.flatnonzero(self.begins_word[ids]) if spaced else np.concatenate([[0], np.flatnonzero(self.ends_word[ids]) + 1])[:-1]
            if len(begin) == len(part) and begin[0] == 0:  # else lower case has made a word two
                ids, borders = ids.tolist(), [*begin.tolist(), len(ids)]
                for i, a, b in zip(part.tolist(), borders, borders[1:], strict=False):
                    out[i] = ids[a:b]
                done[part] = True
        rest = np.flatnonzero(~done)
        texts = [chunks[i] for i in rest]
        if spaced:
            texts = [x[1:] if x.startswith(JOINED) else f" {x}" for x in texts]
        for i, ids in zip(rest.tolist(), self.ids(texts), strict=True):
            out[i] = ids
        return out

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end."""
        store = self.store
        store.forget()
        if self.ends_word is not None:
            whole = pc.match_substring_regex(texts, "<\\||\u0130")  # the one letter whose lower case is a letter and a mark
            fine = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), MARKS, r"\1 \2\3")
        else:
            whole = pc.match_substring_regex(texts, f"{CROSSING}|{JOINED}")
            fine = texts
        if self.begins_word is not None:
            fine = pc.replace_substring_regex(fine, MARKS, rf"\1 {JOINED}\2\3")
            fine = pc.replace_substring_regex(fine, rf"([^{_SPACE}])\n([^{_SPACE}])", f"\\1 {JOINED}\n {JOINED}\\2")
        chunks, ends, distinct = split(pc.if_else(whole, "", fine))
        plain = (lambda c: self.ids([f" {x}" for x in c])) if self.spaced else self.ids
        numbers = store.numbers(distinct, plain if self.ends_word is None and self.begins_word is None else self.words)[chunks]
        firsts = np.concatenate([[0], ends[:-1]])
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if self.spaced:  # the first chunk has no space before it
            plain = np.setdiff1d(np.arange(len(firsts)), at)
            coded = pa.array([distinct[chunks[firsts[i]]] for i in plain], pa.string()).dictionary_encode()
            if len(plain):
                numbers[firsts[plain]] = store.add(self.ids(coded.dictionary.to_pylist())) + coded.indices.to_numpy(zero_copy_only=False)
        if len(at):
            numbers[firsts[at]] = store.add(self.ids(texts.take(pa.array(at)).to_pylist())) + np.arange(len(at))
        ids, at_chunk = store.gather(np.insert(numbers, ends, self.end))
        return ids, at_chunk[ends + np.arange(len(ends))]


_encoders: dict[tuple, LibraryEncoder] = {}
droppers.append(_encoders.clear)


def encoder(path: str, end_id: int, limit: int = 400_000) -> LibraryEncoder:
    """This worker's encoder, kept from task to task."""
    claim(f"tokens {path}")
    if (path, end_id, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id, limit] = LibraryEncoder(path, end_id, limit)
    return _encoders[path, end_id, limit]
