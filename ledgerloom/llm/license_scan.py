"""Operator 9: licence scan by a trained paragraph classifier.

Sparse multinomial logistic regression over word n-grams (one to three words) tells licence families and "unknown" apart. It is trained on
notices made from phrases, family names and paragraphs of the licences (whole, in parts, with words left out), on paragraphs of other
licences, and on ordinary paragraphs of at most ``sample`` documents. A validation part sets the temperature of its probabilities and the least
probability of a family at which a paragraph is believed to be its notice. The classifier names the family; the closest of
that family's paragraphs and names (Myers' word distance) confirms it if it is close enough. Every paragraph (line) of every whole text is scanned; one in which no n-gram of the
vocabulary occurs has the unknown class's score alone, and costs only the lookups.

Wrapped notices: between blank lines, templates are also looked up across line breaks (a template of W words within W // 4 edits has a
piece that occurs unchanged; around it, Myers). The lines that one lies over are judged as one paragraph, numbered by the first of
them. If it is confirmed, its row takes the place of their own, unless one of these is confirmed and as close.

Defined results: only paragraphs believed to be of a family are reported, each row of a repeated document; null and empty texts
report nothing; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, sample_texts, slices
from .decontamination import SEPARATORS, Pieces, edit_distance
from .hashing import WordHasher, runs
from .licence_texts import NAMES, OTHER_PASSAGES, OTHERS, PASSAGES, PHRASES

SCHEMA = "doc_id long, paragraph int, family string, probability double, template string, distance double, confirmed boolean"
UNKNOWN = "unknown"
SAMPLE = 600
#: Words of a paragraph's sentence that is a template of its own.
SENTENCE = 10
#: A template is found if at most this share of its words differs.
CONFIRM = 0.25

class Grams:
    """N-gram hashes of paragraphs."""

    def __init__(self) -> None:
        self.hasher = WordHasher(SEPARATORS)

    def find(self, paragraphs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of n-grams: hashes and the paragraph of each."""
        words, at = self.hasher.hashes(paragraphs)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for n in (1, 2, 3):
            inside = row[: max(0, len(words) - n + 1)] == row[n - 1 :]
            yield runs(words, n)[inside], row[: len(inside)][inside]

    def words(self, text: str) -> list[int]:
        return self.hasher.hashes(pa.array([text]))[0].tolist()


@dataclass
class LicenceModel:
    families: list[str]
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def logits(self, grams: Grams, paragraphs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs in which the vocabulary occurs, and their logits."""
        if not hasattr(self, "_seen"):
            self._seen = np.zeros(1 << 18, bool)
            self._seen[self.keys & np.uint64((1 << 18) - 1)] = True
        found, rows = [], []
        for hashes, row in grams.find(paragraphs):
            maybe = np.flatnonzero(self._seen[hashes & np.uint64((1 << 18) - 1)])
            i = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            real = self.keys[i] == hashes[maybe]
            found.append(i[real])
            rows.append(row[maybe[real]])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(found)], 1), axis=0)
        rows, first = np.unique(pairs[:, 0], return_index=True)
        if not len(rows):
            return rows, np.zeros((0, len(self.bias)))
        return rows, np.add.reduceat(self.weights[pairs[:, 1]], first) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def notices(seed: int = 7) -> tuple[list[str], list[str]]:
    """Training paragraphs and their classes."""
    rng, texts, classes = random.Random(seed), [], []

    def add(text: str, family: str) -> None:
        texts.append(text)
        classes.append(family)

    for family, names in [*NAMES.items(), (UNKNOWN, OTHERS)]:
        for name in names:
            for phrase in PHRASES:
                add(phrase.format(name), family)
        for passage in PASSAGES.get(family, ()):
            words = passage.split()
            for _ in range(8):
                a, b = sorted(rng.sample(range(len(words) + 1), 2))
                part = " ".join(w for w in words[a:b] if rng.random() > 0.08)
                named = [n for n in names if n in passage]
                if b - a > len(words) // 2 and (not named or any(n in part for n in named)):  # what tells it from its relatives stays
                    add(part, family)
            for _ in range(3):
                add(passage, family)
    for passage in OTHER_PASSAGES:
        words = passage.split()
        for _ in range(8):
            a, b = sorted(rng.sample(range(len(words) + 1), 2))
            if b - a > len(words) // 2:
                add(" ".join(w for w in words[a:b] if rng.random() > 0.08), UNKNOWN)
        for _ in range(3):
            add(passage, UNKNOWN)
    return texts, classes


def fit(texts: list[str], classes: list[str], ordinary: list[str], rounds: int = 150) -> LicenceModel:
    """Trains on four fifths of all paragraphs and calibrates on the others."""
    families = [*NAMES, UNKNOWN]
    texts, y = [*texts, *ordinary], np.array([families.index(c) for c in [*classes, *[UNKNOWN] * len(ordinary)]])
    grams, n_notices = Grams(), len(classes)
    parts = [np.stack([row.astype(np.uint64), h], 1) for h, row in grams.find(pa.array(texts, pa.string()))]
    pairs = np.unique(np.concatenate(parts), axis=0)
    row, key = pairs[:, 0].astype(np.int64), pairs[:, 1]
    keys, column = np.unique(key, return_inverse=True)
    common = np.bincount(column, weights=row >= n_notices, minlength=len(keys)) > 0.01 * max(1, len(ordinary))
    use = (np.bincount(column, weights=row < n_notices, minlength=len(keys)) >= 2) & ~common
    number = np.cumsum(use) - 1
    kept = use[column]
    row, column, keys = row[kept], number[column[kept]], keys[use]
    fold = np.random.default_rng(1).integers(0, 5, len(texts))
    target = np.eye(len(families), dtype=np.float32)[y]
    # Paragraphs in which the vocabulary occurs (notices, and few others), as a matrix; the rest have the bias alone.
    there, at = np.unique(row, return_inverse=True)
    found = np.zeros((len(there), len(keys)), np.float32)
    found[at, column] = 1
    weights, bias = np.zeros((len(keys), len(families)), np.float32), np.zeros(len(families), np.float32)

    def logits() -> np.ndarray:
        out = np.tile(bias, (len(texts), 1))
        out[there] += found @ weights
        return out

    def probability(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    for t in range(1, rounds + 1):  # Adam over the whole training part
        error = (probability(logits()) - target) * (fold > 0)[:, None].astype(np.float32) / len(texts)
        down = found.T @ error[there]
        for value, slope, m, v in ((weights, down + 1e-5 * weights, *moments[:2]), (bias, error.sum(0), *moments[2:])):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope**2 - v)
            value -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    held, z = fold == 0, logits()
    model = LicenceModel(families, keys, weights, bias)
    scale = np.geomspace(0.5, 8, 25)
    model.temperature = float(min(scale, key=lambda s: -np.log(probability(z[held] / s)[np.arange(held.sum()), y[held]] + 1e-12).mean())) if held.any() else 1.0
    mass = probability(z[held & (y == len(families) - 1)] / model.temperature)[:, :-1].max(1, initial=0)
    model.least = float(max(0.5, np.quantile(mass, 0.999) if len(mass) else 0.5))
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """The classifier; its ordinary paragraphs are those, without a family's name, of the ``sample`` distinct texts of the least hashes."""
    ordinary = [p for text in sample_texts(id_and_text(docs), sample) for p in text.split("\n") if p.strip()]
    grams = Grams()
    names = [grams.words(n) for family in NAMES.values() for n in family]
    words = [set(grams.words(p)) for p in ordinary]
    texts, classes = notices()
    return fit(texts, classes, [p for p, own in zip(ordinary, words, strict=True) if not any(own.issuperset(n) for n in names)])


def _sentences(passage: str) -> list[str]:
    return re.split(r"(?<=\.)\s+", passage)


class Templates:
    """What a family's paragraphs are compared with."""

    def __init__(self, grams: Grams):
        self.of: dict[str, list[tuple[str, list[int]]]] = {}
        foreign = {tuple(grams.words(x)) for p in OTHER_PASSAGES for x in _sentences(p)}
        for family, names in NAMES.items():
            passages = PASSAGES.get(family, ())
            sentences = [x for p in passages for x in _sentences(p) if x not in passages and len(x.split()) >= SENTENCE and tuple(grams.words(x)) not in foreign]
            self.of[family] = [(t, w) for t in (*passages, *sentences, *names) if (w := grams.words(t))]

    def closest(self, family: str, words: list[int]) -> tuple[str, float]:
        return min(((t, edit_distance(w, words)[0] / len(w)) for t, w in self.of[family]), key=lambda x: x[1])


class Wrapped:
    """Finds templates of two words or more that lie over line breaks."""

    def __init__(self, templates: Templates):
        self.templates, pieces = [], {}
        for words in {tuple(w) for own in templates.of.values() for _, w in own if len(w) > 1}:
            k = int(CONFIRM * len(words))
            n = len(words) // (k + 1)
            keys, places = pieces.setdefault(n, ([], []))
            for i in range(k + 1):
                start = i * len(words) // (k + 1)
                keys.append(runs(np.array(words[start : start + n], np.uint64), n)[0])
                places.append((len(self.templates), start))
            self.templates.append((list(words), k))
        self.pieces = [Pieces(n, *found) for n, found in pieces.items()]

    def spans(self, words: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> list[tuple[int, int]]:
        """First and last lines of templates over several lines. Lines begin at words ``at``, the parts between blank lines at ``blocks``."""
        tried: set[tuple[int, int, int]] = set()
        found: set[tuple[int, int]] = set()
        for pieces in self.pieces:
            rows, firsts, items, starts = pieces.find(words, blocks)
            lengths, edits = (np.array([f(t) for t in self.templates], np.int64)[items] for f in (lambda t: len(t[0]), lambda t: t[1]))
            low, high = np.maximum(blocks[rows], firsts - starts - edits), np.minimum(blocks[rows + 1], firsts - starts + lengths + edits)
            over = np.searchsorted(at, low, "right") < np.searchsorted(at, high - 1, "right")  # else all within one line
            tried.update(zip(low[over].tolist(), high[over].tolist(), items[over].tolist(), strict=True))
        for a, b, item in tried:
            pattern, k = self.templates[item]
            text = words[a:b].tolist()
            distance, end = edit_distance(pattern, text)
            if distance <= k:
                begin = end - edit_distance(pattern[::-1], text[:end][::-1])[1]
                first, last = (int(np.searchsorted(at, a + x, "right")) - 1 for x in (begin, end - 1))
                if first < last:
                    found.add((first, last))
        return sorted(found)


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row for each paragraph believed to be of a family: the family, its probability, the closest template and its distance as a share of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        templates = Templates(grams)
        wrapped = Wrapped(templates)

        def judge(p: np.ndarray, words: list[int]) -> tuple[str, float, str, float, bool]:
            """The likeliest family, and the closest of its templates."""
            k = int(p[:-1].argmax())
            template, distance = templates.closest(model.families[k], words)
            return model.families[k], float(p[k]), template, distance, distance <= CONFIRM

        def joined(paragraphs: pa.Array, ends: np.ndarray, lines: dict[int, tuple]) -> None:
            """Puts what is found over line breaks into ``lines``, the results by line."""
            words, at = grams.hasher.hashes(paragraphs)
            blank = np.flatnonzero(~pc.match_substring_regex(paragraphs, r"\S").to_numpy(zero_copy_only=False))
            blocks = at[np.unique(np.concatenate([[0], ends, blank]))]
            sure = {}
            for first, last in wrapped.spans(words, at, blocks):
                text = "\n".join(paragraphs.slice(first, last - first + 1).to_pylist())
                rows, logits = model.logits(grams, pa.array([text]))
                if len(rows) and (p := model.probabilities(logits)[0])[:-1].max() >= model.least and (row := judge(p, grams.words(text)))[-1]:
                    sure[first, last] = row
            for (first, last), row in sorted(sure.items(), key=lambda x: (x[1][3], x[0][0] - x[0][1], x[0])):
                if not any(lines[i][-1] and lines[i][-2] <= row[-2] for i in range(first, last + 1) if i in lines):
                    for i in range(first, last + 1):
                        lines.pop(i, None)
                    lines[first] = row

        for whole in batches:
            for batch in slices(whole, limit=2 << 20):
                lines = pc.split_pattern(batch.column("text"), "\n")
                paragraphs, ends = lines.flatten(), np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
                rows, logits = model.logits(grams, paragraphs)
                p = model.probabilities(logits) if len(rows) else np.zeros((0, len(model.bias)))
                sure = np.flatnonzero(p[:, :-1].max(1, initial=0) >= model.least)
                found = {int(rows[i]): judge(p[i], grams.words(paragraphs[int(rows[i])].as_py())) for i in sure.tolist()}
                joined(paragraphs, ends, found)
                ids, out = batch.column("doc_id").to_pylist(), []
                for line, row in sorted(found.items()):
                    doc = int(np.searchsorted(ends, line, "right"))
                    out.append((ids[doc], line - int(ends[doc - 1] if doc else 0), *row))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return id_and_text(docs).mapInArrow(run, SCHEMA)
