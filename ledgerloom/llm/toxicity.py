"""Operator 5: toxicity by compression distance.

Two dictionaries are trained by zstandard itself, one on windows of ordinary texts, one on what is over-represented in windows of toxic
texts. Every window of words is compressed twice: with the ordinary dictionary, and with the toxic one in front of it; how
many bytes the toxic one saves is the window's gain. (In the first case noise of the same size stands in its place: zstandard sizes its
tables by the dictionary, and unequal tables would make gains of their own.) A threshold calibrated on ordinary texts says which
windows stand out, and a logistic curve on the windows' gains gives the document's score.

zstandard finds no repeats under four bytes, and a repeat costs it as much as four or five letters, so windows of letters tell
little (README has figures). A text is therefore written in word codes first: of each word six bytes of its hash and six of the hash of its
first four bytes. Codes count as over-represented by how many texts of either class hold them (chi-squared).

The fit takes at most ``sample`` labelled texts of each class (those with the smallest hash of doc_id) and ``windows`` windows of each (with the
smallest hash), three quarters of the texts for the dictionaries, one for calibration; rows whose crc32(doc_id as text) is
divisible by 5 are held out. The texts are read once and written to a table. Scoring reads every text whole.

Defined results: a null or empty text has no windows and gets the curve's value for no gain; without labelled texts of both classes every
score is the share of toxic labels (0 without labels); with too few windows to train on, a dictionary is the windows themselves; repeated rows score
alike; a null doc_id is scored and not held out; an empty table gives an empty result; other columns are ignored by ``score_toxicity`` and
kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, id_and_text, materialize, slices
from .hashing import WordHasher

CODE = 6
WINDOW_WORDS = 64
SAMPLE = 6000
#: Windows of either class that a dictionary is trained on.
WINDOWS = 20_000
#: Bytes of the dictionaries.
TOXIC_BYTES, ORDINARY_BYTES = 16_384, 4096
#: At most so many codes count as over-represented, the strongest.
CODES = 256
#: How much more often they are, and how sure that must be.
RATIO, CHI_SQUARED = 2, 16
#: Bytes of text that a worker writes in codes at a time (six times as much memory).
SLICE = 2 << 20
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalpha())
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, gain double, windows int"


class Coder:
    """Texts as word codes."""

    def __init__(self) -> None:
        self.words, self.stems = WordHasher(SEPARATORS), WordHasher(SEPARATORS, longest=4)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two codes for each word (in the low 48 bits), and where each text's words begin."""
        words, at = self.words.hashes(texts)
        stems, _ = self.stems.hashes(texts)
        return np.stack([words >> np.uint64(16), stems >> np.uint64(16)], 1), at


def as_bytes(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<u8").reshape(-1, 1)).view(np.uint8)[:, :CODE].tobytes()


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: list[float]
    constant: float | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


class Gauge:
    """Gains of windows under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.coder = Coder()
        noise = np.random.default_rng(3).bytes(len(toxic))
        self.pair = [self.compressor(x + ordinary) for x in (toxic, noise)]

    @staticmethod
    def compressor(raw: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=1, min_match=5, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        if len(raw) < 8:
            return zstandard.ZstdCompressor(compression_params=settings)
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)

    def gains(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text, what each of its windows saves."""
        codes, at = self.coder.codes(texts)
        raw, size = as_bytes(codes), 2 * CODE
        toxic, ordinary = (c.compress for c in self.pair)
        out = []
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            parts = [raw[i * size : min(i + WINDOW_WORDS, b) * size] for i in range(a, b, WINDOW_WORDS)]
            out.append(np.array([len(ordinary(p)) - len(toxic(p)) for p in parts], float))
        return out


def features(gains: list[np.ndarray], threshold: float) -> np.ndarray:
    """Largest gain, mean gain, and how many windows stand out (as a logarithm)."""
    return np.array([(g.max(), g.mean(), np.log1p((g > threshold).sum())) if len(g) else (0.0, 0.0, 0.0) for g in gains]).reshape(-1, 3)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> list[float]:
    """Weighted logistic regression by Newton's steps, with a ridge on all but the constant."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = np.concatenate([np.ones((len(x), 1)), x / scale], 1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return [float(w[0]), *(w[1:] / scale).tolist()]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``sample`` labelled texts of each class that are not held out (toxic, fold, key, text), and the classes' sizes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [own.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    # Two times ``sample`` ids at most: a bounded broadcast.
    joined = id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    key = F.xxhash64("doc_id", "text", F.lit(1))
    return materialize(joined.select("toxic", F.pmod(key, F.lit(4)).cast("int").alias("fold"), key.alias("key"), "text"), "labelled"), sizes


def over_represented(texts: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """Codes that more toxic texts hold than ordinary ones, ascending."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many texts of either class each code occurs."""
        coder = Coder()
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                codes, at = coder.codes(batch.column("text"))
                toxic = np.array(batch.column("toxic").to_pylist(), bool)
                row = np.repeat(np.arange(len(at) - 1), 2 * np.diff(at))
                pairs = np.unique(np.stack([codes.reshape(-1), row.astype(np.uint64)], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
                distinct, inverse = np.unique(pairs[:, 0], return_inverse=True)
                of_toxic = toxic[pairs[:, 1].astype(np.int64)]
                n = [np.bincount(inverse, weights=of_toxic == k, minlength=len(distinct)).astype(np.int64) for k in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), *map(pa.array, n)], names=["code", "n_toxic", "n_ordinary"])

    counts = texts.select("toxic", "text").mapInArrow(count, "code long, n_toxic long, n_ordinary long").groupBy("code").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary"))
    n, m = sizes[1], sizes[0]
    a, b = (F.col("n_toxic") + 0.5) / (n + 1), (F.col("n_ordinary") + 0.5) / (m + 1)
    both = (F.col("n_toxic") + F.col("n_ordinary")) / (n + m)
    sure = F.pow(F.col("n_toxic") / n - F.col("n_ordinary") / m, F.lit(2)) / (both * (1.0001 - both) * (1 / n + 1 / m))  # chi-squared
    found = counts.where((a / b > RATIO) & (sure > CHI_SQUARED)).orderBy((a * F.log(a / b)).desc(), "code").limit(CODES).select("code").collect()
    return np.sort(np.array([r.code for r in found], np.uint64))


def samples(texts: DataFrame, codes: np.ndarray, windows: int) -> dict[int, list[bytes]]:
    """At most ``windows`` windows of either class: ordinary ones whole, of toxic ones the over-represented codes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                found, at = coder.codes(batch.column("text"))
                rows = []
                for toxic, key, a, b in zip(batch.column("toxic").to_pylist(), batch.column("key").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                    for i in range(a, b, WINDOW_WORDS):
                        own = found[i : min(i + WINDOW_WORDS, b)].reshape(-1)
                        if toxic:
                            own = own[np.isin(own, codes)]
                        if len(own):
                            rows.append((toxic, key ^ (i - a), as_bytes(own)))
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["toxic", "key", "window"])

    found = texts.select("toxic", "key", "text").mapInArrow(cut, "toxic int, key long, window binary")
    order = F.xxhash64("key")
    return {c: [bytes(r.window) for r in found.where(F.col("toxic") == c).orderBy(order, "window").limit(windows).collect()] for c in (0, 1)}


def dictionary(windows: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, windows, level=3).as_bytes()
    except zstandard.ZstdError:  # too few to train on
        return b"".join(windows)[-size:]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> ToxicityModel:
    texts, sizes = training_texts(docs, labels, sample)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    fit, rest = texts.where("fold > 0"), texts.where("fold = 0")
    there = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(there) < 2:
        return ToxicityModel(b"", b"", 0.0, [], share)
    own = samples(fit, over_represented(fit, there), windows)
    raw = dictionary(own[1], TOXIC_BYTES), dictionary(own[0], ORDINARY_BYTES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        gauge = Gauge(*raw)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g.tolist() for g in gauge.gains(batch.column("text"))], pa.list_(pa.float64()))], names=["toxic", "gains"])

    measured = materialize(rest.select("toxic", "text").mapInArrow(measure, "toxic int, gains array<double>"), "gains")
    # As many rows as there are gains: a window's is some hundred bytes at most.
    clean = sorted((r.gain, r.n) for r in measured.where("toxic = 0").select(F.explode("gains").alias("gain")).groupBy("gain").agg(F.count(F.lit(1)).alias("n")).collect())
    total, threshold = 0, 1.0
    for gain, n in clean:
        total += n
        if total >= 0.99 * sum(k for _, k in clean):
            threshold = max(1.0, gain)
            break
    mean = F.aggregate("gains", F.lit(0.0), lambda a, x: a + x) / F.size("gains")
    found = measured.select("toxic", *[F.coalesce(x, F.lit(0.0)) for x in (F.array_max("gains"), F.when(F.size("gains") > 0, mean), F.log1p(F.size(F.filter("gains", lambda x: x > threshold))))])
    rows = np.array(sorted(map(tuple, found.collect())), float).reshape(-1, 4)  # one for each text
    y = rows[:, 0]
    if not 0 < y.sum() < len(y):
        return ToxicityModel(*raw, threshold, [], share)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return ToxicityModel(*raw, threshold, logistic(rows[:, 1:], y, weight))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row for each document: held_out, score (0 to 1), predicted, the largest gain in bytes and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        gauge = Gauge(model.toxic, model.ordinary)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                gains = gauge.gains(batch.column("text"))
                x = features(gains, model.threshold)
                score = model.score(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(x[:, 0], pa.float64()), pa.array([len(g) for g in gains], pa.int32())],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return id_and_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        gauge = Gauge(model.toxic, model.ordinary)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                score = model.score(features(gauge.gains(batch.column("text").cast(pa.string()).fill_null("")), model.threshold))
                yield batch.filter(pa.array(score < 0.5))

    bounded_batches(docs)
    return docs.mapInArrow(run, docs.schema)
