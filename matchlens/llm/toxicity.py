"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
short windows of words, and each window is compressed with both; windows that the toxic dictionary
shortens more are evidence. What a text's windows show is turned into a score by a logistic curve
that is fitted to labelled texts.

The toxic dictionary is trained on the parts of toxic texts that ordinary texts hardly have, and
carries the ordinary dictionary behind it, so that ordinary words cost the same with both and only
toxic ones make a difference.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.llm.common import fresh, map_rows

#: Words of a window, and from one window to the next: every word is seen in two surroundings.
WINDOW_WORDS, WINDOW_STEP = 8, 4
#: Bytes of the ordinary and of the toxic part of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
#: The bound of the training sample: labelled texts of each label, and the length up to which a text may be drawn.
SAMPLE = {1: 2000, 0: 5000}
SAMPLE_CHARS = 50_000
#: Texts of each kind held back from the dictionaries to fit the curve.
CALIBRATE = 0.4
#: Lengths of the byte strings by which toxic and ordinary text are told apart.
GRAMS = 6, 9, 12
#: Share of toxic texts that a string must occur in, and how many times the ordinary share that must be.
LEAST_SHARE, LEAST_RATIO = 0.01, 20
#: Byte strings that are counted at once, of which each takes eight bytes a few times over.
STRINGS_AT_ONCE = 500_000
THRESHOLD = 0.7
SEED = 42

_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> list[str]:
    """Lower-case words of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def _grams(data: bytes, length: int) -> np.ndarray:
    """The byte strings of a length, each as a number (hashed where 8 bytes do not hold it), by position."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(codes) - length + 1)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x100 if length <= 8 else 0x9E3779B97F4A7C15) + codes[i : i + n]
    return out


def _dealt(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of each byte string, equal ones in the same."""
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)


def _flat(text: str) -> bytes:
    return (" " + " ".join(normal(text)) + " ").encode()


def _without_copies(texts: list[str]) -> list[str]:
    """Texts of which no earlier one is a near copy: equal least hashes of longer strings mark copies."""
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        first: dict[object, str] = {}
        for text in texts:
            data = _flat(text)
            long = _grams(data, 20)
            long = (long ^ long >> np.uint64(29)) * np.uint64(factor)
            first.setdefault(int((long ^ long >> np.uint64(32)).min()) if len(long) else data, text)
        texts = list(first.values())
    return texts


def _toxic_strings(toxic: list[str], ordinary: list[str], length: int) -> np.ndarray:
    """Strings that many toxic texts have and that are rare in ordinary ones."""
    flat = [_flat(t) for t in toxic]
    parts = 1 + sum(map(len, flat)) // STRINGS_AT_ONCE
    found = []
    for part in range(parts):
        own = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.unique(g[_dealt(g, parts) == part]) for g in (_grams(data, length) for data in flat)]]))
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
        counts = np.diff(first, append=len(own))
        often = counts >= max(3, LEAST_SHARE * len(toxic))
        found.append((own[first[often]], counts[often]))
    strings, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(strings)
    strings, counts = strings[order], counts[order]
    known = np.zeros(len(strings), np.int64)
    for text in ordinary if len(strings) else []:
        grams = _grams(_flat(text), length)
        at = np.minimum(np.searchsorted(strings, grams), len(strings) - 1)
        known[np.unique(at[strings[at] == grams])] += 1
    return strings[counts / max(1, len(toxic)) >= LEAST_RATIO * (known + 0.5) / max(1, len(ordinary))]


def _toxic_parts(text: str, strings: dict[int, np.ndarray]) -> list[bytes]:
    """The stretches of a text that at least two of the strings cover."""
    data = _flat(text)
    cover = np.zeros(len(data) + 1, np.int64)
    for length, known in strings.items():
        hits = np.flatnonzero(np.isin(_grams(data, length), known))
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + length, -1)
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) >= 2, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 4]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of at most `size` bytes; of too few samples, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def windows(words: list[str], size: int = WINDOW_WORDS, step: int = WINDOW_STEP) -> list[bytes]:
    """Windows of `size` words from every `step`-th word on, until one reaches the end.

    A text of fewer words is one window, a text without words a blank one.
    """
    starts = range(0, max(1, len(words) - size + step), step)
    return [(" " + " ".join(words[i : i + size]) + " ").encode() for i in starts] if words else [b" "]


@dataclass
class Model:
    """Dictionaries and the curve; a few kilobytes, whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    means: list[float]
    scales: list[float]
    weights: list[float]


class Scorer:
    """Scores of whole texts under a model."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # a blank part of the toxic part's length keeps all distances alike
        self.pair = [self._compressor(bytes(len(toxic)) + ordinary), self._compressor(toxic + ordinary)]

    @staticmethod
    def _compressor(content: bytes):
        def settings(log):
            return zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=log, chain_log=log, search_log=4, min_match=3, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )

        dictionary = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings(14))
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings(8))

    def features(self, text: str | None) -> list[float]:
        """What the gains of a text's windows show: mean, mean of gains alone, share of clear gains, and length."""
        words = normal(text)
        ordinary, toxic = (c.compress for c in self.pair)
        gains = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words)])
        up, clear = float(np.maximum(gains, 0).mean()), float((gains >= 3).mean())
        return [float(gains.mean()), up, math.log1p(50 * up), clear, math.log1p(50 * clear), math.log1p(len(words))]


def _curve(rows: np.ndarray, labels: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression on standardised columns, by Newton steps with a small penalty."""
    means, scales = rows.mean(0), np.maximum(rows.std(0), 1e-6)
    x = np.c_[np.ones(len(rows)), (rows - means) / scales]
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
    return means.tolist(), scales.tolist(), w.tolist()


def fit(labelled: list[tuple[str, int]]) -> Model:
    """A model of labelled texts. Without both labels every score is the share of toxic ones, or 0.

    The first texts of each kind train the dictionaries, the others fit the curve.
    """
    kinds = {k: [t for t, label in labelled if label == k] for k in (0, 1)}
    cut = {k: math.ceil(len(v) * (1 - CALIBRATE)) for k, v in kinds.items()}
    toxic, ordinary = (_without_copies(kinds[k][: cut[k]]) for k in (1, 0))
    strings = {n: _toxic_strings(toxic, ordinary, n) for n in GRAMS}
    parts = [p for t in toxic for p in _toxic_parts(t, strings)]
    order = np.random.default_rng(SEED)
    order.shuffle(parts)
    plain = [w for t in ordinary for w in windows(normal(t), step=WINDOW_WORDS)]
    order.shuffle(plain)
    model = Model(
        _dictionary(plain[:200_000], ORDINARY_BYTES), _dictionary([b"".join(parts[i : i + 6]) for i in range(0, len(parts), 6)], TOXIC_BYTES),
        [], [], [],
    )
    held = [(t, k) for k in (0, 1) for t in (kinds[k][cut[k] :] or kinds[k])]
    if not kinds[0] or not kinds[1]:
        share = min(max(len(kinds[1]) / max(1, len(labelled)), 1e-6), 1 - 1e-6)
        return Model(model.ordinary, model.toxic, [0.0] * 6, [1.0] * 6, [math.log(share / (1 - share))] + [0.0] * 6)
    scorer = Scorer(model.ordinary, model.toxic)
    rows = np.array([scorer.features(t) for t, _ in held])
    model.means, model.scales, model.weights = _curve(rows, np.array([k for _, k in held], float))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit a model on a seeded sample of the labelled rows that are not held out, at most SAMPLE of each label.

    The sample is the rows of smallest hash, so it does not depend on partitions; one task holds it
    and fits the model, the driver gets the model alone. Texts of more than SAMPLE_CHARS characters are not drawn. Labels other than 0 and
    1, null ids and null texts do not train; of several labels of an id the larger counts, of
    several texts the smallest.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    told = told.where(F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    told = told.withColumn("key", F.xxhash64(F.lit(SEED), "id"))
    chosen = [told.where(F.col("label") == k).orderBy("key", "id").limit(n) for k, n in SAMPLE.items()]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").groupBy("key", "id", "label").agg(F.min("text").alias("text"))
    names = [f.name for f in fields(Model)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        model = fit([(value, kind) for _, _, kind, value in sample])
        yield pa.RecordBatch.from_arrays([pa.array([getattr(model, n)]) for n in names], names)

    shape = "ordinary binary, toxic binary, means array<double>, scales array<double>, weights array<double>"
    sample = rows.select("key", "id", "label", "text").repartition(1)
    fitted = sample.mapInArrow(run, shape).first()
    if fitted is None:
        return fit([])
    return Model(bytes(fitted.ordinary), bytes(fitted.toxic), fitted.means, fitted.scales, fitted.weights)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of every whole text, from 0 to 1; no row moves. Null and empty texts are scored as blank."""
    schema = T.StructType([T.StructField(out, T.DoubleType())])

    def make():
        scorer, weights = Scorer(model.ordinary, model.toxic), model.weights

        def one(value: str | None) -> float:
            row = scorer.features(value)
            z = weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(weights[1:], row, model.means, model.scales, strict=True))
            return 1 / (1 + math.exp(-min(max(z, -30), 30)))

        return lambda texts: {out: pa.array([one(t) for t in texts], pa.float64())}

    return map_rows(docs, text, make, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose score reaches `threshold`; other rows and all columns stay as they are."""
    score = fresh(docs, "score")
    return scored(docs, train(docs, labels, id_col, text), text, score).where(F.col(score) < threshold).drop(score)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`.

    Labels, language, source and id are no inputs of a score. Null ids are held out. Repeated rows
    score alike. Other columns and their names play no part. An empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = scored(base, train(docs, labels, id_col, text), "text", "score")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
