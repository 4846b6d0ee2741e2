"""Language identification: averaged hashed subword embeddings under a linear softmax.

The subwords of a text are its byte sequences of 2 to 4 letters, a word border counting
as one letter.  Each is hashed into ``BUCKETS`` embeddings; their mean goes through a
linear layer and a softmax whose temperature is fitted on rows the training left out.
Both layers being linear, a trained model is one table of a logit per bucket and language,
so labelling looks up and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words

UNDETERMINED = "und"
BUCKETS = 1 << 16
SIZES = (2, 3, 4)
ROWS_PER_LANGUAGE = 800  # bound of the training sample, in rows of each language
DIMENSIONS, EPOCHS, RATE = 8, 4, 0.6
REJECTED_SHARE = 0.002  # of well-labelled calibration rows that a rejection may cost
REJECT_BELOW = 0.4  # scores of at least this are never rejected

#: Letters keep their byte, all else becomes a word border.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def has_letters(content: Column) -> Column:
    return F.coalesce(content.rlike(r"\p{L}"), F.lit(False))


def _prepared(content: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(content, F.lit(""))), F.lit(" "))


def subwords(texts: words.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bounds, bucket) of each size: the subwords of text i are ``bucket[bounds[i]:bounds[i + 1]]``."""
    letter = LETTER[texts.data]
    byte = np.where(letter, texts.data, 0x20).astype(np.uint32)
    for size in SIZES:
        n = len(byte) - size + 1
        if n <= 0:
            continue
        ok = letter[:n] | letter[size - 1 :] if size == 2 else letter[1 : n + 1].copy()
        for k in range(2, size - 1):
            ok &= letter[k : n + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), size, np.uint32)
        for k in range(size):
            h = (h ^ byte[at + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield np.searchsorted(at, texts.offsets), h >> np.uint32(16)


def _sums(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, value.shape[1]))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(value, bounds[some], axis=0, dtype=np.float64)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse bucket counts of each text: at most ``BUCKETS`` entries, however long it is."""
    for batch in batches:
        bucket, count = [], []
        for texts in words.slices(words.column(batch, "__text")):
            parts = list(subwords(texts))
            for i in range(texts.n):
                own = [b[at[i] : at[i + 1]] for at, b in parts]
                b, c = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32), return_counts=True)
                bucket.append(b.astype(np.uint16).tobytes())
                count.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [words.column(batch, "language"), words.column(batch, "__order"), pa.array(bucket, pa.binary()), pa.array(count, pa.binary())],
            names=["language", "__order", "bucket", "count"])


def fit(block: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """Model of the declared ``language`` of ``block`` (doc_id, content, language).

    Rows without a language or content are left out.  About ``rows_per_language`` rows of each
    language, chosen by a hash of doc_id, make the sample that goes to the driver as sparse
    counts; a fifth of them only serves the calibration.  None if no row is labelled.
    """
    known = block.select("doc_id", "content", "language").filter("language IS NOT NULL AND content IS NOT NULL")
    count = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return None
    share = F.lit(0.0)
    for language, n in count.items():
        share = F.when(F.col("language") == language, min(1.0, rows_per_language / n)).otherwise(share)
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    sample = known.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).select(
        "language", order.alias("__order"), _prepared(F.col("content")).alias("__text"))
    rows = sample.mapInArrow(_features, "language string, __order long, bucket binary, count binary").collect()
    rows.sort(key=lambda r: (r["__order"], r["language"], bytes(r["bucket"]), bytes(r["count"])))
    return _trained(tuple(sorted(count)), rows)


def _trained(languages: tuple[str, ...], rows: list) -> LanguageModel:
    target = {language: i for i, language in enumerate(languages)}
    examples = []
    for r in rows:
        count = np.frombuffer(r["count"], np.float32)
        if len(count):
            examples.append((np.frombuffer(r["bucket"], np.uint16).astype(np.int64), count / count.sum(), target[r["language"]]))
    rng = np.random.default_rng(0)
    calibration, training = examples[::5], [e for i, e in enumerate(examples) if i % 5] or examples
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = np.zeros((DIMENSIONS, len(languages)), np.float32)
    linear += rng.normal(0, 0.3, linear.shape)
    bias = np.zeros(len(languages))
    steps, total = 0, EPOCHS * max(1, len(training))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(training)):
            bucket, share, label = training[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = share @ embedding[bucket]
            slope = softmax(mean @ linear + bias)
            slope[label] -= 1
            back = linear @ slope
            linear -= rate * np.outer(mean, slope)
            bias -= 0.01 * rate * slope
            # The share of one subword is small, so embeddings take a step per row of the order of a word's.
            embedding[bucket] -= (rate * 50 * share)[:, None] * back
    logits = (embedding @ linear).astype(np.float32)
    raw = np.array([share @ logits[bucket] + bias for bucket, share, _ in calibration]).reshape(-1, len(languages))
    label = np.array([e[2] for e in calibration], int)
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(label)), label], 1e-12)).mean() if len(label) else t for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    chance = softmax(raw / temperature)
    right = chance.max(axis=1)[chance.argmax(axis=1) == label] if len(label) else np.zeros(0)
    floor = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return LanguageModel(languages, logits, bias, temperature, min(REJECT_BELOW, floor))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True)) if x.size else x
    return e / e.sum(axis=-1, keepdims=True)


def identify(block: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, language_pred, score, rejected) of every row of ``block`` (doc_id, content).

    The whole content counts.  Null, empty and letterless content is ``und`` with score 0 and
    rejected, as is everything without a model.  Other rows get a learned language; they are rejected
    when the calibrated score is under the model's ``reject_below``.  Repeated rows repeat; equal
    probabilities go to the first language by code point.  Further columns of ``block`` are ignored.
    """
    text = block.select(
        "doc_id", has_letters(F.col("content")).alias("__letters"), _prepared(F.col("content")).alias("__text"))
    shared = block.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the corpus

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = words.column(batch, "__letters").to_numpy(zero_copy_only=False)
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            if m is not None:
                for texts in words.slices(words.column(batch, "__text")):
                    total, count = np.zeros((texts.n, len(m.languages))), np.zeros(texts.n)
                    for bounds, bucket in subwords(texts):
                        total += _sums(m.logits[bucket], bounds)
                        count += np.diff(bounds)
                    chance = softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                    best[texts.lo : texts.hi], score[texts.lo : texts.hi] = chance.argmax(axis=1), chance.max(axis=1)
            letters &= m is not None
            names = np.array([*(m.languages if m else ()), UNDETERMINED], object)
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "doc_id"), pa.array(names[np.where(letters, best, -1)], pa.string()),
                 pa.array(np.where(letters, score, 0.0)),
                 pa.array(~letters | (score < (m.reject_below if m else 1)))],
                names=["doc_id", "language_pred", "score", "rejected"])

    return text.mapInArrow(label, "doc_id long, language_pred string, score double, rejected boolean")
