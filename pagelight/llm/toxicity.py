"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are rates of lexicon words, of lexicon words close to a second person, of
capitals, punctuation and disguised words.  Besides a fixed lexicon there is one of words and word
stems mined from flagged content.  The trees are fitted on rows measured with what the other half
of the rows mined, so they learn how far a mined word can be trusted; the calibration has rows of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.words import NOT_ALNUM, SPACE, U64, Texts

FLAGGED, APPROVED = "flagged", "approved"
SAMPLE_ROWS = 24_000  # bound of the labelled rows a model is fitted on, in expectation
MINED_SUPPORT, MINED_PRECISION = 3, 0.7
STEMS = (5, 7)  # bytes
NEAR = 3  # words between a lexicon word and a second person
TREES, DEPTH, BINS, RATE, SMOOTHING = 60, 3, 32, 0.2, 1.0

#: Insults and demeaning words.
LEXICON = tuple(
    "arrogant ass asshole bastard bitch brainless bullshit clown coward creep crap cretin cunt damn degenerate dimwit dirtbag disgrace "
    "disgusting douche dumb dumbass failure fatso filth filthy fool freak fuck fucking garbage halfwit hate hideous hypocrite idiot "
    "idiotic ignorant imbecile jackass jerk kill liar lowlife loser losers lunatic maggot moron moronic nasty nitwit pathetic pig "
    "prick psycho retard scum scumbag shit shut sick sleazy slut stink stupid subhuman suck sucks swine terrorist trash trashy traitor "
    "twat ugly useless vermin vile weirdo whore wimp worthless "
    "abschaum arschloch depp dumm dummkopf idioten trottel versager widerlich wichser "
    "basura cabron estupido gilipollas imbecil inutil mierda pendejo puta tonto "
    "abruti batard connard connasse debile merde minable ordure pute salaud salope".split())
#: The second person.
SECOND_PERSON = tuple(
    "you your yours yourself yourselves u ur ya youre du dich dir dein deine deinen euch eure ihr tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros vuestro contigo".split())
#: Characters in place of letters.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
FEATURES = 16


def _keys(strings: tuple[str, ...]) -> np.ndarray:
    encoded = [s.encode() for s in strings]
    end = np.cumsum([len(b) for b in encoded])
    return np.sort(words.hashes(np.frombuffer(b"".join(encoded), np.uint8), end - [len(b) for b in encoded], end))


def _found(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    quick = np.zeros(1 << 16, bool)
    quick[(keys & U64(0xFFFF)).astype(np.int64)] = True
    out = quick[(values & U64(0xFFFF)).astype(np.int64)]
    some = np.flatnonzero(out)
    out[some] = keys[np.minimum(np.searchsorted(keys, values[some]), len(keys) - 1)] == values[some]
    return out


_LEXICON, _SECOND = _keys(LEXICON), _keys(SECOND_PERSON)
_BY_LENGTH: dict[int, list[str]] = {}
for _word in LEXICON:
    _BY_LENGTH.setdefault(len(_word), []).append(_word)


def _undisguised(token: bytes) -> bool:
    """Whether a word with digits or symbols between its letters is a lexicon word."""
    text = token.decode("utf-8", "replace").lower().strip(".,;:?\"'()[]{}")
    plain = re.sub(r"[^\w*]|_", "", text.translate(DISGUISE))
    if "*" in plain:
        return any(all(a in ("*", b) for a, b in zip(plain, word)) for word in _BY_LENGTH.get(len(plain), ()))
    return plain in LEXICON_SET


LEXICON_SET = frozenset(LEXICON)


def _stems(texts: Texts, lower: np.ndarray, w: words.Words) -> Iterator[np.ndarray]:
    """Hash of each word's first bytes, its own for a word that is no longer."""
    for size in STEMS:
        yield words.hashes(lower, w.start, np.minimum(w.start + size, w.end)) + U64(size)


def _folded(texts: Texts) -> tuple[np.ndarray, words.Words]:
    lower = LOWER[texts.data]
    return lower, words.split(Texts(texts.lo, texts.hi, lower, texts.offsets), NOT_ALNUM)


def _count(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of flags in each range between consecutive bounds."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


@dataclass(frozen=True)
class Mined:
    """Hashes of words and stems, ascending, and how strongly each speaks for a flag."""

    key: np.ndarray
    weight: np.ndarray

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values))
        some = np.flatnonzero(_found(self.key, values))
        out[some] = self.weight[np.searchsorted(self.key, values[some])]
        return out


def features(texts: Texts, mined: Mined) -> np.ndarray:
    """One row of FEATURES numbers per text; an empty text has zeros."""
    data, offsets = texts.data, texts.offsets
    lower, w = _folded(texts)
    n_bytes, n = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(w.first), 1)
    hit = _found(_LEXICON, w.hash)
    weight = mined.of(w.hash)
    for stem in _stems(texts, lower, w):
        weight = np.maximum(weight, mined.of(stem))
    own = weight > 0
    any_hit = hit | own
    evidence = np.zeros(len(weight) + 1)
    np.cumsum(weight, out=evidence[1:])
    evidence = evidence[w.first[1:]] - evidence[w.first[:-1]]
    second = np.zeros(len(w.hash) + 1, np.int64)
    np.cumsum(_found(_SECOND, w.hash), out=second[1:])
    at = np.arange(len(w.hash))
    close = any_hit & (second[np.minimum(at + NEAR + 1, w.first[w.row + 1])] > second[np.maximum(at - NEAR, w.first[w.row])])
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = ~NOT_ALNUM[data] & ((data < 0x30) | (data > 0x39))
    uppers = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=uppers[1:])
    size = w.end - w.start
    shout = (size >= 3) & (uppers[w.end] - uppers[w.start] == size)
    mark = (data == 0x21) | (data == 0x3F)
    punctuation = NOT_ALNUM[data] & ~SPACE[data]
    double = np.zeros(len(data), bool)
    double[1:] = mark[1:] & mark[:-1]
    same = np.zeros(len(data), bool)
    same[2:] = letter[2:] & (lower[2:] == lower[1:-1]) & (lower[2:] == lower[:-2])
    token = words.split(texts)
    strange = ~letter & ~SPACE[data]
    totals = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(letter, out=totals[0, 1:])
    np.cumsum(strange, out=totals[1, 1:])
    # Letters at both ends or a symbol that starts a letter, and something else between.
    inner = np.minimum(token.start + 1, token.end), np.maximum(token.end - 1, token.start)
    disguised = (totals[0, token.end] - totals[0, token.start] >= 2) & (
        (totals[1, np.maximum(inner[1], inner[0])] - totals[1, inner[0]] > 0) | np.isin(data[token.start], list(b"@$!013457")))
    plain = np.zeros(len(token.start), bool)
    for k in np.flatnonzero(disguised):
        plain[k] = _undisguised(data[token.start[k] : token.end[k]].tobytes())
    letters = np.maximum(_count(letter, offsets), 1)
    hits, owns = _count(hit, w.first), _count(own, w.first)
    columns = (
        100 * hits / n, np.log1p(hits), 100 * owns / n, np.log1p(np.maximum(evidence, 0)), 100 * _count(close, w.first) / n,
        np.log1p(_count(close, w.first)), _count(upper, offsets) / letters, 100 * _count(shout, w.first) / n,
        100 * _count(mark, offsets) / n_bytes, 100 * _count(double, offsets) / n_bytes, 100 * _count(punctuation, offsets) / n_bytes,
        100 * _count(disguised, token.first) / n, np.log1p(_count(plain, token.first)), 100 * _count(same, offsets) / letters,
        np.log1p(np.diff(w.first)), _count(second[1:] > second[:-1], w.first) / n,
    )
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass(frozen=True)
class ToxicityModel:
    mined: Mined
    edges: np.ndarray  # FEATURES x BINS - 1
    trees: tuple  # (feature, bin) of each node of a full tree, value of each leaf
    prior: float
    steps: np.ndarray  # raw scores and the calibrated probability at each
    chance: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(rows), self.prior)
        return np.interp(self.raw(_binned(rows, self.edges)), self.steps, self.chance)

    def raw(self, binned: np.ndarray) -> np.ndarray:
        out = np.zeros(len(binned))
        for feature, cut, leaf in self.trees:
            out += leaf[_leaves(binned, feature, cut)]
        return out


def _binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], rows[:, k], "left") for k in range(rows.shape[1])], axis=1)


def _leaves(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(binned), np.int64)
    at = np.arange(len(binned))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (binned[at, feature[node]] > cut[node])
    return node - (2**DEPTH - 1)


def _tree(binned: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full tree of DEPTH; a node without a useful cut sends everything left."""
    feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
    node = np.zeros(len(binned), np.int64)
    for level in range(DEPTH):
        first, count = 2**level - 1, 2**level
        gains = np.full((count, FEATURES, BINS), -np.inf)
        for k in range(FEATURES):
            cell = (node - first) * BINS + binned[:, k]
            g, h = (np.bincount(cell, v, count * BINS).reshape(count, BINS).cumsum(axis=1) for v in (slope, curve))
            rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
            gain = g**2 / (h + SMOOTHING) + rest_g**2 / (rest_h + SMOOTHING) - g[:, -1:] ** 2 / (h[:, -1:] + SMOOTHING)
            gains[:, k] = np.where((h > 0.5) & (rest_h > 0.5), gain, -np.inf)
        best = gains.reshape(count, -1).argmax(axis=1)
        useful = gains.reshape(count, -1)[np.arange(count), best] > 1e-6
        feature[first : first + count] = best // BINS
        cut[first : first + count] = np.where(useful, best % BINS, BINS)
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
    leaf = node - (2**DEPTH - 1)
    g, h = (np.bincount(leaf, v, 2**DEPTH) for v in (slope, curve))
    return feature, cut, -RATE * g / (h + SMOOTHING)


def _isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators; mean score and probability of each block."""
    blocks: list[list[float]] = []  # labels, scores, weight
    for i in np.argsort(raw, kind="stable"):
        blocks.append([label[i], raw[i], 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def _trained(rows: np.ndarray, label: np.ndarray, mined: Mined) -> ToxicityModel:
    none = np.zeros(0)
    if not len(label) or label.min() == label.max():
        return ToxicityModel(mined, np.zeros((FEATURES, BINS - 1)), (), float(label.mean()) if len(label) else 0.0, none, none)
    held = np.arange(len(label)) % 4 == 0
    if len(set(label[held])) < 2 or len(set(label[~held])) < 2:
        held = np.zeros(len(label), bool)
    edges = np.quantile(rows[~held], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # Rare features are zero in most rows; their cuts come from the rows that have them.
    for k in range(FEATURES):
        some = rows[~held, k][rows[~held, k] > 0]
        if len(some) and (edges[k] == 0).mean() > 0.5:
            edges[k] = np.concatenate([[0], np.quantile(some, np.linspace(0, 1, BINS - 2, endpoint=False))])
    binned, y = _binned(rows[~held], edges), label[~held]
    raw, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        feature, cut, leaf = _tree(binned, p - y, p * (1 - p))
        trees.append((feature, cut, leaf))
        raw += leaf[_leaves(binned, feature, cut)]
    model = ToxicityModel(mined, edges, tuple(trees), float(label.mean()), none, none)
    own, y = (rows[held], label[held]) if held.any() else (rows, label)
    steps, chance = _isotonic(model.raw(_binned(own, edges)), y)
    return ToxicityModel(mined, edges, tuple(trees), model.prior, steps, chance)


COUNTS = ("flagged1", "all1", "flagged0", "all0")


def _lexicon(rows: list, halves: tuple[int, ...]) -> Mined:
    """Of the counts in the given halves, what has the support and the precision."""
    key = np.array([r["key"] for r in rows], np.int64).view(U64)
    flagged, n = (np.array([sum(r[f"{c}{h}"] for h in halves) for r in rows], float) for c in ("flagged", "all"))
    good = (flagged >= MINED_SUPPORT) & (flagged >= MINED_PRECISION * n) if len(rows) else np.zeros(0, bool)
    order = np.argsort(key[good])
    return Mined(key[good][order], np.log((flagged + 0.5) / (n - flagged + 0.5))[good][order])


def _mined_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, and for each half flagged and all): the rows of a batch that have a word or stem."""
    for batch in batches:
        flagged, half = (words.column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("flagged", "half"))
        for texts in words.slices(words.column(batch, "content")):
            lower, w = _folded(texts)
            row = np.tile(w.row, 1 + len(STEMS))
            key = np.concatenate([w.hash, *_stems(texts, lower, w)])
            order = np.lexsort((row, key))
            row, key = row[order], key[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            row, key = row[fresh], key[fresh]
            own, at = np.unique(key, return_index=True)
            row += texts.lo
            counted = (flagged[row] * half[row], half[row], flagged[row] * (1 - half[row]), 1 - half[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), *[pa.array(np.add.reduceat(c, at) if len(at) else at) for c in counted]],
                names=["key", *COUNTS])


def fit(block: DataFrame, review: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Model of ``review`` (doc_id, status: flagged or approved) over ``block`` (doc_id, content).

    About ``sample_rows`` reviewed rows, chosen by a hash of doc_id, are used, which bounds the
    words mined from them too.  Other states and null are left out.  Without rows of both kinds the score is the flagged
    share, 0 without any row.
    """
    known = review.select("doc_id", (F.col("status") == FLAGGED).alias("flagged")).filter(F.col("status").isin(FLAGGED, APPROVED))
    count = known.count()
    order = F.xxhash64("doc_id", F.lit(7))
    share = min(1.0, sample_rows / max(count, 1))
    chosen = known.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).withColumns(
        {"order": order, "half": F.pmod(F.shiftright(order, 40), F.lit(2)) == 1})
    # Bounded by sample_rows whatever the corpus.
    reviewed = block.select("doc_id", F.coalesce("content", F.lit("")).alias("content")).join(F.broadcast(chosen), "doc_id")
    counts = reviewed.select("flagged", "half", "content").mapInArrow(
        _mined_counts, "key long, " + ", ".join(f"{c} long" for c in COUNTS))
    flagged = F.col("flagged1") + F.col("flagged0")
    enough = [(F.col(f"flagged{h}") >= MINED_SUPPORT) & (F.col(f"flagged{h}") >= MINED_PRECISION * F.col(f"all{h}")) for h in (0, 1)]
    both = (flagged >= MINED_SUPPORT) & (flagged >= MINED_PRECISION * (F.col("all1") + F.col("all0")))
    mined = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter(both | enough[0] | enough[1]).orderBy(
        flagged.desc(), "key").collect()
    across = [_lexicon(mined, (1,)), _lexicon(mined, (0,))]  # for the rows of half 0 and 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = words.column(batch, "half").to_numpy(zero_copy_only=False).astype(np.int64)
            packed = []
            for texts in words.slices(words.column(batch, "content")):
                rows = [features(texts, lexicon) for lexicon in across]
                packed += [rows[h][i].tobytes() for i, h in enumerate(half[texts.lo : texts.hi])]
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "order"), words.column(batch, "flagged"), pa.array(packed, pa.binary())],
                names=["order", "flagged", "row"])

    rows = reviewed.select("order", "flagged", "half", "content").mapInArrow(
        measure, "order long, flagged boolean, row binary").collect()
    rows.sort(key=lambda r: (r["order"], r["flagged"], bytes(r["row"])))
    matrix = np.frombuffer(b"".join(r["row"] for r in rows), np.float32).reshape(-1, FEATURES)
    return _trained(matrix, np.array([float(r["flagged"]) for r in rows]), _lexicon(mined, (0, 1)))


def toxicity(block: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``block`` (doc_id, content): how likely a reviewer would flag the content.

    Whole content counts; null and empty content gets the score of a text without any mark.  Repeated rows
    repeat their score.  An empty block gives no rows.  Further columns of ``block`` are ignored.
    """
    shared = block.sparkSession.sparkContext.broadcast(model)  # bounded by sample_rows and TREES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(features(texts, shared.value.mined))
                     for texts in words.slices(words.column(batch, "content"))]
            yield pa.RecordBatch.from_arrays(
                [words.column(batch, "doc_id"), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    text = block.select("doc_id", F.coalesce("content", F.lit("")).alias("content"))
    return text.mapInArrow(score, "doc_id long, score double")
