"""Finding golden passages inside documents by size-partitioned MinHash containment.

A golden passage is far shorter than the content it may hide in, so their Jaccard similarity
says little; containment does.  Passages are partitioned by the number of their shingles, and
the sketch of a passage is its smallest shingle hashes, as many as its partition needs: of n
shingles of which at least c * n occur in a document, n - ceil(c * n) + 1 cannot all be missing.
Content is sketched by the hashes that are no larger than the partition's sketches reach, and
content with too few shingles for a partition is not searched in it.  A document that holds any
sketch hash is a candidate; the exact share of a passage's shingles, compared as text, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.storage import cut
from pagelight.llm.words import U64, mix

SHINGLE = 5
CONTAINMENT = 0.8
#: Bits of each filter that tells hashes no passage has; a bound of what is broadcast.  A full filter lets all pass.
FILTER_BITS = 1 << 22


def _prepared(content: Column) -> Column:
    """In lower case, with a space for everything beyond ASCII that is no letter, mark or digit, such as quotes, dashes and no-break spaces."""
    return F.lower(F.regexp_replace(F.coalesce(content, F.lit("")), r"[^\x00-\x7F\p{L}\p{M}\p{N}]+", " "))


def _windows(texts: words.Texts, size: int, exact: bool) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """Words, first word of each shingle and its hash; ``exact`` keeps the texts of just ``size`` words."""
    w = words.split(texts, words.NOT_ALNUM)
    value = words.windows(w.hash, size)
    ok = words.within(w.row, size)
    if exact:
        ok = ok & (np.diff(w.first)[w.row[: len(ok)]] == size)
    at = np.flatnonzero(ok)
    # Non-negative, so that comparisons agree with those of Spark's signed numbers.
    return w, at, mix(value[at], size) >> U64(1)


def _text(texts: words.Texts, w: words.Words, at: int, size: int) -> str:
    return " ".join(texts.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(at, at + size))


def passage_shingles(golden: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, width, hash, shingle) of the distinct shingles; passages under ``shingle`` words are one shingle."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = words.column(batch, "item_id").to_pylist()
            out = []
            for texts in words.slices(words.column(batch, "content")):
                for width in range(1, shingle + 1):
                    w, at, value = _windows(texts, width, width < shingle)
                    out += [(item[texts.lo + w.row[a]], width, int(h), _text(texts, w, a, width)) for a, h in zip(at, value)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))],
                names=["item_id", "width", "hash", "shingle"])

    text = golden.select("item_id", _prepared(F.col("content")).alias("content"))
    return text.mapInArrow(cut_up, "item_id long, width int, hash long, shingle string").distinct()


def sketched(shingles: DataFrame, containment: float) -> DataFrame:
    """Shingles with n, their partition (a width and a power of two) and whether they are in the sketch."""
    of_item = Window.partitionBy("item_id")
    n = F.count(F.lit(1)).over(of_item)
    rank = F.row_number().over(of_item.orderBy("hash", "shingle"))
    return shingles.withColumn("n", n).withColumn("rank", rank).select(
        "item_id", "width", "hash", "shingle", "n",
        F.floor(F.log2("n")).cast("int").alias("level"),
        (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(containment) - 1e-9) + 1).alias("in_sketch"))


def _filter(shingles: DataFrame) -> np.ndarray:
    """Bit filter of hashes, built by Spark: at most FILTER_BITS / 64 rows come to the driver."""
    place = F.pmod(F.col("hash"), F.lit(FILTER_BITS))
    rows = (
        shingles.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
        .select("word", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def contained_passages(block: DataFrame, golden: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of passages found in ``block`` (doc_id, content).

    ``golden`` is (item_id, content).  Words are runs of letters and digits, lower case; a shingle is five of
    them, and a passage of fewer words is one shingle of them all.  A passage is found when at least ``containment`` of its
    distinct shingles occur anywhere in the content.  Null and empty content holds nothing, null, empty and
    wordless passages are never found.  Rows that repeat an id count as one document or one passage.
    Empty frames give no rows.  Further columns are ignored.

    Every document is read once, whole.  Only hashes that pass the filters leave a task, so what is
    shuffled grows with the passages found and not with the text.
    """
    shingles = cut(sketched(passage_shingles(golden), containment))
    parts = shingles.groupBy("width", "level").agg(
        F.min("n").alias("least"), F.max(F.when(F.col("in_sketch"), F.col("hash"))).alias("reach")).collect()
    shared = block.sparkSession.sparkContext.broadcast({
        # One entry per width and power of two.
        "parts": sorted((r["width"], int(np.ceil(r["least"] * containment - 1e-9)), r["reach"]) for r in parts),
        "sketch": _filter(shingles.filter("in_sketch")), "all": _filter(shingles)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        widths = sorted({p[0] for p in known["parts"]})
        for batch in batches:
            document = words.column(batch, "doc_id").to_pylist()
            out = []
            for texts in words.slices(words.column(batch, "content")):
                for width in widths:
                    w, at, value = _windows(texts, width, False)
                    reach = np.zeros(texts.n, np.int64)
                    count = np.bincount(w.row[at], minlength=texts.n)
                    for _, least, r in (p for p in known["parts"] if p[0] == width):
                        reach = np.where(count >= least, np.maximum(reach, r), reach)
                    place = (value % U64(FILTER_BITS)).astype(np.int64)
                    row = w.row[at]
                    maybe = known["sketch"][place] & (value <= reach[row].astype(U64))
                    candidate = np.zeros(texts.n, bool)
                    candidate[row[maybe]] = True
                    for k in np.flatnonzero(candidate[row] & known["all"][place]):
                        out.append((document[texts.lo + row[k]], width, int(value[k]), _text(texts, w, at[k], width)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))],
                names=["doc_id", "width", "hash", "shingle"])

    text = block.select("doc_id", _prepared(F.col("content")).alias("content"))
    held = text.mapInArrow(search, "doc_id long, width int, hash long, shingle string").distinct()
    found = held.join(shingles, ["width", "hash", "shingle"]).groupBy("doc_id", "item_id").agg(
        F.max("n").alias("n_shingles"), F.count(F.lit(1)).alias("n_found"), F.max("in_sketch").alias("candidate"))
    share = F.col("n_found") / F.col("n_shingles")
    return found.filter("candidate").select("doc_id", "item_id", "n_shingles", "n_found", share.alias("containment")).filter(
        F.col("containment") >= containment - 1e-9)
