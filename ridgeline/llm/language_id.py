"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every training text's n-grams (2 to 4 bytes of UTF-8, A-Z as a-z) are counted by language in each task and summed over
tasks; the matrix of log-probabilities (languages x 2**15) is broadcast, and batches of texts are scored in numpy. The
language of the largest sum of log-prior and all n-grams' log-probabilities is predicted; its score is its share when
the evidence is weighed as that of ``EVIDENCE`` n-grams.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learnt;
ties go to the first language in order; long texts are read whole; rows whose language is null are not learnt
from; repeated rows count each time; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import ARROW_ROWS, Scratch, batches_of, tidy
from ._text import PIECE, U, byte_views

#: Hashed n-grams; what a task or the model holds is so many numbers for each language.
WIDTH = 1 << 15
SIZES = (2, 3, 4)
#: A score (not the decision) weighs its evidence as if a text had so many n-grams at most: n-grams overlap and are no
#: independent witnesses.
EVIDENCE = 60
#: More languages than this are taken for a mistake in the column.
MAX_LANGUAGES = 1000

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram that begins at each byte."""
    x = _FOLD[data]
    h = x.copy()
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :] * np.uint32(0x9E3779B1)
        if n in SIZES:
            yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about PIECE bytes; a longer text is a run of its own, cut into overlapping pieces by the caller."""
    data, offsets = byte_views(column)
    first, n = 0, len(column)
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """data whole, or for one long text pieces; with each, how many of its first bytes n-grams may begin at (what
    follows them in a piece only ends n-grams)."""
    step = 2 * PIECE
    for at in range(0, max(1, len(data)), step):
        yield step, data[at : at + step + max(SIZES) - 1]


def train(documents: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log-priors, and log-probabilities (languages x WIDTH), from all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column(0), name)).column(1)
                total = totals.setdefault(name, np.zeros(WIDTH, np.int64))
                texts[name] = texts.get(name, 0) + len(own)
                for first, last, data, offsets in _runs(own):
                    for step, part in _pieces(data):
                        for n, g in zip(SIZES, _grams(part)):
                            g = g[_inside(offsets, len(part), n)] if last - first > 1 else g[:step]
                            total += np.bincount(g, minlength=WIDTH)
        names = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([texts[n] for n in names], pa.int64()), pa.array([totals[n].tobytes() for n in names], pa.binary())], names=["lang", "texts", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
        return pa.table({"lang": table["lang"].slice(0, 1), "texts": [pa.compute.sum(table["texts"]).as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, texts long, counts binary"
    rows = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(tidy(count), schema)
    with batches_of(documents.sparkSession, ARROW_ROWS):
        summed = Scratch(documents.sparkSession, "language-id").put("counts", parts.groupBy("lang").applyInArrow(add, schema))
    if summed.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted(summed.collect(), key=lambda r: r.lang)  # a row for each language
    names = [r.lang for r in found]
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in found], float).reshape(len(found), WIDTH)
    seen = np.array([r.texts for r in found], float)
    weight = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * WIDTH))
    return names, np.log(seen / max(seen.sum(), 1)), weight.astype(np.float32)


def _inside(offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which n-grams of size bytes lie in one row."""
    ok = np.ones(max(0, size - n + 1), bool)
    for edge in offsets[1:-1]:
        ok[max(0, edge - n + 1) : edge] = False
    return ok


def predictor(spark: SparkSession, model: tuple[list[str], np.ndarray, np.ndarray]) -> Callable[[Column], Column]:
    """A function of a text column: struct<lang_pred, score>."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(column: pa.Array) -> pa.Array:
        names, prior, weight = shared.value
        table = np.ascontiguousarray(weight.T)
        pred, score = [], []
        for first, last, data, offsets in _runs(column):
            sums, grams = _score(data, offsets, table, len(names))
            letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
            letters = letters[offsets[1:]] > letters[offsets[:-1]]
            for k in np.flatnonzero(~letters):
                letters[k] = any(c.isalpha() for c in bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace"))
            for k in range(last - first):
                if not letters[k] or not names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(np.argmax(sums[k] + prior))
                log = sums[k] * min(1.0, EVIDENCE / max(grams[k], 1)) + prior
                share = np.exp(log - log.max())
                pred.append(names[best])
                score.append(float(share[best] / share.sum()))
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return judge


def _score(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sum of log-probabilities by language, and its number of n-grams."""
    rows = len(offsets) - 1
    sums, grams = np.zeros((rows, langs)), np.zeros(rows)
    for step, part in _pieces(data):
        for n, g in zip(SIZES, _grams(part)):
            at = offsets if rows > 1 else np.array([0, len(part)])
            g = g if rows > 1 else g[:step]
            low, high = at[:-1], np.maximum(at[1:] - n + 1, at[:-1])
            for k in range(langs):
                run = np.zeros(len(g) + 1)
                np.cumsum(table[:, k][g], out=run[1:], dtype=float)
                sums[:, k] += run[np.minimum(high, len(g))] - run[np.minimum(low, len(g))]
            grams += np.minimum(high, len(g)) - np.minimum(low, len(g))
    return sums, grams


def held_out(key: str) -> Column:
    """Every fourth document, by its id's checksum, is never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score: learns from the documents that aren't held out and judges all."""
    learnt = predictor(documents.sparkSession, train(documents.where(~held_out(key)), lang, text))
    judged = documents.select(key, held_out(key).alias("_h"), learnt(F.col(text)).alias("_s"))
    with batches_of(documents.sparkSession, ARROW_ROWS):
        judged = Scratch(documents.sparkSession, "language-id").put("judged", judged)
    return judged.select(key, F.col("_h").alias("held_out"), "_s.lang_pred", "_s.score")
