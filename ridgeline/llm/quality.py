"""Quality classifier: a weak-label model and a hashed linear scorer trained on its posteriors.

Overlapping heuristic labellers each vote on every document: seven say junk or nothing, one says clean or nothing. Expectation-maximisation over the counts of
all documents' vote patterns (at most 3 ** labellers rows) estimates how accurate each labeller is and how common junk
is; a pattern's posterior is its documents' soft label. A logistic model on hashed features of the text itself (the votes
stay out of it) is then fitted to the posteriors of a bounded sample (``SAMPLE`` documents of the smallest id hashes) and
scores every document. Its features are shares, in buckets, of byte 3-grams, of 4-grams of character classes (small and
capital letters, digits, each other ASCII character by itself), and of words by how often the text had them before.

Defined cases: a null or empty text, or one without a word, has quality 0 and is rejected; with too few rows to
train, the posterior is the score; ties have equal scores; repeated rows are each scored; long texts are read whole;
extra columns stay out of it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import ARROW_ROWS, Scratch, batches_of, tidy
from ._text import PIECE, SPACED, byte_views, words

#: Documents that the linear model is fitted to, at most (a documented bound).
SAMPLE = 4000
#: Buckets of 3-grams, of class 4-grams, and of words by recurrence.
GRAMS, CLASSES, RECURRENCE = 1 << 12, 1 << 11, 16
WIDTH = GRAMS + CLASSES + RECURRENCE
#: Documents that score under this are rejected.
THRESHOLD = 0.5
#: Names of the labellers, in the order of the votes.
LABELLERS = ("bars", "symbols", "shouting", "runs", "capitals", "stutter", "variety", "prose")
JUNK, NONE, CLEAN = 0, 1, 2

_MARKS = np.zeros(256, bool)
_MARKS[33:48] = _MARKS[58:65] = _MARKS[91:97] = _MARKS[123:127] = True


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return count / np.maximum(total, 1)


def votes_of(bounds, hashes, starts, ends, part) -> np.ndarray:
    """Rows x labellers of JUNK, NONE or CLEAN."""
    rows = len(bounds) - 1
    n = np.diff(bounds)
    row = np.repeat(np.arange(rows), n)
    last, first = part[ends - 1] if len(ends) else part[:0], part[starts] if len(starts) else part[:0]
    per = lambda mask: np.bincount(row[mask], minlength=rows)
    bar = per((first == 124) & (ends - starts == 1))
    before = part[np.maximum(ends - 2, 0)] if len(ends) else part[:0]
    symbol = per(np.isin(last, np.frombuffer(b"#$%&*", np.uint8)) & (before == last))
    shout = per((last == 33) & (before == 33))
    upper = np.concatenate([[0], np.cumsum((part >= 65) & (part <= 90))])
    lower = np.concatenate([[0], np.cumsum((part >= 97) & (part <= 122))])
    low = starts[np.minimum(bounds[:-1], max(len(starts) - 1, 0))] if len(starts) else np.zeros(rows, int)
    high = ends[np.maximum(bounds[1:] - 1, 0)] if len(ends) else np.zeros(rows, int)
    ups, lows = upper[high] - upper[low], lower[high] - lower[low]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][n > 0]] = False
    stutter = per(same)
    distinct = np.array([len(np.unique(hashes[a:b])) if b - a >= 40 else 0 for a, b in zip(bounds[:-1], bounds[1:])], float) if rows else np.zeros(0)
    variety = _share(distinct, n)
    mark = _MARKS[part]
    marks = np.concatenate([[0], np.cumsum(mark)])
    runs = np.concatenate([[0], np.cumsum(mark & np.concatenate([[False], mark[:-1]]))]) if len(part) else np.zeros(1, int)
    marked, doubled = marks[high] - marks[low], _share(runs[high] - runs[low], n)
    capitals, stammer = _share(ups, ups + lows), _share(stutter, n)
    junk = [
        _share(bar, n) > 0.15,
        _share(symbol, n) > 0.15,
        _share(shout, n) > 0.15,
        doubled > 0.15,
        (capitals > 0.4) & (ups + lows >= 20),
        (stammer > 0.1) & (stutter >= 3),
        (n >= 40) & (variety < 0.25),
    ]
    prose = (marked <= 3 + 0.6 * n) & (doubled < 0.1) & (bar == 0) & ((capitals < 0.35) | (ups + lows < 20)) & ((stammer < 0.08) | (stutter < 3)) & ((n < 40) | (variety > 0.3))
    out = np.stack([*(np.where(x, JUNK, NONE) for x in junk), np.where(prose, CLEAN, NONE)], axis=1).astype(np.int64)
    out[n == 0] = JUNK
    return out


def pattern_code(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of clean by pattern, each labeller's vote probabilities (labeller, class, vote), and the share of clean."""
    junk, clean = (patterns == JUNK).sum(1), (patterns == CLEAN).sum(1)
    post = np.where(junk > 0, 0.05, np.where(clean > 0, 0.95, 0.5)).astype(float)
    table, share = np.zeros((patterns.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        for k in range(patterns.shape[1]):
            for c in range(2):
                table[k, c] = np.bincount(patterns[:, k], weight[c], 3) + 1
        table /= table.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        log = np.stack([np.full(len(patterns), np.log(1 - share)), np.full(len(patterns), np.log(share))])
        for k in range(patterns.shape[1]):
            log += np.log(table[k][:, patterns[:, k]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, table, float(share)


_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


def _grams(x: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram at each place."""
    n = max(0, len(x) - size + 1)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h = (h ^ x[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


def _recurrence(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each row, how many of its words it had 0, 1, 2.., 4.., ... times before, and whether right before."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    order = np.lexsort((hashes, row))
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])]))
    times = np.empty(len(row), np.int64)
    times[order] = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    again = np.zeros(len(row), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    kind = np.minimum(np.log2(times + 1).astype(np.int64), RECURRENCE // 2 - 1) * 2 + again
    return np.bincount(row * RECURRENCE + kind, minlength=rows * RECURRENCE).reshape(rows, RECURRENCE)


def _vote_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern: every row's votes as one number."""
    fields = documents.select(key).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, bounds, h, starts, ends, part in words(batch.column(1), SPACED):
                code = pattern_code(votes_of(bounds, h, starts, ends, part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(code)], names=[key, "pattern"])

    return documents.select(key, F.col(text).alias("_text")).mapInArrow(tidy(run), type(documents.schema)(list(fields)).add("pattern", "long"))


def weak_labels(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of clean by vote pattern, the labellers' vote probabilities, and the share of clean documents."""
    with batches_of(documents.sparkSession, ARROW_ROWS):
        rows = _vote_rows(documents, key, text).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3 ** labellers rows
    patterns = np.array([[r.pattern // 3**k % 3 for k in range(len(LABELLERS))] for r in rows], int).reshape(-1, len(LABELLERS))
    post, table, share = expectation_maximisation(patterns, np.array([r.n for r in rows], float))
    return {r.pattern: float(p) for r, p in zip(rows, post)}, table, share


def _root(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / max(counts.sum(), 1))


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's features: square roots of shares, so that each kind has length one, or zero."""
    data, offsets = byte_views(column)
    recurring = (row for _, _, bounds, h, _, _, _ in words(column, SPACED) for row in _recurrence(bounds, h))
    for k, recurs in enumerate(recurring):
        grams, classes = np.zeros(GRAMS), np.zeros(CLASSES)
        for at in range(offsets[k], offsets[k + 1], PIECE):  # n-grams that begin in a piece may end in the next
            part = data[at : min(offsets[k + 1], at + PIECE + 3)].astype(np.uint32)
            grams += np.bincount(_grams(part[: PIECE + 2], 3, GRAMS), minlength=GRAMS)
            classes += np.bincount(_grams(_CLASS[part], 4, CLASSES), minlength=CLASSES)
        yield np.concatenate([_root(grams), _root(classes), _root(recurs)])


def fit(documents: DataFrame, posterior: dict[int, float], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights and, last, the bias of a logistic model; None where both classes aren't there."""
    rows = documents.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("_text"))
    limit = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return None
    # sample rows at most, however many share an id
    chosen = rows.where(F.col("h") <= limit).orderBy("h", F.crc32(F.coalesce("_text", F.lit("")))).limit(sample)
    known = dict(posterior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = [c for _, _, bounds, h, s, e, part in words(batch.column(1), SPACED) for c in pattern_code(votes_of(bounds, h, s, e, part)).tolist()]
            places, values = [], []
            for v in _vectors(batch.column(1)):
                at = np.flatnonzero(v)
                places.append(at.astype(np.uint16).tobytes())
                values.append(v[at].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([known.get(c, 0.5) for c in code], pa.float64()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["y", "places", "values"])

    with batches_of(documents.sparkSession, ARROW_ROWS):
        found = chosen.mapInArrow(tidy(run), "y double, places binary, values binary").toArrow()  # sample rows, a few KB each
    order = sorted(range(found.num_rows), key=lambda k: (found["y"][k].as_py(), found["places"][k].as_py(), found["values"][k].as_py()))
    y = found["y"].to_numpy()[order]
    if len(y) < 50 or (y > 0.5).all() or (y < 0.5).all():
        return None
    places = [np.frombuffer(found["places"][k].as_buffer(), np.uint16) for k in order]
    sizes = np.array([len(p) for p in places])
    flat = np.concatenate([np.frombuffer(found["values"][k].as_buffer(), np.float16) for k in order]).astype(np.float32)
    return _logistic(np.concatenate(places).astype(np.int32), flat, sizes, y)


def _logistic(places: np.ndarray, values: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.2, decay: float = 1e-5, flat: float = 1e-2) -> np.ndarray:
    """Adam on all rows, which are sparse; each class weighs alike. Ends when ten rounds gain less than ``flat`` of the loss."""
    w, first, second = (np.zeros(WIDTH + 1) for _ in range(3))
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    row = np.repeat(np.arange(len(y)), sizes)
    losses: list[float] = []
    for t in range(1, rounds + 1):
        z = np.clip(np.bincount(row, values * w[places], minlength=len(y)) + w[-1], -30, 30)
        losses.append(float(weight @ (np.log1p(np.exp(z)) - y * z)))
        if t > 10 and losses[-11] - losses[-1] < flat * losses[-11]:
            break
        slope = weight * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(places, values * slope[row], minlength=WIDTH), slope.sum()) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8) * (0.99**t)
    return w


def scorer(spark: SparkSession, posterior: dict[int, float], weights: np.ndarray | None) -> Callable[[Column], Column]:
    """A function of a text column: struct<weak_label (posterior of clean), quality (0 to 1)>."""
    shared = spark.sparkContext.broadcast((dict(posterior), weights))

    @F.arrow_udf("struct<weak_label:double,quality:double>")
    def judge(column: pa.Array) -> pa.Array:
        known, w = shared.value
        code, empty = [], []
        for _, _, bounds, h, s, e, part in words(column, SPACED):
            code += pattern_code(votes_of(bounds, h, s, e, part)).tolist()
            empty += (np.diff(bounds) == 0).tolist()
        weak = np.array([known.get(c, 0.5) for c in code], float)
        quality = weak.copy() if w is None else np.array([1 / (1 + np.exp(-np.clip(v @ w[:-1] + w[-1], -30, 30))) for v in _vectors(column)], float)
        quality[np.array(empty, bool)] = 0.0
        return pa.StructArray.from_arrays([pa.array(weak), pa.array(quality)], names=["weak_label", "quality"])

    return judge


def learn(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Callable[[Column], Column]:
    """The scorer that all documents' votes teach."""
    posterior, _, _ = weak_labels(documents, key, text)
    return scorer(documents.sparkSession, posterior, fit(documents, posterior, key, text))


def classify(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, weak_label, quality and accepted for every document."""
    judged = documents.select(key, learn(documents, key, text)(F.col(text)).alias("_s"))
    with batches_of(documents.sparkSession, ARROW_ROWS):
        judged = Scratch(documents.sparkSession, "quality").put("judged", judged)
    return judged.select(key, "_s.weak_label", "_s.quality", (F.col("_s.quality") >= threshold).alias("accepted"))
