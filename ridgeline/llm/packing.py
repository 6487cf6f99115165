"""Packing along a space-filling curve.

A document's hashed words are projected to ``DIMENSIONS`` coordinates (random signs), scaled to its norm, each made even
by the normal distribution's function, and their Hilbert key orders the documents: like ones become neighbours. Documents are
range-partitioned and sorted by that key (then by a hash of the id, so that equal texts can be split over partitions),
and each partition packs its documents one after another into sequences, cutting where a sequence is full. What is left
at a partition's end is cut into powers of two, which need no padding.

The tokenizer works on each distinct white-space-separated word once for a worker: it never merges across
ASCII white space. Where its file says that it lower-cases and cuts text into letters, single digits and signs before it
merges (``SPLIT``), words are cut so first between ASCII characters, and plain ASCII parts are told apart without regard
to case. Parts of Latin letters, one digit or signs alone go to the tokenizer's merges at once, in lower case and as the
characters that stand for bytes. Words with an apostrophe or a character that begins an added token stay whole. The cache of words is bounded; words are told apart by 64-bit hashes (with 2,000,000 words in it, the
chance that any two of them are taken for one is about 1e-7).

Defined cases: a null or empty text has only the end id; long texts spread over sequences; ties are ordered by id
and checksum, and repeated rows are packed each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ARROW_ROWS, Scratch, batches_of, tidy
from ._text import SPACED, U, mix, parts_of, words

LENGTH = 4096
END = 2
DIMENSIONS, BITS = 4, 8
#: Random signs of a word; their sums estimate a document's norm, by which it is scaled, long or short.
SKETCH = 8
#: Words that a worker's cache holds at most before it starts anew.
CACHE_WORDS = 2_000_000
#: The bounds of the ranges come from about so many sampled documents; they only balance the partitions.
BOUND_SAMPLE = 20_000
#: A partition holds about so many bytes of text at least: its end costs some short sequences.
PARTITION_BYTES = 8 << 20

#: The pattern by which a tokenizer cuts text, if words may be cut beforehand.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters in every edition of Unicode whose lower case is one letter and that nothing composes to.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: The characters by which byte-level merges write the bytes that have no printable one of their own.
_BYTES = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

_STEPS = np.array([0.5 * (1 + erf(x / sqrt(2))) for x in np.linspace(-4, 4, 513)])
OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of integer points (rows) by transposing Gray-coded axes (Skilling's method)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    out = []
    for _, _, bounds, h, _, _, _ in words(column, SPACED):
        m = mix(h)
        n = np.diff(bounds)
        signs = np.empty((len(n), SKETCH))
        for d in range(SKETCH):
            sums = np.concatenate([[0], np.cumsum(m >> U(3 * d + 5) & U(1), dtype=np.int64)])
            signs[:, d] = 2 * (sums[bounds[1:]] - sums[bounds[:-1]]) - n
        y = signs[:, :DIMENSIONS] / np.maximum(np.sqrt((signs * signs).mean(1, keepdims=True)), 1)
        even = np.interp(y, np.linspace(-4, 4, 513), _STEPS)
        out.append(hilbert(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def classes_of(path: str) -> np.ndarray | None:
    """A class for each byte, if words may be cut where it changes: 1 letters, 2 digits (each alone), 3 signs, 4 other
    characters, beside which nothing is cut, 0 what keeps its word whole. None if the tokenizer cuts text otherwise."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    if spec["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [split, level]} or spec["normalizer"] != {"type": "Sequence", "normalizers": normal}:
        return None
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F], kind[0x80:] = 3, 4
    kind[[0xCE, 0xCF]] = 0  # Greek: a sigma's lower case may depend on what follows
    kind[0x30:0x3A] = 2
    kind[0x41:0x5B] = kind[0x61:0x7B] = 1
    kind[ord("'")] = 0
    for token in spec["added_tokens"]:
        first = token["content"].encode()[0]
        kind[[first, *chr(first).swapcase().encode()]] = 0
    return kind


class WordIds:
    """Token ids of words by hash; new words go to the tokenizer once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.classes = Tokenizer.from_file(path), classes_of(path)
        of = lambda k: re.escape("".join(map(chr, np.flatnonzero(self.classes == k))))
        self.plain = re.compile(f"[{of(1)}{_LATIN}]+|[{of(2)}]|[{of(3)}]+") if self.classes is not None else None
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.starts, self.sizes, self.pool, self.used = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def _fresh(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        merge = self.tokenizer.model.tokenize
        found = [[t.id for t in merge(x.lower().encode().decode("latin-1").translate(_BYTES))] if self.plain and self.plain.fullmatch(x) else None for x in texts]
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            found[k] = e.ids
        return found

    def encode(self, hashes, starts, ends, part) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each word's number of ids."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.hashes, uniq)
        known = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == uniq) if len(self.hashes) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = part.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            ids = self._fresh(texts)
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
            self.pool[self.used : self.used + len(flat)] = flat
            begins = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.used += len(flat)
            self.hashes, self.starts, self.sizes = np.insert(self.hashes, at[new], uniq[new]), np.insert(self.starts, at[new], begins), np.insert(self.sizes, at[new], sizes)
            at = np.searchsorted(self.hashes, uniq)
        begin, size = self.starts[at][back], self.sizes[at][back].astype(np.int64)
        ends_at = np.cumsum(size)
        return self.pool[np.repeat(begin - (ends_at - size), size) + np.arange(ends_at[-1])], size


_CACHED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    if path not in _CACHED:
        _CACHED[path] = WordIds(path)
    return _CACHED[path]


def tokens(column: pa.Array, ids: WordIds, end: int = END) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: the first row, all their ids with the end id after each row, and where each row begins (n + 1)."""
    for first, last, bounds, h, starts, ends, part in words(column, SPACED, fold=False) if ids.classes is None else parts_of(column, SPACED, ids.classes):
        flat, size = ids.encode(h, starts, ends, part)
        inner = np.concatenate([[0], np.cumsum(size)])[bounds]
        begins = inner + np.arange(len(inner))
        out = np.empty(len(flat) + len(inner) - 1, np.uint32)
        at_end = begins[1:] - 1
        out[at_end] = end
        mask = np.ones(len(out), bool)
        mask[at_end] = False
        out[mask] = flat
        yield first, out, begins


def _powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Sequences of one partition. The last, unfilled one is kept back until the end is known."""

    def __init__(self, partition: int, length: int):
        self.length, self.next, self.fill = length, partition << 32, 0
        self.rows: list[tuple] = []
        self.held: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.length - self.fill)
            self.held.append((key, at, ids[at : at + take], n, self.fill))
            at, self.fill = at + take, self.fill + take
            if self.fill == self.length:
                self._flush([(0, self.length)])

    def _flush(self, cuts: list[tuple[int, int]]) -> None:
        for low, high in cuts:
            for key, start, ids, n, offset in self.held:
                a, b = max(low, offset), min(high, offset + len(ids))
                if a < b:
                    own = ids[a - offset : b - offset]
                    self.rows.append((key, start + a - offset, b - a, zlib.crc32(np.ascontiguousarray(own, "<u4").tobytes()), n, self.next, a - low))
            self.next += 1
        self.held, self.fill = [], 0

    def end(self) -> None:
        cuts, at = [], 0
        for size in _powers_of_two(self.fill):
            cuts.append((at, at + size))
            at += size
        self._flush(cuts)

    def take(self, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows)) or [()] * 7, []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    total, count = rows.select(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count("*")).first()
    parts = max(1, min(total // PARTITION_BYTES, 100_000))
    tie = F.xxhash64("_key").bitwiseAND(F.lit((1 << 31) - 1))

    @F.arrow_udf("long")
    def place(column: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(curve_keys(column) << 31 | tie.to_numpy())

    some = rows.sample(min(1.0, BOUND_SAMPLE / count), seed=7) if count else rows
    with batches_of(spark, ARROW_ROWS):
        seen = some.select(place("_text", tie).alias("place"), F.coalesce(F.octet_length("_text"), F.lit(0)).alias("size")).toPandas().sort_values("place") if parts > 1 else None
    cuts = np.zeros(0, np.int64)
    if seen is not None:
        weight = np.cumsum(seen["size"].to_numpy() + 1)
        cuts = seen["place"].to_numpy(np.int64)[np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts)]
    shared = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("struct<place:long,part:int>")
    def located(column: pa.Array, tie: pa.Array) -> pa.Array:
        at = curve_keys(column) << 31 | tie.to_numpy()
        return pa.StructArray.from_arrays([pa.array(at), pa.array(np.searchsorted(shared.value, at, "right").astype(np.int32))], names=["place", "part"])

    keyed = rows.withColumn("_at", located("_text", tie))
    ordered = keyed.repartitionById(parts, F.col("_at.part")).sortWithinPartitions("_at.place", "_key", F.crc32(F.col("_text").cast("binary")))
    names = [key, *(c.split()[0] for c in OUT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, kind = word_ids(tokenizer), _Packer(TaskContext.get().partitionId(), length), pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for first, flat, begins in tokens(batch.column(1), ids, end):
                for k in range(len(begins) - 1):
                    packer.add(keys[first + k], flat[begins[k] : begins[k + 1]])
            yield packer.take(names, kind)
        packer.end()
        yield packer.take(names, kind)

    kind = dict(documents.select(key).dtypes)[key]
    with batches_of(spark, ARROW_ROWS):
        return Scratch(spark, "packing").put("pieces", ordered.select("_key", "_text").mapInArrow(tidy(run), f"{key} {kind}, {OUT}"))
