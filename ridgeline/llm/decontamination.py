"""Benchmark decontamination: a positional inverted index of the training texts, and phrase and proximity search.

``build_index`` stores, for each block of documents, where it holds each of its terms: sorted (term, position) postings
of all words in a table of the shared folder, with a dictionary of how often each task's documents hold each term. The
index knows nothing of any benchmark; ``Index.open`` finds it again for later test sets. ``search`` takes each test
phrase's rarest term first, by its count in the whole index, adjusts its list by the term's offset, and intersects with
the lists of the other terms from rare to frequent. With ``slop`` 0 that is exact phrases; else each term may stand up
to ``slop`` words away from its place beside the rarest one.

Phrases are the stated query set. They are cut out and made distinct in a table, and go out in blocks of about
``BLOCK_WINDOWS``, one after another: driver and tasks hold one block of phrases (and the items that hold them) at a
time, so a larger benchmark takes more rounds over the index and no more memory.

Defined cases: null and empty texts have no words and no hits; an item without words has no window, one without an id
none either; equal items and repeated documents are each counted; keys may be of any type; extra columns are ignored;
empty tables give no hits or no rows; a document of any length is in one block, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import ARROW_ROWS, WRITING, Scratch, batches_of, tidy
from ._text import ALNUM, U, words

#: Words of a window; shorter items are one window.
WINDOW = 10
#: About so many windows are searched for in one round.
BLOCK_WINDOWS = 200_000
#: Words of an index block, at most, unless one document has more: places then fit in two bytes.
BLOCK_WORDS = 16_000
#: Index blocks that a task takes at a time.
BLOCK_ROWS = 16
#: Terms of one dictionary row, and of a task's dictionary before it is sent.
DICTIONARY, HELD = 8_000, 1_000_000

# --- the index -----------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """Blocks (block, keys, n_words, terms, counts, positions) and, where block is null, dictionary rows (terms, counts)."""

    table: DataFrame

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(path))

    @property
    def blocks(self) -> DataFrame:
        return self.table.where("block is not null")

    @property
    def dictionary(self) -> DataFrame:
        return self.table.where("block is null").select("terms", "counts")


def _whole(values: np.ndarray) -> bytes:
    """Whole numbers of two or four bytes."""
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32).tobytes()


def _numbers(blob: pa.Scalar, n: int) -> np.ndarray:
    data = blob.as_buffer()
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


def _postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in order, how often each stands, and where, term by term."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), ranked[1:] != ranked[:-1]]))
    return ranked[start], np.diff(np.append(start, len(h))), order


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, where = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(where, np.concatenate([c for _, c in parts]), len(terms)).astype(np.int64)


def _index_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["block", "keys", "n_words", "terms", "counts", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known, held, kind = TaskContext.get().partitionId() << 32, [], 0, None
        blob = lambda x: pa.array([x], pa.binary())

        def dictionary(terms: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(terms), DICTIONARY):
                some = slice(at, at + DICTIONARY)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(kind)), pa.nulls(1, pa.list_(pa.int32())), blob(terms[some].tobytes()), blob(counts[some].tobytes()), blob(None)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for first, last, bounds, h, _, _, _ in words(batch.column(1), ALNUM):
                a = 0
                while a < last - first:  # documents a..b-1 are one block
                    b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK_WORDS, "right")) - 1)
                    b = min(b, last - first)
                    terms, counts, positions = _postings(h[bounds[a] : bounds[b]])
                    known.append((terms, counts))
                    held += len(terms)
                    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    n_words = pa.array(np.diff(bounds[a : b + 1]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed(batch.column(0).slice(first + a, b - a)), listed(n_words), blob(terms.tobytes()), blob(_whole(counts)), blob(_whole(positions))], names=names)
                    number, a = number + 1, b
            if held > HELD:
                known = [_merged(known)]
                held = len(known[0][0])
                if held > HELD // 2:
                    yield from dictionary(*known[0])
                    known, held = [], 0
        if known:
            yield from dictionary(*_merged(known))

    made = T.StructType().add("block", "long").add("keys", T.ArrayType(rows.schema["key"].dataType)).add("n_words", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(tidy(run), made.add("terms", "binary").add("counts", "binary").add("positions", "binary"))


def build_index(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of all documents and all their words to path."""
    rows = _index_rows(documents, key, text)
    with batches_of(documents.sparkSession, ARROW_ROWS):
        rows.write.mode("overwrite").options(**WRITING).parquet(path)
    return Index(documents.sparkSession.read.schema(rows.schema).parquet(path))


def term_counts(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    """How often all documents hold each term of a sorted vocabulary."""
    shared = index.table.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1)):
                t, c = np.frombuffer(t.as_buffer(), U), np.frombuffer(c.as_buffer(), np.int64)
                at, ok = _among(t, wanted)
                total[at[ok]] += c[ok]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    found = index.dictionary.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block's phrases
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def _among(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand in sorted wanted, and which do."""
    at = np.minimum(np.searchsorted(wanted, values), max(0, len(wanted) - 1))
    return at, wanted[at] == values if len(wanted) else np.zeros(len(values), bool)


# --- phrases -------------------------------------------------------------------------------------------------------


def phrases(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """words (hashes), items: every distinct window and the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, bounds, h, _, _, _ in words(batch.column(1), ALNUM):
                for k in range(last - first):
                    own = h[bounds[k] : bounds[k + 1]]
                    cut = sorted({own[p : p + size].tobytes() for p in range(max(1, len(own) - size + 1))}) if len(own) else []
                    yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.repeat(batch.column(0)[first + k], len(cut))], names=["words", "item"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")
    return rows.mapInArrow(tidy(run), "words binary, item string").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _plan(sequences: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Each phrase's (term, offset) from rare to frequent; shorter phrases repeat their last step."""
    lengths = np.array([len(p) for p in sequences], np.int64)
    wide = int(lengths.max()) if len(sequences) else 1
    terms, offsets = np.zeros((len(sequences), wide), np.int64), np.zeros((len(sequences), wide), np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        ids = np.searchsorted(vocabulary, np.stack([sequences[r] for r in rows]))
        order = np.argsort(counts[ids], axis=1, kind="stable")
        order = np.concatenate([order, np.repeat(order[:, -1:], wide - n, 1)], 1)
        terms[rows], offsets[rows] = np.take_along_axis(ids, order, 1), order
    by = np.argsort(terms[:, 0], kind="stable")
    return {"vocabulary": vocabulary, "terms": terms[by], "offsets": offsets[by], "lengths": lengths[by], "phrase": by}


def _intersect(plan: dict[str, np.ndarray], terms, counts, positions, bounds, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, row of the plan) of every match in a block."""
    ends = np.cumsum(counts)
    postings = (np.repeat(terms, counts) << 32) | positions
    lead = plan["terms"][:, 0]
    at, live = _among(lead, terms)
    live = np.flatnonzero(live)
    size = counts[at[live]]
    rows = np.repeat(live, size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start = positions[np.repeat(ends[at[live]] - size, size) + inside] - plan["offsets"][rows, 0]
    doc = np.searchsorted(bounds, start + plan["offsets"][rows, 0], "right") - 1
    keep = (start >= bounds[doc]) & (start + plan["lengths"][rows] <= bounds[doc + 1]) if slop == 0 else np.ones(len(rows), bool)
    rows, start, doc = rows[keep], start[keep], doc[keep]
    for k in range(1, plan["terms"].shape[1]):
        if not len(rows):
            break
        place = start + plan["offsets"][rows, k]
        base = plan["terms"][rows, k] << 32
        low, high = np.maximum(place - slop, bounds[doc]), np.minimum(place + slop, bounds[doc + 1] - 1)
        keep = (low <= high) & (np.searchsorted(postings, base | np.maximum(low, 0)) < np.searchsorted(postings, base | np.maximum(high, 0), "right"))
        rows, start, doc = rows[keep], start[keep], doc[keep]
    return start, rows


FOUND = "block long, place int, spans array<int>, items array<string>"


def _round(index: Index, plan: dict[str, np.ndarray], items: list[list[str]], slop: int) -> DataFrame:
    """For each document that holds a phrase of the plan: which words are hit (start, end pairs), and the items."""
    shared = index.table.sparkSession.sparkContext.broadcast((plan, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, items = shared.value
        for batch in batches:
            for block, n_words, terms, counts, positions in zip(*batch.columns):
                own, n_words = np.frombuffer(terms.as_buffer(), U), n_words.values.to_numpy().astype(np.int64)
                counts, positions = _numbers(counts, len(own)), _numbers(positions, int(n_words.sum()))
                at, ok = _among(own, plan["vocabulary"])
                bounds = np.concatenate([[0], np.cumsum(n_words)])
                start, rows = _intersect(plan, at[ok], counts[ok], positions[np.repeat(ok, counts)], bounds, slop)
                if not len(rows):
                    continue
                anchor = np.clip(start + plan["offsets"][rows, 0], 0, None)
                doc = np.searchsorted(bounds, anchor, "right") - 1
                spans: dict[int, list[int]] = {}
                names: dict[int, set[str]] = {}
                for i in np.lexsort((start, doc)):
                    d, a = int(doc[i]), int(max(start[i] - bounds[doc[i]], 0))
                    b = int(min(start[i] + plan["lengths"][rows[i]], bounds[doc[i] + 1]) - bounds[doc[i]])
                    own_spans = spans.setdefault(d, [])
                    if own_spans and a <= own_spans[-1]:
                        own_spans[-1] = max(b, own_spans[-1])
                    else:
                        own_spans += [a, b]
                    names.setdefault(d, set()).update(items[plan["phrase"][rows[i]]])
                found = [pa.array([block.as_py()] * len(spans), pa.int64()), pa.array(list(spans), pa.int32()), pa.array(list(spans.values()), pa.list_(pa.int32())), pa.array([sorted(names[d]) for d in spans], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(found, names=["block", "place", "spans", "items"])

    return index.blocks.select("block", "n_words", "terms", "counts", "positions").mapInArrow(tidy(run), FOUND)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _disjoint(column: pa.Array) -> pa.Array:
    """Sorted disjoint (start, end) pairs of the same words."""

    def one(flat: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in sorted(zip(flat[::2], flat[1::2])):
            if out and a <= out[-1]:
                out[-1] = max(b, out[-1])
            else:
                out += [a, b]
        return out

    return pa.array([one(x) for x in column.to_pylist()], pa.list_(pa.int32()))


def search(index: Index, benchmark: DataFrame, size: int = WINDOW, slop: int = 0, item: str = "item_id", text: str = "text") -> DataFrame:
    """key, n_words, hit_words (start, end pairs, disjoint, in order) and items, for every indexed document."""
    spark = index.table.sparkSession
    work = Scratch(spark, "decontamination")
    with batches_of(spark, ARROW_ROWS):
        asked = work.put("phrases", phrases(benchmark, size, item, text))
    rounds = max(1, -(-asked.count() // BLOCK_WINDOWS))
    hits = None
    for r in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("words"), F.lit(rounds)) == r).toArrow()
        sequences = [np.frombuffer(x.as_buffer(), U) for x in block["words"]]
        vocabulary = np.unique(np.concatenate([*sequences, np.zeros(0, U)]))
        with batches_of(spark, BLOCK_ROWS):
            plan = _plan(sequences, vocabulary, term_counts(index, vocabulary))
            found = work.put(f"hits{r}", _round(index, plan, block["items"].to_pylist(), slop))
        hits = found if hits is None else hits.unionByName(found)
    if rounds > 1:
        whole = hits.groupBy("block", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = work.put("hits", whole.select("block", "place", _disjoint("spans").alias("spans"), "items"))
    every = index.blocks.select("block", F.posexplode(F.arrays_zip("keys", "n_words")).alias("place", "d")).select("block", "place", "d.keys", "d.n_words")
    found = every.join(hits, ["block", "place"], "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    return found.select(F.col("keys").alias("key"), F.col("n_words").cast("long").alias("n_words"), F.col("spans").alias("hit_words"), "items").select("key", "n_words", none("hit_words", "int"), none("items", "string"))


def find(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, hit_words and items for every document: its index in the shared folder, searched once."""
    work = Scratch(documents.sparkSession, "decontamination-index")
    index = build_index(documents, f"{work.root}/index", key, text)
    return search(index, benchmark, size, slop, item, item_text).withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns, from find()'s spans and items."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_words") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, k: s + (F.get("hit_words", k + 1) - F.get("hit_words", k)).cast("long"))
    n_hit = F.when(F.size("hit_words") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    joined = F.concat_ws(",", F.array_sort("items"))
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
