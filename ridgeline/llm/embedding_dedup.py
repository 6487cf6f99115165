"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors that are equal to the bit (and in label) are one class. The classes of a label are dealt by hash into tiles of about
``TILE`` vectors, and every pair of a label's tiles is one row of work, which carries int8 vectors and three numbers for
each: its doubles stay behind. A unit vector x is s * q + e with q in int8; then x.y differs from s_x s_y q_x.q_y by at most
|s_x q_x| |e_y| + |e_x|. Products of q are exact (whole numbers). Pairs that this bound decides are decided; for pairs
of tiles that it leaves some open in, those alone (as a bit mask) meet the doubles of both tiles in a second join. A tile
pair returns, for each class, how many vectors it links with, and a spanning forest of the links: never the pairs.

Classes have numbers of their own, so vectors that share an id are counted each by itself. Components are those of ids.

Defined cases: a null label or vector, a zero vector, or one with null or non-finite components links with nothing
and is kept (unless another vector of its id links); so do vectors of different lengths among each other; equal vectors
link; rows that repeat an id are vectors like others, under one node; vectors with a null id are each their own, and
their component is the smallest id that they reach, if any; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, forest
from ._store import ARROW_ROWS, Scratch, batches_of, tidy

TILE = 1024
#: What double-precision sums may be off by; added to every bound.
ROUNDING = 1e-12


def _usable(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows are neither empty nor zero, and finite, with a norm that is so too."""
    length = np.diff(offsets)
    some = np.flatnonzero(length > 0)
    ok = np.zeros(len(length), bool)
    if len(some):
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.add.reduceat(flat * flat, offsets[some])  # what isn't finite makes its row's sum so
        ok[some] = np.isfinite(norm) & (norm > 0)
    return ok


def _raw(documents: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, dim, raw: the vector's doubles, or null where it links with nothing."""
    chosen = documents.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fields = chosen.schema.fields[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), float)  # null components are NaN
            length = pc.list_value_length(lists).to_numpy().astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(length)])
            ok = _usable(flat, offsets) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            whole = pa.Array.from_buffers(pa.large_binary(), len(ok), [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(flat)])
            raw = pc.if_else(pa.array(ok), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(ok, length, 0).astype(np.int32)), raw], names=["id", "label", "dim", "raw"])

    return chosen.mapInArrow(tidy(run), type(chosen.schema)(list(fields)).add("dim", "integer").add("raw", "binary"))


TILES = "dim int, tile int, classes binary, copies binary, q binary, stats binary, raw binary"


def _unit(raw: np.ndarray) -> np.ndarray:
    peak = np.abs(raw).max(1, keepdims=True)
    raw = raw / peak  # no overflow in the squares
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _build(group: pa.Table) -> pa.Table:
    """One tile: quantised unit vectors, for each its scale, the norm of its quantised part and of the rest; and doubles."""
    dim = group["dim"][0].as_py()
    x = _unit(np.frombuffer(b"".join(r.as_buffer() for r in group["raw"]), float).reshape(-1, dim))
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    part = q * scale[:, None]
    stats = np.stack([scale, np.sqrt((part * part).sum(1)), np.sqrt(((x - part) ** 2).sum(1))]) * np.array([[1.0], [1 + 1e-14], [1 + 1e-14]])
    whole = lambda name: group[name].to_numpy().astype(np.int64).tobytes()
    made = {"label": group["label"].slice(0, 1), "dim": pa.array([dim], pa.int32()), "tile": group["tile"].slice(0, 1)}
    blobs = {"classes": whole("class"), "copies": whole("copies"), "q": q.tobytes(), "stats": stats.tobytes(), "raw": x.tobytes()}
    return pa.table(made | {k: pa.array([v], pa.binary()) for k, v in blobs.items()})


def _view(x: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


class _Tile:
    def __init__(self, dim: int, classes, copies, q, stats):
        self.classes, self.copies = _view(classes, np.int64), _view(copies, np.int64)
        exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        self.q = _view(q, np.int8).reshape(-1, dim).astype(exact)
        self.scale, self.norm, self.rest = _view(stats, float).reshape(3, -1)


def screen(a: _Tile, b: _Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a surely link with which of b, and which may."""
    near = (a.q @ b.q.T).astype(float) * a.scale[:, None] * b.scale[None, :]
    bound = a.norm[:, None] * b.rest[None, :] + a.rest[:, None] + ROUNDING
    sure = near - bound >= threshold
    return sure, (near + bound >= threshold) & ~sure


def settle(x: np.ndarray, y: np.ndarray, open_pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the open pairs link, in double precision."""
    out = np.zeros_like(open_pairs)
    rows, columns = np.nonzero(open_pairs)
    for at in range(0, len(rows), 100_000):
        r, c = rows[at : at + 100_000], columns[at : at + 100_000]
        out[r, c] = np.einsum("ij,ij->i", x[r], y[c]) >= threshold
    return out


def _found(mask: np.ndarray, same: bool, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """Rows (a, 0, n): n vectors link with those of class a; and (a, b, 0): an edge of the forest. a, b: classes, copies."""
    counts = [(a[0], mask @ b[1])] + ([] if same else [(b[0], mask.T @ a[1])])
    edges = np.array(forest(mask, a[0], b[0]), np.int64).reshape(-1, 2)
    some = [n > 0 for _, n in counts]
    linked = [c[s] for (c, _), s in zip(counts, some)]
    zeros = np.zeros(sum(map(len, linked)), np.int64)
    first, second = np.concatenate([*linked, edges[:, 0]]), np.concatenate([zeros, edges[:, 1]])
    return [pa.array(first), pa.array(second), pa.array(np.concatenate([*(n[s] for (_, n), s in zip(counts, some)), np.zeros(len(edges), np.int64)]))]


def _screen_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim = column["dim"][r].as_py()
                one, two = (_Tile(dim, *(column[f"{side}_{n}"][r] for n in ("classes", "copies", "q", "stats"))) for side in "ab")
                same = column["i"][r].as_py() == column["j"][r].as_py()
                sure, open_pairs = screen(one, two, threshold)
                if same:
                    np.fill_diagonal(sure, False)
                    open_pairs = np.triu(open_pairs, 1)
                rows = _found(sure, same, (one.classes, one.copies), (two.classes, two.copies))
                left = open_pairs.any()
                n = len(rows[0])
                rows = [pa.concat_arrays([x, pa.nulls(int(left), pa.int64())]) for x in rows]
                mark = lambda name, n=n, r=r, left=left: pa.concat_arrays([pa.nulls(n, column[name].type), column[name].slice(r, int(left))])
                masks = pa.array([None] * n + [np.packbits(open_pairs).tobytes()] * int(left), pa.binary())
                yield pa.RecordBatch.from_arrays([*rows, *map(mark, ("label", "dim", "i", "j")), masks], names=["a", "b", "n", "label", "dim", "i", "j", "open"])

    return run


def _settle_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dim = column["dim"][r].as_py()
                x, y = (_view(column[f"{s}_raw"][r], float).reshape(-1, dim) for s in "ab")
                one, two = ((_view(column[f"{s}_classes"][r], np.int64), _view(column[f"{s}_copies"][r], np.int64)) for s in "ab")
                bits = np.unpackbits(_view(column["open"][r], np.uint8), count=len(x) * len(y)).reshape(len(x), len(y)).astype(bool)
                same = column["i"][r].as_py() == column["j"][r].as_py()
                mask = settle(x, y, bits, threshold)
                yield pa.RecordBatch.from_arrays(_found(mask | mask.T if same else mask, same, one, two), names=["a", "b", "n"])

    return run


def link(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """key, n_links, component_id, kept: one row for each of vectors."""
    spark = vectors.sparkSession
    work = Scratch(spark, "embedding-dedup")
    with batches_of(spark, ARROW_ROWS):
        rows = work.put("rows", _raw(vectors, key, vector, label))
    same = ["label", "dim", "raw"]
    classes = rows.where("raw is not null").groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = work.put("classes", classes.withColumn("class", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("raw"), "tiles").cast("int")).drop("tiles", "first")
    kind = dict(rows.dtypes)["label"]
    tiles = work.put("tiles", dealt.groupBy("label", "dim", "tile").applyInArrow(_build, f"label {kind}, {TILES}"))
    # the work list: every pair of tiles of a label, one row each
    grid = tiles.select("label", "dim", F.col("tile").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
    blobs = ("classes", "copies", "q", "stats")
    side = lambda s, at, names: tiles.select("label", "dim", F.col("tile").alias(at), *(F.col(c).alias(f"{s}_{c}") for c in names))
    pairs = grid.join(side("a", "i", blobs), ["label", "dim", "i"]).join(side("b", "j", blobs), ["label", "dim", "j"])
    with batches_of(spark, 4):
        found = work.put("found", pairs.mapInArrow(tidy(_screen_rows(threshold)), f"a long, b long, n long, label {kind}, dim int, i int, j int, open binary"))
        left = found.where("open is not null").select("label", "dim", "i", "j", "open")
        blobs = ("classes", "copies", "raw")
        left = left.join(side("a", "i", blobs), ["label", "dim", "i"]).join(side("b", "j", blobs), ["label", "dim", "j"])
        settled = work.put("settled", left.mapInArrow(tidy(_settle_rows(threshold)), "a long, b long, n long"))
    found = found.where("open is null").select("a", "b", "n").unionByName(settled)
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    edges = found.where("n = 0").select("a", "b")

    members = rows.where("raw is not null").join(classes.select(*same, "class"), same).select("id", "class")
    shared = members.where("id is not null").groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("a")).where("a <> b")
    shared = work.put("shared", shared)
    if not shared.isEmpty():  # an id of several classes joins them
        edges = edges.unionByName(members.join(shared.select("id", "b"), "id").where("class <> b").select(F.col("class").alias("a"), "b").distinct())
    parts = components(edges, work, "cc")
    about = classes.join(parts, F.col("class") == F.col("node"), "left").withColumn("g", F.coalesce("component", "class")).join(counts, F.col("class") == F.col("a"), "left")
    about = about.select(*same, "g", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = about.groupBy("g").agg(F.min("first").alias("component"))
    about = work.put("about", about.join(least, "g").select(*same, "n_links", "component"))
    work.drop("tiles", "found", "settled", "classes", "shared")
    out = rows.where("raw is not null").join(about, same).select("id", "n_links", "component")
    # a vector that links with nothing has the component of its id, if the id has other vectors
    unused = rows.where("raw is null").select("id")
    known = rows.where("raw is not null").join(unused.distinct(), "id", "left_semi").join(about, same).groupBy("id").agg(F.min("component").alias("component"))
    alone = unused.join(known, "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
