"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (tokens). Tokens fall into classes by the number of documents that
hold them: held by one document, rare (under ``FREQUENT``), frequent. In the global order lone tokens come first, then
rare, then frequent ones, each by hash. Let a document of n tokens lose at most t = n - ceil(s * n) of them to any
partner. Its prefix runs until it is sure to share an indexed signature with every partner: each lone or rare
token counts one; frequent tokens are dealt to m subclasses by hash, and each subclass counts one less than its tokens,
for there only pairs of tokens are indexed. The prefix ends at a count of t + 1: two sets that share no signature
then miss more than t tokens. Rare tokens are indexed singly (a list is shorter than FREQUENT), lone tokens not
at all. With m near t, a document has O(t) pairs. m depends on size, so a document is indexed for each m of the
smaller partners that it can have.

Classes are exact at any size, and nothing of them is broadcast. Texts are read once, in chunks of documents; a chunk
sends its tokens to buckets by their top bits (the number of buckets follows the bytes of text), a bucket counts them
and sends back those that several documents hold, and the chunk is put together again from what all buckets say. A token
that ``FREQUENT`` documents of one chunk hold is frequent by that alone: the chunk only announces it, so a bucket
gets a token less than FREQUENT times from any chunk, however common it is. Documents with more than t lone tokens have
no partner and end here. The chunks of documents are told apart by task and order, so documents should be a stored table
(as all queries here read), not the output of a shuffle that may come in another order after a loss.

Equal sets are one class from the start. Then each class is checked against the hub of its lists that it meets most (a
list's hub is its member that shares most with others), which joins most of a large group with as many checks as
members. After that, what lists still hold together across components is decided exactly. Lists of rare tokens are
short: their pairs are pruned by length and by the number of shared prefix tokens, and verified on the whole sets.
Lists of token pairs may be long: their members are dealt into families (by hub; small families that meet in one list
are one) and tiles, and any two tiles of families that share a list are verified as blocks, by one product of their
token matrices; pairs aren't emitted, only a spanning forest of the links. Tiles of one component aren't compared with
each other. Components are then sought among hubs, not among all members.

Sets are compared by 64-bit hashes of their shingles, of which 48 bits and the bucket's are kept (54 or more).

Defined cases: null or wordless texts have empty sets and link with nothing; rows that repeat an id are one
node (so unrelated texts under one id join their components: give rows a key of their own where that isn't meant); rows
with a null id are each their own, and their component is the smallest id that they reach, if any; ties don't
matter (components are sets); very long texts are whole sets; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components, forest
from ._store import ARROW_ROWS, Scratch, batches_of, give_back, tidy
from ._text import SPACED, U, mix, sequence_hash, words

#: A token of at least so many documents is frequent.
FREQUENT = 16
#: A bucket counts the tokens of about so many bytes of text; there are 2**LEAST_BITS buckets at least.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 64 << 20, 6, 22
#: A chunk ends when it has so many tokens (more where there are many buckets) or documents; a longer document is whole.
CHUNK, CHUNK_MOST, CHUNK_DOCS = 1 << 20, 1 << 24, 30_000
#: A tile holds about so many sets, or so many tokens, at most; a token matrix so many numbers.
TILE_SETS, TILE_TOKENS, MATRIX = 256, 500_000, 4_000_000

_LOW = U((1 << 48) - 1)


def token_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes (int64); shorter texts are one shingle."""
    for _, _, bounds, h, _, _, _ in words(column, SPACED):
        whole = sequence_hash(h, k).view(np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield sequence_hash(h[a:b], b - a).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


# --- token classes -------------------------------------------------------------------------------------------------


def bucket_bits(size: int) -> int:
    """log2 of the number of buckets for so many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, ceil(log2(max(1, size) / BUCKET_BYTES))))


def _pack(tokens: np.ndarray) -> np.ndarray:
    """The low six bytes of each token, as rows of bytes."""
    return np.ascontiguousarray(tokens, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(x.as_buffer() for x in column)
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))


def _sums(flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two checksums of each set."""
    ends = np.cumsum(n)
    out = []
    for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat * U(c)), dtype=U)])
        out.append((total[ends] - total[ends - n]).view(np.int64))
    return out


def _sent(kind: T.DataType) -> T.StructType:
    made = T.StructType().add("bucket", "integer").add("chunk", "long").add("tokens", "binary").add("docs", "binary").add("common", "binary")
    return made.add("ids", T.ArrayType(kind)).add("sums", "binary")


def _chunk(number: int, bits: int, ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What one chunk sends. To each bucket: its tokens (six bytes each) by document, whose they are (places, or a count
    for each document, whichever is shorter), and its common tokens. Under ids: the documents, their sums, and the
    places of common tokens, which a bucket only passes on."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets).view(U)
    sums = np.concatenate([n, *_sums(flat, n)])
    flat = flat & (U(((1 << bits) - 1) << (64 - bits)) | _LOW)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
    by = np.argsort(flat)
    start, size = _runs(flat[by])
    often = size >= FREQUENT
    common, places = flat[by[start[often]]], by[np.repeat(often, size)]
    left = np.ones(len(flat), bool)
    left[places] = False
    flat_left, doc_left = flat[left], doc[left]
    bucket = (flat_left >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, packed, doc_left = bucket[order], _pack(flat_left[order]), doc_left[order]
    common_bucket = (common >> U(64 - bits)).astype(np.int64)
    wanted = np.union1d(bucket, common_bucket).astype(np.int64)
    cuts, last = np.searchsorted(bucket, wanted), np.searchsorted(bucket, wanted, "right")
    first_common, last_common = np.searchsorted(common_bucket, wanted), np.searchsorted(common_bucket, wanted, "right")
    docs = []
    for a, b in zip(cuts, last):
        docs.append((doc_left[a:b] if b - a <= 2 * len(sets) else np.bincount(doc_left[a:b], minlength=len(sets)).astype(np.uint32)).tobytes())
    names = ["bucket", "chunk", "tokens", "docs", "common", "ids", "sums"]
    rows = [
        pa.array(wanted, pa.int32()), pa.array(np.full(len(wanted), number), pa.int64()), pa.array([packed[a:b].tobytes() for a, b in zip(cuts, last)], pa.binary()), pa.array(docs, pa.binary()),
        pa.array([common[a:b].tobytes() for a, b in zip(first_common, last_common)], pa.binary()), pa.nulls(len(wanted), pa.list_(ids.type)), pa.nulls(len(wanted), pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(rows, names=names)
    blobs = (size[often].astype(np.uint32), doc[places], common)
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    yield pa.RecordBatch.from_arrays([pa.array([number % (1 << bits)], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), listed, pa.array([sums.tobytes()], pa.binary())], names=names)


def _classed(bits: int):
    """A bucket's answer to each chunk: its tokens that several documents hold, with the top bit of a place set where
    the token is frequent."""

    def run(group: pa.Table) -> pa.Table:
        passed = pc.is_valid(group["ids"])
        rows = group.filter(pc.invert(passed))
        flat = _unpack(rows["tokens"])
        known = np.unique(np.frombuffer(b"".join(x.as_buffer() for x in rows["common"]), U)) & _LOW
        by = np.argsort(flat)
        start, size = _runs(flat[by])
        kind = np.where(size >= FREQUENT, 2, np.where(size > 1, 1, 0)).astype(np.uint8)
        kind[np.isin(flat[by[start]], known)] = 2
        place = np.empty(len(flat), np.uint8)
        place[by] = np.repeat(kind, size)
        at, chunks, tokens, docs = 0, [], [], []
        for chunk, t, d in zip(rows["chunk"].to_pylist(), rows["tokens"], rows["docs"]):
            to = at + len(t.as_buffer()) // 6
            own = np.frombuffer(d.as_buffer(), np.uint16)
            if len(own) != to - at:
                own = np.repeat(np.arange(len(own) // 2, dtype=np.uint16), own.view(np.uint32))
            several = np.flatnonzero(place[at:to])
            if len(several):
                chunks.append(chunk)
                tokens.append(_pack(flat[at:to][several]).tobytes())
                docs.append((own[several] | (place[at:to][several] == 2).astype(np.uint16) << np.uint16(15)).tobytes())
            at = to
        m = len(chunks)
        bucket = pa.array(np.full(m, group["bucket"][0].as_py()), pa.int32())
        made = [bucket, pa.array(chunks, pa.int64()), pa.array(tokens, pa.binary()), pa.array(docs, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, group.schema.field("ids").type), pa.nulls(m, pa.binary())]
        give_back()
        return pa.concat_tables([pa.table(made, schema=group.schema), group.filter(passed)])

    return run


# --- signatures ----------------------------------------------------------------------------------------------------


def slack(n, percent: int):
    """How many of n tokens a partner may lack at most."""
    return n - -(-percent * n // 100)


def _subclasses(n: int, percent: int) -> list[int]:
    """The m of every smaller or equal partner of a set of n tokens."""
    least = -(-percent * n // 100)
    return sorted({1 << (max(1, slack(x, percent)).bit_length() - 1) for x in (least, n)} | {1 << b for b in range((max(1, slack(least, percent))).bit_length() - 1, max(1, slack(n, percent)).bit_length())})


def _pairs(tokens: np.ndarray, need: int, m: int) -> np.ndarray:
    """Signatures of the pairs within subclasses, over the shortest prefix of frequent tokens that counts need."""
    part = (mix(tokens.view(U) ^ U(m)) & U(m - 1)).astype(np.int64)
    _, first = np.unique(part, return_index=True)
    counts = np.ones(len(tokens), np.int64)
    counts[first] = 0
    end = int(np.searchsorted(np.cumsum(counts), need)) + 1
    tokens, part = tokens[:end], part[:end]
    order = np.argsort(part, kind="stable")
    tokens, part, out = tokens[order].view(U), part[order], []
    for lag in range(1, len(tokens)):
        same = part[lag:] == part[:-lag]
        if not same.any():
            break
        out.append(mix(mix(tokens[:-lag][same] + U(m)) * U(3) + tokens[lag:][same]))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def signatures(n: int, shared: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, bool, np.ndarray]:
    """Of a set of n tokens, of which other documents hold those in shared (sorted) and many those marked frequent: the
    rare tokens in its prefix, whether those are all its rare ones, and signatures of pairs."""
    none = np.zeros(0, np.int64)
    need = slack(n, percent) + 1 - (n - len(shared))
    if need <= 0 or n < 2:
        return none, False, none
    rare = shared[~frequent]
    if len(rare) >= need:
        return rare[:need], len(rare) == need, none
    often = shared[frequent]
    combined = [_pairs(often, need - len(rare), m) for m in _subclasses(n, percent)]
    return rare, True, np.unique(np.concatenate(combined)) if combined else none


def _docs(kind: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    made = T.StructType().add("id", kind).add("n", "long").add("c1", "long").add("c2", "long").add("open", "boolean").add("lone", "integer").add("odd", "integer")
    return made.add("rare", longs).add("all_rare", "boolean").add("often", longs).add("tokens", "binary")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _assembled(bits: int, percent: int):
    """A row for each document of a chunk, from what all buckets have answered."""

    def run(group: pa.Table) -> pa.Table:
        passed = pc.is_valid(group["ids"])
        head, rows = group.filter(passed), group.filter(pc.invert(passed))
        ids = head["ids"][0].values
        n, c1, c2 = np.frombuffer(head["sums"][0].as_buffer(), np.int64).reshape(3, -1)
        blob = lambda name, kind: np.frombuffer(head[name][0].as_buffer(), kind)
        sizes = [len(x.as_buffer()) // 6 for x in rows["tokens"]]
        top = np.repeat(rows["bucket"].to_numpy().astype(U) << U(64 - bits), sizes)
        place = np.frombuffer(b"".join(x.as_buffer() for x in rows["docs"]), np.uint16)
        token = np.concatenate([top | _unpack(rows["tokens"]), np.repeat(blob("common", U), blob("tokens", np.uint32))]).view(np.int64)
        often = np.concatenate([place >> 15 == 1, np.ones(len(blob("docs", np.uint16)), bool)])
        doc = np.concatenate([place & 0x7FFF, blob("docs", np.uint16)]).astype(np.int64)
        lone = n - np.bincount(doc, minlength=len(n))
        is_open = (n > 0) & (lone <= slack(n, percent))
        keep = is_open[doc]
        token, often, doc = token[keep], often[keep], doc[keep]
        order = np.lexsort((token, doc))
        token, often = token[order], often[order]
        cuts = np.searchsorted(doc[order], np.arange(len(n) + 1))
        rare, pairs, whole = ([np.zeros(0, np.int64)] * len(n) for _ in range(3))
        all_rare, odd = np.zeros(len(n), bool), lone.copy()
        for k in np.flatnonzero(is_open).tolist():
            s, f = token[cuts[k] : cuts[k + 1]], often[cuts[k] : cuts[k + 1]]
            rare[k], all_rare[k], pairs[k] = signatures(int(n[k]), s, f, percent)
            odd[k] += len(s) - int(f.sum())
            whole[k] = s
        held = [w.tobytes() if len(r) or len(p) else None for r, p, w in zip(rare, pairs, whole)]
        made = [ids, pa.array(n), pa.array(c1), pa.array(c2), pa.array(is_open), pa.array(lone.astype(np.int32)), pa.array(odd.astype(np.int32)), _lists(rare), pa.array(all_rare), _lists(pairs), pa.array(held, pa.binary())]
        give_back()
        return pa.table(made, names=["id", "n", "c1", "c2", "open", "lone", "odd", "rare", "all_rare", "often", "tokens"])

    return run


def describe(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """rows (id, text): a row for each with its set's size and checksums, its lone tokens, whether it may have partners
    (open), its signatures and, if it has any, the tokens that others hold too."""
    kind = rows.schema["id"].dataType
    bits = bucket_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    most = min(CHUNK_MOST, max(CHUNK, 16 << bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sets, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            column, at, done = batch.column(0), 0, 0
            for s in token_sets(batch.column(1), k):
                sets.append(s)
                size, done = size + len(s), done + 1
                if size >= most or len(sets) == CHUNK_DOCS:
                    ids.append(column.slice(at, done - at).take(pa.array(np.arange(done - at))))
                    yield from _chunk(number, bits, pa.concat_arrays(ids), sets)
                    number, ids, sets, size, at = number + 1, [], [], 0, done
            ids.append(column.slice(at).take(pa.array(np.arange(len(column) - at))))  # copies: the batch needn't stay
        if sets:
            yield from _chunk(number, bits, pa.concat_arrays(ids), sets)

    sent = _sent(kind)
    answers = rows.mapInArrow(tidy(run), sent).groupBy("bucket").applyInArrow(_classed(bits), sent)
    return answers.groupBy("chunk").applyInArrow(_assembled(bits, percent), _docs(kind))


# --- verification ----------------------------------------------------------------------------------------------------


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sets: (id, n, tokens that several documents hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            shared = np.zeros(batch.num_rows, np.int64)
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                both = np.sort(np.concatenate([np.frombuffer(z.as_buffer(), np.int64) for z in (x, y)]))
                shared[r] = (both[1:] == both[:-1]).sum()
            yield batch.select([0, 1]).filter(pa.array(100 * shared >= percent * (total - shared), pa.bool_()))

    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("tokens").alias(name), F.col("n").alias(f"n{name}")), side)
    return pairs.select("a", "b", "x", "y", "nx", "ny").mapInArrow(tidy(run), "a long, b long")


def _enough(percent: int):
    """Whether two sets' shared rare prefix tokens leave room for the overlap that they need."""
    need = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent) - 1e-9)
    fits = lambda x, y: ~(((F.col(f"last{x}") <= F.col(f"last{y}")) | F.col(f"all{y}")) & (F.col(f"lone{x}") + F.col(f"r{x}") - F.col("shared") > F.col(f"n{x}") - need))
    return fits("a", "b") & fits("b", "a")


def _pairs_of_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of different components that share enough rare tokens. A list holds under FREQUENT nodes, for its
    token is in so few documents; it is paired in place."""
    entry = F.struct("id", "n", "c", "lone", "r", "last", "all")
    lists = nodes.select(F.explode("rare").alias("sig"), entry.alias("x")).groupBy("sig").agg(F.array_sort(F.collect_list("x")).alias("xs")).where("size(xs) > 1")
    rest = lambda x, k: F.filter(F.slice("xs", k + 2, F.size("xs")), lambda y: (y["c"] != x["c"]) & (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent))
    pairs = F.flatten(F.transform("xs", lambda x, k: F.transform(rest(x, k), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    each = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    flat = each.select("shared", *(F.col(f"{x}.{c}").alias(f"{c}{x}") for x in "ab" for c in ("id", "n", "lone", "r", "last", "all")))
    return flat.where(_enough(percent)).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


TILES = "tile long, ids binary, wholes binary, sizes binary, tokens binary"


def _tile(group: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in group["tokens"]]
    blobs = (group["id"].to_numpy(), group["n"].to_numpy(), np.array([len(s) for s in sets], np.int64), np.concatenate(sets))
    return pa.table({"tile": group["tile"].slice(0, 1)} | {n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("ids", "wholes", "sizes", "tokens"), blobs)})


def _overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of x's sets with y's (sizes, tokens), over slices of their common tokens."""
    common = np.intersect1d(x[1], y[1])
    rows = [np.repeat(np.arange(len(s)), s) for s, _ in (x, y)]
    places = [np.searchsorted(common, t) for _, t in (x, y)]
    out = np.zeros((len(x[0]), len(y[0])), np.float32)
    if not len(common):
        return out
    held = [common[np.minimum(p, len(common) - 1)] == t for p, (_, t) in zip(places, (x, y))]
    width = max(64, MATRIX // max(len(x[0]), len(y[0])))
    for at in range(0, len(common), width):
        parts = []
        for (sizes, _), row, place, ok in zip((x, y), rows, places, held):
            mine = ok & (place >= at) & (place < at + width)
            matrix = np.zeros((len(sizes), min(width, len(common) - at)), np.float32)
            matrix[row[mine], place[mine] - at] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def _families(members: DataFrame, work: Scratch) -> DataFrame:
    """(family, super): small families are one with those that meet in the list that most of them share, so that a list
    of many small families is some full tiles and not a pair of tiles for each two of them."""
    shared = members.select(F.explode("often").alias("sig"), "family").distinct()
    meeting = shared.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1")
    home = shared.join(meeting, "sig").groupBy("family").agg(F.max_by("sig", F.struct("k", "sig")).alias("home"))
    sizes = members.groupBy("family").agg(F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_TOKENS).alias("size"))
    joined = sizes.join(home, "family", "left")
    small = (F.col("size") < 0.5) & F.col("home").isNotNull()
    return work.put("families", joined.select("family", F.when(small, F.xxhash64(F.lit("list"), "home")).otherwise(F.xxhash64(F.lit("hub"), "family")).alias("super"), small.alias("mixed")))


def _by_tiles(nodes: DataFrame, sets: DataFrame, work: Scratch, percent: int) -> DataFrame | None:
    """Edges (a, b) that join what lists of token pairs hold together and components don't."""
    members = nodes.where("size(often) > 0")
    members = members.join(_families(members, work), "family").withColumn("same", ~F.col("mixed") & (F.col("c") == F.col("family")))
    members = work.put("members", members.select("id", "n", "often", "super", "same"))
    sizes = members.groupBy("super", "same").agg(F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_TOKENS)).cast("int").alias("tiles"))
    parts = work.put("parts", sizes)
    tile = lambda k: F.xxhash64("super", "same", k.cast("long"))
    # families that share a list, and each family that isn't one component
    shared = members.select(F.explode("often").alias("sig"), "super").distinct()
    cross = shared.join(shared.withColumnRenamed("super", "other"), "sig").where("super < other").select("super", "other").distinct()
    of = parts.select("super", "same", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t")).select("super", "same", tile(F.col("t")).alias("tile"))
    one, two = of.withColumnsRenamed({"same": "s1", "tile": "t1"}), of.withColumnsRenamed({"super": "other", "same": "s2", "tile": "t2"})
    own = one.join(two, F.col("super") == F.col("other")).where("not (s1 and s2) and t1 <= t2").select("t1", "t2")
    pairs = work.put("tile_pairs", cross.join(one, "super").join(two, "other").select("t1", "t2").unionByName(own))
    if pairs.isEmpty():
        return None
    wanted = pairs.select(F.explode(F.array("t1", "t2")).alias("tile")).distinct()
    dealt = members.join(parts, ["super", "same"]).select("id", tile(F.pmod(F.xxhash64("id"), "tiles")).alias("tile"))
    tiles = work.put("tiles", dealt.join(wanted, "tile", "left_semi").join(sets, "id").select("tile", "id", "n", "tokens").groupBy("tile").applyInArrow(_tile, TILES))
    side = lambda k: tiles.select(*(F.col(c).alias(f"t{k}" if c == "tile" else f"{c}{k}") for c in tiles.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for r in range(batch.num_rows):
                ids1, n1, s1, x, ids2, n2, s2, y = (np.frombuffer(batch.column(k)[r].as_buffer(), np.int64) for k in range(8))
                both = _overlaps((s1, x), (s2, y))
                edges += forest(100 * both >= percent * (n1[:, None] + n2[None, :] - both), ids1, ids2)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    blobs = ("ids", "wholes", "sizes", "tokens")
    rows = pairs.join(side(1), "t1").join(side(2), "t2").select(*(f"{c}{k}" for k in (1, 2) for c in blobs))
    with batches_of(work.spark, 4):
        found = work.put("tile_links", rows.mapInArrow(tidy(run), "a long, b long"))
    work.drop("tiles", "tile_pairs", "members", "parts", "families")
    return found.where("a <> b")


# --- the join --------------------------------------------------------------------------------------------------------


def link(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id for every row of documents; the key may be of any type that has an order."""
    spark = documents.sparkSession
    work = Scratch(spark, "ngram-join")
    with batches_of(spark, ARROW_ROWS):
        docs = work.put("docs", describe(documents.select(F.col(key).alias("id"), F.col(text).alias("text")), k, percent))
        named, several = _components(docs, work, percent)
    if several is None:
        linked, alone = docs.where("open"), docs.where("not open")
        rows = linked.select("id", "n", "c1", "c2").join(named, ["c1", "c2"]).select("id", "n", "component")
        rows = rows.unionByName(alone.select("id", "n", F.col("id").alias("component")))
    else:  # rows that share an id are one node
        once = lambda rows: rows.join(several, "id", "left_anti")
        by_id = docs.select("id", "c1", "c2").join(several, "id", "left_semi").join(named, ["c1", "c2"]).groupBy("id").agg(F.min("component").alias("component"))
        rows = once(docs.where("open")).select("id", "n", "c1", "c2").join(named, ["c1", "c2"]).select("id", "n", "component")
        rows = rows.unionByName(once(docs.where("not open")).select("id", "n", F.col("id").alias("component")))
        rows = rows.unionByName(docs.select("id", "n").join(by_id, "id").select("id", "n", "component"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _components(docs: DataFrame, work: Scratch, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(c1, c2, component) of the sets that may have partners or share an id with another set; and those ids, if any."""
    several = work.put("several", docs.where("id is not null").groupBy("id").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).where("a <> b").select("id"))
    several = None if several.isEmpty() else several
    held = docs.where("open")
    if several is not None:
        held = held.unionByName(docs.where("n > 0 and not open").join(several, "id", "left_semi"))
    what = ("n", "lone", "odd", "rare", "all_rare", "often", "tokens")
    reps = held.groupBy("c1", "c2").agg(F.min("id").alias("first"), F.first(F.struct(*what)).alias("r"))
    reps = work.put("reps", reps.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "first", "r.*"))
    sets = reps.where("tokens is not null").select("id", "n", "tokens")
    nodes = reps.where("tokens is not null").select("id", "n", "lone", "odd", "rare", "all_rare", "often")

    # hubs: each node is checked against the hub that it meets in most of its lists
    listed = nodes.select(F.explode(F.concat("rare", "often")).alias("sig"), "id", "n", "odd")
    hubs = listed.groupBy("sig").agg(F.min_by(F.struct("id", "n"), F.struct("odd", "id")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    met = listed.select("sig", "id", "n").join(hubs.select("sig", "hub"), "sig").groupBy("id", "n", "hub").agg(F.count("*").alias("k"))
    close = (F.col("id") != F.col("hub.id")) & (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent)
    rank = F.struct("k", -F.col("hub.id"))
    homes = work.put("homes", met.groupBy("id").agg(F.max_by("hub.id", rank).alias("family"), F.max_by(F.when(close, F.col("hub.id")), F.when(close, rank)).alias("hub")))
    stars = work.put("stars", verify(homes.where("hub is not null").select(F.col("id").alias("a"), F.col("hub").alias("b")), sets, percent))

    # a component so far: a hub, or who links with it
    joined_to = homes.join(stars, homes["id"] == stars["a"], "left").join(stars.select(F.col("b").alias("h")).distinct(), homes["id"] == F.col("h"), "left")
    labels = joined_to.select("id", "family", F.when(F.col("h").isNotNull(), F.col("id")).otherwise(F.coalesce("b", "id")).alias("c"))
    last = F.coalesce(F.try_element_at("rare", F.lit(-1)), F.lit(-(1 << 63))).alias("last")
    nodes = work.put("nodes", nodes.select("id", "n", "lone", F.size("rare").alias("r"), last, F.col("all_rare").alias("all"), "rare", "often").join(labels, "id"))

    # what lists still join across components, exactly
    singles = work.put("candidates", _pairs_of_lists(nodes, percent))
    rest = work.put("rest", verify(singles, sets, percent))
    blocks = _by_tiles(nodes, sets, work, percent)
    edges = stars.unionByName(rest)
    edges = edges if blocks is None else edges.unionByName(blocks)
    if several is not None:
        own = docs.where("n > 0").select("id", "c1", "c2").join(several, "id", "left_semi").join(reps.select("c1", "c2", F.col("id").alias("a")), ["c1", "c2"]).select("id", "a").distinct()
        edges = edges.unionByName(own.join(own.groupBy("id").agg(F.min("a").alias("b")), "id").where("a <> b").select("a", "b"))

    # components among the hubs that nodes have joined, then named by their smallest id
    home = nodes.select("id", "c")
    at = lambda side: home.select(F.col("id").alias(side), F.col("c").alias(f"c{side}"))
    lifted = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    final = components(lifted, work, "cc")
    placed = reps.select("c1", "c2", "id", "first").join(home, "id", "left").withColumn("node", F.coalesce("c", "id")).join(final, "node", "left")
    placed = placed.select("c1", "c2", "first", F.coalesce("component", "node").alias("g"))
    least = placed.groupBy("g").agg(F.min("first").alias("component"))
    named = work.put("named", placed.join(least, "g").select("c1", "c2", "component"))
    work.drop("reps", "homes", "stars", "nodes", "candidates", "rest", *(["tile_links"] if blocks is not None else []))
    return named, several
