"""Chat formatting: tool calls and their results, linked, ordered, validated and serialised. DataFrame functions only.

Calls and results meet in a hash join by (conversation, call id). A call may name calls that it depends on; a call's
level is one more than its highest dependency's, so that ordering by (level, turn) is topological. Chains of calls with one
dependency each are followed by doubling steps, in as many rounds as their length has binary digits; calls with several
dependencies then take a round for each that follows another. Arguments are parsed as variants and checked against the
tool's schema. Positions in a conversation are counted in blocks of turns, side by side, so one conversation may hold any
share of the rows.

Canonical JSON has its keys in order, no white space, and arguments re-serialised from the parsed value.

Defined cases: a null id links with nothing (ids made from a null turn or conversation are null); of several results for a
call the first (by turn, then content) counts and the others are ``extra``; results without a call are ``orphan``, calls
without one ``open``; arguments that are null or aren't JSON are ``malformed``; dependencies on unknown calls are ignored;
calls in a cycle, or that depend on one, come last by turn; ties in turn are ordered by id and content; of calls that repeat
an id each is linked; repeated rows stay; texts of any length are whole; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

#: Turns in one block of a conversation.
BLOCK = 256


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # string, integer, number, boolean, array or object
    required: bool = True


#: What schema_of_variant says of each kind.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": r"(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def problems(arguments: Column, name: Column, schemas: dict[str, tuple[Field, ...]]) -> Column:
    """What is wrong with a call's arguments, as an array of strings in schema order; the tools are few."""
    value = F.try_parse_json(arguments)
    known = F.lit(None).cast("array<string>")
    for tool, fields in sorted(schemas.items()):
        found = []
        for f in fields:
            own = F.try_variant_get(value, f"$.{f.name}", "variant")
            missing = own.isNull() | F.is_variant_null(own)
            wrong = ~F.schema_of_variant(own).rlike(f"^{_KINDS[f.kind]}$")
            found.append(F.when(missing, F.lit(f"missing {f.name}") if f.required else F.lit(None)).when(wrong, F.lit(f"{f.name} is no {f.kind}")))
        known = F.when(name == tool, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).otherwise(known)
    known = F.coalesce(known, F.array(F.lit("unknown tool")))
    return F.when(value.isNull(), F.array(F.lit("malformed"))).when(~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(known)


_CALL = ["conv_id", "call_id"]


def _followed(single: DataFrame, work: Scratch) -> DataFrame:
    """(call, at, hops) for calls of one dependency each: where their chain of such calls ends, and after how many steps.
    Chains that run into a cycle end nowhere and are left out."""
    most = single.count()
    steps, turn = single, 0
    while 1 << turn <= most:
        ahead = steps.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        turn += 1
        moved = steps.select(*_CALL, "at", "hops").join(ahead, ["conv_id", "at"], "left")
        steps = work.put(f"steps{turn}", moved.select(*_CALL, F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")))
        if turn > 1:
            work.drop(f"steps{turn - 1}")
        if steps.where("moved").isEmpty():
            break
    return steps.select(*_CALL, "at", "hops").join(single.select("conv_id", F.col("call_id").alias("at")), ["conv_id", "at"], "left_anti").select(*_CALL, "at", "hops")


def levels(calls: DataFrame, work: Scratch) -> DataFrame:
    """(conv_id, call_id, level); calls in a cycle, or after one, get no row."""
    named = calls.where("conv_id is not null and call_id is not null")
    ids = named.select(*_CALL).distinct()
    edges = named.select(*_CALL, F.explode("after").alias("dep")).distinct()
    edges = work.put("edges", edges.join(ids.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi").where("dep <> call_id"))
    if edges.isEmpty():  # the usual case: no dependencies
        return ids.withColumn("level", F.lit(0))
    counted = work.put("counted", edges.groupBy(*_CALL).agg(F.count("*").alias("k"), F.min("dep").alias("dep")))
    roots = ids.join(counted, _CALL, "left_anti").withColumn("level", F.lit(0).cast("long"))
    single = work.put("single", counted.where("k = 1").select(*_CALL, F.col("dep").alias("at"), F.lit(1).cast("long").alias("hops")))
    ends = work.put("ends", _followed(single, work))

    # calls of several dependencies wait for where the chains of those begin: a root, or another such call
    through = ends.select("conv_id", F.col("call_id").alias("dep"), "at", "hops")
    loops = single.join(ends, _CALL, "left_anti").select("conv_id", F.col("call_id").alias("dep"))
    waits = edges.join(counted.where("k > 1"), _CALL, "left_semi")
    stuck = waits.join(loops, ["conv_id", "dep"], "left_semi").select(*_CALL).distinct()
    waits = waits.join(through, ["conv_id", "dep"], "left").select(*_CALL, F.coalesce("at", "dep").alias("at"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))
    waits = waits.groupBy(*_CALL, "at").agg(F.max("hops").alias("hops")).join(stuck, _CALL, "left_anti")
    waits = work.put("waits0", waits.join(roots.withColumnRenamed("call_id", "at"), ["conv_id", "at"], "left").select(*_CALL, "at", "hops", "level"))
    placed: list[str] = []
    for turn in count(1):  # ends on cycles too: none of their calls gets ready
        ready = waits.groupBy(*_CALL).agg(F.max(F.col("level") + F.col("hops")).alias("level"), (F.count("level") == F.count("*")).alias("all")).where("all").drop("all")
        ready = work.put(f"ready{turn}", ready)
        if ready.isEmpty():
            break
        placed.append(work.paths[f"ready{turn}"])
        new = ready.select("conv_id", F.col("call_id").alias("at"), F.col("level").alias("new"))
        left = waits.join(ready, _CALL, "left_anti").join(new, ["conv_id", "at"], "left")
        waits = work.put(f"waits{turn}", left.select(*_CALL, "at", "hops", F.coalesce("level", "new").alias("level")))
        work.drop(f"waits{turn - 1}")
    known = roots.unionByName(calls.sparkSession.read.schema(ready.schema).parquet(*placed)) if placed else roots
    chained = ends.join(known.withColumnRenamed("call_id", "at"), ["conv_id", "at"]).select(*_CALL, (F.col("level") + F.col("hops")).alias("level"))
    return known.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """position: gapless in each conversation by (level, turn, order), counted in blocks of turns."""
    rows = rows.withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)))
    sizes = rows.groupBy("conv_id", "level", "_block").agg(F.count("*").alias("_n"))
    before = sizes.selectExpr("conv_id as _conv", "level as _level", "_block as _b", "sum(_n) over (partition by conv_id order by level, _block) - _n as _from")
    inside = rows.selectExpr("*", f"row_number() over (partition by conv_id, level, _block order by turn, {', '.join(order)}) - 1 as _at")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("level") == F.col("_level")) & (F.col("_block") == F.col("_b"))
    return inside.join(before, same).withColumn("position", (F.col("_from") + F.col("_at")).cast("long")).drop("_block", "_conv", "_level", "_b", "_from", "_at")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, tuple[Field, ...]], others: DataFrame | None = None) -> DataFrame:
    """conv_id, position, turn, call_id, level, state, problems, json for every call and every result without its own.

    calls: conv_id, call_id, turn, name, arguments (JSON), after (ids of calls); results: conv_id, call_id, turn, content;
    others: conv_id, turn, name, content: turns that neither call nor answer, ``other``, by turn before all calls.
    """
    work = Scratch(calls.sparkSession, "chat-format")
    placed = levels(calls, work)
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after", F.xxhash64("name", "arguments").alias("tie"))
    calls = calls.join(placed, _CALL, "left").withColumn("level", F.coalesce("level", F.lit(2147483646)))
    results = results.select("conv_id", "call_id", F.col("turn").alias("r_turn"), "content")
    first = results.where("call_id is not null").groupBy(*_CALL).agg(F.min(F.struct("r_turn", "content")).alias("r"))
    linked = calls.join(first, _CALL, "left")
    own = linked.select(
        "conv_id", "turn", "call_id", "level", "name", "arguments", "tie",
        F.when(F.col("r").isNull(), "open").otherwise("linked").alias("state"),
        problems(F.col("arguments"), F.col("name"), schemas).alias("problems"),
        F.col("r.r_turn").alias("result_turn"), F.col("r.content").alias("content"),
    )
    # results that stand alone: of no call, or not the first of theirs
    known = calls.where("call_id is not null").select(*_CALL, F.lit(True).alias("called")).distinct()
    marked = results.join(first, _CALL, "left").join(known, _CALL, "left")
    rest = marked.where("called is null or struct(r_turn, content) <> r").select(
        "conv_id", F.col("r_turn").alias("turn"), "call_id", F.lit(2147483647).alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.xxhash64("content").alias("tie"),
        F.when(F.col("called").isNull(), "orphan").otherwise("extra").alias("state"), F.array().cast("array<string>").alias("problems"), F.col("r_turn").alias("result_turn"), "content",
    )
    rows = own.unionByName(rest)
    if others is not None:
        rows = rows.unionByName(others.select(
            "conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(-1).alias("level"), "name", F.lit(None).cast("string").alias("arguments"), F.xxhash64("name", "content").alias("tie"),
            F.lit("other").alias("state"), F.array().cast("array<string>").alias("problems"), F.lit(None).cast("long").alias("result_turn"), "content",
        ))
    rows = _positions(rows, ["call_id", "tie"])
    body = F.to_json(F.try_parse_json("arguments"))
    # keys in order; arguments stand as JSON, not as a string
    outer = F.to_json(F.struct(F.col("call_id").alias("call_id"), F.col("content").alias("content"), F.col("name").alias("name"), F.col("problems").alias("problems"), F.col("state").alias("state"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    json = F.concat(F.lit('{"arguments":'), F.coalesce(body, F.lit("null")), F.lit(","), F.substr(outer, F.lit(2)))
    return rows.select("conv_id", "position", "turn", "call_id", "level", "state", F.array_join("problems", "; ").alias("problems"), "result_turn", json.alias("json"))


#: The tools that from_conversations knows; it also calls one that isn't there.
TOOLS = {"search": (Field("limit", "integer"), Field("query", "string")), "count": (Field("chars", "integer"),)}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other turns of a table of messages (conv_id, turn, role, text), by a rule that stands for a
    corpus of tool calls. A user message of n characters is a call ``conv_id:turn``; by n mod 5 it calls ``search`` with
    a limit (n mod 7) and its text as query (0), ``search`` without the limit (1), ``count`` with n as a string (2), the
    unknown ``translate`` with its text (3), or ``search`` with arguments that break off (4, and without a text). Unless n is
    a multiple of 4 it depends on the user message two turns earlier, and if n is a multiple of 3 on the one four turns
    earlier, where they are. What the assistant says is the result of the call in the turn before. Other roles, and none,
    are other turns, named by their role."""
    call = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    n, turn = F.char_length("text"), F.col("turn")
    kind = F.coalesce(n, F.lit(4)) % 5
    whole = F.to_json(F.struct((n % 7).alias("limit"), F.col("text").alias("query")))
    arguments = (
        F.when(kind == 0, whole).when(kind == 1, F.to_json(F.struct(F.col("text").alias("query")))).when(kind == 2, F.to_json(F.struct(n.cast("string").alias("chars"))))
        .when(kind == 3, F.to_json(F.struct("text"))).otherwise(F.substr(whole, F.lit(1), F.length(whole) - 1))
    )
    name = F.when(kind == 2, "count").when(kind == 3, "translate").otherwise("search")
    size = F.coalesce(n, F.lit(0))
    after = F.array_compact(F.array(F.when(size % 4 != 0, call(turn - 2)), F.when(size % 3 == 0, call(turn - 4))))
    calls = turns.where("role = 'user'").select("conv_id", call(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    said = turns.where("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    others = turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("content"))
    return calls, said, others
