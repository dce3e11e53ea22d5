"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

A call is a ``<tool_call>{"id", "name", "arguments"}</tool_call>`` block in an
assistant's text; a result is a turn of role tool with {"tool_call_id", "content"}.
Calls and results are hash-joined by conversation and identifier. The turns are
ordered topologically: a result comes after its call, and a call that names
another call's linked result as "$id" in an argument comes after that result.
A turn has a place (its number) and a depth (0); one that comes too early takes
the place of the last turn it waits for and a depth one higher. Sorting a
conversation by place, depth, turn, role and text gives the order. Arguments are
checked against the tools' schemas. JSON is canonical: keys sorted by UTF-16
units, no blanks, whole numbers without a fraction; so equal chats are equal bytes.

The result has a row for each turn, so no conversation is gathered. Only the
links of a conversation in which one is out of order meet in a task, as five
numbers each, without texts.

Cases: null texts and roles are empty; turns without a number come last; rows
without a conv_id form one conversation, of the null id; repeated turns stay. A
call block that isn't strict JSON (trailing text, single quotes, NaN, infinite or
too long numbers, lone surrogates, nesting too deep to read) or has no object
with a name stays text; so does a result of that kind, which is an orphan. An id is
a string of at least a character or a whole number; calls without one are never
linked. Of several calls or results of one id the first ones are linked with each
other; other calls stay unlinked and other results are orphans. Turns in a cycle,
or that wait for one, keep their place and are marked; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrow import runs

from .shared import NULL_ID, Scratch, slices

BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}
CALLS = pa.list_(pa.struct([("id", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("invalid", pa.bool_())]))
PARSED = "conv long, turn long, role string, sig long, content string, calls array<struct<id: string, head: string, tail: string, invalid: boolean>>, refs array<string>, answers string, answer string, said string, asked string"


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("a number too large")
    return value


def _refused(text: str) -> None:
    raise ValueError(f"{text} isn't JSON")


def strict(text: str) -> object:
    """A JSON value that can be written again; anything else is a ValueError."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_refused)
        canonical(value).encode()
    except RecursionError as error:
        raise ValueError("nested too deeply") from error
    return value


def _number(value: float) -> str:
    if value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return re.sub(r"e([+-])0+", r"e\1", repr(value))


def canonical(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("number", "integer"):
        return False
    return isinstance(value, KINDS[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value by a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {'/'.join(kinds)}"]
    found = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: too small"] * (value < schema.get("minimum", value)) + [f"{at}: too large"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                found += errors(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in errors(v, schema["items"], f"{at}[{i}]")]
    return found


def identifier(value: object) -> str | None:
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return value if isinstance(value, str) and value else None


def references(value: object) -> set[str]:
    """Identifiers that strings in a value name as $id."""
    if isinstance(value, str):
        return {value[1:]} if value.startswith("$") and len(value) > 1 else set()
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(references, parts))


def parsed_call(text: str, schemas: dict[str, dict]) -> tuple[dict, set[str]] | None:
    """A call as the text before and after its link's truth value, and what its arguments refer to."""
    try:
        call = strict(text)
    except ValueError:
        return None
    if not isinstance(call, dict) or not isinstance(call.get("name"), str):
        return None
    number, arguments, name = identifier(call.get("id")), call.get("arguments", {}), call["name"]
    wrong = errors(arguments, schemas[name]) if name in schemas else []
    head = canonical({"arguments": arguments} | ({"errors": wrong} if wrong else {}) | {"id": number})[:-1] + ',"linked":'
    return {"id": number, "head": head, "tail": f',"name":{canonical(name)}}}', "invalid": bool(wrong)}, references(arguments)


def parsed_turn(role: str, text: str, schemas: dict[str, dict]) -> tuple[str, list[dict], list[str], str | None, str | None]:
    """Content, calls, references, the id that a result answers and its content."""
    if role == "assistant" and "<tool_call>" in text:
        bodies = BLOCK.findall(text)
        calls = [c for c in (parsed_call(body, schemas) for body in bodies) if c]
        if calls and len(calls) == len(bodies):
            text = BLOCK.sub("", text).strip()
        return canonical(text), [c for c, _ in calls], sorted(set().union(*(r for _, r in calls))), None, None
    if role == "tool":
        try:
            value = strict(text)
        except ValueError:
            value = None
        if isinstance(value, dict) and (number := identifier(value.get("tool_call_id"))) is not None:
            return canonical(text), [], [], number, canonical(value.get("content"))
    return canonical(text), [], [], None, None


def _parsed(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(items):
            found = [parsed_turn(role, text, schemas) for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
            kinds = [pa.string(), CALLS, pa.list_(pa.string()), pa.string(), pa.string()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            said, asked = pa.array([canonical(x) for x in part.column("role").to_pylist()]), pa.array([None if x[3] is None else canonical(x[3]) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv", "turn", "role", "sig")), *columns, said, asked], names=["conv", "turn", "role", "sig", "content", "calls", "refs", "answers", "answer", "said", "asked"])

    return turns.mapInArrow(run, PARSED)


def placed(a: list[int], ta: list[int], b: list[int], tb: list[int]) -> list[tuple[int, int, int, bool]]:
    """Turn, place, depth and whether it waits for a cycle, of the turns in a conversation's links (a before b)."""
    place = {x: (t, 0) for x, t in [*zip(a, ta, strict=True), *zip(b, tb, strict=True)]}
    own, after, waits = dict(place), defaultdict(list), defaultdict(int)
    for x, y in set(zip(a, b, strict=True)):
        after[x].append(y)
        waits[y] += 1
    ready, done = deque(x for x in place if not waits[x]), set()
    while ready:
        x = ready.popleft()
        done.add(x)
        for y in after[x]:
            place[y] = max(place[y], (place[x][0], place[x][1] + 1))
            waits[y] -= 1
            if not waits[y]:
                ready.append(y)
    return [(x, *(place if x in done else own)[x], x not in done) for x in place]


def _placed(links: DataFrame) -> DataFrame:
    """``placed`` for each conversation of the links (conv, a, ta, b, tb)."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = placed(*(pa.chunked_array([part.column(c) for part in held]).to_pylist() for c in ("a", "ta", "b", "tb")))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["uid", "place", "depth", "cyclic"])

        for (own,), part in runs(items, ["conv"]):
            if own != key:
                yield from flush()
                key, held = own, []
            held.append(part)
        yield from flush()

    return links.repartition("conv").sortWithinPartitions("conv").mapInArrow(run, "uid long, place long, depth long, cyclic boolean")


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """A row for each turn: its place and depth in the order, counts of its calls, and its message as canonical JSON."""
    schemas = schemas or {}
    scratch = Scratch(conversations.sparkSession)
    none = F.lit(NULL_ID)
    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long"), none).alias("conv"), F.coalesce(F.col("turn").cast("long"), none).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = _parsed(turns.withColumn("sig", F.xxhash64("text")), schemas)
    turns = scratch.keep(turns.withColumn("uid", F.monotonically_increasing_id()), "turns")

    order = [F.col(c) for c in ("turn", "role", "sig", "uid")]
    calls = turns.select("conv", *order, F.posexplode("calls").alias("at", "call")).where("call.id is not null")
    calls = calls.groupBy("conv", F.col("call.id").alias("id")).agg(F.min(F.struct(*order, "at")).alias("c"))
    results = turns.where("answers is not null").groupBy("conv", F.col("answers").alias("id")).agg(F.min(F.struct(*order)).alias("r"))
    linked = scratch.keep(calls.join(results, ["conv", "id"]).select("conv", "id", F.col("c.uid").alias("a"), F.col("c.turn").alias("ta"), "c.at", F.col("r.uid").alias("b"), F.col("r.turn").alias("tb")), "linked")

    refs = turns.select("conv", F.col("uid").alias("b"), F.col("turn").alias("tb"), F.explode("refs").alias("id"))
    waits = refs.join(linked.select("conv", "id", F.col("b").alias("a"), F.col("tb").alias("ta")), ["conv", "id"]).where("a <> b")
    links = linked.select("conv", "a", "ta", "b", "tb").union(waits.select("conv", "a", "ta", "b", "tb"))
    late = links.where("ta >= tb").select("conv").distinct()
    moved = _placed(links.join(late, "conv", "left_semi"))

    ends = linked.select(F.col("a").alias("uid"), "at").union(linked.select("b", F.lit(-1)))
    ends = ends.groupBy("uid").agg(F.collect_set("at").alias("ends"))
    out = turns.join(ends, "uid", "left").join(moved, "uid", "left")
    is_linked = lambda at: F.coalesce(F.array_contains("ends", at), F.lit(False))
    answers = is_linked(F.lit(-1))
    called = F.transform("calls", lambda c, i: F.concat(c["head"], is_linked(i).cast("string"), c["tail"]))
    message = F.concat(
        F.lit('{"content":'), F.when(answers, F.col("answer")).otherwise(F.col("content")),
        F.lit(',"role":'), F.col("said"),
        F.when(answers, F.concat(F.lit(',"tool_call_id":'), F.col("asked"))).otherwise(""),
        F.when(F.size("calls") > 0, F.concat(F.lit(',"tool_calls":['), F.array_join(called, ","), F.lit("]"))).otherwise(""), F.lit("}"),
    )
    real = lambda x: F.when(F.col(x) != NULL_ID, F.col(x)).alias(x)
    place = F.coalesce("place", "turn")
    return out.select(
        F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"), real("turn"), F.when(place != NULL_ID, place).alias("place"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "role",
        F.size("calls").alias("n_calls"), F.when(answers, 0).otherwise(F.size(F.coalesce("ends", F.array().cast("array<int>")))).alias("n_linked"), F.size(F.filter("calls", lambda c: c["invalid"])).alias("n_invalid"),
        ((F.col("role") == "tool") & ~answers).alias("orphan"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), message.alias("message"),
    )


def with_tool_turns(conversations: DataFrame) -> DataFrame:
    """Conversations with a call for each user's turn and a result for each assistant's.

    A derived workload: whole texts are the arguments and contents. Some calls refer
    to the result of the call before, some arguments break their schemas, every
    third turn's result stands before its call, and every fifth text (by length) is
    an answer to an id that no call has."""
    turn = F.col("turn").cast("long")
    own = conversations.select("conv_id", (turn * 10).alias("turn"), "role", "text")
    text, size = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    before = F.when(turn >= 2, F.concat(F.lit("$q"), (turn - 2).cast("string")))
    search = F.to_json(F.struct(F.concat(F.lit("q"), turn.cast("string")).alias("id"), F.lit("search").alias("name"), F.struct(text.alias("query"), (size % 4).alias("limit"), before.alias("context")).alias("arguments")))
    calculate = F.to_json(F.struct(F.concat(F.lit("q"), turn.cast("string")).alias("id"), F.lit("calculate").alias("name"), F.struct(text.alias("expression"), F.when(size % 3 == 0, size).alias("precision")).alias("arguments")))
    calls = conversations.where("role = 'user' and turn is not null").select("conv_id", (turn * 10 + 1).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("<tool_call>"), F.when(turn % 4 < 2, search).otherwise(calculate), F.lit("</tool_call>")).alias("text"))
    answer = F.to_json(F.struct(F.concat(F.when(size % 5 == 0, F.lit("lost")).otherwise(F.lit("q")), (turn - 1).cast("string")).alias("tool_call_id"), text.alias("content")))
    results = conversations.where("role = 'assistant' and turn is not null").select("conv_id", F.when(turn % 3 == 0, turn * 10 - 15).otherwise(turn * 10 + 1).alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return own.union(calls).union(results)
