"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, which a template then marks.

A fingerprint is the SHA-256 of sorted nested field paths. For a table of one layout (`canonical_turns`) it comes from the
table's schema; for JSON records of mixed layouts (`canonical_records`) from each record. It picks a mapping from `MAPPINGS`,
and the mapping says with column expressions which turns a record holds. Fields that no layout names are left out before.
`format_turns` writes each turn as `<|role|>text<|end|>`, in order; the loss mask covers the texts of assistant turns.
Control strings inside texts, those of other common templates too, are broken by ESC and a dot after their first
character, and ESC itself is doubled, so `parse` restores every text exactly.

Defined cases: a null text is empty; a null role is ''; turns sort by turn (null first), then role, then text, so ties and
repeated rows keep one defined order and all stay; a null id is a conversation of its own; a conversation with no assistant turn
has an empty loss text; an empty table gives no rows; extra columns are ignored. A table whose layout no mapping fits raises
KeyError; a JSON record that none fits, or that is no JSON object, gives one row with its fingerprint (null for no object) and null
turn, role and text. One conversation is streamed turn by turn in one task, never held whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soldlens.llm._shared import arrow_column, bounded_batches, map_arrow

#: The template's marks. ESC cannot be part of a mark.
OPEN, CLOSE = "<|", "|>"
END = "<|end|>"
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", OPEN, CLOSE)
ESC = "\x1b"
#: The first character of each control string, where one follows.
_CONTROL = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: str) -> str:
    """No control string occurs in the result; `unescape` inverts it."""
    return re.sub(f"({_CONTROL})", rf"\1{ESC}.", text.replace(ESC, ESC * 2))


def escaped(text: Column) -> Column:
    """`escape` as a column expression."""
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC * 2)), f"({_CONTROL})", f"$1{ESC}.")


def unescape(text: str) -> str:
    return re.sub(f"{ESC}(?:{ESC}|\\.)", lambda m: ESC if m[0][1] == ESC else "", text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}"


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Code point ranges under the loss mask: the escaped text of each assistant turn."""
    return [m.span(2) for m in _TURN.finditer(formatted) if unescape(m[1]) == "assistant"]


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; arrays and maps show in the path as [] and {}."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, prefix + "{}")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: Column, text: Column, at: Column) -> Column:
    return F.struct(at.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))


def _said(**fields: str) -> Column:
    """Turns from fields in order, leaving out null ones: _said(user='prompt', assistant='completion')."""
    turns = [F.when(F.col(c).isNotNull(), _turn(F.lit(r), F.col(c), F.lit(i))) for i, (r, c) in enumerate(fields.items())]
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def _listed(column: str, role: str, text: str, roles: dict[str, str] | None = None) -> Column:
    def one(x: Column, i: Column) -> Column:
        r = x[role]
        for old, new in (roles or {}).items():
            r = F.when(x[role] == old, new).otherwise(r)
        return _turn(r, x[text], i)

    return F.transform(F.col(column), one)


_instruction = lambda: F.array(
    _turn(F.lit("user"), F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(F.concat_ws("\n", "instruction", "input")), F.lit(0)),
    _turn(F.lit("assistant"), F.col("output"), F.lit(1)),
)

#: Field paths of each layout beside its id column, and its turns as an expression.
LAYOUTS = {
    "prompt": (["prompt", "completion"], lambda: _said(user="prompt", assistant="completion")),
    "prompt_response": (["prompt", "response"], lambda: _said(user="prompt", assistant="response")),
    "system_prompt": (["system", "prompt", "response"], lambda: _said(system="system", user="prompt", assistant="response")),
    "question": (["question", "answer"], lambda: _said(user="question", assistant="answer")),
    "instruction": (["instruction", "input", "output"], _instruction),
    "messages": (["messages[].role", "messages[].content"], lambda: _listed("messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"], lambda: _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "turn": (["turn", "role", "text"], lambda: F.array(_turn(F.col("role"), F.col("text"), F.col("turn")))),
}
MAPPINGS = {fingerprint(paths): turns for paths, turns in LAYOUTS.values()}


TOP_FIELDS = sorted({re.split(r"[.\[{]", p)[0] for paths, _ in LAYOUTS.values() for p in paths})
#: Types of the fields that JSON records may have.
_JSON = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>", "turn": "long"}
JSON_SCHEMA = ", ".join(f"`{f}` {_JSON.get(f, 'string')}" for f in TOP_FIELDS)
_CANONICAL = "array<struct<turn:bigint,role:string,text:string>>"


def canonical_turns(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, turn, role, text), one row per turn, by the mapping that the records' fingerprint selects; KeyError if none does."""
    own = [f for f in records.schema if f.name != id_column and f.name in TOP_FIELDS]
    key = fingerprint(field_paths(T.StructType(own)))
    if key not in MAPPINGS:
        raise KeyError(f"no mapping for the layout {sorted(field_paths(records.schema))}")
    return _exploded(records.select(F.col(id_column), MAPPINGS[key]().alias("__turns")), id_column)


def _exploded(rows: DataFrame, id_column: str, *more: str) -> DataFrame:
    rows = rows.select(id_column, *more, F.explode("__turns").alias("__t"))
    return rows.select(id_column, *more, "__t.turn", F.coalesce("__t.role", F.lit("")).alias("role"), F.coalesce("__t.text", F.lit("")).alias("text"))


def json_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value, as `field_paths` has them."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in json_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in json_paths(v, prefix + "[]")}
    return {prefix}


def record_fingerprint(record: str | None) -> str | None:
    """The fingerprint of a JSON object's fields that layouts name; null for anything else. Nested fields that none names do not count."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    named = {p for paths, _ in LAYOUTS.values() for p in paths}
    return fingerprint([p for p in json_paths({k: v for k, v in value.items() if k in TOP_FIELDS}) if p in named or "[]" not in p])


def canonical_records(records: DataFrame, record: str = "record", id_column: str = "conv_id") -> DataFrame:
    """(id, fingerprint, turn, role, text) of JSON records, each by the mapping that its own fingerprint selects."""
    bounded_batches(records.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.array([record_fingerprint(x) for x in batch.to_pylist()], pa.string())

    rows = records.select(F.col(id_column).alias("__id"), arrow_column(run, "string", F.col(record)).alias("__key"), F.from_json(record, JSON_SCHEMA).alias("__r"))
    rows = rows.select("__id", "__key", "__r.*")
    turns = F.lit(None).cast(_CANONICAL)
    for key, of in MAPPINGS.items():
        turns = F.when(F.col("__key") == key, of().cast(_CANONICAL)).otherwise(turns)
    rows = rows.select(F.col("__id").alias(id_column), F.col("__key").alias("fingerprint"), turns.alias("__turns"))
    known = _exploded(rows.where("__turns IS NOT NULL"), id_column, "fingerprint")
    none = rows.where("__turns IS NULL").select(id_column, "fingerprint", F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    return known.unionByName(none)


def format_turns(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, seq, formatted): the formatted conversation as one piece per turn; concatenated by seq it is the output text.

    All pieces of a conversation come in one partition, in order.
    """
    order = Window.partitionBy(id_column).orderBy("turn", "role", "text")
    piece = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit(""))), F.lit(CLOSE), escaped(F.coalesce("text", F.lit(""))), F.lit(END))
    return turns.select(id_column, (F.row_number().over(order) - 1).cast("long").alias("seq"), piece.alias("formatted"))


def conversation_digests(formatted: DataFrame, id_column: str = "conv_id", arranged: bool = False) -> DataFrame:
    """Read back from the formatted pieces: turns, loss text and lengths per conversation; `arranged` pieces are as `format_turns` gives them."""
    kind = formatted.schema[id_column].dataType.simpleString()
    rows = formatted.select(id_column, "seq", "formatted")
    if not arranged:
        rows = rows.repartition(id_column).sortWithinPartitions(id_column, "seq")
    names = [id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, state, id_type = object(), None, None

        def made(found):
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(types)], names)

        def row():
            return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out, id_type = [], batch.schema.field(0).type
            for x, seq, piece in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if state is None or seq == 0 or x != key:
                    if state is not None:
                        out.append(row())
                    key, state = x, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(piece):
                    role, text = unescape(m[1]), unescape(m[2])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(piece)
            yield made(out)
        if state is not None:
            yield made([row()])

    return map_arrow(rows, run, f"`{id_column}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
