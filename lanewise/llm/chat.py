"""Chat formatting: layouts told by a hash of their nested field paths, and a template with a loss mask.

A layout is the set of nested field paths of a record (``messages[].role``).
Its fingerprint, a hash of the sorted paths, selects a declarative mapping to
canonical turns (role, text): of a typed table once, by its schema; of JSON
lines for each record. The template writes a turn as

    <turn>### role: text</turn>

and a line end. Control strings inside roles and texts are broken by a
backslash after their first character, and backslashes are doubled, so that
taking each backslash away and the next character as it is gives them back,
and no control string of the output comes from a text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import new_path, small_batches

OPEN, HEAD, COLON, CLOSE = "<turn>", "### ", ": ", "</turn>\n"
#: What is never left whole inside a text, and inside a role besides that.
CONTROL, CONTROL_ROLE = r"(<(?=/?turn>)|#(?=##)|\\)", r"(<(?=/?turn>)|#(?=##)|:(?= )|\\)"
LEARNED_ROLES = ("assistant",)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """paths: the layout. each: the path of a list of turns, or None for fields of the record. turns: (role, text) by path; a role with = before it is literal."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str | None = None


def _list(name: str, each: str, role: str, text: str, *more: str) -> Mapping:
    return Mapping(name, (f"{each}[].{role}", f"{each}[].{text}", *more), ((role, text),), each)


def _fields(name: str, *turns: tuple[str, str]) -> Mapping:
    return Mapping(name, tuple(t for _, t in turns), tuple((f"={r}", t) for r, t in turns))


MAPPINGS = (
    Mapping("rows", ("conv_id", "role", "text", "turn"), (("role", "text"),)),
    _list("messages", "messages", "role", "content"), _list("messages-id", "messages", "role", "content", "id"), _list("conversation", "conversation", "role", "content"), _list("shares", "conversations", "from", "value"), _list("shares-id", "conversations", "from", "value", "id"), _list("dialog", "dialog", "speaker", "utterance"), _list("nested", "chat.turns", "role", "text"),
    _fields("instruction", ("user", "instruction"), ("assistant", "output")), _fields("instruction-input", ("user", "instruction"), ("user", "input"), ("assistant", "output")), _fields("instruction-system", ("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), _fields("instruction-response", ("user", "instruction"), ("assistant", "response")),
    _fields("instruction-context", ("user", "context"), ("user", "instruction"), ("assistant", "response")), _fields("prompt-completion", ("user", "prompt"), ("assistant", "completion")), _fields("prompt-response", ("user", "prompt"), ("assistant", "response")), _fields("system-prompt", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fields("question-answer", ("user", "question"), ("assistant", "answer")), _fields("context-question", ("user", "context"), ("user", "question"), ("assistant", "answer")), _fields("query-response", ("user", "query"), ("assistant", "response")), _fields("preference", ("user", "prompt"), ("assistant", "chosen")),
)


def fingerprint(paths: tuple[str, ...] | list[str] | set[str]) -> str:
    """Hash of a set of paths."""
    return xxhash.xxh3_64_hexdigest("\n".join(sorted(set(paths))).encode())


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def select_mapping(paths: tuple[str, ...] | list[str] | set[str]) -> Mapping | None:
    """The mapping of exactly this layout; else the one with most paths among those that the layout holds, the first of equals; else None."""
    have = set(paths)
    if (exact := BY_FINGERPRINT.get(fingerprint(have))) is not None:
        return exact
    return max((m for m in MAPPINGS if have.issuperset(m.paths)), key=lambda m: len(m.paths), default=None)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def value_paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a parsed JSON value; an empty object or list has none."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, at + "[]")}
    return {at}


def canonical_role(role: Column) -> Column:
    """Other names of the roles in one form; names not known, and null, as they are."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))[role], role)


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a typed table, by the mapping that its schema selects; ValueError where none does.

    Records that are turns themselves (layout "rows") keep ids, order, role and
    text as they are. Of other layouts each record is a conversation: its id is
    the record's id, if it has an integer one, or a number of its own; turns
    count from 0; input fields that are null or empty are no turn; a null list
    has none. Columns that the mapping doesn't name are ignored.
    """
    mapping = select_mapping(schema_paths(df.schema))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    if mapping.name == "rows":
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    struct = lambda role, text: F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))
    if mapping.each:
        role, text = mapping.turns[0]
        turns = F.transform(F.col(mapping.each), lambda x: struct(canonical_role(x[role].cast("string")), x[text]))
    else:
        turns = F.filter(F.array(*(struct(F.lit(r[1:]), F.col(t)) for r, t in mapping.turns)), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    own = "id" in df.columns and isinstance(df.schema["id"].dataType, (T.LongType, T.IntegerType))
    numbered = df.select((F.col("id") if own else F.monotonically_increasing_id()).cast("long").alias("conv_id"), turns.alias("t"))
    return numbered.select("conv_id", F.posexplode("t").alias("turn", "x")).select("conv_id", F.col("turn").cast("long").alias("turn"), "x.role", "x.text")


def record_turns(record: object) -> list[tuple[str | None, str]] | None:
    """Canonical turns of a parsed record; None where no mapping is known."""
    mapping = select_mapping(value_paths(record))
    if mapping is None:
        return None
    as_text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    def at(value: object, path: str) -> object:
        for k in path.split("."):
            value = value.get(k) if isinstance(value, dict) else None
        return value

    if mapping.each:
        role, text = mapping.turns[0]
        return [(ROLE_NAMES.get(r := at(x, role), r), as_text(at(x, text))) for x in at(record, mapping.each) or []]
    turns = [(r[1:] if r[0] == "=" else at(record, r), as_text(at(record, t))) for r, t in mapping.turns]
    return [x for x in turns if x[1]] if mapping.name != "rows" else turns


def json_turns(df: DataFrame, column: str = "json") -> DataFrame:
    """All columns of df, fingerprint string and turns array<struct<role, text>>; JSON that is null, broken or of no known layout has null turns."""
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<fingerprint:string,turns:array<struct<role:string,text:string>>>")
    def of(lines: pa.Array) -> pa.Array:
        out = []
        for line in lines.to_pylist():
            try:
                record = json.loads(line) if line is not None else None
            except ValueError:
                record = None
            turns = record_turns(record) if isinstance(record, dict) else None
            out.append({"fingerprint": fingerprint(value_paths(record)) if isinstance(record, dict) else None, "turns": turns and [{"role": r, "text": t} for r, t in turns]})
        return pa.array(out, pa.struct([("fingerprint", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]))

    return df.withColumn("__x", of(F.col(column))).select(*df.columns, "__x.fingerprint", "__x.turns")


def escaped(x: Column, control: str = CONTROL) -> Column:
    return F.when(x.rlike(control), F.regexp_replace(x, control, r"$1\\")).otherwise(x)


def unescaped(x: Column) -> Column:
    """What ``escaped`` was given: after each character that it marks, one backslash goes."""
    return F.when(F.contains(x, F.lit("\\")), F.regexp_replace(x, r"([<#:\\])\\", "$1")).otherwise(x)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end for every row of turns(conv_id, turn, role, text, ...).

    formatted is the turn's stretch of its conversation's text, which is all
    stretches in the order of conv_id, turn, role and text; its length is
    bounded by that of the turn, however long a conversation is. The loss mask
    is code points loss_start to loss_end of the stretch; null where the role
    isn't learned. Null roles and texts are empty ones; ids may be null.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head, body = F.concat(F.lit(OPEN + HEAD), escaped(role, CONTROL_ROLE), F.lit(COLON)), escaped(text)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.isin(*LEARNED_ROLES).alias("learned"), head.alias("h"), body.alias("b"))
    at = F.length("h").cast("long")
    return rows.select("conv_id", "turn", F.concat("h", "b", F.lit(CLOSE)).alias("formatted"), F.when(F.col("learned"), at).alias("loss_start"), F.when(F.col("learned"), at + F.length("b")).alias("loss_end"))


def parsed(out: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss (text under the mask; null for none), size of rows that ``formatted`` made; an error where a row is none."""
    whole = F.startswith("formatted", F.lit(OPEN + HEAD)) & F.endswith("formatted", F.lit(CLOSE)) & F.contains("formatted", F.lit(COLON))
    inner = F.substring("formatted", F.lit(len(OPEN + HEAD) + 1), F.length("formatted") - len(OPEN + HEAD + CLOSE))
    checked = F.when(whole, inner).otherwise(F.raise_error(F.lit("a row is not a formatted turn")).cast("string"))
    out = out.withColumn("__in", checked).withColumn("__role", F.substring_index("__in", COLON, 1))
    text = F.substring("__in", F.length("__role") + len(COLON) + 1, F.length("__in"))
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    return out.select("conv_id", "turn", unescaped(F.col("__role")).alias("role"), unescaped(text).alias("text"), loss.alias("loss"), F.length("formatted").cast("long").alias("size"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal conv_id; a conversation is hashed as it streams by."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    key, state = None, None
    done: list[tuple] = []

    def close() -> None:
        if state is not None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for b in batches:
        for conv, role, text, loss, size in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text", "loss", "size")), strict=True):
            if state is None or conv != key:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += size
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done = []
    close()
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*done, strict=True)) or [[]] * 6, kinds, strict=True)], names)


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for each conv_id of turns(conv_id, turn, role, text).

    The formatted table is written to the shared folder and parsed from there.
    Digests of a conversation are sequential by their definition: its rows are
    sorted (with spilling) and hashed as a stream, never held together. Rows
    with a null conv_id make one conversation; ties of turn go by role, text.
    """
    spark = turns.sparkSession
    small_batches(spark)
    path = new_path(spark, "chat")
    formatted(turns).write.parquet(path)
    rows = parsed(spark.read.parquet(path))
    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss", "size").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
