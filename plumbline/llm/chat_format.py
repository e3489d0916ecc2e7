"""Conversations of any known layout as one text with marked turns and a loss mask.

A table's layout is recognised by a fingerprint: the SHA-256 of its sorted
nested field paths (``messages[].role`` and so on).  The fingerprint selects a
declarative mapping, which says where role and text of each turn come from, and
the mapping becomes column expressions.  The template writes
``<|role|>`` line, text, ``<|end|>`` line per turn; control strings inside
texts and roles are broken up by a backslash, and backslashes are doubled, so
every text can be read back exactly.

Defined results: null texts and roles are empty; an empty conversation formats
to the empty text; turns are ordered by turn, then role, then text, so repeated
rows are kept and ties have one result; columns that no mapping names are
ignored; an unknown layout raises ValueError with its paths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that chat templates give a meaning to
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN_OPEN, TURN_NAMED, TURN_END = "<|", "|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"
_BREAK = r"(<|\[|\|)(?=\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|>)"


def field_paths(dtype: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; an array adds ``[]``."""
    if isinstance(dtype, T.ArrayType):
        return field_paths(dtype.elementType, prefix + "[]")
    if isinstance(dtype, T.StructType):
        dot = prefix + "." if prefix else ""
        return sorted(p for f in dtype for p in field_paths(f.dataType, dot + f.name))
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Where turns come from: fixed (role, column) pairs, an array with role and text fields, or one row per turn."""

    paths: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    key: str = "conv_id"
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = [
    Mapping(("conv_id", "turn", "role", "text"), role="role", text="text", order="turn"),
    Mapping(("conv_id", "prompt", "response"), pairs=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("conv_id", "instruction", "input", "output"), pairs=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("conv_id", "messages[].role", "messages[].content"), array="messages", role="role", text="content"),
    Mapping(("conv_id", "conversations[].from", "conversations[].value"), array="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"))),
]
BY_FINGERPRINT = {fingerprint(list(m.paths)): m for m in MAPPINGS}


def mapping_of(df: DataFrame) -> Mapping:
    """The mapping whose fingerprint the table has: by all its fields, or by those of one known layout (extra columns)."""
    paths = field_paths(df.schema)
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    if exact:
        return exact
    within = [m for m in MAPPINGS if set(m.paths) <= set(paths)]
    if len(within) != 1:
        raise ValueError(f"{len(within)} known layouts fit the fields {paths}")
    return within[0]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turns: array of role and text) for a table of any known layout."""
    m = mapping_of(df)
    if m.pairs:
        turns = F.array(*[_turn(F.lit(role), F.col(c)) for role, c in m.pairs])
        if ("user", "input") in m.pairs:  # an instruction without input is one user turn
            turns = F.filter(turns, lambda t: (t["text"] != "") | (t["role"] != "user"))
        return df.select(F.col(m.key).alias("conv_id"), turns.alias("turns"))
    if m.array:
        def named(role: Column) -> Column:
            for old, new in m.roles:
                role = F.when(role == old, new).otherwise(role)
            return role

        turns = F.transform(F.coalesce(F.col(m.array), F.array().cast(df.schema[m.array].dataType)),
                            lambda t: _turn(named(t[m.role]), t[m.text]))
        return df.select(F.col(m.key).alias("conv_id"), turns.alias("turns"))
    each = F.struct(F.col(m.order).alias("at"), _turn(F.col(m.role), F.col(m.text)).alias("t"))
    return (df.groupBy(F.col(m.key).alias("conv_id")).agg(F.array_sort(F.collect_list(each)).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: t["t"]).alias("turns")))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _BREAK, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss): ``loss`` lists start and length, in code points, of the assistant texts."""
    written = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN_OPEN), escape(t["role"]), F.lit(TURN_NAMED)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == LOSS_ROLE).alias("loss")))
    one = turns.select("conv_id", written.alias("w"))
    # running lengths: one pass over the turns of a conversation
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def walk(seen: Column, t: Column) -> Column:
        body = seen["at"] + F.length(t["head"])
        size = F.length(t["body"]).cast("bigint")
        span = F.array(F.struct(body.alias("start"), size.alias("length")))
        return F.struct((body + size + len(TURN_END)).alias("at"),
                        F.when(t["loss"], F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    pieces = F.transform("w", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END)))
    return one.select("conv_id", F.array_join(pieces, "").alias("formatted"), F.aggregate("w", start, walk)["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.split(formatted, r"\Q" + TURN_END + r"\E")
    marked = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def parse(piece: Column) -> Column:
        cut = F.locate(TURN_NAMED, piece)
        return F.struct(unescape(F.substring(piece, F.lit(len(TURN_OPEN) + 1), cut - len(TURN_OPEN) - 1)).alias("role"),
                        unescape(F.substring(piece, cut + len(TURN_NAMED), F.length(piece))).alias("text"))

    return F.transform(marked, parse)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
