"""Chat formatting: heterogeneous layouts to canonical turns by schema fingerprint, then to training text.

A record's fingerprint is the hash of all nested field paths that it has and some mapping
knows; other fields don't count.  It is looked up in one map, made beforehand: for every
mapping the fingerprint of its own paths, and of these with one further known path, and
beside each the mapping that such a record takes, which is the one with the most paths of
those that the record has all of.  Only a record whose fingerprint the map lacks has its
paths compared with the mappings'.  The mapping says which paths hold the turns, roles and
texts.  Records may be JSON strings of mixed layouts in one column, or a table whose columns
are the fields.  Everything is DataFrame operations.

In the text a turn is ``<turn role="ROLE">TEXT</turn>`` and a line feed.  Inside texts
a run of ``<``, backslashes and ``turn`` or ``/turn`` gets one backslash more after its
``<``; so no text holds a bare control string and the escape can be undone exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLOSE = "</turn>\n"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    Either ``turns`` (a path to an array of objects, with ``role`` and ``text`` inside),
    or ``fields`` (role and path pairs, in order; paths of one role are joined by an
    empty line), or ``rows`` (one turn a row: order, role and text columns).
    """

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str] | None = None

    def paths(self) -> tuple[str, ...]:
        """The field paths that mark the layout, sorted."""
        if self.turns:
            return tuple(sorted((f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}")))
        if self.rows:
            return tuple(sorted(self.rows))
        return tuple(sorted(p for _, p in self.fields))


LAYOUTS = (
    Layout("turn_rows", rows=("turn", "role", "text")),
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value"),
    Layout("dialog", turns="dialog", role="speaker", text="text"),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)
#: Names that sources give to the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Every field path that some layout knows; others don't count in a fingerprint.
KNOWN = frozenset(p for layout in LAYOUTS for p in layout.paths())


def contained(paths, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The mapping with the most paths of those that ``paths`` has all of, the first of equals."""
    return next((x for x in sorted(layouts, key=lambda x: -len(x.paths())) if set(x.paths()) <= set(paths)), None)


def _by_fingerprint(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    known = [set(x.paths()) | {*more} for x in layouts for more in [(), *((p,) for p in sorted(KNOWN))]]
    return {fingerprint(paths): contained(paths, layouts) for paths in known}


#: Mappings by fingerprint: of tables, and of JSON records, which hold all turns.
BY_FINGERPRINT = _by_fingerprint(LAYOUTS)
JSON_LAYOUTS = tuple(x for x in LAYOUTS if not x.rows)
JSON_BY_FINGERPRINT = _by_fingerprint(JSON_LAYOUTS)


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaf fields of a type; array elements are marked ``[]``."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix]


def layout_of(df: DataFrame) -> Layout:
    """The layout of a table by the fingerprint of its schema's known paths; other columns don't matter."""
    found = KNOWN.intersection(schema_paths(df.schema))
    layout = BY_FINGERPRINT.get(fingerprint(found)) or contained(found)
    if layout is None:
        raise ValueError(f"no layout has all its fields in {sorted(schema_paths(df.schema))}")
    return layout


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def _reader(layout: Layout) -> Callable[[Column], Column]:
    """What reads one element of the layout's array of turns."""
    return lambda t: F.struct(_role(t[layout.role]).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))


def json_fingerprint(payload: Column) -> Column:
    """Fingerprint of each JSON record: the hash of the known paths that it has."""
    return F.transform(F.array(_known_paths(F.try_parse_json(payload))), _print)[0]


def _known_paths(value: Column) -> Column:
    """The known paths of a record, sorted; an array's path counts if its first element has it, and none whose value is null."""
    return F.array_compact(F.array(*(F.when(F.try_variant_get(value, "$." + p.replace("[]", "[0]"), "string").isNotNull(), p) for p in sorted(KNOWN))))


def _print(paths: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", paths), 256), 1, 16)


def _json_layout(value: Column) -> Column:
    """The name of each record's mapping, null for a layout that is not known."""
    by_print = F.create_map(*(F.lit(x) for print_, layout in JSON_BY_FINGERPRINT.items() for x in (print_, layout.name)))
    longest = sorted(JSON_LAYOUTS, key=lambda x: -len(x.paths()))

    def choose(paths: Column) -> Column:
        holds = lambda layout: F.size(F.array_except(F.array(*map(F.lit, layout.paths())), paths)) == 0
        return F.coalesce(F.try_element_at(by_print, _print(paths)), *(F.when(holds(x), x.name) for x in longest))

    return F.transform(F.array(_known_paths(value)), choose)[0]


def turns_from_json(df: DataFrame, *, payload: str, key: str) -> DataFrame:
    """(key, turn, role, text) of JSON records in mixed layouts, and layout, the mapping used.

    Each record's fingerprint selects its mapping.  A record that is null, no JSON or of
    an unknown layout gives one row with a null layout, turn, role and text, so none is
    lost unseen.
    """
    value = F.try_parse_json(F.col(f"`{payload}`").cast("string"))
    turn_type = "array<struct<role:string,text:string>>"
    rows = df.select(F.col(f"`{key}`").alias("key"), value.alias("v")).withColumn("layout", _json_layout(F.col("v")))
    turns = F.lit(None).cast(turn_type)
    for layout in JSON_LAYOUTS:
        if layout.turns:
            listed = F.try_variant_get(F.col("v"), f"$.{layout.turns}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
            made = F.transform(listed, _reader(layout))
        else:
            get = lambda p: F.try_variant_get(F.col("v"), f"$.{p}", "string")
            by_role: dict[str, list[str]] = {}
            for role, path in layout.fields:
                by_role.setdefault(role, []).append(path)
            made = F.array(*(F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(F.nullif(get(p), F.lit("")) for p in ps)).alias("text")) for r, ps in by_role.items()))
        turns = F.when(F.col("layout") == layout.name, made.cast(turn_type)).otherwise(turns)
    return rows.select("key", "layout", F.posexplode_outer(turns).alias("turn", "t")).select("key", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout")


def turns_from_table(df: DataFrame, *, key: str) -> DataFrame:
    """(key, turn, role, text) of a table, by the mapping that its schema's fingerprint selects.

    Null roles and texts are empty.  A table with a turn in each row keeps its roles as
    they are; other layouts have the names of ROLES put into one form.  Any further
    columns are ignored.
    """
    layout = layout_of(df)
    col = lambda c: F.col(f"`{c}`")
    if layout.rows:
        turn, role, text = layout.rows
        return df.select(col(key).alias("key"), col(turn).cast("long").alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    if layout.turns:
        turns = F.transform(col(layout.turns), _reader(layout))
    else:
        by_role: dict[str, list[str]] = {}
        for role, path in layout.fields:
            by_role.setdefault(role, []).append(path)
        turns = F.array(*(F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(F.nullif(col(p), F.lit("")) for p in ps)).alias("text")) for r, ps in by_role.items()))
    return df.select(col(key).alias("key"), F.posexplode(turns).alias("turn", "t")).select("key", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&lt;"), F.lit("<")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """key, formatted and loss_mask of every conversation.

    ``loss_mask`` lists the spans of the trained role's texts, in order: the turn's
    place, the start in code points from 0, and the length.  Turns are ordered by turn
    (null first), then role and text.  A null key is a conversation of its own.  One row
    for each key; an empty table gives an empty result.  A conversation's text is one
    value, so a conversation has to fit in a task.
    """
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    head = F.concat(F.lit('<turn role="'), _escape_role(F.coalesce("role", F.lit(""))), F.lit('">'))
    body = escape(F.coalesce("text", F.lit("")))
    rows = turns.select("key", "turn", "role", "text", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("size", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(F.col("role") == trained, F.struct(F.col("place").alias("turn"), (F.col("end") - len(CLOSE) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length")))
    parts = F.collect_list(F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span")))
    out = rows.groupBy("key").agg(F.array_sort(parts).alias("parts"))
    return out.select("key", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.array_compact(F.transform("parts", lambda p: p["span"])).alias("loss_mask"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns, array of (role, text), read back from the text alone."""
    pieces = F.split(F.col("formatted"), CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r'(?s)^<turn role="([^"]*)">', 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.regexp_replace(piece, r'(?s)^<turn role="[^"]*">', "")).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
