"""Chat formatting with DataFrame functions only: records of any known layout become turns, turns one text with a loss mask.

A record is a variant (or JSON text). The paths of its nested fields are hashed, and the hash selects a declarative
mapping to canonical turns (role, text): rows of one turn, prompt and response, instruction and output, or lists of messages.

The template writes `### role: text</turn>` and a new line for each turn. Its control strings get a backslash after their first
character inside roles and texts, and backslashes are doubled there, so that no text can open or close a turn and all
can be read back. The loss mask is a run length for each turn: code points before, inside and after what is learnt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

OPEN, SEPARATOR, CLOSE, BREAK = "### ", ": ", "</turn>", "\n"

#: A field of a variant's schema, with its type up to eight levels down: what is inside its brackets goes with it.
_NAME = r"(`[^`]*`|[^\s:<>,`]+)"
_INSIDE = "<[^<>]*+>"
for _ in range(8):
    _INSIDE = f"<(?:[^<>]++|{_INSIDE})*+>"
_FIELD = rf"{_NAME}: \w+(?:\([\d,]+\))?(?:{_INSIDE})?"


@dataclass(frozen=True)
class Layout:
    """How records with just these known fields turn into turns.

    parts: (role, fields) of each turn, the fields joined by an empty line where they aren't empty. Or each: the field that lists
    messages, or "" for a record that is a message itself; role and text name a message's fields, and names renames its roles.
    """

    fields: tuple[str, ...]
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    names: tuple[tuple[str, str], ...] = ()


LAYOUTS = {
    "turn": Layout(("role", "text"), each="", role="role", text="text"),
    "message": Layout(("content", "role"), each="", role="role", text="content"),
    "messages": Layout(("messages[].content", "messages[].role"), each="messages", role="role", text="content"),
    "dialogue": Layout(("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant"))),
    "prompt": Layout(("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    "completion": Layout(("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    "system_prompt": Layout(("prompt", "response", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    "instruction": Layout(("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": Layout(("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    "question": Layout(("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
}


def field_paths(record: Column) -> Column:
    """Paths of a variant's fields: a, a.b for objects in it, a[].b for lists of objects; deeper ones count as their parent."""
    fields = lambda body: F.regexp_extract_all(body, F.lit(_FIELD), F.lit(0))
    name = lambda field: F.regexp_extract(field, _NAME, 1)
    inside = lambda field, before, after: F.regexp_extract(field, f"^[^<]*: {before}(.*){after}$", 1)

    def paths(field: Column) -> Column:
        one, many = inside(field, "OBJECT<", ">"), inside(field, "ARRAY<OBJECT<", ">>")
        named = lambda body, dot: F.transform(fields(body), lambda f: F.concat(name(field), F.lit(dot), name(f)))
        return F.when(one != "", named(one, ".")).when(many != "", named(many, "[].")).otherwise(F.array(name(field)))

    body = F.regexp_extract(F.schema_of_variant(record), r"^OBJECT<(.*)>$", 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields(body), paths))))


def fingerprint(record: Column, layouts: dict[str, Layout] = LAYOUTS) -> Column:
    """Hash of the record's paths, as far as any layout has them: other fields don't hide a layout."""
    known = sorted({f for layout in layouts.values() for f in layout.fields})
    return F.xxhash64(F.array_join(F.array_intersect(field_paths(record), F.array(*map(F.lit, known))), "\n"))


def _string(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turns(record: Column, layout: Layout) -> Column:
    """The record's turns as array<struct<role, text>>."""

    def named(role: Column) -> Column:
        out = F.coalesce(role, F.lit(""))
        for old, new in layout.names:
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.each == "":
        return F.array(turn(named(_string(record, layout.role)), _string(record, layout.text)))
    if layout.each:
        messages = F.try_variant_get(record, f"$.{layout.each}", f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")
        return F.transform(messages, lambda m: turn(named(m[layout.role]), m[layout.text]))
    filled = lambda f: F.nullif(_string(record, f), F.lit(""))
    return F.array(*[turn(F.lit(role), F.concat_ws("\n\n", *map(filled, fields))) for role, fields in layout.parts])


def canonical_turns(records: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", record_col: str = "record", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, part, role, text): the turns of all records, `part` counting those of one record.

    record: a variant, or JSON text. Records of no known layout give no turns; unknown_layouts() lists them.
    """
    rows = _parsed(plain(records, id_col, order_col, record_col).toDF("conv_id", "turn", "record"), layouts)
    made = F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in layouts.values():
        made = F.when(F.col("print") == _print_of(layout), _turns(F.col("record"), layout)).otherwise(made)
    return rows.select("conv_id", "turn", F.posexplode(made).alias("part", "made")).select("conv_id", "turn", "part", "made.role", "made.text")


def unknown_layouts(records: DataFrame, *, record_col: str = "record", layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(paths, n): field paths of records that no layout fits, and how many records have them; what to write a mapping for."""
    rows = _parsed(plain(records, record_col).toDF("record"), layouts)
    known = F.coalesce(F.col("print").isin([]), F.lit(False))
    for layout in layouts.values():
        known = known | F.coalesce(F.col("print") == _print_of(layout), F.lit(False))
    return rows.where(~known).groupBy(F.coalesce(F.array_join(field_paths(F.col("record")), ", "), F.lit("")).alias("paths")).agg(F.count("*").alias("n"))


def _print_of(layout: Layout) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(layout.fields))))


def _parsed(rows: DataFrame, layouts: dict[str, Layout]) -> DataFrame:
    record = F.col("record") if rows.schema["record"].dataType.typeName() == "variant" else F.try_parse_json(F.col("record").cast("string"))
    return rows.withColumn("record", record).withColumn("print", fingerprint(F.col("record"), layouts))


def escaped(text: Column) -> Column:
    """`text` without any control string, reversibly."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE):
        out = F.replace(out, F.lit(control), F.lit(_broken(control)))
    return out


def unescaped(text: Column) -> Column:
    for control in (CLOSE, OPEN):
        text = F.replace(text, F.lit(_broken(control)), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of (conv_id, turn, part, role, text): a text for each conversation.

    mask: for each turn the code points before, inside and after what is learnt, which is an assistant's text as escaped;
    together they are all code points of the text.

    A conversation is one row of the output, so one task holds each; nothing else is gathered. Null texts and roles are empty.
    Turns that repeat a number come by role, then text; null numbers first. Null ids are one conversation.
    """
    line = F.struct("turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit(SEPARATOR), F.lit(_broken(SEPARATOR))), F.lit(SEPARATOR))
    written = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    tail = len(CLOSE + BREAK)

    def run(w: Column) -> Column:
        before, inside = F.char_length(w["head"]), F.char_length(w["body"])
        return F.struct(F.when(w["learn"], before).otherwise(before + inside).alias("before"), F.when(w["learn"], inside).otherwise(0).alias("inside"), F.lit(tail).alias("after"))

    return chats.select("conv_id", written.alias("w")).select("conv_id", F.array_join(F.transform("w", lambda w: F.concat(w["head"], w["body"], F.lit(CLOSE + BREAK))), "").alias("formatted"), F.transform("w", run).alias("mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, learnt) back from (conv_id, formatted, mask): turns array<struct<role, text>>, learnt all text under the mask."""
    pieces = F.split("formatted", CLOSE + BREAK, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    at = lambda p: F.instr(p, F.lit(SEPARATOR))
    role = lambda p: unescaped(F.replace(F.substr(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1), F.lit(_broken(SEPARATOR)), F.lit(SEPARATOR)))
    turn = lambda p: F.struct(role(p).alias("role"), unescaped(F.substr(p, at(p) + len(SEPARATOR))).alias("text"))
    learnt = F.zip_with("pieces", "mask", lambda p, m: F.when(m["inside"] > 0, unescaped(F.substr(p, m["before"] + 1, m["inside"]))).otherwise(""))
    return chats.withColumn("pieces", pieces).select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(learnt, "").alias("learnt"), "formatted")


def chat_records(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, record) of a table that has a row for each turn."""
    rows = plain(rows, id_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))


def chat_report(records: DataFrame) -> DataFrame:
    """What the formatted texts and masks of all records say when they are read back: the form of query op12."""
    back = read_chats(format_chats(canonical_turns(records)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
