"""Conversations as text for training: marks, escapes, loss mask, and the parser that reads them back.

Grammar of a conversation: turn*.  A turn is one of

    <s>[INST] text [/INST]            a user's turn
    <s>[SYS] text [/SYS]              a system turn
    <s>[OUT] text </s>                an assistant's turn, under the loss mask
    <s>[ROLE] role [/ROLE] text </s>  a turn of any other role

without the spaces.  A text is rendered as it is, the turn is parsed again, and where role and text do not
come back alike, the text is escaped: each `<`, `[` and backslash gets a backslash after it.  No mark can begin
inside an escaped text, so the second rendering always parses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[", "</s>"
#: Role: what follows OPEN, and the closing mark.
MARKS = {"user": ("INST]", "[/INST]"), "system": ("SYS]", "[/SYS]"), "assistant": ("OUT]", CLOSE)}
OTHER, OTHER_END = "ROLE]", "[/ROLE]"
SPECIAL = r"[<\[\\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({SPECIAL})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({SPECIAL})\\", "$1")


def render(role: Column, text: Column) -> Column:
    """A turn with its marks; role and text are used as they are."""
    out = F.concat(F.lit(OPEN + OTHER), role, F.lit(OTHER_END), text, F.lit(CLOSE))
    for name, (head, end) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(OPEN + head), text, F.lit(end))).otherwise(out)
    return out


def _after(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(n + 1), F.char_length(text))


def _closed(body: Column, end: str) -> Column:
    """What stands before the first closing mark, if nothing follows it, else null."""
    at = F.instr(body, F.lit(end))
    return F.when((at > 0) & (at == F.char_length(body) - len(end) + 1), F.substring(body, F.lit(1), at - 1))


def parse_turn(piece: Column) -> Column:
    """struct(role, text, lead), unescaped, of what follows one OPEN; null where the grammar does not hold.

    `lead` is how many code points of the piece stand before the text.
    """
    turn = lambda role, text, lead: F.when(text.isNotNull() & role.isNotNull(), F.struct(role.alias("role"), unescaped(text).alias("text"), lead.cast("int").alias("lead")))
    body = _after(piece, len(OTHER))
    at = F.instr(body, F.lit(OTHER_END))
    name = F.when(at > 0, F.substring(body, F.lit(1), at - 1))
    rest = F.substring(body, at + len(OTHER_END), F.char_length(body))
    out = F.when(F.startswith(piece, F.lit(OTHER)), turn(unescaped(name), _closed(rest, CLOSE), F.char_length(name) + len(OTHER) + len(OTHER_END)))
    for role, (head, end) in MARKS.items():
        out = F.when(F.startswith(piece, F.lit(head)), turn(F.lit(role), _closed(_after(piece, len(head)), end), F.lit(len(head)))).otherwise(out)
    return out


def pieces(formatted: Column) -> Column:
    """What follows each OPEN; null if anything stands before the first one."""
    cut = F.split(formatted, r"<s>\[", -1)
    return F.when(F.char_length(formatted) == 0, F.array().cast("array<string>")).when(cut[0] == "", F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text, lead), with nulls where the grammar does not hold."""
    return F.transform(pieces(formatted), parse_turn)


def rendered(role: Column, text: Column) -> Column:
    """A turn as it is if it parses to itself, else with role and text escaped."""
    plain = render(role, text)
    back = parse(plain)
    same = (F.size(back) == 1) & back[0].isNotNull() & (back[0]["role"] == role) & (back[0]["text"] == text)
    return F.when(F.coalesce(same, F.lit(False)), plain).otherwise(render(escaped(role), escaped(text)))


def format_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row a turn: conv, turn, role, text and its segment of the formatted conversation.  Nothing is grouped or shuffled.

    A null role or text counts as empty.  A turn that does not read back as it was stops the job.
    """
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    out = rows.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), as_text(role_col).alias("role"), as_text(text_col).alias("text"))
    return out.withColumn("segment", rendered(F.col("role"), F.col("text")))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row a conversation: its id, formatted text, and `marks`, an array of struct(offset, start, length) a turn.

    `offset` is where the turn begins in the formatted text, `start` and `length` are the span under the loss
    mask (length 0 for turns that are not the assistant's), all in code points.  Turns are ordered by turn (nulls
    first), then role, then text; repeated rows are turns of their own.  Rows with a null id are one conversation.  Empty
    texts are empty turns.  Other columns are left out, whatever their names.  An empty table gives none.
    A formatted conversation is one value, of at most 2 GB; format_turns has no such bound.
    """
    turns = format_turns(rows, id_col, turn_col, role_col, text_col)
    size, lead = F.char_length("segment").cast("long"), len(OPEN) + len(MARKS["assistant"][0])
    before = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.sum(size).over(before) - size
    turns = turns.select("conv", offset.alias("offset"), "segment", (F.col("role") == "assistant").alias("loss"))
    mark = F.struct("offset", (F.col("offset") + F.when(F.col("loss"), lead).otherwise(0)).alias("start"), F.when(F.col("loss"), size - lead - len(CLOSE)).otherwise(0).alias("length"))
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(mark.alias("mark"), "segment"))).alias("turns"))
    part = lambda name: F.transform("turns", lambda t: t[name])
    return grouped.select(F.col("conv").alias(id_col), F.array_join(part("segment"), "").alias("formatted"), part("mark").alias("marks"))


def under_mask(formatted: Column, marks: Column) -> Column:
    """The unescaped text under the loss mask, spans in order with nothing between."""
    segments = F.transform(pieces(formatted), lambda p: F.concat(F.lit(OPEN), p))
    span = lambda s, m: unescaped(F.substring(s, (m["start"] - m["offset"] + 1).cast("int"), m["length"].cast("int")))
    return F.array_join(F.zip_with(segments, marks, span), "")
