"""Chat formatting from a declarative template, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns become text, which of it bears loss, and which role may follow which.

    A turn is ``opening + role + line feed + text + closing``. ``guarded`` lists control strings that must not stand in a
    text or role as they are: the template's own and those other common templates treat as control tokens. ``moves`` is
    the state machine: (state, role) to the next state; it starts in ``start`` and ends well in one of ``ends``.
    """

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    guarded: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )
    moves: Mapping[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    ends: tuple[str, ...] = ("answered", "asked")


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """The text with every backslash doubled and a backslash after the first character of each control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in template.guarded:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    """The inverse: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def literal(text: str) -> str:
    """A regular expression for exactly this text."""
    return "".join(c if c.isalnum() else "\\n" if c == "\n" else "\\" + c for c in text)


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: Template = DEFAULT,
) -> DataFrame:
    """One row a conversation: conv_id, formatted, segments (text, loss), valid, bad_turn, complete.

    ``formatted`` is the segments' texts joined. Turns stand in the order of turn, role, text (nulls first), so equal
    turn numbers and repeated rows have a defined place and all are kept. A null role or text is empty; rows with a null
    conversation id form one conversation. ``valid`` says whether the state machine accepts the order of roles,
    ``bad_turn`` is the position (from 0) of the first turn it refuses, else null; ``complete`` whether it also ends in
    an end state. Refused conversations are formatted all the same. A line feed in a role is escaped, too.
    A conversation's text is one string by definition, so its turns meet in one task; conversations are spread.
    """
    empty = F.lit("")
    row = F.struct(
        F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), empty).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), empty).alias("text"),
    )
    chats = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )

    def pieces(t: Column) -> Column:
        role = F.replace(escaped(t["role"], template), F.lit("\n"), F.lit(ESCAPE + "\n"))
        head = F.concat(F.lit(template.opening), role, F.lit("\n"))
        loss = t["role"].isin(*template.loss_roles)
        parts = ((head, F.lit(False)), (escaped(t["text"], template), loss), (F.lit(template.closing), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), flag.alias("loss")) for text, flag in parts])

    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws(" ", acc["state"], turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("refused")).alias("state"), (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"),
        )

    walked = chats.select(
        "conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), F.aggregate("turns", begin, step).alias("end")
    )
    return walked.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        F.col("end.bad").isNull().alias("valid"), F.col("end.bad").alias("bad_turn"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*template.ends)).alias("complete"),
    )


def parsed_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """Roles and texts read back from the formatted text: array of (role, text)."""
    bodies = F.regexp_extract_all(formatted, F.lit(f"(?s){literal(template.opening)}(.*?){literal(template.closing)}"), F.lit(1))

    def turn(body: Column) -> Column:
        head = F.regexp_extract(body, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        text = F.substring(body, F.length(head) + 2, F.length(body))
        return F.struct(unescaped(head).alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text that bears loss, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
