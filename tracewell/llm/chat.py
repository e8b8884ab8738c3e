"""Chat formatting: a state machine over roles and a declarative template, in DataFrame functions only.

``format_conversations`` turns the rows of a conversation into one string, a list of text segments with a
loss flag each, and a verdict on the turn order. ``read_back`` parses the string again.

Defined cases: null text or role counts as empty; rows of one conversation are ordered by turn (nulls
first), then role, then text, so ties and repeated rows have one result; a null conversation id is a
conversation of its own; an empty table gives an empty result; columns beyond the four named ones are
ignored, whatever their names. A conversation is one value of the result, so its rows meet in one task; its
length is bounded by what one value of a table can hold (2 GB), and the time is proportional to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F


def _default_moves() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "opened", "user": "asked"},
        "opened": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "asked"},
    }


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles whose text carries loss, and the moves of the role machine.

    ``moves[state][role]`` is the next state; a missing entry is a violation, after which the machine
    resumes in the state that the role leads to from any state, or stays where it was.
    """

    turn_open: str = "<|im_start|>"
    role_close: str = "\n"
    turn_close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=_default_moves)
    first: str = "start"
    final: tuple[str, ...] = ("answered",)


CHATML = Template()


def escape(text: Column) -> Column:
    """Doubles every backslash and parts ``<|``, with which every control string begins."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: after it, ``<\\|`` can only stem from ``<|``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _lookup(pairs: list[tuple[Column, str]], other: Column) -> Column:
    out = other
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def run_machine(roles: Column, template: Template = CHATML) -> Column:
    """struct(state, position, violations, first_violation) after reading an array of roles."""
    anywhere = {role: to for moves in template.moves.values() for role, to in moves.items()}

    def step(acc: Column, role: Column) -> Column:
        allowed = [
            ((acc.state == F.lit(state)) & (role == F.lit(name)), to)
            for state, moves in template.moves.items()
            for name, to in moves.items()
        ]
        moved = _lookup(allowed, F.lit(None).cast("string"))
        resumed = _lookup([(role == F.lit(name), to) for name, to in anywhere.items()], acc.state)
        bad = moved.isNull()
        return F.struct(
            F.coalesce(moved, resumed).alias("state"),
            (acc.position + 1).alias("position"),
            (acc.violations + bad.cast("long")).alias("violations"),
            F.coalesce(acc.first_violation, F.when(bad, acc.position)).alias("first_violation"),
        )

    zero = F.struct(
        F.lit(template.first).alias("state"),
        F.lit(0).cast("long").alias("position"),
        F.lit(0).cast("long").alias("violations"),
        F.lit(None).cast("long").alias("first_violation"),
    )
    return F.aggregate(roles, zero, step)


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, formatted, segments (array of struct(text, loss)), loss_spans (array of
    struct(start, chars) in code points of ``formatted``), n_turns, valid_order, n_violations,
    first_violation (position of the first turn that the machine refuses).
    One exchange: the window and the grouping share the partitioning by conversation.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = (
        rows.withColumn("seq", F.row_number().over(order))
        .withColumn("head", F.concat(F.lit(template.turn_open), _escape_role(F.col("role")), F.lit(template.role_close)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("loss", F.col("role").isin(*template.loss_roles))
        .withColumn("chars", F.length("head") + F.length("body") + F.lit(len(template.turn_close)))
        .withColumn("ends", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("ends") - len(template.turn_close) - F.length("body"))
    )
    part = F.struct("seq", "role", "head", "body", "loss", "start")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    close = F.lit(template.turn_close)
    whole = whole.withColumn("ran", run_machine(F.transform("parts", lambda p: p.role), template))

    def pieces(p: Column) -> Column:
        plain = F.lit(False)
        return F.array(
            F.struct(p["head"].alias("text"), plain.alias("loss")),
            F.struct(p["body"].alias("text"), p["loss"].alias("loss")),
            F.struct(close.alias("text"), plain.alias("loss")),
        )

    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], close)), "").alias("formatted"),
        F.flatten(F.transform("parts", pieces)).alias("segments"),
        F.transform(
            F.filter("parts", lambda p: p["loss"]),
            lambda p: F.struct(p["start"].alias("start"), F.length(p["body"]).cast("long").alias("chars")),
        ).alias("loss_spans"),
        F.size("parts").cast("long").alias("n_turns"),
        ((F.col("ran.violations") == 0) & F.col("ran.state").isin(*template.final)).alias("valid_order"),
        F.col("ran.violations").alias("n_violations"),
        F.col("ran.first_violation").alias("first_violation"),
    )


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Adds ``turns`` (array of struct(role, text)) and ``loss_text`` parsed from the formatted string.

    The text inside the marks holds no control string, so splitting at the closing mark is exact.
    """
    parts = F.split("formatted", re.escape(template.turn_close), -1)
    inner = F.filter(parts, lambda p, i: i < F.size(parts) - 1)
    head = len(template.turn_open)

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(head + 1), F.length(p))
        at = F.instr(rest, F.lit(template.role_close))
        return F.struct(
            _unescape_role(F.substring(rest, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(rest, at + len(template.role_close), F.length(rest))).alias("text"),
        )

    spans = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))),
    )
    return formatted.withColumn("turns", F.transform(inner, turn)).withColumn("loss_text", F.array_join(spans, ""))
