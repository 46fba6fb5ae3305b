"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_conversations`` turns rows (conv_id, turn, role, text) into one row per
conversation: the formatted text, its segments with loss flags, and the verdict
of the state machine on the order of turns.  Only DataFrame functions are used.

Texts are escaped like quoted mail: a control string inside a text gets one
backslash in front of the backslashes that already precede it, so the escape is
undone by removing one.  Markers of the template stand at the start of a line,
never behind a backslash, and so cannot be confused with text.

Defined results: a null text is empty; a null role is the empty role; roles the
template does not know are formatted (their name URL-encoded in the marker),
carry no loss and make the order invalid; turns are ordered by (turn, role,
text) with null turns first, ties and repeated rows are kept as turns of their
own; rows with a null conv_id form the conversation null; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxscan.llm.columns import let


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are trained on, and the allowed order.

    ``opening`` ends in the role and ``opening_end``; the closing marker begins
    with a line feed.  ``moves`` maps (state, role) to the next state; a state is
    final if a conversation may end there.
    """

    opening: str = "<turn "
    opening_end: str = ">\n"
    closing: str = "\n</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
        ("answered", "tool"): "asked",
    })

    @property
    def controls(self) -> str:
        """Pattern of the strings that must not appear unescaped in a text."""
        return "|".join(re.escape(x.strip()) for x in (self.closing, self.opening))


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"(\\\\*)({template.controls})", "\\\\$1$2")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"\\\\(\\\\*)({template.controls})", "$1$2")


def _verdict(roles: Column, template: Template) -> Column:
    """struct(state, n, bad): the last state, turns seen, and the first turn out of order."""
    table = F.create_map(*[
        F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}>{role}", to)
    ])
    zero = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")
    )

    def step(acc: Column, role: Column) -> Column:
        to = F.element_at(table, F.concat(acc.state, F.lit(">"), role))
        return F.struct(
            F.coalesce(to, F.lit("refused")).alias("state"), (acc.n + 1).alias("n"),
            F.coalesce(acc.bad, F.when(to.isNull(), acc.n + 1)).alias("bad"),
        )

    return F.aggregate(roles, zero, step)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, segments, valid, bad_turn (from 1, null if the order holds).

    ``segments`` are struct(text, loss, start, length) in order; their texts
    joined are ``formatted`` and their places are counted in code points.  One
    exchange by conversation; the running lengths need no second one.
    """
    template = template or Template()
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(template.opening), F.url_encode("role"), F.lit(template.opening_end)).alias("head"),
        escape(F.col("text"), template).alias("body"),
    )
    close = len(template.closing)
    size = (F.length("head") + F.length("body") + close).cast("long")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "conv_id", "role", "head", "body",
        F.row_number().over(order).alias("seq"),
        (F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - size).alias("start"),
    )
    kept = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "role", "head", "body", "start"))).alias("turns")
    )

    def piece(text: Column, loss: Column, start: Column) -> Column:
        return F.struct(
            text.alias("text"), loss.alias("loss"), start.alias("start"),
            F.length(text).cast("long").alias("length"),
        )

    def pieces(t: Column) -> Column:
        body_at = t.start + F.length(t.head)
        return F.array(
            piece(t.head, F.lit(False), t.start),
            piece(t.body, t.role.isin(*template.loss_roles), body_at),
            piece(F.lit(template.closing), F.lit(False), body_at + F.length(t.body)),
        )

    verdict = _verdict(F.transform("turns", lambda t: t.role), template)
    return (
        kept.select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"),
            F.flatten(F.transform("turns", pieces)).alias("segments"), verdict.alias("v"),
        )
        .select(
            "conv_id", "n_turns",
            F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
            "segments",
            (F.col("v.bad").isNull() & F.col("v.state").isin(*template.final)).alias("valid"),
            F.col("v.bad").alias("bad_turn"),
        )
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct(role, text)> read back from a formatted conversation."""
    template = template or Template()
    marker = f"(?<!\\\\){re.escape(template.opening)}"
    chunks = F.split(formatted, marker)

    def turn(chunk: Column) -> Column:
        at = F.instr(chunk, template.opening_end)
        body = F.substring(
            chunk, at + len(template.opening_end),
            F.length(chunk) - at - (len(template.opening_end) - 1 + len(template.closing)),
        )
        return F.struct(
            F.url_decode(F.substring_index(chunk, template.opening_end, 1)).alias("role"),
            unescape(body, template).alias("text"),
        )

    return let(chunks, lambda c: F.transform(F.slice(c, F.lit(2), F.size(c)), turn))


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """The unescaped text under the loss mask, joined without anything between."""
    template = template or Template()
    trained = F.filter(segments, lambda s: s.loss)
    return F.array_join(F.transform(trained, lambda s: unescape(s.text, template)), "")
