"""Chat formatting in DataFrame functions: a state machine over roles, a declarative template, loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. A turn is `head`, its role's label, `colon`, the escaped text and `end`.

    `moves` are the state machine's transitions "state>role" and `final` its accepting states. `loss_roles`
    name the roles whose texts are trained on. Control strings inside texts are escaped by codes, in order, and unescaped in
    reverse: the backslash comes first, so that each backslash in an escaped text begins one of the codes. What is escaped follows
    from `head`, `colon` and `end`, without the blanks around them; no mark may hold a backslash.
    """

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, str] = field(default_factory=lambda: {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = [self.head.strip(), self.end.strip(), self.colon]
        if not all(marks) or any("\\" in m for m in marks) or marks[0] == marks[1]:
            raise ValueError("head, colon and end have to be different, not blank and without backslashes")
        if any(m in code for m in marks for _, code in self.escapes):
            raise ValueError("head, colon and end may not be letters of the codes")

    @property
    def escapes(self) -> tuple[tuple[str, str], ...]:
        """(string, code) of the backslash, the head, the end and, for roles only, the colon. A part of the head that repeats is enough."""
        return (("\\", "\\b"), (self.head.strip(), "\\h"), (self.end.strip(), "\\t"), (self.colon, "\\c"))

    def text(self, c: Column) -> Column:
        return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), self.escapes[:3], c)

    def role(self, c: Column) -> Column:
        """A known role's label; any other role escaped after a tilde."""
        other = F.concat(F.lit("~"), reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), self.escapes, c))
        return reduce(lambda x, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(x), self.labels.items(), other)

    def plain(self, c: Column) -> Column:
        return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(self.escapes), c)

    def plain_role(self, c: Column) -> Column:
        other = self.plain(F.substring(c, F.lit(2), F.length(c)))
        return reduce(lambda x, kv: F.when(c == kv[1], F.lit(kv[0])).otherwise(x), self.labels.items(), other)


def format_chats(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, valid, final_state, segments, formatted) of each conversation of turns (conv_id, turn, role, text, ...).

    `segments` are (text, loss) in order and `formatted` is their concatenation. Turns follow `turn`, ties by
    role and text; repeated rows are turns of their own. A null text or role counts as empty; a null conv_id is
    a conversation, a null turn comes first. `valid`: the state machine accepts the roles; a conversation that
    it rejects is formatted all the same, for the caller to filter. One conversation is one training example
    and so one row: its size bounds what one task gathers. No rows give no rows.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for kv in t.moves.items() for x in kv])
    state = F.aggregate("turns", F.lit("start"), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), r["role"])), F.lit("error")))
    plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("loss"))
    one = lambda r: F.array(plain(F.concat(F.lit(t.head), t.role(r["role"]), F.lit(t.colon))), F.struct(t.text(r["text"]).alias("text"), r["role"].isin(*t.loss_roles).alias("loss")), plain(F.lit(t.end)))
    out = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("final_state"), F.flatten(F.transform("turns", one)).alias("segments"))
    out = out.withColumn("valid", F.col("final_state").isin(*t.final))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    parts = F.split(formatted, re.escape(t.end))
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(p: Column) -> Column:
        label = F.substring(F.substring_index(p, t.colon, 1), F.lit(len(t.head) + 1), F.length(p))
        text = F.substring(p, F.length(label) + (len(t.head) + len(t.colon) + 1), F.length(p))
        return F.struct(t.plain_role(label).alias("role"), t.plain(text).alias("text"))

    return F.transform(parts, one)


def loss_text(segments: Column, t: Template = Template()) -> Column:
    """All text under the loss flags, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.plain(s["text"])), "")
