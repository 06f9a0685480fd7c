"""Chat formatting by a finite-state machine over roles, in Spark expressions only.

A declarative template gives each role its header, and says whether its text
is learnt from. A conversation becomes segments ``(text, loss)``: header, text
and end of each turn. The machine's allowed steps from role to role decide
whether the order of turns is valid and which turn breaks it first.

Inside texts (and names of roles that the template does not know) control
strings are escaped: a backslash is doubled, ``</turn>`` is ``<\\/turn>``, and a
``#`` after a ``#`` has a backslash before it, so neither the end of a turn nor a
header can stand in a text. Taking the backslash off each pair reverses it.

Defined cases: null roles and texts are empty strings; rows go by turn (null
first), ties by role and text, and each row is a turn; rows without a
conversation id form one conversation; an empty table gives an empty result;
further columns are not read. A conversation is one row, so its turns meet in one task by nature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``roles``: name -> (heading, learnt from); ``steps``: allowed (role before, role), "" before the first turn; ``last``: roles that may end."""

    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True), "tool": ("Tool", False)})
    steps: tuple[tuple[str, str], ...] = (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"), ("assistant", "tool"), ("tool", "assistant"))
    last: tuple[str, ...] = ("assistant",)
    opening: str = "### "
    colon: str = ": "
    closing: str = "</turn>\n"
    end_mark: str = "</turn>"


CHAT = Template()


def escape(c: Column, t: Template = CHAT) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit(t.end_mark), F.lit(t.end_mark[0] + "\\" + t.end_mark[1:]))
    return F.regexp_replace(c, "(?<=#)#", r"\\#")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\s\S])", "$1")


def heading(role: Column, t: Template) -> Column:
    out = F.concat(F.lit("~"), F.replace(escape(role, t), F.lit(":"), F.lit("\\:")))
    for name, (shown, _) in t.roles.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return F.concat(F.lit(t.opening), out, F.lit(t.colon))


def format_chats(rows: DataFrame, t: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, valid, first_bad_turn) of each conversation; first_bad_turn counts from 0."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    learnt = [r for r, (_, loss) in t.roles.items() if loss]
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        piece(heading(x.role, t), F.lit(False)),
        piece(escape(x.text, t), x.role.isin(learnt)),
        piece(F.lit(t.closing), F.lit(False)))))
    roles = F.transform("turns", lambda x: x.role)
    allowed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in t.steps))
    steps = F.transform(roles, lambda r, i: F.array_contains(allowed, F.struct(F.when(i == 0, F.lit("")).otherwise(F.get(roles, i - 1)).alias("a"), r.alias("b"))))
    bad = F.array_position(steps, F.lit(False)) - 1
    return (grouped.withColumn("segments", segments).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        ((bad < 0) & F.element_at(roles, -1).isin(list(t.last))).alias("valid"), F.when(bad >= 0, bad).alias("first_bad_turn")))


def read_turns(formatted: Column, t: Template = CHAT) -> Column:
    """array<struct<role, text>> read back from formatted text."""
    parts = F.filter(F.split(formatted, r"\Q" + t.closing + r"\E", -1), lambda s: s != "")
    pattern = r"^" + r"\Q" + t.opening + r"\E((?:[^\\:]|\\[\s\S])*)" + r"\Q" + t.colon + r"\E([\s\S]*)$"
    shown = {v: k for k, (v, _) in t.roles.items()}

    def one(s: Column) -> Column:
        name = F.regexp_extract(s, pattern, 1)
        role = unescape(F.substr(name, F.lit(2)))
        for v, k in shown.items():
            role = F.when(name == v, F.lit(k)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_extract(s, pattern, 2)).alias("text"))

    return F.transform(parts, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
