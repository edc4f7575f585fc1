"""Chat formatting: a finite-state machine over roles and a declarative template, in built-in functions only.

A template gives each role a label and says which roles carry loss, and the machine gives the
allowed next roles of each state. A conversation's turns, in order, become one text,

    ### Label: escaped text </turn>\\n

per turn, and a list of segments, each with its text as it stands in the output and its loss flag:
the header and the end mark never carry loss, the text of a loss role does. Inside texts and foreign
labels, the characters that control strings are made of are replaced by two-character codes, so no
text can open or close a turn, and parsing the output gives back every turn exactly.

The machine marks conversations whose turns break the order (valid is false); they are formatted
all the same, and a caller can filter on valid.

Edge cases: a null text counts as empty. A null role is a foreign role named "". Roles that the
template does not know are written behind a code of their own and never carry loss. Turns with equal
or null numbers are ordered by role, then text, nulls first. Repeated rows are turns of their own.
Rows without a conversation id are one conversation. A conversation without rows does not occur; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles it knows, and which order they may come in."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    open: str = "### "
    between: str = ": "
    close: str = " </turn>\n"
    #: State to allowed roles; a role leads to the state of its name.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})


#: Characters of control strings and their codes; the escape character is coded first and decoded last.
CODES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
FOREIGN = "\\r"


def escaped(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _label(role: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for pair in t.labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), F.concat(F.lit(FOREIGN), escaped(role)))


def _role(label: Column, t: Template) -> Column:
    known = F.create_map(*[F.lit(x) for role, name in t.labels.items() for x in (name, role)])
    foreign = unescaped(F.substring(label, len(FOREIGN) + 1, 1 << 30))
    return F.when(F.startswith(label, F.lit(FOREIGN)), foreign).otherwise(F.try_element_at(known, label))


def _valid(roles: Column, t: Template) -> Column:
    """The machine, run over the roles; an unknown step leads to a state that nothing leaves."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit("broken")
        for source, targets in t.moves.items():
            out = F.when((state == source) & role.isin(*targets), role).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step).isin(*t.final)


def format_conversations(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, n_turns, valid, formatted, segments (text, loss)."""
    t = template or Template()
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        parts = (
            (F.concat(F.lit(t.open), _label(x.role, t), F.lit(t.between)), F.lit(False)),
            (escaped(x.text), x.role.isin(*t.loss)),
            (F.lit(t.close), F.lit(False)),
        )
        return F.array(*[F.struct(p.alias("text"), loss.alias("loss")) for p, loss in parts])

    found = grouped.withColumn("segments", F.flatten(F.transform("turns", segments)))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _valid(F.transform("turns", lambda x: x.role), t).alias("valid"),
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        "segments",
    )


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that an output text holds."""
    t = template or Template()
    pieces = F.filter(F.split(formatted, "\\Q" + t.close + "\\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(t.open) + 1, 1 << 30)
        at = F.instr(body, t.between)
        return F.struct(_role(body.substr(F.lit(1), at - 1), t).alias("role"), unescaped(body.substr(at + len(t.between), F.length(body))).alias("text"))

    return F.transform(pieces, turn)
