"""Chat formatting with a declarative template and per-segment loss flags.

Everything here is a DataFrame expression. A conversation is one row holding
its turns in order; a finite-state machine given as a table validates the turn
order, and a template given as a table turns every turn into text segments,
each with a flag that says whether its text counts for the training loss.

Defined results
---------------
* null text or null role: the empty string;
* ties in ``turn``: ordered by role, then text; null turns come first;
* repeated rows: each is a turn;
* a row with a null conversation id is a conversation of its own (so they never meet in one unbounded row);
* a turn order the machine rejects: the conversation is still formatted, with
  ``valid`` false and ``bad_turn`` the index of the first refused turn;
* an empty table gives an empty result; further columns are ignored.

One conversation is one output row, so its turns meet in one task; nothing
else is gathered by the grouping.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What is put around the text of each role.

    ``roles`` maps a role to (prefix, suffix, loss). Any other role is written
    between ``other_open`` and ``other_close`` and never counts for the loss.
    Every turn stands between ``open`` and ``close``.
    """

    open: str = "<s>"
    close: str = "</s>"
    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("[SYS] ", " [/SYS]", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("", "", True),
        }
    )
    other_open: str = "[ROLE]"
    other_close: str = "[/ROLE]"

    def controls(self) -> list[str]:
        """The strings that must not occur inside a text, longest first."""
        found = {self.open, self.close, self.other_open, self.other_close}
        for prefix, suffix, _ in self.roles.values():
            found |= {prefix.strip(), suffix.strip()}
        return sorted(found - {""}, key=lambda s: (-len(s), s))


@dataclass(frozen=True)
class TurnMachine:
    """Allowed role changes: (state, role) -> next state; no entry means refusal."""

    start: str = "start"
    steps: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "instructed"),
        ("start", "user", "asked"),
        ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    accept: tuple[str, ...] = ("answered",)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def escape(text: Column, template: ChatTemplate) -> Column:
    """Double each backslash, then put one behind the first character of every control string."""
    controls = template.controls()
    pattern = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, "\\\\")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def gather_turns(rows: DataFrame) -> DataFrame:
    """conv_id and its turns, in order."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("__alone")
    return rows.groupBy("conv_id", alone).agg(F.sort_array(F.collect_list(turn)).alias("turns")).drop("__alone")


def _segments(turn: Column, template: ChatTemplate) -> Column:
    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    role, text = turn["role"], escape(turn["text"], template)
    named = F.concat(F.lit(template.open + template.other_open), escape(role, template), F.lit(template.other_close))
    out = F.array(piece(named, False), piece(text, False), piece(F.lit(template.close), False))
    for name, (prefix, suffix, loss) in template.roles.items():
        own = F.array(
            piece(F.lit(template.open + prefix), False), piece(text, loss), piece(F.lit(suffix + template.close), False)
        )
        out = F.when(role == name, own).otherwise(out)
    return out


def format_chat(
    rows: DataFrame, template: ChatTemplate = ChatTemplate(), machine: TurnMachine = TurnMachine()
) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid, bad_turn for each conversation of ``rows``."""
    table = F.create_map(*(F.lit(x) for state, role, then in machine.steps for x in (f"{state}\n{role}", then)))

    def step(acc: Column, turn: Column) -> Column:
        then = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        refused = acc["bad"].isNotNull() | then.isNull()
        return F.struct(
            F.coalesce(then, F.lit("refused")).alias("state"),
            F.when(acc["bad"].isNotNull(), acc["bad"]).when(refused, acc["n"]).alias("bad"),
            (acc["n"] + 1).alias("n"),
        )

    begin = F.struct(
        F.lit(machine.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n")
    )
    return (
        gather_turns(rows)
        .withColumn("run", F.aggregate("turns", begin, step))
        .select(
            "conv_id",
            F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
            (F.col("run.bad").isNull() & F.col("run.state").isin(*machine.accept)).alias("valid"),
            F.col("run.bad").alias("bad_turn"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, _quoted(template.close), -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(template.open) + 1), F.length(piece))
        after = F.length(body) - len(template.other_open)
        rest = F.substring(body, F.lit(len(template.other_open) + 1), after)
        cut = F.locate(template.other_close, rest)
        out = F.struct(
            unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(rest, cut + len(template.other_close), F.length(rest))).alias("text"),
        )
        known = F.when(body.startswith(template.other_open), out)
        plain = None
        for name, (prefix, suffix, _) in template.roles.items():
            inner = F.substring(body, F.lit(len(prefix) + 1), F.length(body) - len(prefix) - len(suffix))
            own = F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))
            if prefix:
                known = known.when(body.startswith(prefix), own)
            else:
                plain = own
        return known.otherwise(plain) if plain is not None else known

    return F.transform(turns, read)
