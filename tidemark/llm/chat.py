"""Chat formatting from a declarative template, validated by a finite-state machine over roles [native].

format_chats turns one row per turn into one row per conversation: text segments with a loss flag for each,
and their concatenation. Control strings inside texts are escaped, and read_chats inverts the formatting.

Escaping: inside a text, a "<" followed by n >= 0 backslashes and a "|" gets one more backslash; so no text can
hold a control string, and removing one backslash from each such run restores it exactly.

Defined cases: a null role or text counts as empty; turns are ordered by turn (nulls first), then role, then text,
so ties and repeated rows have one result; rows with a null conversation id form one conversation; a table without
rows gives none. Roles outside the template are formatted like others, carry no loss and make the order invalid.
A conversation is one row of output, so its turns meet in one row; different conversations are never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles bear loss, and which role may follow which."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> next state; what is missing leads to the dead state.
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "asked", ("start", "user"): "user", ("asked", "user"): "user", ("user", "assistant"): "done", ("done", "user"): "user"})
    accepting: tuple[str, ...] = ("done",)


CHATML = Template()
DEAD = "dead"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _final_state(roles: Column, t: Template) -> Column:
    steps = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\x00{role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\x00"), r)), F.lit(DEAD)))


def format_chats(turns: DataFrame, template: Template = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """-> id, n_turns, final_state, valid, segments (array of text, loss), formatted.

    Each turn is three segments: its opening, its escaped text (with the loss flag of its role) and its closing.
    """
    t = template
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.select(F.col(id_col), one.alias("one")).groupBy(id_col).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                part(F.concat(F.lit(t.start), escape(x["role"]), F.lit(t.after_role)), F.lit(False)),
                part(escape(x["text"]), x["role"].isin(*t.loss_roles)),
                part(F.lit(t.end + t.after_end), F.lit(False)),
            ),
        )
    )
    state = _final_state(F.transform("turns", lambda x: x["role"]), t)
    made = chats.select(id_col, F.size("turns").cast("long").alias("n_turns"), state.alias("final_state"), pieces.alias("segments"))
    return made.withColumn("valid", F.col("final_state").isin(*t.accepting)).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_chats(chats: DataFrame, template: Template = CHATML, formatted_col: str = "formatted") -> DataFrame:
    """chats with turns_read: array of (role, text, loss), parsed from the formatted text alone."""
    t = template
    between = F.split(F.col(formatted_col), F.lit(_quoted(t.start)))
    bodies = F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0)))
    closing = len(t.end + t.after_end)

    def one(x: Column) -> Column:
        cut = F.instr(x, t.after_role)
        role = unescape(F.substring(x, F.lit(1), cut - 1))
        text = unescape(F.substring(x, cut + len(t.after_role), F.length(x) - cut - len(t.after_role) + 1 - closing))
        return F.struct(role.alias("role"), text.alias("text"), role.isin(*t.loss_roles).alias("loss"))

    return chats.withColumn("turns_read", F.transform(bodies, one))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|<>" else c for c in text).replace(r"\<", "<").replace(r"\>", ">")
