r"""Format conversations as training text with a loss mask.

A template names, per role, what stands before and after a turn and whether its text bears
loss. A finite-state machine over roles tells whether the turns come in a legal order.
A conversation becomes a list of segments (text, loss); joined, they are the formatted
text, and the segments with loss hold the texts to learn and nothing else.

Control strings within texts are escaped: the escape sign and each control string become
the escape sign and a letter of their own. After that every escape sign begins such a
pair, so that replacing the pairs back, the sign's own last, restores the text.

Defined cases: null text is empty; null role is the role ``""``; roles that the template
lacks are formatted by its ``*`` entry without loss and make the order illegal; turns
with equal numbers stand by role, then text; null turn numbers come first; repeated rows
are turns of their own; an empty table gives an empty result; extra columns are ignored.
A conversation's text is one value of the result, so its turns meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``heads``: what opens a turn by role; ``end`` closes every turn."""

    heads: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Role "
    other_end: str = ": "
    end: str = "</turn>\n"
    learn: tuple[str, ...] = ("assistant",)
    sign: str = "\\"
    # Control strings and the letter that stands for each; the sign's own pair is sign + "b".
    controls: tuple[tuple[str, str], ...] = (("###", "h"), ("</turn>", "e"))
    # Replaced besides in the names of roles that have no head of their own.
    role_controls: tuple[tuple[str, str], ...] = ((":", "c"),)
    # Legal moves of the machine: state -> {role: next state}.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)


def escape(text: Column, t: Template, more: tuple[tuple[str, str], ...] = ()) -> Column:
    out = F.replace(text, F.lit(t.sign), F.lit(t.sign + "b"))
    for control, letter in t.controls + more:
        out = F.replace(out, F.lit(control), F.lit(t.sign + letter))
    return out


def unescape(text: Column, t: Template, more: tuple[tuple[str, str], ...] = ()) -> Column:
    for control, letter in t.controls + more:
        text = F.replace(text, F.lit(t.sign + letter), F.lit(control))
    return F.replace(text, F.lit(t.sign + "b"), F.lit(t.sign))


def head(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(t.other), escape(role, t, t.role_controls), F.lit(t.other_end))
    for name, opening in t.heads.items():
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def final_state(roles: Column, t: Template) -> Column:
    """The machine's state after all roles; null after an illegal turn."""
    def step(state: Column, role: Column) -> Column:
        out = F.lit(None).cast("string")
        for at, moves in t.moves.items():
            for name, to in moves.items():
                out = F.when((state == at) & (role == name), F.lit(to)).otherwise(out)
        return out
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, legal, segments array<struct<text, loss>>; one row per conversation."""
    t = template or Template()
    none = F.lit("")
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")).alias("row"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    learnt = lambda role: role.isin(*t.learn)

    def pieces(row: Column) -> Column:
        return F.array(
            F.struct(head(row["role"], t).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(row["text"], t).alias("text"), learnt(row["role"]).alias("loss")),
            F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
        )

    legal = F.coalesce(final_state(F.transform("rows", lambda r: r["role"]), t).isin(*t.final), F.lit(False))
    return chats.select("conv_id", legal.alias("legal"), F.flatten(F.transform("rows", pieces)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learnt_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    t = template or Template()
    raw = F.split(text, "\\Q" + t.end + "\\E", -1)
    turns = F.slice(raw, F.lit(1), F.size(raw) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(t.other) + 1, 1 << 30)
        told = F.substring_index(rest, t.other_end, 1)
        role, body = unescape(told, t, t.role_controls), F.substr(rest, F.char_length(told) + F.lit(len(t.other_end) + 1))
        for name, opening in t.heads.items():
            known = F.startswith(piece, F.lit(opening))
            role = F.when(known, F.lit(name)).otherwise(role)
            body = F.when(known, F.substring(piece, len(opening) + 1, 1 << 30)).otherwise(body)
        return F.struct(role.alias("role"), unescape(body, t).alias("text"))

    return F.transform(turns, turn)
