"""Conversations as training text: a machine over roles, segments with loss flags, one template.

The template says how a turn is marked, which roles are learned from and which role may
follow which. A turn becomes three segments: its opening mark, its text and its closing
mark; only texts of learned roles carry the loss flag. Control strings inside texts get a
backslash after their first character, and those that have backslashes there get one more,
so that marks are found by plain search and texts come back exactly.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles learned from, and the moves of the machine over roles.

    A turn is written as ``opening``, its role, ``opened``, its text, ``closing``. The control
    strings are ``opening`` and ``closing`` without white space at their ends. Both must start
    with the same character, which must not come again in either: then no text can complete
    or overlap a mark.
    """

    opening: str = "<turn "
    opened: str = ">\n"
    closing: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: MappingProxyType(
            {
                ("start", "system"): "instructed",
                ("start", "user"): "asked",
                ("instructed", "user"): "asked",
                ("asked", "assistant"): "answered",
                ("answered", "user"): "asked",
            }
        )
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        first = self.opening[:1]
        for control in self.controls:
            if len(control) < 2 or control[0] != first or first in control[1:] or "\\" in control:
                raise ValueError("control strings must share a first character that comes nowhere else in them, and no backslash")
        if not self.opened or self.opened[0].isalnum() or self.opened[0] in ".-*_+%":
            raise ValueError("opened must start with a character that an encoded role cannot hold")

    @property
    def controls(self) -> tuple[str, str]:
        return self.opening.strip(), self.closing.strip()

    @property
    def _rests(self) -> str:
        return "|".join(f"\\Q{c[1:]}\\E" for c in self.controls)

    def escape(self, text: Column) -> Column:
        first = self.opening[0]
        return F.regexp_replace(text, F.lit(f"\\Q{first}\\E(\\\\*)({self._rests})"), F.lit(f"{_plain(first)}\\\\$1$2"))

    def unescape(self, text: Column) -> Column:
        first = self.opening[0]
        return F.regexp_replace(text, F.lit(f"\\Q{first}\\E\\\\(\\\\*)({self._rests})"), F.lit(f"{_plain(first)}$1$2"))

    def segments(self, role: Column, escaped: Column) -> Column:
        """The three segments of a turn: array of (text, loss)."""

        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        mark = F.concat(F.lit(self.opening), F.url_encode(role), F.lit(self.opened))
        no = F.lit(False)
        return F.array(part(mark, no), part(escaped, role.isin(*self.learned)), part(F.lit(self.closing), no))

    def walk(self, roles: Column) -> Column:
        """(state, bad): where the machine ends, and the index of the first turn it refuses, or null.

        The machine stays where it is on a turn that it refuses.
        """
        table = F.create_map(*[F.lit(x) for (state, role), to in self.moves.items() for x in (f"{state}\n{role}", to)])
        begin = F.struct(F.lit(self.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

        def step(now: Column, role: Column) -> Column:
            to = F.try_element_at(table, F.concat(now["state"], F.lit("\n"), role))
            refused = F.when(to.isNull(), now["at"])
            return F.struct(
                F.coalesce(to, now["state"]).alias("state"),
                (now["at"] + 1).alias("at"),
                F.coalesce(now["bad"], refused).alias("bad"),
            )

        return F.aggregate(roles, begin, step, lambda x: F.struct(x["state"].alias("state"), x["bad"].alias("bad")))


def _plain(text: str) -> str:
    """Text for the replacement of a regular expression."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


TURNS = Template()


def turn_segments(turns: DataFrame, template: Template = TURNS) -> DataFrame:
    """One row per segment of every turn: conv_id, turn, role, part (0 to 2), text, loss.

    Needs no shuffle, whatever the length of a conversation. Null roles and texts count as
    empty; repeated rows give repeated segments.
    """
    rows = _rows(turns, template)
    parts = F.posexplode(template.segments(F.col("role"), F.col("body"))).alias("part", "segment")
    return rows.select("conv_id", "turn", "role", parts).select("conv_id", "turn", "role", "part", "segment.text", "segment.loss")


def _rows(turns: DataFrame, template: Template) -> DataFrame:
    body = template.escape(F.coalesce(F.col("text"), F.lit("")))
    return turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), body.alias("body"))


def format_conversations(turns: DataFrame, template: Template = TURNS) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, n_turns, segments (array of text and loss, in order), formatted (their
    texts joined), state (where the machine over roles ends), first_refused (index of the first
    turn it refuses, or null), valid (none refused) and complete (valid, and ends in a final
    state). All conversations are formatted, invalid ones too.

    Turns come by turn, null first; equal ones by role and text, repeated rows all stay. Null
    roles and texts count as empty; rows without a conv_id form one conversation. Other
    columns are ignored. An empty table gives an empty result. A conversation is one training
    example and becomes one value, as its text has to; ``turn_segments`` has no such bound.
    """
    whole = _rows(turns, template).groupBy("conv_id")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda t: template.segments(t["role"], t["body"])))
    walked = template.walk(F.transform("turns", lambda t: t["role"]))
    out = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), parts.alias("segments"), walked.alias("walked"))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    valid = F.col("walked.bad").isNull()
    return out.select(
        "conv_id", "n_turns", "segments", "formatted", F.col("walked.state").alias("state"),
        F.col("walked.bad").alias("first_refused"), valid.alias("valid"),
        (valid & F.col("walked.state").isin(*template.final)).alias("complete"),
    )


def read_turns(formatted: Column, template: Template = TURNS) -> Column:
    """The turns of a formatted conversation, read by its marks: array of (role, text)."""
    pieces = F.split(formatted, F.lit(f"\\Q{template.closing}\\E"), -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        length = F.locate(template.opened, piece, len(template.opening) + 1)
        role = F.substr(piece, F.lit(len(template.opening) + 1), length - F.lit(len(template.opening) + 1))
        text = F.substr(piece, length + F.lit(len(template.opened)))
        return F.struct(F.url_decode(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(pieces, turn)


def learned_text(segments: Column, template: Template = TURNS) -> Column:
    """The texts under the loss flag, as they were before formatting, joined with nothing between."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: template.unescape(s["text"])), "")


def digests(formatted: DataFrame, template: Template = TURNS) -> DataFrame:
    """What ``format_conversations`` wrote, read back and hashed.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn), loss_chars,
    loss_sha256 (the text learned from), formatted_chars, and the machine's findings.
    """
    back = formatted.withColumns(
        {"turns": read_turns(F.col("formatted"), template), "learned": learned_text(F.col("segments"), template)}
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_refused").cast("long").alias("first_refused"),
        "complete",
    )
