"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags by segment.

A template gives the marks of each role and says which texts count for the loss. Each mark is known by a sign of its own:
its first character that is no letter, digit or backslash and stands in no mark before it. Inside texts and roles a code
that begins with a backslash stands for every backslash and for every such sign, so no text can imitate a mark and every
text comes back exactly, whatever the template; one whose marks have no such signs is refused. Segments are (text, loss) pairs; the formatted conversation is their concatenation.

The state machine reads the roles in order of the turns, from "start"; a conversation is well-formed if it always finds
a transition and ends in an accepting state. Formatting does not depend on that: the flag says it, the caller decides.

Defined results: a null text is an empty one; a null or unknown role is set like any other and never accepted; turns
with equal numbers are ordered by role and text, repeated rows stay; a null conversation id is one conversation of its
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn (``{role}`` stands for the role), roles whose texts count for the loss, and the machine."""

    before: str = "### {role}: "
    after: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("asked", "answered")

    def __post_init__(self):
        if self.before.count("{role}") != 1:
            raise ValueError("before names {role} once")
        if not sign_of(self.middle, self.head) or not sign_of(self.after, self.head + self.middle):
            raise ValueError("the marks behind the role and behind the text need a sign that stands in no mark before them")

    @property
    def head(self) -> str:
        return self.before.split("{role}")[0]

    @property
    def middle(self) -> str:
        return self.before.split("{role}")[1]

    @property
    def text_signs(self) -> str:
        """What is escaped in texts."""
        return "\\" + (sign_of(self.head, "") or "") + sign_of(self.after, self.head + self.middle)

    @property
    def role_signs(self) -> str:
        """What is escaped in roles."""
        return self.text_signs + sign_of(self.middle, self.head)


def sign_of(mark: str, before: str) -> str | None:
    """The character that a mark is known by: visible if there is one."""
    free = [c for c in mark if not c.isalnum() and c != "\\" and c not in before]
    return next((c for c in free if not c.isspace()), free[0] if free else None)


#: Fixed codes of frequent signs; any other is a backslash, u, and eight hexadecimal digits.
SHORT = {"\\": "\\b", "#": "\\h", "<": "\\l", ":": "\\c"}


def codes(signs: str) -> list[tuple[str, str]]:
    """Each sign with what stands for it, the backslash first. A backslash in escaped text always begins a code."""
    ordered = sorted(set(signs), key=lambda c: (c != "\\", c))
    return [(c, SHORT.get(c, f"\\u{ord(c):08x}")) for c in ordered]


def escape(text: Column, signs: str) -> Column:
    for sign, code in codes(signs):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column, signs: str) -> Column:
    for sign, code in reversed(codes(signs)):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def last_state(roles: Column, template: Template) -> Column:
    """The state after all roles; null once there is no transition."""
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.element_at(table, F.concat(state, F.lit(" "), role)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, segments (array of (text, loss)), formatted, well_formed.

    Every turn gives three segments: its opening mark, its escaped text, its closing mark.
    """
    template = template or Template()

    def segments(t: Column) -> Column:
        opening = F.concat(F.lit(template.head), escape(t["role"], template.role_signs), F.lit(template.middle))
        loss = t["role"].isin(*template.loss_roles)
        no = F.lit(False)
        return F.array(
            F.struct(opening.alias("text"), no.alias("loss")),
            F.struct(escape(t["text"], template.text_signs).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.after).alias("text"), no.alias("loss")),
        )

    rows = turns_of(conversations).select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), last_state(F.col("turns.role"), template).alias("state"))
    return rows.select(
        "conv_id",
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
        F.coalesce(F.col("state").isin(*template.accepting), F.lit(False)).alias("well_formed"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) read from formatted text alone.

    The closing mark holds a sign that stands in no escaped text, and the mark behind the role one that stands in no
    escaped role, so both are found as they are.
    """
    template = template or Template()
    head, middle = template.head, template.middle
    turns = F.filter(F.split(formatted, r"\Q" + template.after + r"\E", -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        end = F.instr(t, middle)
        role = F.substring(t, F.lit(len(head) + 1), end - 1 - len(head))
        text = F.substring(t, end + len(middle), F.char_length(t))
        return F.struct(unescape(role, template.role_signs).alias("role"), unescape(text, template.text_signs).alias("text"))

    return F.transform(turns, turn)


def digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Lengths and hashes, all read back from the formatted text and the loss flags of the segments."""
    template = template or Template()
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template.text_signs)), "")
    rows = chats.select("conv_id", "formatted", read_back(F.col("formatted"), template).alias("turns"), loss.alias("loss"), "well_formed")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "well_formed",
    )
