"""Chat formatting: a state machine over roles and a declarative template."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

REJECTED = "rejected"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which texts train, and which role may follow which.

    A turn reads ``<turn role>text</turn>`` and a line end.  The first characters
    of the three markers never stand in an escaped role or text: such a character
    becomes a backslash and its number among them, and a backslash becomes one
    with the next number.  So no marker can arise inside a turn, whatever the
    markers are, and replacing the pairs undoes it.  A marker that is empty or
    begins with a backslash or a digit, and a closing marker that could begin
    inside another, are errors.  ``moves`` maps a state to the states that may
    follow; a turn's state is its role, and no state leads out of ``rejected``.
    """

    open: str = "<turn "
    opened: str = ">"
    close: str = "</turn>\n"
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    moves: tuple = (
        ("start", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )
    final: tuple = ("user", "assistant")

    def __post_init__(self):
        for marker in (self.open, self.opened, self.close):
            if not marker or marker[0] == "\\" or marker[0].isdigit():
                raise ValueError(f"{marker!r} cannot mark turns")
        for marker in (self.open, self.opened):
            for at in range(len(marker)):
                if marker[at:].startswith(self.close) or self.close.startswith(marker[at:]):
                    raise ValueError(f"{self.close!r} could begin inside {marker!r}")

    @property
    def escapes(self):
        """(character, what stands for it); the backslash goes first and comes back last."""
        special = tuple(dict.fromkeys(m[0] for m in (self.open, self.opened, self.close)))
        return (("\\", f"\\{len(special)}"), *((c, f"\\{i}") for i, c in enumerate(special)))

    def escaped(self, text):
        return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), self.escapes, text)

    def plain(self, escaped):
        return reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), reversed(self.escapes), escaped)

    def header(self, role):
        return F.concat(F.lit(self.open), self.escaped(role), F.lit(self.opened))

    def body(self, text):
        return self.escaped(text)

    def next_state(self, state, role):
        allowed = reduce(
            lambda found, move: found | ((state == move[0]) & role.isin(*move[1])), self.moves, F.lit(False)
        )
        return F.when(allowed, role).otherwise(F.lit(REJECTED))


def format_chats(rows, template=None, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per conversation: (conv, valid, segments, formatted).

    ``segments`` are (text, loss) in order: the marker that opens a turn, the
    escaped text, the closing marker; only texts of the loss roles have the
    flag.  ``formatted`` is their concatenation.  ``valid`` is whether the state
    machine accepts the order of the roles; others are formatted as they are.

    Turns are sorted by (turn, role, text), nulls first.  A null role or text is
    the empty string; rows without a conversation form one of their own.
    Repeated rows are repeated turns.  Other columns are not read.  A
    conversation is one row of the result and so has to fit into a task.
    """
    template = template or Template()
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = F.aggregate("turns", F.lit(template.start), lambda state, t: template.next_state(state, t["role"]))

    def parts(t):
        loss = t["role"].isin(*template.loss_roles)
        return F.array(
            F.struct(template.header(t["role"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(template.body(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    segments = grouped.select(
        "conv", state.isin(*template.final).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments")
    )
    return segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted, template=None):
    """The turns of a formatted text, as an array of (role, text)."""
    template = template or Template()
    turns = F.filter(F.split(formatted, rf"\Q{template.close}\E"), lambda part: part != "")

    def turn(part):
        inside = F.substring(part, len(template.open) + 1, F.length(part))
        end = F.instr(inside, template.opened)
        role, text = F.substring(inside, 1, end - 1), F.substring(inside, end + len(template.opened), F.length(part))
        return F.struct(template.plain(role).alias("role"), template.plain(text).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments, template=None):
    """All text under the loss mask, unescaped, with nothing between."""
    template = template or Template()
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: template.plain(s["text"])), "")
