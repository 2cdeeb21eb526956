"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of messages: ``message`` (a whole text), ``delta`` (a streamed piece, appended), ``edit`` (the text so
far is replaced), ``regenerate`` (the text so far is dropped; deltas follow) and ``delete``. ``fold_events`` partitions the
log by conversation and message, sorts by sequence, and folds each
message of a turn to its final text; ``render`` writes each turn
between marks, with the control strings inside texts escaped; ``assemble`` joins a conversation's turns; ``read_back``
parses a formatted conversation into turns and the text under the loss mask.

The escape code is a backslash and one letter. Every backslash, mark and closing string of a text becomes such a code, so
a backslash in the output always begins a code, and decoding by replacement, the backslash's own code last, is exact.

Edge cases: a null text or role reads as empty. Events of equal sequence fold in the order of kind, then text; repeated
rows of a log count as often as they occur. Turns of equal number keep the order of role, then text. A null conversation id
is a conversation; a null turn sorts first. A conversation all of whose messages are deleted has no row. An empty log gives
an empty result. Other columns are not read. A conversation is one row of the output, so it has to fit a row; turns are
rendered one by one before that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, LOSS_ROLE, PIECE = "### ", " </turn>\n", "assistant", 256
#: Escape codes: what must not stand in a text, and its letter. The backslash is coded first and decoded last.
CODES = (("\\", "b"), ("###", "h"), ("</turn>", "t"), (":", "c"))


def _escape(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit("\\" + x[1])), codes, text)


def _unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit("\\" + x[1]), F.lit(x[0])), reversed(CODES), text)


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), a row a message, from events (conv_id, turn, message, seq, kind, role, text)."""
    event = F.struct(
        "seq", F.lower("kind").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    )
    grouped = log.groupBy("conv_id", "turn", "message").agg(F.sort_array(F.collect_list(event)).alias("events"))
    # The text is what stands from the last event that is no delta on: found once, so that the work is linear in the events.
    restarts = F.transform("events", lambda e, i: F.when(e.kind != "delta", i))
    tail = F.slice("events", F.coalesce(F.array_max(restarts), F.lit(0)) + 1, F.size("events"))
    said = F.transform(F.filter(tail, lambda e: e.kind.isin("message", "edit", "delta")), lambda e: e.text)
    roles = F.filter(F.transform("events", lambda e: e.role), lambda r: r != "")
    folded = F.struct(F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(said, "").alias("text"))
    gone = F.element_at("events", -1).kind == "delete"
    return grouped.where(~gone).select("conv_id", "turn", folded.alias("m")).select("conv_id", "turn", "m.role", "m.text")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered): each turn between its marks. Colons are coded in roles only."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rendered = F.concat(F.lit(OPEN), _escape(role, CODES), F.lit(": "), _escape(text, CODES[:3]), F.lit(CLOSE))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), rendered.alias("rendered"))


def assemble(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted): the turns of each conversation in order."""
    turn = F.struct("turn", "role", "text", "rendered")
    ordered = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.array_join(F.transform("turns", lambda t: t.rendered), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): what a reader of the formatted text recovers."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    head = len(OPEN)

    def turn(p: Column) -> Column:
        mark = F.position(F.lit(": "), p)
        role = _unescape(F.substr(p, F.lit(head + 1), mark - F.lit(head + 1)))
        return F.struct(role.alias("role"), _unescape(F.substr(p, mark + F.lit(2))).alias("text"))

    read = formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.role == LOSS_ROLE), lambda t: t.text), "")
    return read.select("conv_id", "formatted", "turns", loss.alias("loss_text"))


def format_conversations(log: DataFrame) -> DataFrame:
    """(conv_id, formatted) from an event log."""
    return assemble(render(fold_events(log)))


def as_events(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """A table of finished turns as the log that a client would have written; rows of one turn are messages of their own.

    What the assistant says is streamed: deltas of ``piece`` code points. Any other turn is one ``message`` event.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    said = F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(said), F.lit(1)), F.lit(piece))
    pieces = F.when(F.col("role") == LOSS_ROLE, F.transform(starts, lambda i: F.substr(said, i, F.lit(piece)))).otherwise(F.array(said))
    turns = conversations.select("conv_id", "turn", "role", "text", nth.alias("message"))
    kind = F.when(F.col("role") == LOSS_ROLE, F.lit("delta")).otherwise(F.lit("message"))
    return turns.select("conv_id", "turn", "message", "role", kind.alias("kind"), F.posexplode(pieces).alias("seq", "text"))
