"""Chat training texts from conversation logs: events are folded into final messages, messages rendered under a template.

A log holds events (conv_id, message, seq, kind, role, text). Per message, in the order of ``seq``: ``open`` names the role, ``delta``
appends to the text, ``edit`` replaces it, ``regenerate`` empties it; what came before the last of the latter two is void. Events
are grouped by message first, so only final texts meet in a conversation, which is one row of the result and has to fit one.

The template marks turns by control strings; where a text (or a role) holds one, or one with backslashes after its first character,
a backslash is put there, and taken out again when the output is read. So no control string stands in an escaped text, texts
without control strings stay as they are, and the loss mask is the list of segments of the formatted text with ``loss`` set: the
texts of assistants.

Defined cases: null text and null role are empty, a null turn comes first, turns that agree in number are ordered by role, then text,
and repeated rows are turns of their own. Rows without a conversation id belong to no conversation: each is one by itself. An
empty table gives no rows. Extra columns never reach the operator.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import ROW, numbered, only

#: Characters of a streamed delta in a derived log.
DELTA = 400

# The template, as (role, mark before the text, mark behind it); other roles are named inside their turn.
TURNS = [("user", "[INST]", "[/INST]"), ("system", "[SYS]", "[/SYS]"), ("assistant", "<s>", "</s>")]
OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE = "[TURN]", "[ROLE]", "[/TURN]"
#: What follows the first character of a control string.
TAILS = r"/?(?:INST|SYS|TURN|ROLE)\]|/?s>"
CONTROL = rf"([\[<])(\\*(?:{TAILS}))"
ESCAPED = rf"([\[<])\\(\\*(?:{TAILS}))"
TURN = r"(?s)(\[INST\]|\[SYS\]|\[TURN\]|<s>) (.*?) (?:\[/INST\]|\[/SYS\]|\[/TURN\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def log_of(conversations: DataFrame, part: int = 0) -> DataFrame:
    """An event log as a chat front end would have left it, from finished turns (conv_id, turn, role, text).

    Every turn is opened and streamed in deltas. A third of the turns was first streamed up to one delta and regenerated, another
    third was begun and then edited as a whole. Messages are named by turn, part and row, so repeated rows stay apart; logs of
    several tables need a ``part`` of their own.
    """
    own = ["conv_id", "turn", "role", "text"]
    rows = numbered(only(conversations, *own), "chat-rows").select(*own, ROW)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    deltas = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))

    def event(kind: str, seq: Column, held: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role"), held.alias("text"))

    def streamed(found: Column, at: int) -> Column:
        return F.transform(found, lambda t, i: event("delta", i + at, t))

    nothing = F.lit(None).cast("string")
    way = F.pmod(F.xxhash64("conv_id", "turn", ROW), F.lit(3))
    opened = F.array(event("open", F.lit(0), nothing).withField("role", role))
    begun = F.slice(deltas, 1, 1)
    events = F.concat(
        opened,
        F.when(way == 0, F.concat(streamed(begun, 1), F.array(event("regenerate", F.lit(2), nothing)), streamed(deltas, 3)))
        .when(way == 1, F.concat(streamed(begun, 1), F.array(event("edit", F.lit(2), text))))
        .otherwise(streamed(deltas, 1)),
    )
    message = F.struct(F.col("turn").cast("long").alias("turn"), F.lit(part).alias("part"), F.col(ROW).alias("row"))
    made = rows.select(F.col("conv_id").cast("long").alias("conv_id"), message.alias("message"), F.explode(events).alias("e"))
    return made.select("conv_id", "message", "e.*")


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): every message of a log in its final form.

    Repeated events of one place in the sequence are one event, as logs are delivered at least once.
    """
    one = F.struct("seq", "kind", "role", "text")
    held = log.groupBy("conv_id", "message").agg(F.sort_array(F.collect_set(one)).alias("events"))
    starts = F.filter(F.transform("events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
    valid = F.slice("events", F.coalesce(F.array_max(starts), F.lit(0)) + 1, F.size("events"))
    texts = F.transform(F.filter(valid, lambda e: e["kind"].isin("delta", "edit")), lambda e: F.coalesce(e["text"], F.lit("")))
    roles = F.transform(F.filter("events", lambda e: e["kind"] == "open"), lambda e: F.coalesce(e["role"], F.lit("")))
    role = F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit(""))
    return held.select("conv_id", "message", role.alias("role"), F.array_join(texts, "").alias("text"))


def segments_of(role: Column, text: Column) -> Column:
    """Segments (text, loss) of a turn."""
    whole = F.lit(OTHER_OPEN + " "), F.concat(escape(role), F.lit(f" {OTHER_ROLE} "), escape(text)), F.lit(" " + OTHER_CLOSE)
    before, held, behind = whole
    for name, opens, closes in TURNS:
        before = F.when(role == name, opens + " ").otherwise(before)
        held = F.when(role == name, escape(text)).otherwise(held)
        behind = F.when(role == name, " " + closes).otherwise(behind)
    parts = [(before, F.lit(False)), (held, role == "assistant"), (behind, F.lit(False))]
    return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])


def render(final: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments) of final messages; the segments' texts in order are the formatted text.

    Messages stand by turn (the ``turn`` of ``message``), those of one turn by role and text.
    """
    turn = F.struct(F.col("message.turn").alias("turn"), "role", "text")
    # A row without an id is a conversation by itself, so that such rows never meet in one group.
    alone = F.when(F.col("conv_id").isNull(), F.col("message"))
    held = final.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda t: segments_of(t["role"], t["text"])))
    found = held.select("conv_id", parts.alias("segments"))
    return found.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    marks = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))

    def turn(mark: Column, body: Column) -> Column:
        border = f" {OTHER_ROLE} "
        role = unescape(F.substring_index(body, border, 1))
        text = F.substr(body, F.length(F.substring_index(body, border, 1)) + len(border) + 1)
        for name, opens, _ in TURNS:
            role = F.when(mark == opens, name).otherwise(role)
            text = F.when(mark == opens, body).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.zip_with(marks, bodies, turn)


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the output."""
    found = rendered.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chats(conversations: DataFrame) -> DataFrame:
    """Formatted conversations, by way of an event log."""
    return render(messages(log_of(conversations)))
