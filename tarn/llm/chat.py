"""Chat formatting: rebuild conversations from an event log, then render them.

Events are ``conv_id, turn, seq, kind, role, text``. Kinds:

* ``message`` opens a message with its text; ``delta`` appends to the message that is open;
* ``edit`` replaces what the open message holds so far;
* ``regenerate`` drops everything of its turn and of later turns that came before it (by ``seq``).

Everything is DataFrame operations. The log is first folded by (conversation, turn, message), which is
where a stream of deltas becomes one text; only finished pieces are then brought together by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that must not appear unescaped inside a text: <| </s> <s> [INST] [/INST].
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    """Double each backslash, then put one behind the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turn, messages array<struct<role,text>>`` of each turn that still has messages.

    Events sort by seq (null first), then kind in the order of KINDS, role and text, so repeated and
    tied rows have one order; repeated ``message`` events are messages of their own. A null kind is a
    message, a null text is empty, a null role is the last role named in its turn, else empty. Events
    of other kinds append as deltas do. Other columns are never read.

    A turn's events are numbered by message in one sorted pass and then collected message by message,
    so n events cost n log n, however many of them one message has.
    """
    kind = F.coalesce("kind", F.lit("message"))
    # a struct is never null, so that one column serves joins, windows and groups alike
    e = events.select(
        F.struct("conv_id", "turn").alias("k"), F.coalesce(F.col("seq").cast("bigint"), F.lit(-(2**63))).alias("seq"),
        F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("rank"), "role", "text", kind.alias("kind"),
    )
    order = ["seq", "rank", "role", "text"]
    turns = e.groupBy("k").agg(
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct(*order))).alias("turn_role"),
    )
    sofar = Window.partitionBy("k.conv_id").orderBy(F.col("k.turn").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    turns = turns.select("k", "turn_role", F.max("again").over(sofar).alias("cut"))
    opened = F.sum((F.col("kind") == "message").cast("int")).over(Window.partitionBy("k").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    ))
    numbered = e.join(turns, "k").withColumn("message", opened)
    alive = numbered.where((F.col("kind") != "regenerate") & (F.col("cut").isNull() | (F.col("seq") >= F.col("cut"))))
    said = alive.groupBy("k", "message").agg(
        F.sort_array(F.collect_list(F.struct(*order, "kind"))).alias("own"), F.first("turn_role").alias("turn_role")
    )
    edit = F.coalesce(F.array_max(F.transform("own", lambda x, i: F.when(x["kind"] == "edit", i + 1))), F.lit(1))
    live = F.slice("own", edit, F.size("own"))
    message = F.struct(
        "message", F.coalesce(F.get("own", F.lit(0))["role"], "turn_role", F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"),
    )
    messages = said.select("k", message.alias("m")).groupBy("k").agg(F.sort_array(F.collect_list("m")).alias("m"))
    return messages.select("k.conv_id", "k.turn", F.transform("m", lambda x: F.struct(x["role"], x["text"])).alias("messages"))


def render(folded: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_mask`` of each conversation.

    ``loss_mask`` lists (message number, start, length) of the texts to learn from, counted in code
    points inside the message's piece, so that reading it stays linear in the text.
    """
    def piece(m: Column) -> Column:
        return F.concat(F.lit(START), escape(m["role"]), F.lit(SEP), escape(m["text"]), F.lit(END))

    head = len(START) + len(SEP)
    pieces = folded.select(
        "conv_id", "turn",
        F.transform(
            "messages",
            lambda m: F.struct(
                piece(m).alias("piece"),
                F.when(m["role"] == learn_role, head + F.length(escape(m["role"]))).alias("start"),
            ),
        ).alias("pieces"),
    )
    whole = pieces.groupBy("conv_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "pieces"))), lambda x: x["pieces"])).alias("p")
    )
    mask = F.filter(
        F.transform(
            "p",
            lambda x, i: F.struct(
                i.alias("message"), x["start"].alias("start"),
                (F.length(x["piece"]) - x["start"] - len(END)).alias("length"),
            ),
        ),
        lambda x: x["start"].isNotNull(),
    )
    return whole.select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), mask.alias("loss_mask")
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render. A conversation whose every event was dropped has no row; a null conv_id is one conversation."""
    return render(fold(events))


def message_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: each row opens a message, sequenced by its turn."""
    return conversations.select(
        "conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )


def streamed_events(conversations: DataFrame, deltas: int = 3) -> DataFrame:
    """Finished turns as the log of a stream that leads to them.

    A turn opens with a message that is regenerated; then each of its rows (by role and text) opens
    with a draft, an edit replaces it by the first part of the text, and deltas bring the rest.
    """
    text = F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"), nth.alias("nth"))
    step = F.ceil(F.length("text") / (deltas + 1)).cast("int")
    part = lambda k: F.substring("text", step * k + 1, step)

    def event(at: int, kind: str, text: Column) -> Column:
        role = F.col("role") if kind == "message" else F.lit(None).cast("string")
        return F.struct((F.col("nth") * 100 + at).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    nothing = F.lit(None).cast("string")
    first = F.array(event(0, "message", F.concat(F.lit("not this: "), "text")), event(1, "regenerate", nothing))
    each = F.array(
        event(2, "message", F.lit("draft")), event(3, "edit", part(0)), *[event(3 + k, "delta", part(k)) for k in range(1, deltas + 1)]
    )
    log = F.when(F.col("nth") == 1, F.concat(first, each)).otherwise(each)
    return rows.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "turn", "e.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered conversations: ``messages`` (role, text) and ``loss_texts``, unescaped."""
    end = END.replace("|", r"\|")
    raw = F.split("formatted", end)
    # through a generator of one row, so that the split is made once and not once for each mask entry
    pieces = formatted.select("*", F.explode(F.array(F.struct(F.slice(raw, 1, F.size(raw) - 1).alias("p")))).alias("__z"))
    pieces = pieces.withColumn("__p", F.col("__z.p"))

    def parsed(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.length(p))
        return F.struct(
            unescape(F.substring_index(body, SEP, 1)).alias("role"),
            unescape(F.substring(body, F.length(F.substring_index(body, SEP, 1)) + len(SEP) + 1, F.length(body))).alias("text"),
        )

    masked = F.transform(
        "loss_mask", lambda m: unescape(F.substring(F.get("__p", m["message"]), m["start"] + 1, m["length"]))
    )
    return pieces.select("*", F.transform("__p", parsed).alias("messages"), masked.alias("loss_texts")).drop("__p", "__z")
