r"""Event-sourced chat formatting, with DataFrame functions only.

A log row is an event ``(conv_id, seq, message, role, kind, text)``. ``kind`` is one of

* ``delta``: streamed text, appended to the message;
* ``edit`` or ``regenerate``: the message's text starts over with this text;
* ``rewind``: the message starts over as by ``edit``, and later messages of the conversation begun before it are dropped, as they
  answered what is no longer there.

``fold`` partitions the log by conversation and message, sorts by ``seq`` and folds the events into final messages; its first
grouping is by message, so one long conversation is spread over tasks until its messages are final. ``render`` writes each
conversation as one text with a loss mask. The template is ``<|im_start|>role<|im_sep|>text<|im_end|>\n`` per turn; inside
roles and texts ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string can occur there and ``unescape`` gives the text back.

The mask is kept per turn: ``loss_spans`` has (turn, start, length) in code points from the start of that turn's piece of the output, so
reading it back takes one pass however long the conversation is.

Defined results: null texts and roles count as empty; unknown kinds append; null ``conv_id`` is a conversation of its own; events with
equal ``seq`` are taken in the order of kind and text; an empty log gives no rows; other columns are ignored. The final text of
a conversation is one value and so must fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
RESETS = ("edit", "regenerate", "rewind")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, message, role, text``, one row each, from a log of events."""
    log = events.select("conv_id", "seq", "message", _empty("kind").alias("kind"), _empty("text").alias("text"), F.col("role").cast("string").alias("role"))
    reset = F.col("kind").isin(*RESETS)
    by_message = log.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("events"),
        F.max(F.when(reset, F.struct("seq", "kind", "text"))).alias("reset"),
        F.max(F.when(F.col("kind") == "rewind", F.col("seq"))).alias("rewound"),
        F.min("seq").alias("begun"),
        F.max_by("role", F.struct("seq", "kind", "text")).alias("role"),
    )
    live = F.filter("events", lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_message.withColumn("text", F.array_join(F.transform(live, lambda e: e["text"]), ""))
        .withColumn("rewound_before", F.max("rewound").over(before))
        .where(F.col("rewound_before").isNull() | (F.col("begun") > F.col("rewound_before")))
        .select("conv_id", "message", _empty("role").alias("role"), "text")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``."""
    head = F.concat(F.lit(START), escape(_empty("role")), F.lit(SEP))
    body = escape(_empty("text"))
    pieces = messages.select(
        "conv_id",
        F.struct(
            "message",
            F.concat(head, body, F.lit(END)).alias("piece"),
            F.char_length(head).alias("start"),
            F.char_length(body).alias("length"),
            F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
        ).alias("turn"),
    )
    turns = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"), t["loss"].alias("loss")))
    spans = F.transform(F.filter(numbered, lambda t: t["loss"]), lambda t: F.struct(t["turn"].alias("turn"), t["start"].alias("start"), t["length"].alias("length")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Roles, texts and the text under the loss mask, taken from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    part = lambda t, i: unescape(F.element_at(F.split(F.substring(t, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>"), i))
    turns = F.transform(F.col("whole"), lambda t: F.struct(part(t, 1).alias("role"), part(t, 2).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.get(F.col("whole"), s["turn"]), s["start"] + 1, s["length"])))
    return rendered.withColumn("whole", whole).select("conv_id", "formatted", "loss_spans", turns.alias("turns"), masked.alias("loss_texts"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A log whose fold is the given rows: per row a streamed draft, a regeneration with the first half, and a delta with the rest.

    Rows stand by turn (null first), then role and text; each is a message of its own, repeated rows too.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text, half = _empty("text"), (F.char_length(_empty("text")) / 2).cast("int")
    first, rest = F.left(text, half), F.substring(text, half + 1, F.lit(2**31 - 1))
    kinds = [("delta", text), ("regenerate", first), ("delta", rest)]
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), t.alias("text")) for k, (kind, t) in enumerate(kinds)])
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order))
    return rows.select("conv_id", "message", "role", F.explode(steps).alias("e")).select(
        "conv_id", (F.col("message") * len(kinds) + F.col("e.step")).alias("seq"), "message", "role", "e.kind", "e.text"
    )


def digest(rendered: DataFrame) -> DataFrame:
    back = read_back(rendered)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle_sql() -> str:
    esc = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
    t, r = "coalesce(text, '')", "coalesce(role, '')"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
             string_agg({r} || chr(10) || {t} || chr(10), '' {order}) AS turns,
             coalesce(string_agg({t}, '' {order}) FILTER (role = 'assistant'), '') AS loss,
             sum(length('{START}') + length({esc.format(r)}) + length('{SEP}') + length({esc.format(t)}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
