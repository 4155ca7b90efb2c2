r"""Chat formatting from event logs, with DataFrame functions only.

A log holds one row per event: conversation, sequence, turn, kind, role, text. fold() orders the events of
a conversation by sequence and folds deltas, edits and regenerations into final messages; render() writes
a conversation as one string and as segments of which some carry the loss.

The template: <s> starts a conversation; a user's turn is [INST] text [/INST] (with one space inside each
mark), an assistant's turn a space, the text and </s>, any other turn <|role|>role<|text|>text<|end|>.
Inside texts and roles a backslash is doubled and each control string gets a backslash after its first
character, so that no control string is left; dropping the backslashes gives the text back.

A rendered conversation is one string, so its messages meet in one row; conversations are the unit of
parallel work, and no other group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.llm.common import table

BOS, EOS = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_TEXT, ROLE_CLOSE = "<|role|>", "<|text|>", "<|end|>"
#: Strings that mean something to the template or to tokenizers, and never stay whole inside a text.
CONTROLS = (BOS, EOS, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", ROLE_OPEN, ROLE_TEXT, ROLE_CLOSE)
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<\|role\|>.*?<\|end\|>| .*?</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Final messages (conv, turn, role, text) from events (conv, seq, turn, kind, role, text).

    kind is delta (adds text to the turn), edit (the turn's text so far is replaced) or regenerate (the
    turn's content and all later turns so far are void; the text, if any, starts the turn anew). Events of
    equal seq go by kind, role and text. Null texts are empty; the role is the first of the turn's live events
    that isn't null. Null conversations and turns are groups of their own, and no regeneration reaches a null
    turn. Other columns are dropped, whatever their names; an empty log gives no messages. The live text of
    a conversation has to fit one row, as its rendering does.
    """
    events = events.select(conv, "seq", "turn", "kind", "role", "text")
    # newest first, so that what follows an event is a frame that only grows
    newest = [F.col(c).desc() for c in ("seq", "kind", "role", "text")]
    later = Window.partitionBy(conv).orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
    later_in_turn = Window.partitionBy(conv, "turn").orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    edited = F.max(F.when(F.col("kind") == "edit", F.lit(1))).over(later_in_turn)
    live = events.withColumn("cut", cut).where(F.coalesce(F.col("turn") < F.col("cut"), F.lit(True))).withColumn("edited", edited)
    said = F.when(F.col("edited").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", F.col("text").alias("place"), said.alias("said"))))
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r.isNotNull())
    return (
        live.groupBy(conv, "turn")
        .agg(parts.alias("parts"))
        .select(
            conv,
            "turn",
            F.get(roles, F.lit(0)).alias("role"),
            F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"),
        )
    )


def streamed(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A log of events, as a chat service writes it, that fold() turns into the given messages (conv, turn, role, text) again.

    turn has numbers from 1. By turn: the text comes in two deltas; or as a draft of which an edit keeps the
    first half and a delta adds the second; or as a draft and an abandoned next turn, both voided by a
    regeneration, after which the text is streamed anew.
    """
    half = (F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    draft = F.concat(second, F.lit(" ..."))

    def event(at: int, kind: str, text: Column, turn: Column | None = None) -> Column:
        turn = F.col("turn") if turn is None else turn
        return F.struct((F.col("turn") * 8 + at).alias("seq"), turn.alias("turn"), F.lit(kind).alias("kind"), text.alias("text"))

    plain = F.array(event(0, "delta", first), event(1, "delta", second))
    edited = F.array(event(0, "delta", draft), event(1, "edit", first), event(2, "delta", second))
    abandoned = event(1, "delta", F.lit("..."), F.col("turn") + 1)
    again = F.array(event(0, "delta", draft), abandoned, event(2, "regenerate", first), event(3, "delta", second))
    way = F.pmod(F.col("turn") + F.coalesce(F.col(conv).cast("long"), F.lit(0)), F.lit(3))
    events = F.when(way == 0, plain).when(way == 1, edited).otherwise(again)
    return messages.select(conv, "role", F.explode(events).alias("e")).select(conv, "e.seq", "e.turn", "e.kind", "role", "e.text")


def render(messages: DataFrame, conv: str = "conv_id", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, segments (array of text and loss; joined they are formatted).

    Messages are taken by turn, then role and text. A null role counts as empty, a null text too.
    """

    def segments(m: Column) -> Column:
        text, role = escape(F.coalesce(m["text"], F.lit(""))), F.coalesce(m["role"], F.lit(""))
        piece = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
        user = F.array(piece(F.concat(F.lit(USER_OPEN), text, F.lit(USER_CLOSE)), False))
        trained = F.array(piece(F.lit(" "), False), piece(text, True), piece(F.lit(EOS), False))
        head = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_TEXT))
        other = F.array(piece(F.concat(head, text, F.lit(ROLE_CLOSE)), False))
        return F.when(role == "user", user).when(role == trained_role, trained).otherwise(other)

    gathered = messages.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    start = F.array(F.struct(F.lit(BOS).alias("text"), F.lit(False).alias("loss")))
    return gathered.select(
        conv, F.concat(start, F.flatten(F.transform("messages", segments))).alias("segments")
    ).select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns of a rendered string, as an array of role and text."""

    def turn(x: Column) -> Column:
        size = F.length(x)
        body = F.substring(x, F.lit(len(ROLE_OPEN) + 1), size - len(ROLE_OPEN) - len(ROLE_CLOSE))
        role = F.substring_index(body, ROLE_TEXT, 1)
        pair = lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text"))
        return (
            F.when(
                x.startswith(USER_OPEN),
                pair(F.lit("user"), F.substring(x, F.lit(len(USER_OPEN) + 1), size - len(USER_OPEN) - len(USER_CLOSE))),
            )
            .when(x.startswith(ROLE_OPEN), pair(role, F.substring(body, F.length(role) + len(ROLE_TEXT) + 1, F.length(body))))
            .otherwise(pair(F.lit("assistant"), F.substring(x, F.lit(2), size - 1 - len(EOS))))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1; every row is a turn, rows with equal turns go by role and text.

    The turns are first written out as a log with deltas, edits and regenerations, which fold() resolves.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    probe = f"{EOS}[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    messages = rows.unionByName(extra).withColumn("turn", F.row_number().over(in_order).cast("long"))
    read = render(fold(streamed(messages))).withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(trained, lambda s: unescape(s["text"])), "")
    return read.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    escaped = r"replace(text, '\', '\\')"
    for control in CONTROLS:
        escaped = f"replace({escaped}, '{control}', '{control[0]}\\{control[1:]}')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length({escaped}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
            ELSE 23 + length({escaped.replace("text", "role", 1)}) END AS chars
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


SQL = _sql()
