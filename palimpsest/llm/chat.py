"""Chat formatting: fold event logs into conversations and render them, in DataFrame functions only.

An event has a conversation, a message number, a sequence number, a kind, a role and a text:

* ``message`` is a complete message (every such row is a turn of its own);
* ``delta`` appends to the message, ``edit`` replaces its text;
* ``regenerate`` empties its text, so that later deltas make it anew, and takes over a role it brings;
* ``delete`` removes the message; what comes after it under that number is a new message.

Other kinds change nothing. A log that begins without ``message`` begins a message with its first event.

Events are folded per message first, so that a hot conversation is spread over its messages, and only
the final messages of a conversation meet in one row. Folding takes the last event that sets a text and
joins the deltas after it once, so a message streamed in n deltas costs n steps. A turn is rendered as
``<|im_start|>role\\ntext<|im_end|>\\n``; control strings in roles and texts get a backslash inside and
lose it again on reading, so every text comes back exactly.

:func:`as_events` makes the log that a service would have kept of rows by turn: what an assistant says is
streamed, thrown away, asked for again and streamed in ``STREAMED`` pieces; what others say is sent and
then edited into its final text.

Defined results: null text and null role count as empty, null conversations form one conversation,
null sequence numbers come first. Ties are put in order by role and text; repeated rows are repeated
turns. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns here or in other common templates: an opening character and the rest.
CONTROL = r"\||/?s>|<SYS>>|</SYS>>|/?INST\]"
TRAINED_ROLES = ("assistant",)
#: Pieces in which :func:`as_events` streams a text.
STREAMED = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles are one line: backslash and line feed are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\")  # between pairs of backslashes only those of line feeds are left
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, seq, role and text of every message as it stands after all its events."""
    kept = events.select(
        F.col("conv_id"),
        F.col("msg"),
        F.struct(F.col("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("kind")).alias("e"),
    )
    logs = kept.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("log"))
    log, n = F.col("log"), F.size("log")
    at = F.sequence(F.lit(0), n - 1)
    starts = F.filter(at, lambda i: (i == 0) | (log[i]["kind"] == "message") | (log[F.greatest(i - 1, F.lit(0))]["kind"] == "delete"))
    spans = let(starts, lambda s: F.transform(s, lambda x, j: F.struct(x.alias("lo"), F.coalesce(F.get(s, j + 1), n).alias("hi"))))

    def state(span: Column) -> Column:
        part = F.slice(log, span["lo"] + 1, span["hi"] - span["lo"])

        def told(seg: Column) -> Column:
            sets = F.transform(seg, lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i).otherwise(0))
            roles = F.filter(seg, lambda e: (e["kind"] == "regenerate") & (e["role"] != ""))
            role = F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).otherwise(seg[0]["role"])

            def text(last: Column) -> Column:
                own = F.when(seg[last]["kind"] == "regenerate", F.lit("")).otherwise(seg[last]["text"])
                more = F.filter(F.slice(seg, last + 2, F.size(seg)), lambda e: e["kind"] == "delta")
                return F.concat(own, F.array_join(F.transform(more, lambda e: e["text"]), ""))

            return F.struct(seg[0]["seq"].alias("seq"), role.alias("role"), let(F.array_max(sets), text).alias("text"), (F.element_at(seg, -1)["kind"] == "delete").alias("gone"))

        return let(part, told)

    return logs.select("conv_id", F.explode(F.filter(F.transform(spans, state), lambda m: ~m["gone"])).alias("m")).select("conv_id", "m.seq", "m.role", "m.text")


def format_chats(events: DataFrame, trained_roles: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """conv_id, the rendered conversation, and its segments, of which those under the loss mask are marked.

    The segments put together are the rendered text.
    """
    turns = final_messages(events).select(
        "conv_id",
        F.struct("seq", "role", "text").alias("m"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))

    def cut(m: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")), F.lit(False)),
            part(escape(m["text"]), m["role"].isin(*trained_roles)),
            part(F.lit(f"{STOP}\n"), F.lit(False)),
        )

    segments = whole.select("conv_id", F.flatten(F.transform("turns", cut)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a rendered conversation, read back from its marks."""
    cut = F.split(formatted, r"<\|im_start\|>")
    blocks = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))

    def back(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        rest = F.substring(block, F.length(role) + 2, F.length(block))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring_index(rest, STOP, 1)).alias("text"))

    return F.transform(blocks, back)


def as_events(rows: DataFrame) -> DataFrame:
    """Rows by turn as the events that made them. Rows that repeat a turn are messages of their own."""
    told = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = told.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    size = F.greatest(F.lit(1), F.ceil(F.length("text") / STREAMED)).cast("int")
    event = lambda step, kind, said: F.struct(step.alias("step"), F.lit(kind).alias("kind"), said.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(STREAMED - 1)), lambda i: event(i + 3, "delta", F.col("text").substr(i * size + 1, size)))
    thrown_away = F.array(event(F.lit(0), "message", F.lit("")), event(F.lit(1), "delta", F.substring("text", 1, 20)), event(F.lit(2), "regenerate", F.lit("")))
    edited = F.array(event(F.lit(0), "message", F.substring("text", 2, 20)), event(F.lit(1), "edit", F.col("text")))
    log = counted.withColumn("e", F.explode(F.when(F.col("role").isin(*TRAINED_ROLES), F.concat(thrown_away, pieces)).otherwise(edited)))
    return log.select("conv_id", F.struct("turn", F.xxhash64("role", "text").alias("hash"), F.md5("text").alias("md5"), "copy").alias("msg"), F.struct("turn", "e.step").alias("seq"), "e.kind", "role", "e.text")


def digest_chats(chats: DataFrame) -> DataFrame:
    """Counts and digests of rendered conversations, read back from the rendering and its mask."""
    said = chats.select(
        "conv_id",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("loss_texts"),
    )
    loss = F.array_join("loss_texts", "")
    return said.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, digests and sizes of every conversation, rebuilt from its event log, rendered and read back.

    Null roles and texts count as empty, null conversations are one conversation, null turns come first, ties
    are ordered by role and text, repeated rows are repeated turns. Besides the table there is conversation -1.
    Other columns are not read.
    """
    ok = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return digest_chats(format_chats(as_events(rows.unionByName(own))))


#: The control strings, their escapes and the marks are plain text, so SQL can tell every column.
ORACLE_OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\\\2\3', 'g') AS safe FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(safe) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
