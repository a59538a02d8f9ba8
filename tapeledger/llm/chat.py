"""Conversations as training text with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeledger.llm.common import read


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    trained: bool = False


@dataclass(frozen=True)
class Template:
    """Marks around turns. Every mark starts with ``<`` or ``[``, which texts hold only escaped."""

    start: str = "<s>"
    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>\n", "\n<</SYS>>"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("[ANS] ", "</s>", trained=True),
        }
    )
    name_before: str = "[ROLE]"
    name_after: str = "[/ROLE] "
    other_after: str = "</s>"


# Role that may follow in a state, and the state it leads to. A conversation is valid if it ends in DONE.
TURN_ORDER = {
    "start": {"system": "open", "user": "asked"},
    "open": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
DONE = "answered"
BROKEN = "broken"


def escape(text: Column) -> Column:
    """Text in which no control string can occur: a backslash follows each ``<`` and ``[``; backslashes are doubled."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<")), F.lit("\\\\"), F.lit("\\"))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _turn_segments(turn: Column, template: Template) -> Column:
    role = turn["role"]
    before = F.concat(F.lit(template.name_before), escape(role), F.lit(template.name_after))
    after, trained = F.lit(template.other_after), F.lit(False)
    for name, marks in template.roles.items():
        before = F.when(role == name, F.lit(marks.before)).otherwise(before)
        after = F.when(role == name, F.lit(marks.after)).otherwise(after)
        trained = F.when(role == name, F.lit(marks.trained)).otherwise(trained)
    no = F.lit(False)
    return F.array(_segment(F.concat(F.lit(template.start), before), no), _segment(escape(turn["text"]), trained), _segment(after, no))


def _next_state(state: Column, role: Column) -> Column:
    out = F.lit(BROKEN)
    for source, moves in TURN_ORDER.items():
        for name, target in moves.items():
            out = F.when((state == source) & (role == name), F.lit(target)).otherwise(out)
    return out


def format_chat(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template | None = None
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``valid``, ``valid_turns``, ``segments`` and ``formatted``.

    ``segments`` are the pieces of the output in order, each with its ``loss`` flag; ``formatted`` is
    their concatenation and ``parse_chat`` reads it back. A state machine over the roles says how
    many turns keep the order (``valid_turns``) and whether the whole is a finished exchange
    (``valid``); conversations out of order are formatted all the same. Turns of one number are put
    in order of role and text, a null number first; null texts and roles are empty; other roles are
    named in the output and carry no loss. A null conversation is a conversation of its own, further
    columns are ignored, an empty table gives an empty table.

    The text of a conversation is one value, so its turns meet in one task by definition.
    """
    template = template or Template()
    turn = F.struct(df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    turns = df.select(df[conv_col].alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.struct(F.lit("start").alias("state"), F.lit(0).alias("good"))

    def step(s: Column, t: Column) -> Column:
        state = _next_state(s["state"], t["role"])
        return F.struct(state.alias("state"), (s["good"] + (state != BROKEN).cast("int")).alias("good"))

    walked = turns.withColumn("walk", F.aggregate("turns", first, step))
    shaped = walked.withColumn("segments", F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))))
    return shaped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        (F.col("walk")["state"] == DONE).alias("valid"),
        F.col("walk")["good"].cast("long").alias("valid_turns"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse_chat(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: an array of ``role`` and ``text``."""
    template = template or Template()

    def inner(block: Column, before: int, after: int) -> Column:
        return unescape(F.substr(block, F.lit(before + 1), F.length(block) - before - after))

    def turn(block: Column) -> Column:
        named = F.substring_index(block, template.name_after, 1)
        role = inner(named, len(template.name_before), 0)
        text = unescape(F.substr(block, F.length(named) + len(template.name_after) + 1, F.length(block) - F.length(named) - len(template.name_after) - len(template.other_after)))
        out = F.struct(role.alias("role"), text.alias("text"))
        for name, marks in template.roles.items():
            known = F.struct(F.lit(name).alias("role"), inner(block, len(marks.before), len(marks.after)).alias("text"))
            out = F.when(F.startswith(block, F.lit(marks.before)), known).otherwise(out)
        return out

    blocks = F.split(formatted, F.concat(F.lit("\\Q"), F.lit(template.start), F.lit("\\E")), -1)
    return F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(extra))
    made = format_chat(talks).withColumn("turns", parse_chat(F.col("formatted"))).withColumn("loss_text", loss_text(F.col("segments")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


QUERIES = {
    "op7_chat": (
        op7_chat,
        r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS escaped,
  length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) AS escaped_role,
  row_number() OVER w AS k, lag(role) OVER w AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + 3 + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 18 + escaped_role END)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN last = 'user' THEN role = 'assistant' WHEN last = 'assistant' THEN role = 'user'
    WHEN last = 'system' AND k = 2 THEN role = 'user' ELSE false END) AND max(CASE WHEN k = n THEN role END) = 'assistant' AS valid
FROM e GROUP BY conv_id""",
    )
}
