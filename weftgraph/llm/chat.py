"""Multi-party chat formatting by perspective rotation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, system_role: str = "system") -> DataFrame:
    """Render every dialogue once for each participant, as one row per (participant, turn).

    ``turns`` has conv_id, turn, role, text; role names the speaker. In the rendering
    for ``perspective`` that speaker sits as assistant, everybody else as a named
    user; turns of ``system_role`` stay system turns and are no participant.
    ``rendered`` is the turn's piece of the transcript: the transcript is the pieces in
    order of (turn, role, content). Only what the perspective's speaker says is
    trained on: code points ``loss_from`` to ``loss_to`` of ``rendered``, both 0 for
    masked turns. Rows stay apart instead of one transcript a row, so that a dialogue
    of any length (it may hold a third of all turns) never meets in one task.

    Null text is an empty turn. A null role speaks as user ``unknown`` and has no
    perspective. Null conv_id is a dialogue like any other. Repeated rows are repeated
    turns. A dialogue without participants, or an empty table, gives no rows. Markers
    inside a text or a name are broken up by a space so that they cannot end a turn; line breaks in a name are spaces in the header.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    speakers = (
        turns.filter(F.col("role").isNotNull() & (F.col("role") != system_role))
        .select(F.col("conv_id").alias("of"), F.col("role").alias("perspective"))
        .distinct()
    )
    rows = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    seat = F.when(own, "assistant").when(F.col("role") == system_role, "system").otherwise("user")
    name = F.when(seat == "user", F.coalesce("role", F.lit("unknown")))
    content = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    rows = rows.select("conv_id", "perspective", "turn", seat.alias("seat"), name.alias("name"), content.alias("content"))
    shown = F.replace(F.regexp_replace("name", r"[\r\n]", " "), F.lit("<|im_"), F.lit("<| im_"))
    head = F.concat(F.lit(OPEN), "seat", F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    trained = F.col("seat") == "assistant"
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        "seat",
        "name",
        F.concat(head, "content", F.lit(CLOSE + "\n")).alias("rendered"),
        F.when(trained, F.char_length(head)).otherwise(0).cast("long").alias("loss_from"),
        F.when(trained, F.char_length(head) + F.char_length("content") + len(CLOSE)).otherwise(0).cast("long").alias("loss_to"),
    )


ROTATE_SQL = """
WITH speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), seats AS (
  SELECT c.conv_id, s.perspective, c.turn,
         CASE WHEN c.role = s.perspective THEN 'assistant' WHEN c.role = 'system' THEN 'system' ELSE 'user' END AS seat,
         c.role, replace(coalesce(c.text, ''), '<|im_', '<| im_') AS content
  FROM conversations c JOIN speakers s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
), named AS (
  SELECT *, CASE WHEN seat = 'user' THEN coalesce(role, 'unknown') END AS name FROM seats
), headed AS (
  SELECT *, '<|im_start|>' || seat || coalesce(' name=' || replace(regexp_replace(name, '[\\r\\n]', ' ', 'g'), '<|im_', '<| im_'), '') || chr(10) AS head FROM named
)
SELECT conv_id, perspective, turn, seat, name, head || content || '<|im_end|>' || chr(10) AS rendered,
       CASE WHEN seat = 'assistant' THEN length(head) ELSE 0 END AS loss_from,
       CASE WHEN seat = 'assistant' THEN length(head) + length(content) + 10 ELSE 0 END AS loss_to
FROM headed
"""
