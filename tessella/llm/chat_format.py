"""Chat formatting: every participant's view of a multi-party dialogue.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as named
users and system turns as they are; the mask holds the character spans of the assistant's own words with their end
mark. A conversation of any length is rendered in parts of consecutive turns, one row a part and view; offsets run over
the whole dialogue, so joining the parts' texts gives it.

Defined cases: a null text is empty; a null role is the speaker "unknown"; a null turn comes first; turns with equal
numbers are ordered by speaker and text; repeated rows are turns of their own; a conversation with system turns only
has no participant and gives no row; a null conversation id is a conversation like another; the turn mark inside a text
is broken by a space, and control characters, angle brackets and bars in a name become underscores. Parts are by turn
number, so their size is bounded where turn numbers don't repeat without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def perspectives(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 256
) -> DataFrame:
    """(conversation, perspective, part, n_turns, n_targets, char_start, text, mask: array<struct<start, end>>)."""
    number = F.coalesce(F.col(turn).cast("bigint"), F.lit(-1))
    rows = turns.select(
        F.col(conversation).alias("c"),
        F.floor(number / part_turns).alias("part"),
        F.struct(
            number.alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"),
            F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
        ).alias("x"),
    )
    speakers = rows.select(F.col("c").alias("c2"), F.col("x.speaker").alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
    parts = rows.groupBy("c", "part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    views = parts.join(speakers, F.col("c").eqNullSafe(F.col("c2"))).drop("c2")

    def head(x):
        named = F.concat(F.lit("user name="), F.regexp_replace(x["speaker"], r"[\x00-\x20<>|]", "_"))
        label = F.when(x["speaker"] == SYSTEM, SYSTEM).when(x["speaker"] == F.col("perspective"), "assistant").otherwise(named)
        return F.concat(F.lit(START), label, F.lit("\n"))

    shown = F.transform("xs", lambda x: F.struct(head(x).alias("head"), x["text"].alias("text"), (x["speaker"] == F.col("perspective")).alias("own")))
    views = views.withColumn("ys", shown)
    views = views.withColumn("lengths", F.transform("ys", lambda y: (F.length(y["head"]) + F.length(y["text"]) + len(END)).cast("bigint")))
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)
    order = Window.partitionBy("c", "perspective").orderBy("part")
    views = views.withColumn("size", size).withColumn("char_start", F.sum("size").over(order) - F.col("size"))

    def span(y, i):
        before = F.aggregate(F.slice("lengths", 1, i), F.col("char_start"), lambda a, n: a + n)
        start = before + F.length(y["head"])
        return F.struct(start.alias("start"), (start + F.length(y["text"]) + len(END) - 1).alias("end"), y["own"].alias("own"))

    spans = F.filter(F.transform("ys", span), lambda s: s["own"])
    whole = F.array_join(F.transform("ys", lambda y: F.concat(y["head"], y["text"], F.lit(END))), "")
    return views.select(
        F.col("c").alias(conversation),
        "perspective",
        "part",
        F.size("ys").cast("bigint").alias("n_turns"),
        F.size(spans).cast("bigint").alias("n_targets"),
        "char_start",
        whole.alias("text"),
        F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("mask"),
    )


def digest(views: DataFrame) -> DataFrame:
    """The mask as text, "start-end" joined by ";", for comparisons."""
    return views.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, COALESCE(turn, -1) AS turn, COALESCE(role, 'unknown') AS speaker,
    replace(COALESCE(text, ''), '<|im_', '<| im_') AS body, FLOOR(COALESCE(turn, -1) / 256.0)::BIGINT AS part
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
h AS (
  SELECT t.*, perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
    ELSE 'user name=' || regexp_replace(speaker, '[\x00-\x20<>|]', '_', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS seg FROM h),
o AS (
  SELECT *, SUM(length(seg)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, body ROWS UNBOUNDED PRECEDING) - length(seg) AS pos
  FROM s)
SELECT conv_id, perspective, part, COUNT(*) AS n_turns, COUNT(*) FILTER (WHERE speaker = perspective) AS n_targets,
  MIN(pos)::BIGINT AS char_start, string_agg(seg, '' ORDER BY turn, speaker, body) AS text,
  COALESCE(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(body) + 10)::BIGINT, ';' ORDER BY turn, speaker, body)
    FILTER (WHERE speaker = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
