"""Chat formatting by perspective rotation.

For every participant (role) of a conversation the dialogue is rendered with that speaker as assistant and all others
as named users; only the assistant's text is in the loss mask. A row holds one turn of one rendering, with its
characters' place in the whole rendering, so a conversation of any length is spread over many tasks; render() joins the
turns. Everything is built-in column functions.

A marker inside a text or name can't pass for one of the rendering's: "<|" is rendered as "< |", and "|>" in a name as "| >".

Defined results: a null role is the participant "unknown", a null text is empty, null conversation ids form one
conversation (an empty id is another one), turns without a number come first, equal turns are ordered by role and text, equal rows
are turns of their own; "system" is a participant like others, with a rendering of its own; extra columns are not read; an empty
table gives an empty result. Very long turns are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.llm.common import prefix_sums

ASSISTANT = "<|assistant|>\n"
END = "<|end|>\n"


def harmless(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role ("assistant" or "user"), segment, start, end (characters), mask_start, mask_end.

    The mask covers the text and the end mark of the assistant's turns; elsewhere it is empty (its end is its start).
    """
    read = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), harmless(F.coalesce("text", F.lit(""))).alias("_text")
    ).withColumn("_conv", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("w")))
    people = read.select("_conv", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, ASSISTANT).otherwise(F.concat(F.lit("<|user name="), F.replace(harmless(F.col("speaker")), F.lit("|>"), F.lit("| >")), F.lit("|>\n")))
    each = read.join(people, "_conv").withColumn("_head", F.length(header).cast("long"))
    each = each.withColumn("segment", F.concat(header, "_text", F.lit(END))).withColumn("_size", F.length("segment").cast("long"))
    each = each.withColumn("_key", F.concat_ws("\x00", "_conv", "perspective"))
    placed = prefix_sums(each, "_key", ["turn", "speaker", "_text"], "_size", "start")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker",
        F.when(own, "assistant").otherwise("user").alias("role"),
        "segment", "start", (F.col("start") + F.col("_size")).alias("end"),
        F.when(own, F.col("start") + F.col("_head")).otherwise(F.col("start")).alias("mask_start"),
        F.when(own, F.col("start") + F.col("_size")).otherwise(F.col("start")).alias("mask_end"),
    )


def render(placed: DataFrame) -> DataFrame:
    """conv_id, perspective, text, mask (array of start and end): whole renderings of turns(), each in one row."""
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "segment", "mask_start", "mask_end")))
    return placed.groupBy("conv_id", "perspective").agg(parts.alias("_p")).select(
        "conv_id", "perspective",
        F.array_join(F.transform("_p", lambda p: p["segment"]), "").alias("text"),
        F.transform(F.filter("_p", lambda p: p["mask_end"] > p["mask_start"]), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end"))).alias("mask"),
    )


ORACLE_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body, coalesce('v' || CAST(conv_id AS VARCHAR), 'w') AS c
  FROM conversations),
p AS (SELECT DISTINCT c, speaker AS perspective FROM r),
e AS (
  SELECT *, CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(speaker, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head FROM r JOIN p USING (c)),
s AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM e),
q AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY c, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM s)
SELECT conv_id, perspective, turn, speaker, CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role, segment, start,
       CAST(start + length(segment) AS BIGINT) AS "end",
       CAST(CASE WHEN speaker = perspective THEN start + length(head) ELSE start END AS BIGINT) AS mask_start,
       CAST(CASE WHEN speaker = perspective THEN start + length(segment) ELSE start END AS BIGINT) AS mask_end
FROM q
"""
