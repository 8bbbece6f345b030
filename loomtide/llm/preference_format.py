"""Preference formatting of chosen and rejected conversations. DataFrame functions only.

The longest common prefix of turns of the two is rendered once, as the prompt; what follows in each is its completion, with the
stretches of characters that bear loss: what assistants say, with the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn.
START, BODY, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, its turns (role, text) and those of its neighbour (2i and 2i + 1; empty if there is none), in order of turn, role and text.

    Null roles and texts are empty, a null turn comes first. Both are gathered at once, so that the table is read and dealt once; the
    turns without a conv_id are one conversation, without a neighbour.
    """
    one = F.struct(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = conversations.groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    rows = both.select("all", F.explode(F.array_distinct(F.transform("all", lambda t: t.conv_id))).alias("conv_id"))
    of = lambda own: F.transform(F.filter("all", lambda t: t.conv_id.eqNullSafe(F.col("conv_id")) == F.lit(own)), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return rows.select("conv_id", of(True).alias("turns"), of(False).alias("next"))


def _text(turn: Column) -> Column:
    return F.concat(F.lit(START), turn.role, F.lit(BODY), turn.text, F.lit(END))


def _rendered(part: Column) -> Column:
    return F.array_join(F.transform(part, _text), "")


def _loss(part: Column) -> Column:
    """(start, length) in characters of the stretches of the rendered part that bear loss."""
    began = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = (F.length(turn.role) + len(START) + len(BODY)).cast("long")
        body = (F.length(turn.text) + len(END)).cast("long")
        span = F.array(F.struct((acc.at + head).alias("start"), body.alias("length")))
        return F.struct((acc.at + head + body).alias("at"), F.when(turn.role == LEARNED, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(part, began, step, lambda acc: acc.spans)


def preference_format(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_loss and rejected_loss of pairs (pair_id, chosen, rejected: arrays of (role, text)).

    A null side has no turns. If one side begins with the whole other side, or both are equal, the completions that are left are empty.
    Each row is formatted by itself; equal rows give equal rows. Other columns are not read.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & (x.role == y.role) & (x.text == y.text))
    rows = rows.withColumn("differs", F.array_position(same, False))
    rows = rows.withColumn("n", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return rows.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), _rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), _rendered(rest("c")).alias("chosen"), _rendered(rest("r")).alias("rejected"), _loss(rest("c")).alias("chosen_loss"), _loss(rest("r")).alias("rejected_loss"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for preference_format from plain conversations: chosen is a conversation up to its last reply; rejected has in its place the
    last reply of the conversation next to it (2i and 2i + 1), if there is one. Without a reply both are the whole conversation."""
    last = lambda c: (F.size(c) - F.array_position(F.reverse(F.transform(c, lambda t: t.role == LEARNED)), True) + 1).cast("int")  # noqa: E731  of the last reply; size + 1 if none
    rows = conversation_pairs(conversations).select("conv_id", "turns", last("turns").alias("at"), F.get("next", last("next") - 1).alias("instead"))
    before = F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.filter(F.array("instead"), lambda t: t.isNotNull()))
    return rows.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("at")).alias("chosen"), F.when(F.col("at") > F.size("turns"), F.col("turns")).otherwise(before).alias("rejected"))


def digest(formatted: DataFrame) -> DataFrame:
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s.length)
    return formatted.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected", chars("chosen_loss").alias("chosen_loss_chars"), chars("rejected_loss").alias("rejected_loss_chars"))


SQL = r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations GROUP BY conv_id),
a AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS pos FROM t),
p AS (SELECT x.conv_id, x.turns, x.pos, turns[pos].text AS reply, (SELECT y.turns[y.pos].text FROM a y WHERE y.conv_id = xor(x.conv_id, 1::BIGINT)) AS other FROM a x),
n AS (SELECT *, CASE WHEN pos IS NULL THEN len(turns) WHEN other IS NOT NULL AND other = reply THEN pos ELSE pos - 1 END AS n FROM p)
SELECT conv_id, n::BIGINT AS prompt_turns,
       array_to_string(list_transform(turns[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') AS prompt,
       CASE WHEN n < pos THEN '<|assistant|>' || chr(10) || reply || '<|end|>' || chr(10) ELSE '' END AS chosen,
       CASE WHEN n < pos AND other IS NOT NULL THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END AS rejected,
       CASE WHEN n < pos THEN length(reply) + 8 ELSE 0 END::BIGINT AS chosen_loss_chars,
       CASE WHEN n < pos AND other IS NOT NULL THEN length(other) + 8 ELSE 0 END::BIGINT AS rejected_loss_chars
FROM n
"""
