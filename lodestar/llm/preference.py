"""Preference formatting: conversation pairs as one prompt and two masked completions.

The longest common prefix of turns (role and text) of chosen and rejected is rendered once, as the prompt. What follows is
rendered for each, with a mask as run lengths in characters: only what the assistant says, with its end mark, is trained
("12-,30+" is 12 characters that are not and 30 that are).

Only DataFrame functions are used; a conversation is one row, as it is one training example.

Defined results: null role counts as "user", null text as empty; turns with the same number come in the order of role and text,
null numbers first; turns without conv_id belong to no conversation and are left out; conversations that are equal have
all turns in the prompt and empty completions; a completion without turns is empty and has an empty mask; no turns, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text): conv_id, turns (array of role, text in order)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lists = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    before, after = HEAD.split("{}")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(TAIL))), "")


def _mask(turns: Column) -> Column:
    def runs(t: Column) -> Column:
        head, body = F.length(t["role"]) + len(HEAD) - 2, F.length(t["text"]) + len(TAIL)
        return F.when(t["role"] == "assistant", F.concat(head.cast("string"), F.lit("-,"), body.cast("string"), F.lit("+"))).otherwise(F.concat((head + body).cast("string"), F.lit("-")))

    return F.array_join(F.transform(turns, runs), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected; arrays of role, text): pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    c, r = F.col("chosen"), F.col("rejected")
    shorter = F.least(F.size(c), F.size(r))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: (i <= shorter) & (F.get(c, i - 1) != F.get(r, i - 1)))
    p = pairs.withColumn("n_prefix", F.coalesce(F.array_min(differs) - 1, shorter))
    rest = lambda a: F.slice(a, F.col("n_prefix") + 1, F.greatest(F.size(a) - F.col("n_prefix"), F.lit(0)))
    p = p.select("pair_id", "n_prefix", F.slice(c, F.lit(1), F.col("n_prefix")).alias("_p"), rest(c).alias("_c"), rest(r).alias("_r"))
    return p.select(
        "pair_id", "n_prefix", _render(F.col("_p")).alias("prompt"), _render(F.col("_c")).alias("chosen"), _render(F.col("_r")).alias("rejected"),
        _mask(F.col("_c")).alias("chosen_mask"), _mask(F.col("_r")).alias("rejected_mask"),
    )


def repeated_answer_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation in which the assistant speaks: rejected is the conversation up to the assistant's last
    turn, which there repeats the assistant's turn before (nothing, if there was none). pair_id is conv_id.
    """
    c = conversations(turns)
    spoken = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == "assistant")
    c = c.withColumn("_at", spoken).where(F.size("_at") > 0)
    last, n = F.element_at("_at", -1), F.size("_at")
    earlier = F.when(n > 1, F.get("turns", F.get("_at", n - 2) - 1)["text"]).otherwise(F.lit(""))
    swapped = F.struct(F.lit("assistant").alias("role"), earlier.alias("text"))
    return c.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), last - 1), F.array(swapped)).alias("rejected"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), a AS (
  SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS spoken FROM t
), p AS (
  SELECT conv_id, turns AS c,
         list_concat(turns[1:spoken[-1] - 1], [{'role': 'assistant', 'text': CASE WHEN len(spoken) > 1 THEN turns[spoken[-2]].text ELSE '' END}]) AS r
  FROM a WHERE len(spoken) > 0
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))) AS k FROM p
)
SELECT conv_id, CAST(k AS INTEGER) AS n_prefix,
       array_to_string(list_transform(c[1:k], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt,
       array_to_string(list_transform(c[k + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS chosen,
       array_to_string(list_transform(r[k + 1:], lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS rejected,
       array_to_string(list_transform(c[k + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN (length(t.role) + 5) || '-,' || (length(t.text) + 8) || '+' ELSE (length(t.role) + length(t.text) + 13) || '-' END), ',') AS chosen_mask,
       array_to_string(list_transform(r[k + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN (length(t.role) + 5) || '-,' || (length(t.text) + 8) || '+' ELSE (length(t.role) + length(t.text) + 13) || '-' END), ',') AS rejected_mask
FROM n
"""
