"""Preference formatting of chats, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a turn's text, and after it.
HEAD, TAIL = "<|{}|>\n", "\n"


def conversations_of(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): the turns (role, text) of each conversation in order of turn, role and text; null turns come last."""
    some = F.struct(F.col("turn").isNull().alias("n"), "turn", "role", "text")
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(some)).alias("t")).select(key, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.format_string("<|%s|>\n", F.coalesce(turn["role"], F.lit("")))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit(TAIL))), "")


def _mask(turns: Column, learn: str) -> Column:
    """[start, end) in code points of what is learned: the texts of the role's turns, with their closing line."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(F.coalesce(t["text"], F.lit(""))) + len(TAIL)
        spans = F.when(t["role"].eqNullSafe(learn), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """pairs (chosen, rejected: arrays of (role, text)) with n_prompt, prompt, and for both sides completion and mask.

    The prompt is the longest common prefix of turns, rendered once: turns are equal if role and text are (null equals null).
    The completions are the rest of each side. A mask has the code-point ranges of the completion that a model learns, the turns
    of `learn`. Equal sides have empty completions; sides without a common turn have an empty prompt; a null side
    counts as one without turns; an empty table gives an empty result.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    df = pairs.withColumn("chosen", F.coalesce("chosen", none)).withColumn("rejected", F.coalesce("rejected", none))
    same = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: z["chosen"].eqNullSafe(z["rejected"]) & z["chosen"].isNotNull())
    first = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)).cast("int")
    df = df.withColumn("n_prompt", first - 1)
    rest = lambda side: F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side), F.lit(1)))
    df = df.withColumn("prompt", _rendered(F.slice("chosen", F.lit(1), F.col("n_prompt"))))
    for side in ("chosen", "rejected"):
        df = df.withColumn(f"{side}_rest", rest(F.col(side)))
        df = df.withColumn(f"{side}_completion", _rendered(F.col(f"{side}_rest"))).withColumn(f"{side}_mask", _mask(F.col(f"{side}_rest"), learn))
    return df.drop("chosen", "rejected", "chosen_rest", "rejected_rest")


def paired_with_neighbour(conversations: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """(key, chosen, rejected): rejected is the conversation with its last `learn` turn's text taken from the partner's last one.

    The partner has the key with the lowest bit flipped. Where there's no partner, or one of the two has no such turn, rejected
    is null. Null keys are left out. A repeated (key, turn) is a turn of its own.
    """
    own = F.expr(f"filter(turns, t -> t.role <=> '{learn}')")
    some = conversations.filter(F.col(key).isNotNull())
    partner = some.filter(F.size(own) > 0).select(F.col(key).bitwiseXOR(F.lit(1)).alias(key), F.struct(F.element_at(own, -1)["text"].alias("text")).alias("other"))
    at = F.array_max(F.expr(f"transform(turns, (t, i) -> CASE WHEN t.role <=> '{learn}' THEN i END)"))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("at"), F.col("other.text")).otherwise(t["text"]).alias("text")))
    rejected = F.when(F.col("other").isNotNull() & F.col("at").isNotNull(), swapped)
    return some.withColumn("at", at).join(partner, key, "left").select(key, F.col("turns").alias("chosen"), rejected.alias("rejected"))
