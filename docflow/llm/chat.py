"""Preference formatting in DataFrame functions only.

A pair of conversations shares its opening turns. The longest common turn prefix is rendered once as the prompt; what
follows in the chosen and in the rejected one are the two completions, with the spans that training may score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a rendered turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
_TURNS = "array<struct<role:string,text:string>>"
#: What the user says after an answer that was not liked, in pairs made of single conversations.
AGAIN = "Try again."


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turns): the turns of each conversation in order (equal numbers: by role, then text), repeats included.

    Null turn numbers come first; null roles and texts are empty. Rows without a key are conversations of one turn each,
    so they never meet in one group. A conversation becomes one text and so is one group, whatever its length.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col(key).cast("long").alias(key), turn.alias("t"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_lone")).groupBy(key, "_lone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return rows.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_pairs(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, chosen, rejected) made of single conversations, which part at their first, a middle or their last answer.

    Chosen: the whole conversation. Rejected: in place of one of its answers it has the next one (after the last the first
    again), or an empty one where they are equal. Which one that is goes by the key modulo 3. What follows it stays on both
    sides where the key modulo 4 is 0 or 1, is gone from the rejected side where it is 2, and is followed there by one more
    turn of the user, who asks for another answer, where it is 3. Without an answer both sides are the conversation. A null
    key counts as 0.
    """
    k = F.coalesce(F.col(key), F.lit(0))
    answers = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda x: x.isNotNull())
    rows = convs.select(F.col(key), F.col("turns").alias("chosen"), answers.alias("answers"), F.pmod(k, F.lit(4)).alias("end"), F.pmod(k, F.lit(3)).alias("which"))
    m = F.size("answers")
    rows = rows.withColumn("nth", F.when(F.col("which") == 0, 0).when(F.col("which") == 1, F.floor(m / 2).cast("int")).otherwise(m - 1))
    rows = rows.withColumn("at", F.get("answers", F.col("nth"))).withColumn("other", F.get("answers", (F.col("nth") + 1) % F.greatest(m, F.lit(1))))
    said, next_ = F.get(F.col("chosen"), F.col("at"))["text"], F.get(F.col("chosen"), F.col("other"))["text"]
    stale = F.struct(F.lit("assistant").alias("role"), F.when(said == next_, F.lit("")).otherwise(next_).alias("text"))
    rest = F.slice("chosen", F.col("at") + 2, F.size("chosen"))
    more = F.array(F.struct(F.lit("user").alias("role"), F.lit(AGAIN).alias("text")))
    rest = F.when(F.col("end") < 2, rest).when(F.col("end") == 2, F.array().cast(_TURNS)).otherwise(F.concat(rest, more))
    changed = F.concat(F.slice("chosen", 1, F.col("at")), F.array(stale), rest)
    return rows.select(key, "chosen", F.when(m > 0, changed).otherwise(F.col("chosen")).cast(_TURNS).alias("rejected"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _scored(turns: Column) -> Column:
    """Spans (start, length), in characters of the rendered turns: the texts and end marks of the answers."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN + MIDDLE)
        body = F.length(t["text"]) + len(CLOSE)
        span = F.struct((state["at"] + head).alias("start"), body.alias("length"))
        return F.struct((state["at"] + head + body).alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, step, add, lambda s: s["spans"])


def preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, n_prompt_turns, prompt, chosen, rejected, chosen_scored, rejected_scored).

    ``pairs`` has the turns of both sides as arrays of (role, text). Turns are common as long as role and text are equal.
    The scored spans lie in the completions; everything else is masked. Null and empty sides have empty completions;
    equal sides are all prompt. Every row keeps a row; other columns are left out; an empty table gives no rows.
    """
    empty = F.array().cast(_TURNS)
    rows = pairs.select(F.col(key), F.coalesce(F.col("chosen").cast(_TURNS), empty).alias("_c"), F.coalesce(F.col("rejected").cast(_TURNS), empty).alias("_r"))
    short = F.least(F.size("_c"), F.size("_r"))
    same = F.zip_with(F.slice("_c", 1, short), F.slice("_r", 1, short), lambda a, b: a.eqNullSafe(b))
    prefix = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("long")) - 1, short.cast("long"))
    rows = rows.withColumn("n_prompt_turns", prefix)
    n = F.col("n_prompt_turns").cast("int")
    tail = {c: F.slice(c, n + 1, F.greatest(F.size(c), F.lit(1))) for c in ("_c", "_r")}
    return rows.select(
        F.col(key), "n_prompt_turns", _rendered(F.slice("_c", 1, n)).alias("prompt"), _rendered(tail["_c"]).alias("chosen"), _rendered(tail["_r"]).alias("rejected"), _scored(tail["_c"]).alias("chosen_scored"), _scored(tail["_r"]).alias("rejected_scored")
    )
