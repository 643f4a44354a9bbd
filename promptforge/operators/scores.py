"""Candidate scores from model replies.

Replies arrive long-form, one row per (candidate, question) or
(candidate, noun chunk).  Every score is a hash aggregation with map-side
partial aggregation, so a candidate holding many rows is pre-combined before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import _col, answer_correct, nan_to_null, strip, yes_no

# Fixed value: a content-filtered reply is treated as an empty answer.
FILTERED_STATUS = "filtered"


def effective_reply(status, text) -> Column:
    """A content-filtered reply counts as the empty answer."""
    return F.when(_col(status) == F.lit(FILTERED_STATUS), F.lit("")).otherwise(_col(text))


def tifa_answer_rows(answers: DataFrame, picked: str = "picked", answer: str = "answer") -> DataFrame:
    """One row per (candidate, question) with a 0/1 ``correct``."""
    return answers.withColumn("correct", answer_correct(picked, answer))


def tifa_scores(answers: DataFrame, keys: list[str], q_pos: str = "q_pos",
                picked: str = "picked", answer: str = "answer") -> DataFrame:
    """A1 + R4: correct / questions (0.0 without questions) and the picked
    answers in question order.  Rows with a null ``answer`` stand for a
    candidate without questions (left join upstream)."""
    rows = tifa_answer_rows(answers, picked, answer)
    has_q = F.col(answer).isNotNull()
    agg = rows.groupBy(*keys).agg(
        F.count(F.when(has_q, F.lit(1))).alias("n_questions"),
        F.coalesce(F.sum(F.when(has_q, F.col("correct"))), F.lit(0)).cast("long").alias("n_correct"),
        # bounded by the number of questions of one prompt
        F.array_sort(F.collect_list(F.when(has_q, F.struct(F.col(q_pos), F.col(picked))))).alias("_ans"),
    )
    return (agg.withColumn("tifa", F.coalesce(F.try_divide(F.col("n_correct").cast("double"),
                                                          F.col("n_questions")), F.lit(0.0)))
               .withColumn("answers", F.transform("_ans", lambda x: x[picked]))
               .drop("_ans"))


def vqa_hard_scores(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """A2 + P13: yes / chunks.  A reply that is neither yes nor no is still open
    (the reference asks again); the score stays null until none is open."""
    yn = yes_no(reply)
    agg = replies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count(F.when(yn == "yes", F.lit(1))).alias("n_yes"),
        F.count(F.when(yn.isNull(), F.lit(1))).alias("n_open"),
    )
    return agg.withColumn(
        "vqa", F.when(F.col("n_open") == 0,
                      F.coalesce(F.try_divide(F.col("n_yes").cast("double"), F.col("n_chunks")),
                                 F.lit(0.0))))


def _is_yes_token(tok) -> Column:
    return F.startswith(F.lower(strip(tok)), F.lit("yes"))


def yes_probability(top_logprobs) -> Column:
    """P14 on an array<struct<token, logprob>> (the model's top-k list, k=5):
    exp(logprob) of the first token starting with "yes", else 0.0."""
    hit = F.get(F.filter(_col(top_logprobs), lambda x: _is_yes_token(x["token"])), 0)
    return F.coalesce(F.exp(hit["logprob"]), F.lit(0.0))


def yes_probability_rows(tokens: DataFrame, keys: list[str], rank: str,
                         token: str = "token", logprob: str = "logprob") -> DataFrame:
    """P14 on long-form top-logprob rows (one row per listed token, ``rank`` =
    list position): the first yes-token is a partial ``min`` aggregate, so no
    list is ever materialised."""
    first_yes = F.min(F.when(_is_yes_token(F.col(token)), F.struct(F.col(rank), F.col(logprob))))
    return (tokens.groupBy(*keys).agg(first_yes.alias("_y"))
                  .withColumn("yes_prob", F.coalesce(F.exp(F.col("_y")[logprob]), F.lit(0.0)))
                  .drop("_y"))


def vqa_soft_scores(probs: DataFrame, keys: list[str], prob: str = "yes_prob") -> DataFrame:
    """A3: mean presence probability per candidate (null when there are none)."""
    return probs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks"),
                                    F.avg(nan_to_null(prob)).alias("vqa"))


def candidate_scores(cands: DataFrame, tifa: str = "tifa", vqa: str = "vqa") -> DataFrame:
    """A4 + P16: ``sum`` of the selected metrics and the history ``score``."""
    return (cands.withColumn("sum", F.col(tifa) + F.col(vqa))
                 .withColumn("score", (F.col(tifa) + F.col(vqa)) / 2))


def score_candidates(tifa_rows: DataFrame, vqa_rows: DataFrame, keys: list[str], soft: bool = False,
                     q_pos: str = "q_pos", picked: str = "picked", answer: str = "answer",
                     chunk_pos: str = "chunk_pos", reply: str = "reply", prob: str = "yes_prob") -> DataFrame:
    """A1 + A2/A3 + A4 + R4 + R5 in ONE aggregation: question rows and
    noun-chunk rows are stacked into a long (candidate, kind, value) table and
    reduced by a single shuffle on the candidate key, instead of two
    aggregations and a join.  Same results as :func:`tifa_scores` +
    :func:`vqa_hard_scores` / :func:`vqa_soft_scores` + sum.

    A null ``picked`` (``reply``, ``yes_prob``) is a question (chunk) without a
    valid reply yet: it counts in ``n_open_questions`` (``n_open``), and the
    score stays null until none is open.  ``answers`` and ``vqa_scores`` are
    the replies and presence scores in order."""
    t = tifa_rows.select(*keys, F.lit("t").alias("_k"), F.col(q_pos).cast("long").alias("_pos"),
                         answer_correct(picked, answer).cast("double").alias("_v"),
                         F.col(picked).alias("_txt"), F.col(answer).isNotNull().alias("_counts"),
                         F.col(picked).isNull().alias("_open"))
    if soft:
        v_val = nan_to_null(prob)
        v_open = F.col(prob).isNull()
    else:
        yn = yes_no(reply)
        v_val, v_open = (yn == "yes").cast("double"), yn.isNull()
    v = vqa_rows.select(*keys, F.lit("v").alias("_k"), F.col(chunk_pos).cast("long").alias("_pos"),
                        v_val.alias("_v"), F.lit(None).cast("string").alias("_txt"), F.lit(True).alias("_counts"),
                        v_open.alias("_open"))
    is_t = (F.col("_k") == "t") & F.col("_counts")
    is_v = F.col("_k") == "v"
    n = lambda cond: F.count(F.when(cond, F.lit(1)))
    in_order = lambda cond, c: F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("_pos"), F.col(c)))))
    agg = t.unionByName(v).groupBy(*keys).agg(
        n(is_t).alias("n_questions"), n(is_t & F.col("_open")).alias("n_open_questions"),
        F.coalesce(F.sum(F.when(is_t, F.col("_v"))), F.lit(0.0)).cast("long").alias("n_correct"),
        in_order(is_t, "_txt").alias("_ans"), n(is_v).alias("n_chunks"), n(is_v & F.col("_open")).alias("n_open"),
        F.sum(F.when(is_v, F.col("_v"))).alias("_vsum"), F.avg(F.when(is_v, F.col("_v"))).alias("_vavg"),
        in_order(is_v, "_v").alias("_vqa"))
    tifa = F.when(F.col("n_open_questions") == 0,
                  F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_questions")), F.lit(0.0)))
    mean = F.col("_vavg") if soft else F.try_divide(F.col("_vsum"), F.col("n_chunks"))
    # the mean of no presence score is undefined when soft, 0.0 when hard
    vqa = F.when(F.col("n_open") == 0, mean if soft else F.coalesce(mean, F.lit(0.0)))
    return (agg.withColumn("tifa", tifa).withColumn("vqa", vqa)
               .withColumn("answers", F.transform("_ans", lambda x: x["_txt"]))
               .withColumn("vqa_scores", F.transform("_vqa", lambda x: x["_v"]))
               .withColumn("sum", F.col("tifa") + F.col("vqa"))
               .drop("_ans", "_vqa", "_vsum", "_vavg"))
