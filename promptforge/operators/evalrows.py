"""Evaluation rows: QCA parsing, noun chunks, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptforge.functions.qca import with_qca
from promptforge.functions.text import split_chunks, strip
from promptforge.operators.merge import dedup_keep_first


def qca_table(replies: DataFrame, prompt: str = "prompt", reply: str = "visual_questions",
              keep=()) -> DataFrame:
    """P5 + P6: ``(prompt, qca struct, anomaly)`` from question replies."""
    base = replies.select(*keep, F.col(prompt).alias("prompt"), F.col(reply).alias("text"))
    return with_qca(base, "text").select(*keep, "prompt", "qca", "anomaly", "text")


def qca_errors(parsed: DataFrame, dataset: str, row_index: str = "row_index") -> DataFrame:
    """The anomaly report ``(dataset, index, prompt, text)``."""
    return parsed.filter("anomaly").select(F.lit(dataset).alias("dataset"), F.col(row_index).alias("row_index"),
                                           "prompt", "text")


def qca_rows(parsed: DataFrame, keys=("prompt",)) -> DataFrame:
    """One row per parsed question (positional zip of the three lists)."""
    z = F.arrays_zip(F.col("qca.questions").alias("question"), F.col("qca.choices").alias("choices"),
                     F.col("qca.answers").alias("answer"))
    return parsed.select(*keys, F.posexplode(z).alias("q_pos", "_z")).select(
        *keys, "q_pos", F.col("_z.question").alias("question"), F.col("_z.choices").alias("choices"),
        F.col("_z.answer").alias("answer"))


def chunk_arrays(df: DataFrame, col: str = "noun_chunks") -> DataFrame:
    """The comma-joined chunk string as a stripped array."""
    return df.withColumn("chunks", split_chunks(col))


def chunk_rows(df: DataFrame, keys=("prompt",), col: str = "noun_chunks") -> DataFrame:
    return df.select(*keys, F.posexplode(split_chunks(col)).alias("chunk_pos", "chunk"))


def _suffix_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; other colliding names get ``_x`` / ``_y``."""
    common = (set(left.columns) & set(right.columns)) - {key}
    for c in common:
        left = left.withColumnRenamed(c, f"{c}_x")
        right = right.withColumnRenamed(c, f"{c}_y")
    return left.join(right, key, "inner")


def first_per_prompt(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per non-null prompt: the first by ``order_by`` (by all columns
    when it is None or the table lacks them).  A partial ``min(struct)``, so a
    prompt that fills a third of the table reaches the shuffle once a task."""
    df = df.filter(F.col("prompt").isNotNull())
    order = [c for c in order_by or [] if c in df.columns] or [c for c in df.columns if c != "prompt"]
    return dedup_keep_first(df, "prompt", order) if order else df.distinct()


def load_eval_rows(qca: DataFrame | None = None, chunks: DataFrame | None = None,
                   scoring: DataFrame | None = None, order_by: list[str] | None = None,
                   multiply: bool = False) -> tuple[DataFrame, str]:
    """S6 + J1 + J2: QCA join noun chunks on ``prompt``, plus the scoring table
    when both exist.  Returns the rows and their kind: MERGED, NOUN_CHUNK or
    QCA.  Null prompts are dropped first (the reference crashes on them).

    When inputs are joined, each is first reduced to one row per prompt (the
    row the final first-wins merge keeps anyway; ``order_by`` says which), so a
    prompt repeated across a large share of the inputs never turns into a pair
    product.  ``multiply`` asks for the plain inner join, in which repeated
    prompts multiply."""
    if qca is None and chunks is None:
        raise ValueError("need a question table, a noun-chunk table or both")
    has_prompt = F.col("prompt").isNotNull()
    if qca is not None and chunks is not None:
        parts = [d.filter(has_prompt) if multiply else first_per_prompt(d, order_by)
                 for d in (qca, chunks, *([scoring] if scoring is not None else []))]
        rows = parts[0]
        for other in parts[1:]:
            rows = _suffix_join(rows, other, "prompt")
        return rows, "MERGED"
    return (chunks.filter(has_prompt), "NOUN_CHUNK") if chunks is not None else (qca.filter(has_prompt), "QCA")


def eval_info(rows: DataFrame, kind: str) -> DataFrame:
    """Per-row inputs of scoring: stripped prompt, chunk list, question lists."""
    out = rows.withColumn("original_prompt", strip("prompt"))
    if kind != "QCA":
        out = out.withColumn("chunks", split_chunks("noun_chunks"))
    if kind != "NOUN_CHUNK":
        out = (out.withColumn("questions", F.col("qca.questions")).withColumn("choices", F.col("qca.choices"))
                  .withColumn("answers", F.col("qca.answers")))
    return out


def prompt_to_score(rows: DataFrame, scoring_column: str = "") -> DataFrame:
    """The chosen column (as text, stripped) or else the original prompt.
    A missing value reads as pandas' NaN, whose text form is ``"nan"``."""
    if scoring_column:
        as_text = F.coalesce(F.col(scoring_column).cast("string"), F.lit("nan"))
        return rows.withColumn("prompt_to_score", strip(as_text))
    return rows.withColumn("prompt_to_score", strip("prompt"))
