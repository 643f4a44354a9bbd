"""Training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import pick_correction

DEFAULT_INSTRUCTION = ("Rewrite this text-to-image prompt so that it is detailed and descriptive while "
                       "staying faithful to its intent, clear and fluent. Original prompt: ")
ASSISTANT_LEAD = "Here is the rephrased prompt: "

# The chat markers of each training format, as
# (before the instruction, between the original prompt and the assistant turn).
FORMATS = {
    "hf": ("<s> [INST] ", " [/INST] "),
    "gemma": ("<start_of_turn>user ", "<end_of_turn> <start_of_turn>model "),
    "chatml": ("<|im_start|>user ", "<|im_end|> <|im_start|>assistant "),
}
ALL_FORMATS = ("hf", "qwen", "gemma", "test", "chatml")


def corrected_pairs(df: DataFrame, original: str = "original_prompt", rephrased: str = "rephrased_prompt",
                    corrected: str | None = "corrected_prompt") -> DataFrame:
    """P20: when a corrected column exists, ``"Correct."`` keeps the rephrased prompt."""
    out = df.withColumn("original_prompt", F.col(original))
    if corrected is None:
        return out.withColumn("rephrased_prompt", F.col(rephrased))
    return out.withColumn("rephrased_prompt", pick_correction(rephrased, corrected))


def format_pairs(df: DataFrame, fmt: str, keys=(), instruction: str = DEFAULT_INSTRUCTION,
                 lead: str = ASSISTANT_LEAD) -> DataFrame:
    """Render (original_prompt, rephrased_prompt) pairs: P21 ``hf``, P22
    ``gemma``, P23 ``chatml``, P24 ``qwen`` (two from/value messages), P25
    ``test``; P26: unknown formats fail before any plan is built.  The pair
    columns come from the same row (J9), so no join is involved."""
    if fmt not in ALL_FORMATS:
        raise ValueError(f"unknown format {fmt!r}; choose from {', '.join(ALL_FORMATS)}")
    keys = list(keys)
    o, r = F.col("original_prompt"), F.col("rephrased_prompt")
    if fmt == "test":
        return df.select(*keys, o.alias("original_prompt"), r.alias("rephrased_and_corrected_prompt"))
    if fmt == "qwen":
        msgs = F.array(
            F.struct(F.lit("user").alias("from"), F.concat(F.lit(instruction), o).alias("value")),
            F.struct(F.lit("assistant").alias("from"), F.concat(F.lit(lead), r).alias("value")))
        return df.select(*keys, msgs.alias("messages"))
    open_, close = FORMATS[fmt]
    return df.select(*keys, F.concat(F.lit(open_ + instruction), o, F.lit(close + lead), r).alias("text"))
