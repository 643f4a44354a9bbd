"""Request-table builders.

Each builder maps a DataFrame to ``(request_id, stage, <keys>, messages)``.
Model calls happen outside this library; replies come back as a table keyed
by ``request_id`` (see ``replies.py``).  The instruction wording is ours and is
a parameter everywhere; only the markers that downstream parsers rely on are
fixed (``Q: / Choices: / A:`` replies, one paraphrase per line, yes/no answers,
the rephrased-prompt marker and the chat markers of the training formats).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions import messages as M
from promptforge.functions.text import _col, strip
from promptforge.operators.replies import GENERATION_MARKER
from promptforge.operators.training import DEFAULT_INSTRUCTION, FORMATS

NOUN_PHRASE_INSTRUCTION = ('Split the sentence below into its noun phrases, leaving out framing words '
                           'such as "a photo of". Reply with comma-separated values only.')
DESCRIPTION_PREFIX = "Description: "
OPTIMIZER_ROLE = ("You improve prompts for text-to-image models: given a prompt written by a person, "
                  "you write versions that the image model renders more faithfully. Keep answers short.\n")
# A short few-shot exchange of our own showing the reply layout the parser expects.
DEFAULT_FEW_SHOT = [
    ("user", "Description: a red kite above two boats"),
    ("assistant", "Q: is there a kite?\nChoices: yes, no\nA: yes\n"
                  "Q: what color is the kite?\nChoices: red, blue, green\nA: red\n"
                  "Q: how many boats are there?\nChoices: 1, 2, 3\nA: 2"),
]
ICL_PROMPT_LABEL = "Prompt: "
ICL_ANSWER_LABEL = "Rewritten: "
ICL_SYSTEM = ("You rewrite user prompts for a text-to-image model so that its images stay faithful to "
              "the user's intent while becoming more complete and appealing.")


# Wording of the other requests: {n} is the number of paraphrases, the other
# names in braces are columns of the request's row.
INSTANT = ('Write {n} paraphrases of this text-to-image prompt that keep its meaning: "{prompt}". Put each on its own '
           "numbered line. Rate each from 0 to 10 for how faithful and appealing its image would be and keep improving "
           "until one earns 10/10. Finally copy the best one between <BEST> and </BEST>, with nothing else inside the tags.")
FIRST_ITERATION = ('Write {n} paraphrases of this text-to-image prompt that keep its meaning: "{prompt}". Put each on its '
                   "own numbered line. They should lead to faithful, appealing images; added details are welcome when "
                   "they do not contradict the prompt.")
NEXT_ITERATION = ('Improve this prompt written by a person: "{prompt}". Earlier attempts follow in ascending order of score '
                  "(0-100). TIFA is the share of multiple-choice questions about the image answered correctly; VQA is the "
                  "mean presence score of the prompt's visual elements.{history}\n\nWrite {n} new paraphrases of the "
                  "initial prompt that keep its meaning and score higher than every attempt above, fixing the elements "
                  "that were missed. Prefer substitutions and reorderings to additions. Put each on its own numbered line.")
SELECT_ALL = ("Below is a model's reply that should contain {n} paraphrases of a prompt. Copy the {n} paraphrases, one per "
              'line, without numbers or indentation, and nothing else.\nReply:\n"{reply}"')
SELECT_BEST = ("Below is a model's reply with {n} scored paraphrases of a prompt; the best may be marked with <BEST> tags. "
               "Reply with one line only: the paraphrase the model chose as best, without numbers or "
               'indentation.\nReply:\n"{reply}"')
TIFA_QUESTION = ("Answer the question about the image below by copying exactly one of the choices.\n"
                 "Question: {question}\nChoices: {choices}\nImage:")
VQA_QUESTION = 'Is "{chunk}" visible in this image? Answer with yes or no only.'


def fill(template: str, n: int | None = None, **columns) -> Column:
    """A template with its ``{name}`` places taken by columns (``{n}`` by the
    number): one concat of literals and columns."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([a-z]+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece == "n":
            parts.append(F.lit(str(n)))
        elif piece in columns:
            parts.append(_col(columns[piece]))
        else:
            raise ValueError(f"no column for {{{piece}}}")
    return F.concat(*parts)


def _with_messages(df: DataFrame, stage: str, keys: list[str], messages: Column, scope: str = "", keep=()) -> DataFrame:
    return df.select(M.request_id(stage, *keys, scope=scope).alias("request_id"), F.lit(stage).alias("stage"),
                     *keys, *keep, messages.alias("messages"))


def _ask(df: DataFrame, stage: str, keys, text: Column, scope: str, keep=()) -> DataFrame:
    return _with_messages(df, stage, list(keys), F.array(M.text_message("user", text)), scope, keep)


def noun_chunk_requests(df: DataFrame, prompt: str = "prompt", keys=("prompt_id",),
                        instruction: str = NOUN_PHRASE_INSTRUCTION, scope: str = "", keep=()) -> DataFrame:
    """M1: instruction, blank line, stripped prompt.  Columns of ``keep`` go along."""
    return _ask(df, "noun_chunks", keys, F.concat(F.lit(instruction + "\n\n"), strip(prompt)), scope, keep)


def visual_question_requests(df: DataFrame, prompt: str = "prompt", keys=("prompt_id",),
                             few_shot=None, scope: str = "", keep=()) -> DataFrame:
    """M2: a fixed few-shot dialogue (literal array, folded by the optimizer)
    followed by ``Description: <prompt>``.  Columns of ``keep`` go along."""
    shots = [M.text_message(r, F.lit(t)) for r, t in (few_shot or DEFAULT_FEW_SHOT)]
    last = M.text_message("user", F.concat(F.lit(DESCRIPTION_PREFIX), strip(prompt)))
    return _with_messages(df, "visual_questions", list(keys), F.array(*shots, last), scope, keep)


def instant_requests(df: DataFrame, prompt: str = "prompt", keys=("prompt_id",), n: int = 4,
                     template: str = INSTANT, scope: str = "") -> DataFrame:
    """M3: n numbered paraphrases, self-scored 0-10, best one in <BEST> tags."""
    return _ask(df, "instant", keys, fill(template, n, prompt=strip(prompt)), scope)


def first_iteration_requests(df: DataFrame, prompt: str = "prompt", keys=("prompt_id",), n: int = 4,
                             role_text: str = OPTIMIZER_ROLE, template: str = FIRST_ITERATION, scope: str = "") -> DataFrame:
    """M4: role sentence plus a request for n paraphrases."""
    return _ask(df, "iter_0", keys, fill(role_text + template, n, prompt=strip(prompt)), scope)


def next_iteration_requests(df: DataFrame, iteration: int, prompt: str = "original_prompt",
                            history: str = "history", keys=("prompt_id",), n: int = 4,
                            role_text: str = OPTIMIZER_ROLE, template: str = NEXT_ITERATION, scope: str = "") -> DataFrame:
    """M5: initial prompt + history block (G2) + closing instruction."""
    text = fill(role_text + template, n, prompt=prompt, history=F.coalesce(_col(history), F.lit("")))
    return _ask(df, f"iter_{iteration}", keys, text, scope)


def select_all_requests(df: DataFrame, reply: str = "reply", keys=("request_id",), n: int = 4,
                        template: str = SELECT_ALL, scope: str = "") -> DataFrame:
    """M6: ask for the n paraphrases of a reply, one per line."""
    return _ask(df, "select_all", keys, fill(template, n, reply=reply), scope)


def select_best_requests(df: DataFrame, reply: str = "reply", keys=("request_id",), n: int = 4,
                         template: str = SELECT_BEST, scope: str = "") -> DataFrame:
    """M7: ask for the single best paraphrase of a reply on one line."""
    return _ask(df, "select_best", keys, fill(template, n, reply=reply), scope)


def tifa_requests(cands: DataFrame, questions: DataFrame, join_keys: list[str], cand_keys: list[str],
                  image_url: str = "image_url", template: str = TIFA_QUESTION, scope: str = "") -> DataFrame:
    """One request per (candidate, question): text part + image part.
    ``questions`` is long-form ``(join_keys, q_pos, question, choices)``."""
    j = cands.join(questions, join_keys)
    msg = M.message("user", M.text_part(fill(template, question="question", choices="choices")), M.image_part(image_url))
    return _with_messages(j, "tifa", cand_keys + ["q_pos"], F.array(msg), scope)


def vqa_requests(cands: DataFrame, chunks: DataFrame, join_keys: list[str], cand_keys: list[str],
                 image_url: str = "image_url", template: str = VQA_QUESTION, scope: str = "") -> DataFrame:
    """One request per (candidate, noun chunk): image part + yes/no question."""
    j = cands.join(chunks, join_keys)
    msg = M.message("user", M.image_part(image_url), M.text_part(fill(template, chunk="chunk")))
    return _with_messages(j, "vqa", cand_keys + ["chunk_pos"], F.array(msg), scope)


def icl_requests(prompts: DataFrame, examples: DataFrame, prompt: str = "prompt", keys=("prompt_id",),
                 ex_prompt: str = "prompt", ex_best: str = "best_paraphrase", ex_order: str = "sample_key",
                 system: str = ICL_SYSTEM, prompt_label: str = ICL_PROMPT_LABEL,
                 answer_label: str = ICL_ANSWER_LABEL, scope: str = "") -> DataFrame:
    """System message + example pairs + the user prompt.

    The examples (at most the sample size, 100 by default) are folded once
    into one array by a scalar subquery whose value every row reuses.
    """
    pairs = examples.agg(F.array_sort(F.collect_list(
        F.struct(F.col(ex_order).alias("k"), F.col(ex_prompt).alias("p"), F.col(ex_best).alias("b"))))
        .alias("_ex"))
    shots = pairs.select(F.flatten(F.transform("_ex", lambda e: F.array(
        M.text_message("user", F.concat(F.lit(prompt_label), e["p"])),
        M.text_message("assistant", F.concat(F.lit(answer_label), e["b"]))))).alias("_shots"))
    # scalar subquery: evaluated once, its value inlined into every row's expression
    msgs = F.concat(F.array(M.text_message("system", F.lit(system))), shots.scalar(),
                    F.array(M.text_message("user", F.concat(F.lit(prompt_label), F.col(prompt)))))
    return _with_messages(prompts, "icl", list(keys), msgs, scope)


def generation_requests(df: DataFrame, prompt: str = "prompt", keys=("prompt_id",),
                        instruction: str = DEFAULT_INSTRUCTION, scope: str = "") -> DataFrame:
    """The fine-tuned model's input string in the ``hf`` chat markers,
    ending with the rephrased-prompt marker the reply parser splits on."""
    open_, close = FORMATS["hf"]
    text = F.concat(F.lit(open_ + instruction), _col(prompt), F.lit(close + GENERATION_MARKER))
    return df.select(M.request_id("generation", *keys, scope=scope).alias("request_id"), *keys, text.alias("request_text"))


def flat_request(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Flatten a request table for comparison: message count, last role and
    text, image URL, a digest of the texts before, modality (and ``more``)."""
    n = F.size("messages")
    last = F.get(F.col("messages"), n - 1)
    before = F.array_join(F.transform(F.slice("messages", F.lit(1), n - 1), M.message_text), "\x1e")
    image = F.get(F.filter(last["content"], lambda p: p["type"] == "image_url"), 0)["image_url"]
    return df.select("request_id", *keys, n.alias("n_messages"),
                     last["role"].alias("last_role"), M.message_text(last).alias("last_text"),
                     image.alias("image_url"), F.md5(before).alias("before_md5"),
                     M.modality("messages").alias("modality"), *more)
