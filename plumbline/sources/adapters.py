"""Dataset adapters: any Spark-readable table of a known dataset shape to raw corpus items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.corpus import length_band, min_length, min_level, plain_number, strip_tex_spacing

# ---- fixed values: task instructions, licences, limits ------------------------------------
MATH_INSTRUCTION = (
    "Solve the problem. Show your reasoning, then give the final numeric answer "
    "on its own last line in the form: #### <answer>")
CHOICE_INSTRUCTION = (
    "Answer the multiple-choice question. Reason briefly, then give the letter of "
    "the correct option on its own last line in the form: #### <letter>")
SUMMARY_INSTRUCTION = (
    "Write a concise summary of the article below in 2-4 sentences. "
    "Cover only what the article states.")
LONG_FORM_INSTRUCTION = (
    "Answer the question thoroughly and accurately for a general audience. Two to four paragraphs.")
SUPPORT_INSTRUCTION = (
    "You are a customer support agent. Write a reply to the customer message below. "
    "Be warm, specific and actionable. Do not invent order numbers, policies or dates.")
DATASETS = {
    "gsm8k": ("openai/gsm8k", "MIT", "math_word_problem"),
    "math": ("nlile/hendrycks-MATH-benchmark", "MIT", "math_word_problem"),
    "mmlu_pro": ("TIGER-Lab/MMLU-Pro", "MIT", "multiple_choice"),
    "cnn": ("abisee/cnn_dailymail", "Apache-2.0", "summarization"),
    "dolly": ("databricks/databricks-dolly-15k", "CC-BY-SA-3.0", "long_form_qa"),
    "bitext": ("bitext/Bitext-customer-support-llm-chatbot-training-dataset", "CDLA-Sharing-1.0", "support_reply"),
}
MARKED_ANSWER = r"####\s*(-?[\d,]+(?:\.\d+)?)"
MATH_MIN_LEVEL = 3
ARTICLE_CHARS = (1500, 6000)
QUESTION_MIN_CHARS = 25
MESSAGE_MIN_CHARS = 20
OPEN_CATEGORIES = ("open_qa", "general_qa")
# -------------------------------------------------------------------------------------------


def _item(rows: DataFrame, kind: str, source_id: Column, instruction: str, user: Column, truth: Column | None) -> DataFrame:
    dataset, licence, task = DATASETS[kind]
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))
    return rows.select(
        F.lit(dataset).alias("source_dataset"), source_id.cast("string").alias("source_id"), F.lit(licence).alias("source_license"),
        F.lit(task).alias("task_type"), messages.alias("messages"),
        (truth if truth is not None else F.lit(None)).cast("string").alias("ground_truth"))


def _gsm8k(rows: DataFrame) -> DataFrame:
    answered = rows.filter(F.col("answer").rlike(MARKED_ANSWER))
    truth = F.replace(F.regexp_extract("answer", MARKED_ANSWER, 1), F.lit(","), F.lit(""))
    return _item(answered, "gsm8k", F.concat(F.lit("test-"), "row"), MATH_INSTRUCTION, F.col("question"), truth)


def _math(rows: DataFrame) -> DataFrame:
    answer = strip_tex_spacing(F.col("answer"))
    hard = rows.filter(min_level(F.col("level"), MATH_MIN_LEVEL) & plain_number(answer))
    return _item(hard, "math", F.col("unique_id"), MATH_INSTRUCTION, F.col("problem"), F.replace(answer, F.lit(","), F.lit("")))


def _mmlu_pro(rows: DataFrame) -> DataFrame:
    rendered = F.array_join(F.transform("options", lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o)), "\n")
    user = F.concat("question", F.lit("\n\n"), rendered)
    return _item(rows, "mmlu_pro", F.col("question_id"), CHOICE_INSTRUCTION, user, F.upper(F.trim("answer")))


def _cnn(rows: DataFrame) -> DataFrame:
    return _item(rows.filter(length_band(F.col("article"), *ARTICLE_CHARS)), "cnn", F.col("id"), SUMMARY_INSTRUCTION, F.col("article"), None)


def _dolly(rows: DataFrame) -> DataFrame:
    question = F.trim("instruction")
    wanted = F.col("category").isin(*OPEN_CATEGORIES) & (F.coalesce("context", F.lit("")) == "")
    kept = rows.filter(wanted & min_length(question, QUESTION_MIN_CHARS))
    return _item(kept, "dolly", F.concat(F.lit("train-"), "row"), LONG_FORM_INSTRUCTION, question, None)


def _bitext(rows: DataFrame) -> DataFrame:
    message = F.trim("instruction")
    kept = rows.filter(min_length(message, MESSAGE_MIN_CHARS))
    return _item(kept, "bitext", F.concat(F.lit("train-"), "row"), SUPPORT_INSTRUCTION, message, None)


_ADAPTERS = {"gsm8k": _gsm8k, "math": _math, "mmlu_pro": _mmlu_pro, "cnn": _cnn, "dolly": _dolly, "bitext": _bitext}


def normalise_source(rows: DataFrame, kind: str) -> DataFrame:
    """Raw items of one dataset. Columns follow the dataset; ``row`` is its row number where ids need one."""
    return _ADAPTERS[kind](rows)
