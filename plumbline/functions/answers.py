"""Answer extraction, verification and judge replies as column expressions.

Verifiers live in a registry of column builders, so a user adds one with
``register_verifier`` and it runs inside the same stage as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# ---- fixed values: answer formats ---------------------------------------------------------
FINAL_ANSWER_MARKER = r"(?:####|final answer\s*(?:is)?\s*:?|answer\s*(?:is)?\s*:?|\\boxed\{)"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
CHOICE_MARKER = r"(?:answer\s*(?:is)?\s*:?|option\s*:?|\\boxed\{|####)\s*\(?([A-J])\)?\b"
BARE_CHOICE = r"\b\(?([A-J])\)?\b"
FENCED_BLOCK = r"```(?:json)?\s*(.*?)\s*```"
JSON_OBJECT = r"\{.*\}"
POSITION_OUTCOMES = ("A", "B", "tie")
DEFAULT_CONFIDENCE = 0.5
# -------------------------------------------------------------------------------------------


def _last(matches: Column) -> Column:
    return F.try_element_at(matches, F.lit(-1))


def _last_number(text: Column) -> Column:
    return _last(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def as_number(text: Column) -> Column:
    """Number from its written form; separators, currency and a final stop are ignored."""
    bare = F.rtrim(F.trim(F.translate(text, ",$", "")), F.lit("."))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def extract_final_number(text: Column) -> Column:
    """Last number after the last answer marker, else the last number of the text."""
    tail = F.regexp_replace(text, f"(?is)^.*{FINAL_ANSWER_MARKER}", "")
    return F.translate(F.coalesce(_last_number(tail), _last_number(text)), ",", "").try_cast("double")


def extract_choice(text: Column) -> Column:
    """Last marked option letter, else the last letter that stands alone."""
    def read(flag: str) -> Column:
        marked = _last(F.regexp_extract_all(text, F.lit(f"(?i{flag}){CHOICE_MARKER}"), F.lit(1)))
        bare = _last(F.regexp_extract_all(text, F.lit(f"(?-i{flag}){BARE_CHOICE}"), F.lit(1)))
        return F.coalesce(marked, bare)

    # Unicode word and space classes are slower and change nothing in ASCII text.
    ascii_only = F.octet_length(text) == F.length(text)
    return F.upper(F.when(ascii_only, read("")).otherwise(read("U")))


def _numbers_agree(output: Column, truth: Column) -> Column:
    return F.coalesce(extract_final_number(output) == as_number(truth), F.lit(False))


def _choices_agree(output: Column, truth: Column) -> Column:
    return F.coalesce(extract_choice(output) == F.upper(F.trim(truth)), F.lit(False))


Check = Callable[[Column, Column], Column]
Extract = Callable[[Column], Column]

_VERIFIERS: dict[str, tuple[Check, Extract]] = {
    "final_number": (_numbers_agree, lambda t: extract_final_number(t).cast("string")),
    "choice_letter": (_choices_agree, extract_choice),
}


def register_verifier(name: str, check: Check, extract: Extract) -> None:
    _VERIFIERS[name] = (check, extract)


def verify(verifier: Column, output: Column, truth: Column) -> Column:
    """Pass flag; NULL verifier or truth means ungradable, an unknown name is an error."""
    graded = F.when(verifier.isNull() | truth.isNull(), F.lit(None).cast("boolean"))
    for name, (check, _) in _VERIFIERS.items():
        graded = graded.when(verifier == name, check(output, truth))
    message = F.concat(F.lit("unknown verifier: "), verifier)
    return graded.otherwise(F.raise_error(message).cast("boolean"))


def extract_answer(verifier: Column, output: Column) -> Column:
    """The answer a sample reached, as text; NULL when none can be read."""
    branches = [F.when(verifier == name, take(output)) for name, (_, take) in _VERIFIERS.items()]
    return F.coalesce(*branches, F.lit(None).cast("string"))


def parse_judge_reply(raw: Column) -> Column:
    """STRUCT(outcome, confidence, reasoning) of a judge's reply; NULL when unparseable.

    A fenced block is tried first, then the widest object, then the whole text.
    """
    candidates = F.array(
        F.when(raw.rlike(f"(?s){FENCED_BLOCK}"), F.regexp_extract(raw, f"(?s){FENCED_BLOCK}", 1)),
        F.when(raw.rlike(f"(?s){JSON_OBJECT}"), F.regexp_extract(raw, f"(?s){JSON_OBJECT}", 0)),
        F.trim(raw),
    )

    def read(text: Column) -> Column:
        doc = F.try_parse_json(text)
        outcome = F.try_variant_get(doc, "$.outcome", "string")
        confidence = F.try_variant_get(doc, "$.confidence", "variant")
        reasoning = F.try_variant_get(doc, "$.reasoning", "variant")
        value = F.try_variant_get(doc, "$.confidence", "double")
        confidence_ok = confidence.isNull() | F.coalesce(value.between(0.0, 1.0), F.lit(False))
        reasoning_ok = reasoning.isNull() | (F.schema_of_variant(reasoning) == "STRING")
        return F.when(
            outcome.isin(*POSITION_OUTCOMES) & confidence_ok & reasoning_ok,
            F.struct(
                outcome.alias("outcome"),
                F.coalesce(value, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
                F.coalesce(F.try_variant_get(doc, "$.reasoning", "string"), F.lit("")).alias("reasoning"),
            ),
        )

    return F.try_element_at(F.filter(F.transform(candidates, read), lambda r: r.isNotNull()), F.lit(1))


def to_candidate_outcome(outcome: Column, slot: Column) -> Column:
    """Position outcome to candidate outcome: the slot decides what "A" means."""
    return (
        F.when(outcome == "tie", F.lit("tie"))
        .when(outcome == slot, F.lit("win"))
        .when(outcome.isNotNull(), F.lit("loss"))
    )


def combine_positions(first: Column, second: Column) -> Column:
    """Agreeing orders stand, disagreeing ones are a tie, a missing one gives NULL."""
    return F.when(first.isNotNull() & second.isNotNull(), F.when(first == second, first).otherwise(F.lit("tie")))
