"""Message text, canonical forms and content keys, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.hashing import sha256

# ---- fixed values -------------------------------------------------------------------------
# Whitespace as defined for ECMAScript ``\s`` and ``trim``.
WHITESPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPOKEN_ROLES = ("user", "assistant")
SYSTEM_ROLES = ("system", "developer")
CHARS_PER_TOKEN = 4
WORST_CASE_CHARS_PER_TOKEN = 3
PROMPT_PREVIEW_CHARS = 400
RESPONSE_PREVIEW_CHARS = 1200
# -------------------------------------------------------------------------------------------


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def canonical_turn(role: Column, content: Column) -> Column:
    # Once runs are single spaces, the native trim is enough.
    collapsed = F.trim(F.regexp_replace(content, f"{WHITESPACE}+", " "))
    return F.concat(F.lower(trim_ws(role)), F.lit(":"), collapsed)


def canonicalise(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: canonical_turn(m["role"], m["content"])), "\n")


def spoken_turns(messages: Column) -> Column:
    spoken = F.filter(messages, lambda m: m["role"].isin(*SPOKEN_ROLES))
    return F.when(F.size(spoken) > 0, spoken).otherwise(messages)


def canonical_turns(messages: Column) -> Column:
    """ARRAY of STRUCT(role, line, chars): the canonical line and raw length of every turn."""
    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"), canonical_turn(m["role"], m["content"]).alias("line"), F.length(m["content"]).alias("chars")))


def joined_lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["line"]), "\n")


def joined_chars(turns: Column) -> Column:
    """Length of the turns' contents joined by a blank line."""
    return F.aggregate(turns, F.lit(0), lambda s, t: s + t["chars"]) + 2 * (F.greatest(F.size(turns), F.lit(1)) - 1)


def embedding_text(messages: Column) -> Column:
    """Canonical text of the user and assistant turns; of all turns if there are none."""
    return canonicalise(spoken_turns(messages))


def prompt_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n\n")


def user_prompt_text(messages: Column) -> Column:
    return prompt_text(spoken_turns(messages))


def json_string(text: Column) -> Column:
    """The JSON literal of a string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def sorted_params(params: Column) -> Column:
    """JSON object of a MAP<name, JSON literal>, names in order."""
    pairs = F.transform(
        F.array_sort(F.map_entries(params)),
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def exact_key_scope(model: Column, prompt_version: Column, params: Column) -> Column:
    """What follows the messages in the payload of an exact key."""
    return F.concat(
        F.lit(',"model":'), json_string(model),
        F.lit(',"promptVersion":'), json_string(prompt_version),
        F.lit(',"params":'), sorted_params(params), F.lit("}"),
    )


def exact_key(canonical: Column, model: Column, prompt_version: Column, params: Column) -> Column:
    """sha256 over canonical text, scope and the parameters; their order does not matter."""
    return sha256(F.concat(F.lit('{"messages":'), json_string(canonical), exact_key_scope(model, prompt_version, params)))


def cache_key(model: Column, messages: Column, params: Column, replicate: Column) -> Column:
    """Content address of one generation: sha256 of compact JSON with sorted keys."""
    ordered = F.transform(
        messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))
    )
    payload = F.to_json(
        F.struct(
            ordered.alias("messages"), model.alias("model"),
            params.alias("params"), replicate.cast("int").alias("replicate_idx"),
        )
    )
    return sha256(payload)


def request_params(requested: Column, model_max: Column, takes_sampling: Column) -> Column:
    """Parameters of a benchmark call; temperature only where the model accepts one."""
    return F.struct(
        F.least(requested, model_max).cast("int").alias("max_tokens"),
        F.when(takes_sampling, F.lit(0.0)).alias("temperature"),
    )


def request_hash(body: Column) -> Column:
    """Hash of the raw body: here key order does matter."""
    return sha256(body)


def text_hash(model: Column, text: Column) -> Column:
    return sha256(F.concat(model, F.lit("\0"), text))


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(chars / CHARS_PER_TOKEN))


def worst_case_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(chars / WORST_CASE_CHARS_PER_TOKEN))


def prompt_preview(body: Column) -> Column:
    contents = F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string,content:string>>")
    return F.left(F.coalesce(F.try_element_at(contents, F.lit(-1))["content"], F.lit("")), F.lit(PROMPT_PREVIEW_CHARS))


def response_preview(body: Column) -> Column:
    text = F.coalesce(
        F.get_json_object(body, "$.text"),
        F.get_json_object(body, "$.choices[0].message.content"),
        F.lit(""),
    )
    return F.left(text, F.lit(RESPONSE_PREVIEW_CHARS))
