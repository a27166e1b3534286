"""Responses of three protocols, as JSON text, brought to one form through VARIANT columns.

The shape of a response tells its protocol unless it is given. What is malformed becomes a status, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTOCOLS = ("chat_completions", "responses", "copilot_sdk")
# States of a response that is not complete.
_UNFINISHED = ["failed", "cancelled", "queued", "in_progress"]


def _kind(value: Column, path: str | None = None) -> Column:
    """STRING, BIGINT, OBJECT, ARRAY, ...; null where there is nothing, or a JSON null."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant") if path else value), "^[A-Z]+", 0)
    return F.when(kind != "VOID", kind)


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _filled(value: Column, path: str) -> Column:
    return (_kind(value, path) == "STRING") & (F.trim(_text(value, path)) != "")


def protocol_of(body: Column) -> Column:
    """By shape: ``choices``, ``output`` or ``text``; null for another one."""
    has = lambda name: _kind(body, f"$.{name}").isNotNull()
    return F.when(has("choices"), PROTOCOLS[0]).when(has("output"), PROTOCOLS[1]).when(has("text"), PROTOCOLS[2])


def _whole(value: Column, path: str, strict: bool) -> Column:
    """A count of tokens; the strict form leaves out negative numbers, and both what is no whole number."""
    number = F.when(_kind(value, path) == "BIGINT", F.try_variant_get(value, path, "bigint"))
    return F.when(number >= 0, number) if strict else number


def _usage(body: Column, strict: bool) -> dict[str, Column]:
    renamed = {"prompt_tokens": "input_tokens", "completion_tokens": "output_tokens", "total_tokens": "total_tokens"}
    # A usage with input_tokens speaks the other protocol's names throughout.
    other = _kind(body, "$.usage.input_tokens").isNotNull() if not strict else F.lit(False)
    return {name: F.when(other, _whole(body, f"$.usage.{second}", strict)).otherwise(_whole(body, f"$.usage.{name}", strict)) for name, second in renamed.items()}


def _truthy(value: Column, path: str) -> Column:
    text = _text(value, path)
    return _kind(value, path).isNotNull() & ~F.coalesce(text.isin("", "false", "0", "0.0", "{}", "[]"), F.lit(False))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once for a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def normalised_response(raw: Column, protocol: Column | None = None) -> Column:
    """struct(protocol, status, text, finish_reason, request_id, actual_model, prompt_tokens, completion_tokens, total_tokens, cost_usd, cost_source).

    status is ``ok`` or the first fault: not_an_object, provider_error, unknown_protocol, choices_not_a_list, multiple_choices, content_not_text,
    output_not_a_list, not_completed, usage_not_an_object, invalid_cost. A faulty response has nothing but its protocol and status.
    """
    return _let(F.try_parse_json(raw), lambda body: _let(_read(body, protocol), lambda read: _let(_fault(body, read), lambda fault: _normalised(body, read, fault))))


def _read(body: Column, protocol: Column | None) -> Column:
    """struct(protocol, content, state, usage, cost, number): what faults and fields are told from."""
    own = protocol_of(body)
    parts = {
        "protocol": own if protocol is None else F.coalesce(protocol, own), "content": _kind(body, "$.choices[0].message.content"), "state": _text(body, "$.status"),
        "usage": _kind(body, "$.usage"), "cost": _kind(body, "$.usage.cost"), "number": F.try_variant_get(body, "$.usage.cost", "double"),
    }
    return F.struct(*[part.alias(name) for name, part in parts.items()])


def _fault(body: Column, read: Column) -> Column:
    protocol, content, state, usage, cost, number = (read[n] for n in ("protocol", "content", "state", "usage", "cost", "number"))
    chat, responses = protocol == PROTOCOLS[0], protocol == PROTOCOLS[1]
    choices = F.try_variant_get(body, "$.choices", "array<variant>")
    return (
        F.when(F.coalesce(_kind(body) != "OBJECT", F.lit(True)), "not_an_object")
        .when(_truthy(body, "$.error"), "provider_error")
        .when(protocol.isNull() | ~protocol.isin(*PROTOCOLS), "unknown_protocol")
        .when(chat & F.coalesce(_kind(body, "$.choices") != "ARRAY", F.lit(True)), "choices_not_a_list")
        .when(chat & (F.size(choices) > 1), "multiple_choices")
        .when(chat & F.coalesce(content != "STRING", F.lit(False)) & _truthy(body, "$.choices[0].message.content"), "content_not_text")
        .when(responses & F.coalesce(_kind(body, "$.output") != "ARRAY", F.lit(True)), "output_not_a_list")
        .when(responses & F.coalesce(state.isin(_UNFINISHED), F.lit(False)), "not_completed")
        .when(F.coalesce(usage != "OBJECT", F.lit(False)), "usage_not_an_object")
        .when(cost.isNotNull() & (~cost.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT") | F.isnan(number) | (number < 0) | (number == float("inf"))), "invalid_cost")
    )


def _normalised(body: Column, read: Column, fault: Column) -> Column:
    protocol, content, state, cost, number = (read[n] for n in ("protocol", "content", "state", "cost", "number"))
    chat, responses = protocol == PROTOCOLS[0], protocol == PROTOCOLS[1]
    messages = F.filter(
        F.coalesce(F.try_variant_get(body, "$.output", "array<variant>"), F.array().cast("array<variant>")),
        lambda item: (_text(item, "$.type") == "message") & (F.coalesce(_text(item, "$.role"), F.lit("assistant")) == "assistant"),
    )
    parts = F.flatten(F.transform(messages, lambda item: F.coalesce(F.try_variant_get(item, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: _text(p, "$.type") == "output_text"), lambda p: _text(p, "$.text")), "")
    text = F.when(chat, F.when(content == "STRING", _text(body, "$.choices[0].message.content")).otherwise("")).when(responses, joined).otherwise(F.coalesce(_text(body, "$.text"), F.lit("")))
    details = _text(body, "$.incomplete_details.reason")
    finish = F.when(chat, _text(body, "$.choices[0].finish_reason")).when(responses, F.when(state == "completed", "stop").when(details == "max_output_tokens", "length").otherwise(state)).otherwise(_text(body, "$.finish_reason"))
    source = F.when(cost.isNotNull(), F.when(F.coalesce(F.try_variant_get(body, "$.usage.opencode.estimated", "boolean"), F.lit(False)), "provider_estimated").otherwise("reported"))
    found = {"text": text, "finish_reason": finish, "request_id": _text(body, "$.id"), "actual_model": _text(body, "$.model"), **_usage(body, False), "cost_usd": number, "cost_source": source}
    return F.struct(protocol.alias("protocol"), F.coalesce(fault, F.lit("ok")).alias("status"), *[F.when(fault.isNull(), v).alias(n) for n, v in found.items()])


def strict_response(raw: Column) -> Column:
    """struct(status, request_id, model, choices, prompt_tokens, completion_tokens, total_tokens) of a chat completion.

    Stricter: id, model, and each choice's role and content are filled text, its index a whole number. choices: array of (index, role, content,
    finish_reason), ``stop`` where no reason is told; counts of tokens that are negative or no whole number are null.
    """
    body = F.try_parse_json(raw)
    choices = F.try_variant_get(body, "$.choices", "array<variant>")
    broken = lambda test: F.exists(choices, lambda c: ~F.coalesce(test(c), F.lit(False)))
    fault = (
        F.when(F.coalesce(_kind(body) != "OBJECT", F.lit(True)), "not_an_object")
        .when(~F.coalesce(_filled(body, "$.id"), F.lit(False)), "no_id")
        .when(~F.coalesce(_filled(body, "$.model"), F.lit(False)), "no_model")
        .when(F.coalesce(_kind(body, "$.choices") != "ARRAY", F.lit(True)) | (F.size(choices) == 0), "no_choices")
        .when(broken(lambda c: _kind(c) == "OBJECT"), "choice_not_an_object")
        .when(broken(lambda c: _kind(c, "$.index") == "BIGINT"), "no_index")
        .when(broken(lambda c: _kind(c, "$.message") == "OBJECT"), "no_message")
        .when(broken(lambda c: _filled(c, "$.message.role")), "no_role")
        .when(broken(lambda c: _filled(c, "$.message.content")), "no_content")
    )
    one = lambda c: F.struct(F.try_variant_get(c, "$.index", "bigint").alias("index"), F.trim(_text(c, "$.message.role")).alias("role"), _text(c, "$.message.content").alias("content"), F.coalesce(F.when(_filled(c, "$.finish_reason"), F.trim(_text(c, "$.finish_reason"))), F.lit("stop")).alias("finish_reason"))
    found = {"request_id": F.trim(_text(body, "$.id")), "model": F.trim(_text(body, "$.model")), "choices": F.transform(choices, one), **_usage(body, True)}
    return F.struct(F.coalesce(fault, F.lit("ok")).alias("status"), *[F.when(fault.isNull(), v).alias(n) for n, v in found.items()])


def generation_evidence(step: Column) -> Column:
    """struct(actual_model, requested, sent, effective, reason) of a step's generation settings, kept apart.

    ``step``: JSON text. ``reason`` says why there are no effective settings; it is null where there are.
    """
    body = F.try_parse_json(step)
    part = lambda name: F.to_json(F.when(_kind(body, f"$.{name}").isNotNull(), F.try_variant_get(body, f"$.{name}", "variant")))
    effective = part("effective_generation")
    reason = F.when(effective.isNull(), F.coalesce(_text(body, "$.effective_generation_missing_reason"), F.lit("not_reported")))
    return F.struct(_text(body, "$.actual_model").alias("actual_model"), part("requested_generation").alias("requested"), part("sent_generation").alias("sent"), effective.alias("effective"), reason.alias("reason"))
