"""Names and texts of planned work: routes, call ids, prompts, and settings that overlay each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUTE_FORMS = ("via", "arrow", "to")


def route_name(seed: Column, target: Column, form: str = "via") -> Column:
    """``a-via-b``, ``a->b->a`` or ``a-to-b``."""
    return {"via": lambda: F.concat_ws("-via-", seed, target), "arrow": lambda: F.concat_ws("->", seed, target, seed), "to": lambda: F.concat_ws("-to-", seed, target)}[form]()


def route_pair(name: Column) -> Column:
    """struct(seed, target) of a route's name in any of the forms; null for what is none."""
    forms = ["^([^>]+?)-via-(.+)$", r"^([^>]+)->([^>]+)->\1$", "^([^>]+?)-to-(.+)$"]
    out = F.lit(None).cast("struct<seed:string,target:string>")
    for form in reversed(forms):
        out = F.when(name.rlike(form), F.struct(F.regexp_extract(name, form, 1).alias("seed"), F.regexp_extract(name, form, 2).alias("target"))).otherwise(out)
    return out


def call_id(*parts: Column) -> Column:
    """The parts of a call (campaign, phase, problem, route, repeat, step) as one path; null if one is."""
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws("/", *[p.cast("string") for p in parts]))


def overlaid(top: Column, nested: Column) -> Column:
    """A setting of the contract, else that of its nested configuration."""
    return F.coalesce(top, nested)


def first_examples(examples: Column, most: int = 2) -> Column:
    """The first distinct entries of an array of (input, output), in order."""
    return F.slice(F.array_distinct(examples), 1, most)


def _quoted(text: Column) -> Column:
    """A JSON string, without escapes of what isn't ASCII."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def example_prompt(statement: Column, examples: Column, source: Column, seed: Column, target: Column) -> Column:
    """The text that asks for a translation: languages, specification, up to two distinct public examples as JSON, source."""
    listed = F.array_join(F.transform(first_examples(examples), lambda e: F.concat(F.lit('{"input": '), _quoted(e["input"]), F.lit(', "output": '), _quoted(e["output"]), F.lit("}"))), ", ")
    return F.concat(
        F.lit("Source language: "), seed, F.lit("\nTarget language: "), target, F.lit("\nSpecification:\n"), statement, F.lit("\nPublic examples:\n["), listed, F.lit("]\nSource code:\n"), source,
    )


def filled_template(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` places, filled; a place that isn't given is an error, a null field makes the text null."""
    import string

    pieces = []
    for text, name, _, _ in string.Formatter().parse(template):
        pieces.append(F.lit(text))
        if name is not None:
            pieces.append(fields[name].cast("string"))
    return F.concat(*pieces)


#: Properties of a program that a reader has to confirm; nothing tells them by itself.
ANNOTATED = ("recursive", "accumulator", "list_processing", "explicit_state", "automatic_result")


def annotation(language: Column, of: str) -> Column:
    """struct of ``unconfirmed`` annotations for the steps of one language, null for other steps."""
    fields = [F.lit("unconfirmed").alias(name) for name in ANNOTATED] + [F.lit("unreviewed").alias("review_result")]
    return F.when(language == of, F.struct(*fields))
