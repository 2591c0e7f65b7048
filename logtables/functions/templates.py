"""Column expressions for templates: the mining fold, variables, and filling a pattern.

A template is a list of tokens; ``<*>`` stands for any token. Within a group of lines of equal token
count, taken in arrival order, a line joins the first template that is similar enough and makes it
more general, else it opens a template. The order matters, so this is a fold over one array; the
caller bounds the array.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtables.functions.text import with_value

# Wildcard token, share of positions that must agree, text for an unknown template.
WILDCARD = "<*>"
THRESHOLD = 0.5
UNKNOWN = "UNKNOWN"

TEMPLATES = "array<struct<tokens:array<string>,opened:int>>"
BLOCK = 16
# A wildcard between blanks or ends. The literal comes first, so that other text is passed over fast.
WILDCARD_TOKEN = r"<\*>(?<![^ ]<\*>)(?![^ ])"


def _similar(template: Column, words: Column, threshold: float) -> Column:
    hits = F.filter(template, lambda token, i: (token == WILDCARD) | (token == F.get(words, i)))
    return F.size(hits) >= F.size(template) * threshold


def _generalized(template: Column, words: Column) -> Column:
    return F.transform(
        template, lambda token, i: F.when(token == F.get(words, i), token).otherwise(F.lit(WILDCARD))
    )


def mined_group(lines: Column, threshold: float = THRESHOLD) -> Column:
    """Fold an ordered array of lines (structs with ``tokens``) into templates.

    Returns ``templates`` in opening order, each with the position of the line that opened it, and
    ``assigned``, the template position of each line. Assignments are gathered in blocks, since an
    array is copied whenever it grows.
    """

    def take(state: Column, i: Column) -> Column:
        templates, assigned = state.getField("templates"), state.getField("assigned")

        def placed(words: Column, hit: Column) -> Column:
            opening = F.array(F.struct(words.alias("tokens"), i.alias("opened")))
            merged = F.transform(
                templates,
                lambda t, k: F.when(
                    k + 1 == hit, t.withField("tokens", _generalized(t.getField("tokens"), words))
                ).otherwise(t),
            )
            return F.when(
                hit == 0,
                F.struct(
                    F.concat(templates, opening).alias("templates"),
                    F.concat(assigned, F.array(F.size(templates))).alias("assigned"),
                ),
            ).otherwise(
                F.struct(
                    merged.alias("templates"),
                    F.concat(assigned, F.array((hit - 1).cast("int"))).alias("assigned"),
                )
            )

        def first_hit(words: Column) -> Column:
            similar = F.transform(templates, lambda t: _similar(t.getField("tokens"), words, threshold))
            return F.array_position(similar, F.lit(True))

        return with_value(
            F.get(lines, i).getField("tokens"),
            lambda words: with_value(first_hit(words), lambda hit: placed(words, hit)),
        )

    last = F.size(lines) - 1

    def take_block(state: Column, start: Column) -> Column:
        return F.aggregate(
            F.sequence(start, F.least(start + BLOCK - 1, last)),
            F.struct(state.getField("templates").alias("templates"), F.array().cast("array<int>").alias("assigned")),
            take,
            lambda block: F.struct(
                block.getField("templates").alias("templates"),
                F.concat(state.getField("blocks"), F.array(block.getField("assigned"))).alias("blocks"),
            ),
        )

    return F.aggregate(
        F.sequence(F.lit(0), last, F.lit(BLOCK)),
        F.struct(F.array().cast(TEMPLATES).alias("templates"), F.array().cast("array<array<int>>").alias("blocks")),
        take_block,
        lambda end: F.struct(
            end.getField("templates").alias("templates"), F.flatten(end.getField("blocks")).alias("assigned")
        ),
    )


def template_key(pattern: Column) -> Column:
    """Key of a pattern, the same in every batch and on every node."""
    return F.md5(pattern)


def key_of(pattern: str) -> str:
    """The key of a given pattern, for filters."""
    return hashlib.md5(pattern.encode()).hexdigest()


def variables_of(tokens: Column, template: Column) -> Column:
    """The tokens at the wildcard positions of ``template``, in order."""
    return F.filter(tokens, lambda token, i: F.get(template, i) == WILDCARD)


def wildcard_count(pattern: Column) -> Column:
    return F.size(F.split(pattern, WILDCARD_TOKEN)) - 1


def filled(pattern: Column, variables: Column) -> Column:
    """Put the variables into the wildcard positions of ``pattern``, by position.

    A wildcard without a variable stays; surplus variables are ignored.
    """
    pieces = F.split(pattern, WILDCARD_TOKEN)
    gaps = F.size(pieces) - 1
    padded = F.concat(variables, F.array_repeat(F.lit(WILDCARD), gaps))
    values = F.when(F.size(variables) == gaps, variables).otherwise(F.slice(padded, F.lit(1), gaps))
    joined = F.zip_with(pieces, values, lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))))
    return F.array_join(joined, "")
