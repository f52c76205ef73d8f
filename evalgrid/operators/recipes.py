"""Recipes, manuals and reference answers: decoding, cutting and rebuilding, as column expressions.

A recipe's numbered steps are an array; what an answer leaks through is folded from the last step to the first. Answers come
as ``variant`` values, so one column may hold objects, strings of objects, lists and single values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalgrid.functions import text as t

#: Characters of an answer that counts, and words of one that restates its question.
LEAST, RESTATES = 4, 5
#: Where a numbered step begins.
STEP = r"(?m)(?<!\n\n)(?=^\s*\d+\.\s)"
#: Fixed pattern: a closing sentence that hands something in quotes to the user.
HANDS_OVER = r'(?i)[^.\n"]*?\bto\s+(?:the\s+)?users?\b[^."\n]*"[^"]*"\.?\s*\z'
#: Headings of a manual's sections, which of them say what can be done and which how it looks, and what an empty one says.
HEADINGS = (
    "Purpose and top-level navigation", "Search", "Page anatomy", "Lists, pagination, sorting, filters", "Forms and multi-step flows", "Gotchas", "Visual style",
)
VARIANTS = {"full": (1, 2, 3, 4, 5, 6, 7), "affordance": (1, 2, 3, 4, 5, 6), "style": (7,)}
FILLER = "(nothing observed for this section.)"


def tidy(text: Column) -> Column:
    """Lower case, trimmed, white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+\z", "")


def decoded(value: Column) -> Column:
    """A JSON text as a variant; a string that is itself JSON is decoded once more, and what isn't JSON is null."""
    once = F.try_parse_json(value)
    twice = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    return F.when(F.schema_of_variant(once) == "STRING", twice).otherwise(once)


def _strings(v: Column, path: str) -> Column:
    """The texts of a list, or of a single value, at a path; none where there is nothing."""
    many, one = F.try_variant_get(v, path, "array<string>"), F.try_variant_get(v, path, "string")
    there = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(there)
    return F.when(there.isNull() | (kind == "VOID"), F.array().cast("array<string>")).when(F.startswith(kind, F.lit("ARRAY")), F.coalesce(many, F.array().cast("array<string>"))).otherwise(F.when(one.isNull(), F.array().cast("array<string>")).otherwise(F.array(one)))


def _only(v: Column, path: str, many: bool) -> Column:
    """As ``_strings``, but only lists, or only single values."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_list = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    return F.when(is_list == many, _strings(v, path)).otherwise(F.array().cast("array<string>"))


def answers(evaluation: Column, intent: Column, least: int = LEAST) -> Column:
    """The strings that answer a task, from its evaluation (JSON, or a JSON string of it), in the order of the containers.

    ``must_include`` is a list; ``list_match.items`` holds alternatives, each a value or a list; ``fuzzy_match`` and
    ``exact_match`` are values, the second or a list; ``number_match`` has a value or values. What must not be said is no
    answer. Answers shorter than ``least`` fall out, and so do those of five words or more that the intent holds.
    """

    def found(v: Column) -> Column:
        at = "$.reference_answers."
        items = F.coalesce(F.try_variant_get(v, at + "list_match.items", "array<variant>"), F.array().cast("array<variant>"))
        alternatives = F.flatten(F.transform(items, lambda x: _strings(x, "$")))
        every = [
            _only(v, at + "must_include", True), alternatives, _only(v, at + "fuzzy_match", False), _strings(v, at + "exact_match"),
            _only(v, at + "number_match.value", False), _only(v, at + "number_match.values", True),
        ]
        return F.filter(F.flatten(F.array(*every)), lambda x: x.isNotNull())

    asked = tidy(F.coalesce(intent, F.lit("")))
    # What is too short, and what only says the question again.
    fits = lambda x: (F.length(F.regexp_replace(F.trim(x), r"\s+", " ")) >= least) & ~((F.size(F.split(tidy(x), " ")) >= RESTATES) & F.contains(asked, tidy(x)))
    return F.filter(F.coalesce(t.let(decoded(evaluation), found), F.array().cast("array<string>")), fits)


def leaks(text: Column, wanted: Column, least: int = LEAST) -> Column:
    """Whether a text holds any of the answers, both tidied."""
    return t.let(tidy(text), lambda low: F.exists(wanted, lambda a: (F.length(tidy(a)) >= least) & F.contains(low, tidy(a))))


def stripped(recipe: Column, wanted: Column) -> Column:
    """A recipe without what gives its answer away.

    The last step loses its closing sentence if that hands something in quotes to the user and the rest holds none of the ``wanted``
    answers. Otherwise the whole last step goes, and with it each step before for as long as it holds one. Without answers only the
    last step is touched; a text without numbered steps is trimmed at its end.
    """

    def fold(parts: Column) -> Column:
        steps, n = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.size(parts) - 1
        last = right_trimmed(F.element_at(parts, -1))
        mark = F.regexp_extract(last, r"\A(\s*\d+\.(?:\s|\z))", 1)
        body = F.substr(last, F.length(mark) + 1)
        kept = right_trimmed(F.regexp_replace(body, HANDS_OVER, ""))
        some = F.exists(wanted, lambda a: F.length(tidy(a)) >= LEAST)
        narrow = F.rlike(body, F.lit(HANDS_OVER)) & ~(some & leaks(kept, wanted))
        before = lambda k: right_trimmed(F.substring(F.array_join(F.slice(parts, 1, k + 1), ""), 2, 1 << 30))
        earlier = F.reverse(F.slice(steps, 1, F.greatest(n - 1, F.lit(0))))
        state = F.struct((n - 1).alias("k"), F.lit(True).alias("going"))
        step = lambda s, x: F.struct(F.when(s.going & leaks(x, wanted), s.k - 1).otherwise(s.k).alias("k"), (s.going & leaks(x, wanted)).alias("going"))
        left = F.when(some, F.aggregate(earlier, state, step, lambda s: s.k)).otherwise(n - 1)
        whole = F.when(narrow & (kept != ""), F.concat(before(n - 1), F.lit("\n"), mark, kept)).when(narrow, before(n - 1)).otherwise(before(left))
        return F.when(n < 1, before(F.lit(0))).otherwise(whole)

    # A line end before the text makes what stands before the first step a part of its own, empty or not.
    return F.when(recipe == "", recipe).otherwise(t.let(F.split(F.concat(F.lit("\n"), recipe), STEP), fold))


def manual(sections: Column, site: Column, keep: tuple[int, ...] = VARIANTS["full"]) -> Column:
    """A manual rebuilt from its sections (a map by number): title, and each section to keep with its heading, filled where it is empty."""
    own = lambda k: F.coalesce(F.nullif(F.try_element_at(sections, F.lit(k)), F.lit("")), F.lit(FILLER))
    parts = [F.concat(F.lit("# Site manual: "), site)]
    for k in sorted(keep):
        parts += [F.lit(f"## {k}. {HEADINGS[k - 1]}"), own(k)]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))
