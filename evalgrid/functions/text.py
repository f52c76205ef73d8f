"""Text as column expressions: tokens, n-grams, sections, tags and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row; a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


#: A word of a leak gate, on lower-cased text.
WORD = r"[A-Za-z][A-Za-z0-9'\-]*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def ngrams(text: Column, n: int) -> Column:
    """The set of word n-grams; empty if the text is shorter."""

    def grams(w: Column) -> Column:
        last = F.size(w) - n + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(words(text), grams)


def ngrams_sql(text: str, n: int) -> tuple[str, str]:
    """DuckDB's n-grams of the words ``w``, and the expression for those words."""
    w = f"regexp_extract_all(lower({text}), '[A-Za-z][A-Za-z0-9''\\-]*')"
    return f"[array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]", w


def sections(text: Column) -> Column:
    """Bodies of a manual's numbered sections by number; of duplicates the last wins."""
    every = F.split(text, r"(?m)^## (?=\d\.)")
    parts = F.slice(every, 2, F.greatest(F.size(every), F.lit(1)))
    pairs = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).cast("int").alias("k"), F.regexp_replace(F.substring(p, 3, 1_000_000_000), r"\A\s+|\s+\z", "").alias("body")))
    # At most ten numbers: the last body of each.
    last = lambda found: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.try_element_at(F.filter(found, lambda x: x.k == k), F.lit(-1)))
    return F.map_from_entries(F.filter(let(pairs, last), lambda x: x.isNotNull()))


def tags(html: Column) -> Column:
    """Names of the opening tags in order, in lower case."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), lambda t: F.lower(t))


#: Roles by tag, in the order of role vectors; other tags count as the last.
ROLES = {"a": "link", "h1": "heading", "p": "paragraph", "li": "listitem", "nav": "navigation", "article": "article", "footer": "contentinfo", "b": "strong"}


def role_counts(html: Column) -> Column:
    """Counts of the roles in fixed order, with ``_other`` last."""

    def counts(t: Column) -> Column:
        known = [F.size(F.filter(t, _is(k))) for k in ROLES]
        other = F.size(t)
        for k in known:
            other = other - k
        return F.array(*[k.cast("double") for k in known], other.cast("double"))

    return let(tags(html), counts)


def _is(tag: str):
    return lambda x: x == tag


def l2_normalised(v: Column) -> Column:
    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
        return let(norm, lambda n: F.transform(x, lambda y: F.when(n > 0, y / n).otherwise(0.0)))

    return let(v, scaled)


def hue(hexes: Column) -> tuple[Column, Column, Column]:
    """Hue (degrees), saturation and lightness of a colour of six hex digits."""
    r, g, b = [F.conv(F.substring(hexes, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5)]
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = high - low, (high + low) / 2
    h = F.when(span == 0, 0.0).when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    s = F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1)))
    return h, s, light
