"""Style sheets: a tokenizer for their declarations, colours in every notation, and counts of what a design uses.

A sheet is read once, from left to right: strings, comments, blocks within blocks and declarations are told apart as they come. What is
counted is a table of tests on a declaration's property and value, which Spark and SQL conditions are made from.
"""

from __future__ import annotations

import colorsys
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

STYLE, COMMENT = r"(?is)<style[^>]*>(.*?)</style>", r"(?s)/\*.*?\*/"
_PIECE = re.compile(r"\"(?:\\.|[^\"\\])*+\"?|'(?:\\.|[^'\\])*+'?|/\*.*?(?:\*/|\Z)|\((?:\"[^\"]*\"|'[^']*'|[^()\"'])*+\)|[{};:]|[^{};:\"'/(]++|.", re.S)
_NAME = re.compile(r"-{0,2}[a-zA-Z_][-a-zA-Z0-9_]*\Z")

#: Tests of a property or a value: = is, ^ begins with, $ ends with, ~ holds, / fits a pattern, ! isn't. Those of one side are alternatives, but what isn't must not be.
#: A declaration counts if both sides fit, or either where the table says "or". (What is counted is the definition of the measure.)
_COLOURED = "~color ^border =background =outline =fill =stroke =box-shadow =text-shadow"
_SIZED = "=font-size =font"
COUNTED: dict[str, tuple[str, str, str]] = {
    "animation": ("^animation", "", "and"),
    "border_radius": ("~border-radius", "", "and"),
    "fixed_px_width": ("=width =min-width =max-width", "/[0-9]px/", "and"),
    "flex": ("~flex", "^flex ^inline-flex", "or"),
    "float": ("=float", "!none", "and"),
    "fluid_unit": ("", "/[0-9.](?:%|(?:vw|vh|fr)(?:[^a-z0-9]|$))/ ~minmax(", "and"),
    "gradient": ("", "~gradient(", "and"),
    "grid": ("^grid", "^grid ^inline-grid", "or"),
    "hex": (_COLOURED, "/#(?:[0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})(?:[^0-9a-z]|$)/", "and"),
    "hsl": (_COLOURED, "/hsla?[(]/", "and"),
    "important": ("", "~!important", "and"),
    "pos_absolute": ("=position", "=absolute", "and"),
    "pos_fixed": ("=position", "=fixed =sticky", "and"),
    "rgb": (_COLOURED, "/rgba?[(]/", "and"),
    "shadow": ("~shadow", "", "and"),
    "transform": ("=transform $-transform !text-transform", "", "and"),
    "transition": ("^transition", "", "and"),
    "unit_em": (_SIZED, "/[0-9.]em/", "and"),
    "unit_percent": (_SIZED, "/[0-9.]%/", "and"),
    "unit_pt": (_SIZED, "/[0-9.]pt/", "and"),
    "unit_px": (_SIZED, "/[0-9.]px/", "and"),
    "unit_rem": (_SIZED, "/[0-9.]rem/", "and"),
    "vendor": ("^-webkit- ^-moz- ^-ms-", "", "and"),
}
#: Named colours that count, and the steps of web-safe ones.
NAMED = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff", "magenta": "ff00ff",
    "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff", "cyan": "00ffff", "orange": "ffa500",
    "darkblue": "00008b", "lightgray": "d3d3d3", "lightgrey": "d3d3d3", "darkgray": "a9a9a9", "whitesmoke": "f5f5f5", "gainsboro": "dcdcdc", "beige": "f5f5dc", "ivory": "fffff0", "crimson": "dc143c", "gold": "ffd700",
}
WEB_SAFE = (0x00, 0x33, 0x66, 0x99, 0xCC, 0xFF)


def read(css: str | None) -> Iterator[tuple[str, str]]:
    """Property and value of each declaration, in lower case. Text before a block is its selector; what a sheet leaves open ends with it."""
    name, held, depth = None, [], 0

    def declared() -> Iterator[tuple[str, str]]:
        value = "".join(held).strip().lower()
        if depth and name is not None and value:
            yield name, value

    for piece in _PIECE.findall(css or ""):
        if piece.startswith("/*"):
            held.append(" ")
        elif piece in ("{", "}", ";"):
            if piece != "{":
                yield from declared()
            depth = max(0, depth + (piece == "{") - (piece == "}"))
            name, held = None, []
        elif piece == ":" and name is None and _NAME.match(own := "".join(held).strip()):
            name, held = own.lower(), []
        else:
            held.append(piece)
    yield from declared()


_NOTATIONS = re.compile(r"#([0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{3,4})(?![0-9a-z])|(rgb|hsl)a?\(([^)]*)\)|(?<![-\w#])(" + "|".join(NAMED) + r")(?![-\w(])")


def colours_of(value: str) -> Iterator[tuple[int, int, int, str]]:
    """Red, green, blue and the notation of each colour in a value."""
    for digits, kind, inner, name in _NOTATIONS.findall(value):
        if kind:
            parts = [x for x in re.split(r"[\s,/]+", inner.strip()) if x]
            try:
                numbers = [float(re.sub(r"(?:deg|%)$", "", x)) for x in parts[:3]]
            except ValueError:
                continue
            if len(numbers) == 3 and kind == "rgb":
                yield *(min(255, max(0, int((n * 255 / 100 if x.endswith("%") else n) + 0.5))) for n, x in zip(numbers, parts, strict=False)), kind
            elif len(numbers) == 3:
                rgb = colorsys.hls_to_rgb(numbers[0] / 360 % 1, min(1, max(0, numbers[2] / 100)), min(1, max(0, numbers[1] / 100)))
                yield *(int(255 * x + 0.5) for x in rgb), kind
        else:
            code = NAMED[name] if name else "".join(2 * c for c in digits[:3]) if len(digits) < 6 else digits
            yield *(int(code[i : i + 2], 16) for i in (0, 2, 4)), "named" if name else "hex3" if len(digits) < 6 else "hex6"


def _tests(column: str, tests: str, like: str) -> str:
    """SQL of the tests of one side, joined."""
    quoted = lambda x: x.replace("'", "''")
    how = {
        "=": "{0} = '{1}'", "^": "{0} LIKE '{1}%'", "$": "{0} LIKE '%{1}'", "~": "contains({0}, '{1}')", "/": like, "!": "{0} <> '{1}'",
    }
    found: dict[bool, list[str]] = {True: [], False: []}
    for x in re.findall(r"/.*?/(?= |$)|\S+", tests):
        found[x[0] != "!"].append(how[x[0]].format(column, quoted(x[1:].rstrip("/") if x[0] == "/" else x[1:])))
    return " AND ".join([f"({' OR '.join(found[True])})"] * bool(found[True]) + found[False])


def condition(name: str, dialect: str) -> str:
    """The test of a counter on a declaration ``x`` (property ``x.p``, value ``x.v``) in Spark's or DuckDB's SQL."""
    like = "regexp_like({0}, '{1}')" if dialect == "spark" else "regexp_matches({0}, '{1}')"
    prop, value, how = COUNTED[name]
    return f" {how.upper()} ".join(f"({s})" for s in (_tests("x.p", prop, like), _tests("x.v", value, like)) if s)


def sheet(html: Column) -> Column:
    """The text of a page's style elements."""
    return F.array_join(F.regexp_extract_all(html, F.lit(STYLE), 1), "\n")


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in "pv"])))
def declarations(css: pd.Series) -> pd.Series:
    """Properties and values of a sheet, in order."""
    return pd.Series([[{"p": p, "v": v} for p, v in read(c)] for c in css])


@F.pandas_udf(ArrayType(StructType([*(StructField(c, IntegerType()) for c in "rgb"), StructField("notation", StringType())])))
def colours(found: pd.Series) -> pd.Series:
    """The colours that declarations (as ``declarations`` gives them) set, in order."""
    bears = lambda p: "color" in p or p.startswith("border") or p in ("background", "outline", "fill", "stroke", "box-shadow", "text-shadow")
    return pd.Series([[dict(zip("rgb", c, strict=False)) | {"notation": c[3]} for x in ds if bears(x["p"]) for c in colours_of(x["v"])] for ds in found])


def count(column: str, name: str) -> Column:
    return F.expr(f"size(filter({column}, x -> {condition(name, 'spark')}))")


def counters(column: str) -> Column:
    """``name=n`` of every counter that isn't 0, by name."""
    each = [F.struct(F.lit(n).alias("k"), count(column, n).alias("n")) for n in sorted(COUNTED)]
    return F.array_join(F.transform(F.filter(F.array(*each), lambda c: c.n > 0), lambda c: F.concat_ws("=", c.k, c.n.cast("string"))), " ")


def first_families(column: str) -> Column:
    """The first font family of each declaration of families, without quotes."""
    first = F.transform(F.filter(column, lambda x: x.p == "font-family"), lambda x: F.trim(F.translate(F.split(x.v, ",")[0], "\"'", "")))
    return F.filter(first, lambda f: f != "")


def families(column: str) -> Column:
    """The distinct first font families, in order."""
    return F.array_join(F.array_sort(F.array_distinct(first_families(column))), ",")


def palette(column: str) -> Column:
    """The distinct colours that are written as six hex digits or three, as six, in order, whatever property bears them."""
    found = F.flatten(F.transform(F.filter(column, lambda x: F.contains(x.v, F.lit("#"))), lambda x: F.regexp_extract_all(x.v, F.lit(r"#([0-9a-f]{6}|[0-9a-f]{3})(?:[^0-9a-z]|$)"), 1)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda h: F.when(F.length(h) == 6, h).otherwise(F.regexp_replace(h, "(.)", "$1$1")))))
