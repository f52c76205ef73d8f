"""URL algebra and page elements as column expressions. Pages are read without a DOM, by patterns over their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def origin(url: Column) -> Column:
    """Scheme and host, as they are written."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ends = F.rlike(path, F.lit(r"/\.\.?$"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def site_path(url: Column, base: Column) -> Column:
    """Path and query, from the host's root, of a reference found on page ``base``; null if it leads off the site or isn't a page's."""
    ref = F.trim(url)
    part = lambda u, i: F.regexp_extract(u, _SPLIT, i)
    scheme, host, path, query = (part(ref, i) for i in (1, 2, 3, 4))
    own_host, own_path, own_query = (part(base, i) for i in (2, 3, 4))
    folder = F.regexp_extract(F.when(own_path == "", F.lit("/")).otherwise(own_path), r"^(.*/)", 1)
    joined = F.when(path == "", own_path).when(F.startswith(path, F.lit("/")) | (host != ""), path).otherwise(F.concat(folder, path))
    asked = F.when((path == "") & (query == "") & (host == ""), own_query).otherwise(query)
    off = ((scheme != "") & ~F.lower(scheme).isin("http", "https")) | ((host != "") & (host != own_host)) | ((scheme != "") & (host == ""))
    absolute = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(~off, F.concat(F.when(F.contains(absolute, F.lit("/.")), without_dots(absolute)).otherwise(absolute), asked))


#: Character references that labels hold, and what they stand for; the ampersand's comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def label(html: Column) -> Column:
    """The text of a piece of html: tags and references resolved, white space collapsed, 120 characters at most."""
    out = F.regexp_replace(html, r"<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.left(F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " ")), F.lit(120))


def label_sql(html: str) -> str:
    out = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES:
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"left(trim(regexp_replace({out}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), 120)"


#: Most links of a page and most other labels.
MOST_LINKS, MOST_LABELS = 200, 60
#: Patterns of a page's elements; the group is the element's content or attribute.
LINK = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
HEADING = r"(?is)<h{0}\b[^>]*>(.*?)</h{0}>"
BUTTON = r"(?is)<button\b[^>]*>(.*?)</button>"
INPUT = r'(?is)<(?:input|textarea|select)\b[^>]*?\b(?:placeholder|aria-label|name)\s*=\s*"([^"]*)"'
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"


def every(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), group)


def links(html: Column, base: Column) -> Column:
    """``array<struct<label, path>>`` of the links that stay on the site, in order, each (label, path) once."""
    pairs = F.arrays_zip(F.slice(every(html, LINK, 1), 1, MOST_LINKS).alias("href"), F.slice(every(html, LINK, 2), 1, MOST_LINKS).alias("text"))
    out = F.transform(pairs, lambda x: F.struct(label(x["text"]).alias("label"), site_path(x["href"], base).alias("path")))
    return F.array_distinct(F.filter(out, lambda x: x.path.isNotNull()))


def levelled(texts: Column, n: int) -> Column:
    return F.transform(texts, lambda x: F.concat(F.lit(f"h{n}: "), x))


def headings(html: Column) -> Column:
    """``hN: text`` of the headings of the first three levels, level by level."""
    found = [levelled(F.transform(every(html, HEADING.format(n)), label), n) for n in (1, 2, 3)]
    return F.slice(F.concat(*found), 1, MOST_LABELS)


def observed_labels(html: Column) -> Column:
    """All that a page's elements say, in lower case: links, buttons, inputs, headings with and without their level, and the title."""
    said = F.concat(F.transform(every(html, LINK, 2), label), F.transform(every(html, BUTTON), label), F.transform(every(html, INPUT), label), F.transform(every(html, TITLE), label))
    heads = [F.transform(every(html, HEADING.format(n)), label) for n in range(1, 7)]
    named = [levelled(h, n) for n, h in enumerate(heads, 1)]
    return F.array_distinct(F.filter(F.transform(F.concat(said, *heads, *named), lambda x: F.lower(x)), lambda x: F.trim(x) != ""))
