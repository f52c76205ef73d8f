"""Main text of HTML pages by equivalence-class template deduction.

1. A page's tokens are its tags, told apart by their path from the root (with class and
   id), and its text runs. How often each page of a host holds a
   token is the token's occurrence vector. Vectors are never gathered: a vector's fingerprint is the
   sum over pages of a hash of page and count, an aggregate that needs no page in one
   place, so a host with a third of all pages is no special case.
2. Tokens of a host with one fingerprint form an equivalence class. Classes that are large (two
   tokens or more) and frequent (half of the host's pages or more) are valid. A text run counts only if pages
   that differ hold it, and one within an article only if articles that differ hold it: copies prove nothing.
3. Valid classes nest: an element is the template's if its own token and those of all elements around it are
   in valid classes. What lies between the template's tokens are its slots, and a slot's place in the nest says what it is
   for: what stands in menus, headers, footers, side bars, adverts, forms or comments is not main text, nor is the template's own text,
   and where an article is marked only what lies within it is taken.
4. Names are a further check on what stands in a slot, and judge a part whose name prose bears as well (``_LOOSE_WORDS``)
   only if it is the template's own and its text doesn't vary between pages or stands beside text of the template, like the heading of a box.
   What remains, decoded, is the main text.

Where a host's pages share no template, a page's is deduced from it alone. Without any template a page is one slot, and all its text comes out.

Paths are hashes that grow with each element, and elements nest to ``DEPTH`` at most, as in browsers; what is open beyond
that hangs there. So a page takes memory in proportion to its length, however broken it is.

The templates of all hosts go to every task only while they are at most ``MOST_BYTES`` together;
beyond that they are joined to the pages by host, which the adaptive planner splits where a host is hot.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import modest_batches, written

#: Size up to which the hosts' templates are sent to every task, and the share of a host's pages that makes a class frequent.
MOST_BYTES, FREQUENT = 16 << 20, 0.5
#: Pages that must hold a text run within their articles before it counts as the template's: two articles may share a line by chance.
PROOF = 3
#: Elements that nest.
DEPTH = 512

_PART = re.compile(
    r"<!--.*?(?:(-->)|\Z)|<[!?][^>]*>|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*?(?:/>|>.*?(?:(</(?P=raw)\s*>)|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed values of the HTML standard: elements without an end, elements within a line, and elements that end an open one of the same kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SELF_ENDING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_P_WITHIN = _ENDS_P - {"p"} | {"td", "li", "body"}
#: Elements, and names in class, id or role, that mark what isn't main text.
_ASIDE = frozenset("head nav header footer aside form dialog menu button select fieldset".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored sidebar cookie cookies consent gdpr notice notices popup modal newsletter subscribe share sharing "
    "social comment comments respond reply replies disqus nav navbar navigation menu breadcrumb breadcrumbs header footer masthead related search login pagination pager complementary contentinfo".split()
)
#: Names of readers' comments, which articles may bear too when they stand in another or outside of the main one.
_COMMENT_WORDS = frozenset("comment comments respond reply replies disqus".split())
#: Those of them that name parts of articles too. (Adverts and comments vary between pages as articles do, so the template can't tell them.)
_LOOSE_WORDS = frozenset("banner header navigation notice notices related reply respond search share sharing social".split())
#: Words that say nothing of a name's meaning: ``share-buttons`` is a name for sharing, ``share-price`` is not.
_PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box button buttons center column container content el footer form global group header icons inner item items left links list main message module outer "
    "page panel posts primary right row secondary section signup site slot small stories sub text the thread top unit widget wrap wrapper".split()
)
_MAIN = frozenset(("article", "main"))
#: Elements that only a page has: a form around one of them is a wrapper of the page, of which its controls alone are left out.
_PAGE_PARTS = frozenset("article main nav header footer h1".split())
_CONTROLS = frozenset("label legend option".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_NUMBER = re.compile(r"[0-9]+(?:x[0-9]+)?\Z")


def _sign(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _named(names: str, words: frozenset[str]) -> set[str]:
    """The words among ``words`` that a class, id or role is a name of: they stand alone or beside numbers and words without meaning."""
    found: set[str] = set()
    for name in names.split():
        parts = [x for x in _SPLIT.split(name) if x]
        own = words.intersection(parts)
        if own and all(x in own or x in _PLAIN_WORDS or x in _ASIDE_WORDS or _NUMBER.match(x) for x in parts):
            found |= own
    return found


class _Kind:
    """What an element's tag and names say of it."""

    __slots__ = ("aside", "comment", "form", "loose", "main", "part")

    def __init__(self, tag: str, names: str) -> None:
        said = _named(names, _ASIDE_WORDS) if names and tag not in ("html", "body") else set()
        self.comment = bool(said & _COMMENT_WORDS)
        self.main = tag in _MAIN or "main" in names.split()
        self.aside = tag in _ASIDE or (bool(said) and tag not in _MAIN)
        self.form = tag == "form" and not said
        self.part = self.main or tag in _PAGE_PARTS
        # A word alone may name a part of the article; with words like box or list beside it, it doesn't.
        self.loose = self.aside and tag not in _ASIDE and said <= _LOOSE_WORDS and said <= set(names.split())


@lru_cache(4096)
def _kind(tag: str, names: str) -> _Kind:
    return _Kind(tag, names)


class Element:
    """An element: its path's hash, what it is, where it begins, and what a reader keeps of it."""

    __slots__ = ("at", "key", "kind", "own", "parent", "tag")

    def __init__(self, tag: str, names: str, parent: Element | None, at: int = -1) -> None:
        self.tag, self.parent, self.kind, self.at = tag, parent, _kind(tag, names), at
        self.key = _sign(f"{parent.key if parent else 0} {tag} {names}")
        self.own = None


ROOT = Element("", "", None)


def read(page: str) -> Iterator[tuple[str, Element, str]]:
    """A page's parts in order: ``("open" | "close" | "void", element, tag)`` and ``("text", element around it, raw text)``.

    An end tag ends what is open within its element; one that fits nothing open is passed over.
    """
    stack: list[Element] = [ROOT]

    def end(names: tuple[str, ...], barrier: tuple[str, ...] | frozenset[str] = ()) -> bool:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in names:
                del stack[at:]
                return True
            if stack[at].tag in barrier:
                return False
        return False

    # Behind the last > nothing can end, and nothing is looked for; so what never ends is not read again from each of its beginnings.
    at, last, open_end = 0, page.rfind(">") + 1, False
    for m in _PART.finditer(page, 0, last):
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            open_end = at == last and not (m[1] or m[3]) and (m[0].startswith("<!--") or (m["raw"] is not None and not m[0].endswith("/>")))
            continue
        if m["end"]:
            closed = next((e for e in reversed(stack) if e.tag == tag), None)
            if closed is not None:
                yield "close", closed, tag
                end((tag,))
            continue
        if tag in _SELF_ENDING and tag != "p":
            end(_SELF_ENDING[tag], ("ul", "ol", "dl", "table", "select"))
        elif tag in _ENDS_P:
            # A paragraph that is open around one of these was ended by it, so none needs to be looked for beyond the nearest.
            end(("p",), _P_WITHIN)
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m["rest"])).lower() if m["rest"] else ""
        new = Element(tag, names, stack[min(len(stack), DEPTH) - 1], m.start())
        if tag in _VOID:
            yield "void", new, tag
        else:
            del stack[DEPTH:]
            stack.append(new)
            yield "open", new, tag
    if at < len(page) and not open_end:
        rest = page[at:]
        rest = rest[: m.start()] if (m := re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)) else rest
        if rest:
            yield "text", stack[-1], rest


def _text_token(around: Element, text: str) -> int:
    return _sign(f"{around.key}#{' '.join(text.split())}")


def _end_token(key: int) -> int:
    return _sign(f"{key}>")


def _part_token(key: int) -> int:
    return _sign(f"{key}~")


#: Kinds of tokens: tags, text runs, and loosely named parts.
TAG, TEXT, PART = 0, 1, 2


def tokens(page: str | None, sign: int = 0) -> list[tuple[int, int, int, int]]:
    """``(token, kind, n, sign)``: how often a page holds each token, and a sign of what must differ for the token to prove a template.

    That is the page's ``sign``, or, for text within an article, the sign of all text there. A loosely named part is
    a token of its own, with the sign of its text.
    """
    found: Counter[tuple[int, int]] = Counter()
    within: set[int] = set()
    main, loose = xxhash.xxh3_64(), {}
    for what, e, text in read(page) if page else ():
        if what != "text":
            key = e.key
            found[key if what != "close" else _end_token(key), TAG] += 1
            if what != "close":
                # What is main, and which loosely named parts are around, goes down from parent to child.
                up = e.parent.own or (False, ())
                inner = (*up[1], key) if e.kind.loose and what == "open" and key not in up[1] else up[1]
                e.own = (up[0] or e.kind.main, inner)
                if e.kind.loose and what == "open":
                    found[_part_token(key), PART] += 1
                    loose.setdefault(key, xxhash.xxh3_64())
        elif text.strip():
            token = _text_token(e, text)
            found[token, TEXT] += 1
            is_main, parts = e.own or (False, ())
            if is_main:
                within.add(token)
                main.update(token.to_bytes(8, "little"))
            for part in parts:
                loose[part].update(token.to_bytes(8, "little"))
    own = {_part_token(k): x.intdigest() >> 1 for k, x in loose.items()}
    own |= dict.fromkeys(within, main.intdigest() >> 1)
    return [(token, kind, n, own.get(token, sign)) for (token, kind), n in found.items()]


def alone(page: str) -> frozenset[int]:
    """The template of a page that has no host to share with: one page proves no text and no part, only tags."""
    return frozenset(t[0] for t in tokens(page) if t[1] == TAG)


def extract(page: str | None, template: frozenset[int], names: bool = True) -> str:
    """The main text of a page: what is left in the slots of a template. Without ``names`` only the template's own elements are judged.

    The page is read twice, as a box's heading may come last and the article after what looks like one.
    """
    if not page:
        return ""
    boxes: set[int] = set()
    wrappers: set[int] = set()
    own_main = False
    for what, e, text in read(page):
        if what == "open":
            own_main |= e.kind.main and bool(template) and not (e.kind.comment and names)
            # What stands around each element goes down from parent to child: the form that is innermost.
            e.own = e if e.kind.form else e.parent.own
            if e.kind.part:
                form = e.own
                while form is not None and form.at not in wrappers:
                    wrappers.add(form.at)
                    form = form.parent.own
        elif what == "text" and text.strip() and _text_token(e, text) in template:
            while e is not None and e.at not in boxes:  # the template's text makes all that is around it boxes
                boxes.add(e.at)
                e = e.parent

    def judged(e: Element, parent: tuple[bool, bool, bool]) -> tuple[bool, bool, bool]:
        """Whether an element is nested in the template, whether text within it may be main text, and whether an article is around it."""
        (nested, ok, inside), kind = parent, e.kind
        nested = nested and e.key in template
        if ok and template and (names or nested):
            comment = kind.comment and (inside or not kind.main or own_main)
            aside = comment or (kind.aside and not (kind.form and e.at in wrappers)) or (bool(wrappers) and e.tag in _CONTROLS)
            if aside and kind.loose and inside and not comment:
                # The template's own part is left out if its text doesn't vary or stands beside text of the template.
                aside = nested and (_part_token(e.key) not in template or e.at in boxes)
            ok = not aside
        return nested, ok, inside or (kind.main and ok)

    blocks: list[list[str]] = [[]]
    for what, e, text in read(page):
        if what != "text":
            if what != "close":
                e.own = judged(e, e.parent.own or (True, True, False))
            if text not in _INLINE and blocks[-1]:
                blocks.append([])
            continue
        _, ok, inside = e.own or (True, True, False)
        if ok and (inside or not own_main) and not (text.strip() and _text_token(e, text) in template):
            blocks[-1].append(_html.unescape(text))
    return " ".join(words for words in (" ".join("".join(b).split()) for b in blocks if b) if words)


def text_of(page: str | None, template: frozenset[int]) -> str:
    """The main text by the host's template or, where the host's pages share none, by the page's own."""
    return extract(page, template or alone(page)) if page else ""


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """``host, token``: the tokens of each host's valid classes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                sign = _sign(page or "")
                rows += [(host, *t[:3], sign, t[3]) for t in tokens(page, sign)]
                rows.append((host, -1, TAG, 1, sign, sign))  # counts the host's pages
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    columns = ["host", "token", "kind", "n", "sign", "own"]
    found = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html")).mapInPandas(count, "host string, token long, kind int, n int, sign long, own long")
    vectors = found.groupBy("host", "token", "kind").agg(
        F.sum(F.xxhash64("sign", "n").cast("decimal(38,0)")).alias("vector"),
        F.count("*").alias("pages"),
        F.min("own").alias("low"),
        F.max("own").alias("high"),
        F.max(F.col("own") != F.col("sign")).alias("inside"),
    )
    vectors = written(vectors, "occurrences")
    classes = vectors.where("token >= 0").groupBy("host", "vector", "pages").agg(F.count("*").alias("size"))
    hosts = vectors.where("token < 0").select("host", F.col("pages").alias("all"))
    valid = classes.join(hosts, "host").where((F.col("size") >= 2) & (F.col("pages") >= F.col("all") * FREQUENT)).select("host", "vector", "pages")
    # A text run is the template's only if pages or articles that differ hold it, and a part varies only if its texts differ.
    varied = F.col("low") < F.col("high")
    proven = (F.col("kind") == TAG) | (varied & ((F.col("kind") == PART) | ~F.col("inside") | (F.col("pages") >= PROOF)))
    return vectors.where("token >= 0").join(valid, ["host", "vector", "pages"]).where(proven).select("host", "token")


def main_texts(pages: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (columns page_id, url, html; others are ignored).

    A null or empty page, or one without main text, has an empty text. A null URL, or one without ``://``,
    counts to the host that has no name. Repeated rows come out as they are; an empty table gives an
    empty one. Very long, deep or broken pages take memory in proportion to their length.
    """
    modest_batches(pages.sparkSession)
    deduced = written(templates(pages), "templates")
    size = deduced.agg(F.sum(F.octet_length("host") + F.lit(8))).first()[0] or 0
    own = pages.select("page_id", F.col("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    whole = deduced.groupBy("host").agg(F.collect_list("token").alias("tokens"))
    none: frozenset[int] = frozenset()
    if size <= most_bytes:
        by_host = {r["host"]: frozenset(r["tokens"]) for r in whole.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        @F.pandas_udf("string")
        def main_text(host: pd.Series, page: pd.Series) -> pd.Series:
            return pd.Series([text_of(p, shared.value.get(h, none)) for h, p in zip(host, page, strict=True)], dtype="object")

        read_ = own.withColumn("text", main_text("host", "html"))
    else:

        @F.pandas_udf("string")
        def main_text(template: pd.Series, page: pd.Series) -> pd.Series:
            return pd.Series([text_of(p, none if t is None else frozenset(t)) for t, p in zip(template, page, strict=True)], dtype="object")

        read_ = own.join(whole, "host", "left").withColumn("text", main_text("tokens", "html"))
    return read_.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
