"""Queries over pages: links and their paths, elements, labels, and crawls over the links that pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions import styles, urls
from evalgrid.functions.text import hue
from evalgrid.operators import graphs
from evalgrid.plans import register
from evalgrid.sources import bindings as b
from evalgrid.sources import files

S = SparkSession
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
#: References on the given pages are absolute paths; others are held against a library in the tests.
PATH = "regexp_replace(regexp_replace({u}, '^[a-z]+://[^/?#]*', ''), '#.*$', '')"
OWN = f"(CASE WHEN left({PATH.format(u='url')}, 1) = '/' THEN '' ELSE '/' END || {PATH.format(u='url')})"
LINKS = f"""SELECT page_id, {HOST} AS host, url, i, {urls.label_sql('text')} AS label, {PATH.format(u='href')} AS path FROM (
    SELECT page_id, url, unnest(range(1, 201)[1:len(hrefs)]) AS i, unnest(hrefs) AS href, unnest(texts) AS text FROM (SELECT page_id, url, regexp_extract_all(html, '{urls.LINK}', 1)[1:200] AS hrefs, regexp_extract_all(html, '{urls.LINK}', 2)[1:200] AS texts FROM pages))"""


def host():
    return F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))


def linked(spark: S, d: str) -> DataFrame:
    """``page_id, host, ord, label, path`` of every link that stays on its site, once a page."""
    p = b.table(spark, d, "pages").select("page_id", host().alias("host"), F.posexplode(urls.links(F.col("html"), F.col("url"))).alias("ord", "x"))
    return p.select("page_id", "host", "ord", "x.*")


@register("fn02_url_algebra", f"""SELECT p.page_id, host, path, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || path AS absolute, coalesce(n, 0) AS links, coalesce(resolved, '') AS resolved FROM (SELECT page_id, url, {HOST} AS host, {OWN} AS path FROM pages) p
  LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(path, ' ' ORDER BY path) AS resolved FROM (SELECT DISTINCT page_id, path FROM ({LINKS})) GROUP BY 1) USING (page_id)""")
def fn02(spark: S, d: str) -> DataFrame:
    """Each page's host, its path from the host's root, the address that gives back, and the paths that its references lead to."""
    own = b.table(spark, d, "pages").select("page_id", "url", host().alias("host"), urls.site_path(F.col("url"), F.col("url")).alias("path"), urls.links(F.col("html"), F.col("url")).alias("l"))
    paths = F.array_sort(F.array_distinct(F.transform("l", lambda x: x.path)))
    return own.select("page_id", "host", "path", F.concat(urls.origin(F.col("url")), "path").alias("absolute"), F.size(paths).cast("long").alias("links"), F.array_join(paths, " ").alias("resolved"))


def _texts(pattern: str, prefix: str = "") -> str:
    return f"['{prefix}' || {urls.label_sql('x')} FOR x IN regexp_extract_all(html, '{pattern}', 1)]"


HEADS = "list_concat(list_concat(" + ", ".join(_texts(urls.HEADING.format(n), f"h{n}: ") for n in (1, 2)) + "), " + _texts(urls.HEADING.format(3), "h3: ") + ")"


@register("fn12_page_elements", f"""SELECT p.page_id, title, headings, coalesce(links, '') AS links, buttons, inputs, forms FROM (SELECT page_id, {urls.label_sql(f"regexp_extract(html, '{urls.TITLE}', 1)")} AS title, array_to_string({HEADS}[1:60], ' | ') AS headings, array_to_string({_texts(urls.BUTTON)}[1:60], ' | ') AS buttons,
    array_to_string({_texts(urls.INPUT)}[1:60], ' | ') AS inputs, len(regexp_extract_all(html, '(?i)<form\\b'))::BIGINT AS forms FROM pages) p
  LEFT JOIN (SELECT page_id, string_agg(label || ' ' || path, ' | ' ORDER BY i) AS links FROM (SELECT page_id, label, path, min(i) AS i FROM ({LINKS}) GROUP BY ALL) GROUP BY 1) USING (page_id)""")
def fn12(spark: S, d: str) -> DataFrame:
    """What a page offers: title, headings, links with the paths that they lead to, buttons, inputs and forms."""
    html = F.col("html")
    some = lambda p: F.array_join(F.slice(F.transform(urls.every(html, p), urls.label), 1, urls.MOST_LABELS), " | ")
    links = F.array_join(F.transform(urls.links(html, F.col("url")), lambda x: F.concat_ws(" ", x.label, x.path)), " | ")
    return b.table(spark, d, "pages").select(
        "page_id", urls.label(F.regexp_extract("html", urls.TITLE, 1)).alias("title"), F.array_join(urls.headings(html), " | ").alias("headings"), links.alias("links"),
        some(urls.BUTTON).alias("buttons"), some(urls.INPUT).alias("inputs"), F.size(urls.every(html, r"(?i)<form\b", 0)).cast("long").alias("forms"))


SAID = [urls.LINK, urls.BUTTON, urls.INPUT, urls.TITLE, *(urls.HEADING.format(n) for n in range(1, 7))]
LABELS = " UNION ALL ".join(
    [f"SELECT url, unnest([{urls.label_sql('x')} FOR x IN regexp_extract_all(html, '{p}', {2 if p == urls.LINK else 1})]) AS x FROM pages" for p in SAID]
    + [f"SELECT url, unnest({_texts(urls.HEADING.format(n), f'h{n}: ')}) FROM pages" for n in range(1, 7)])


@register("set04_observed_labels", f"SELECT {HOST} AS host, count(DISTINCT lower(x)) AS labels FROM ({LABELS}) WHERE trim(x, ' ') <> '' GROUP BY 1")
def set04(spark: S, d: str) -> DataFrame:
    p = b.table(spark, d, "pages").select(host().alias("host"), F.explode(urls.observed_labels(F.col("html"))).alias("label"))
    return p.distinct().groupBy("host").agg(F.count("*").alias("labels"))


#: Fixed values of a crawl: pages of a site and depth.
PAGES, DEPTH = 25, 3


def _crawl_sql() -> str:
    """The crawl in SQL, a round after the other: paths are known by (host, path), and a page by the smallest id of its path."""
    parts = [
        f"own AS (SELECT host, path, min(page_id) AS page_id FROM (SELECT page_id, {HOST} AS host, {OWN} AS path FROM pages) GROUP BY 1, 2)",
        f"links AS ({LINKS})",
        "edges AS (SELECT own.host, own.path AS src, links.path AS dst, min(i) AS i FROM own JOIN links USING (page_id) GROUP BY ALL)",
        "seen0 AS (SELECT host, arg_min(path, page_id) AS node, 0::BIGINT AS depth, 1::BIGINT AS place FROM own GROUP BY 1)",
        "front0 AS (FROM seen0)",
    ]
    for k in range(1, DEPTH + 1):
        parts.append(f"""front{k} AS (SELECT host, node, {k}::BIGINT AS depth, place FROM (SELECT f.host, f.node, before + row_number() OVER (PARTITION BY f.host ORDER BY f.place, f.i, f.node) AS place FROM (
          SELECT e.host, e.dst AS node, min((p.place, e.i)).f1 AS place, min((p.place, e.i)).f2 AS i FROM (SELECT host, node, {{'f1': place}}.f1 AS place FROM front{k - 1}) p JOIN edges e ON e.host = p.host AND e.src = p.node GROUP BY 1, 2) f
          JOIN (SELECT host, max(place) AS before FROM seen{k - 1} GROUP BY 1) s USING (host) WHERE (f.host, f.node) NOT IN (SELECT (host, node) FROM seen{k - 1})) WHERE place <= {PAGES})""".replace("min((p.place, e.i)).f1", "min({'f1': p.place, 'f2': e.i}).f1").replace("min((p.place, e.i)).f2", "min({'f1': p.place, 'f2': e.i}).f2").replace("{'f1': place}.f1", "place"))
        parts.append(f"seen{k} AS (FROM seen{k - 1} UNION ALL FROM front{k})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT s.host, node, depth, place, page_id IS NOT NULL AS there FROM seen{DEPTH} s LEFT JOIN own ON own.host = s.host AND own.path = node WHERE place <= {PAGES}"


@register("gr01_breadth_first_crawl", _crawl_sql())
def gr01(spark: S, d: str) -> DataFrame:
    """Each site crawled from its first page over the links that its pages hold, in their order; ``there`` says whether a path has a page."""
    pages = b.table(spark, d, "pages").select("page_id", host().alias("host"), urls.site_path(F.col("url"), F.col("url")).alias("path"))
    keep = lambda df: files.kept(df, "crawl")
    own = keep(pages.groupBy("host", "path").agg(F.min("page_id").alias("page_id")))
    edges = linked(spark, d).select("page_id", "ord", F.col("path").alias("dst")).join(own, "page_id").groupBy("host", F.col("path").alias("src"), "dst").agg(F.min("ord").alias("ord"))
    roots = own.groupBy("host").agg(F.min_by("path", "page_id").alias("node"))
    walk = graphs.crawl(roots, keep(edges), DEPTH, PAGES, keep=keep)
    return walk.join(own.select("host", F.col("path").alias("node"), F.lit(True).alias("there")), ["host", "node"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def _probe_sql() -> str:
    """The crawl in SQL with a search on each site's first page, whose result is the site's last page, and the rounds that follow it."""
    head, _, _ = _crawl_sql().rpartition("\nSELECT s.host")
    parts = [
        head,
        f"found AS (FROM seen{DEPTH} WHERE place <= {PAGES})",
        "front10 AS (SELECT o.host, arg_max(o.path, page_id) AS node, 1::BIGINT AS depth, any_value(before) + 1 AS place FROM own o JOIN (SELECT host, max(place) AS before FROM found GROUP BY 1) f ON f.host = o.host GROUP BY 1)",
        "seen10 AS (FROM found UNION ALL FROM front10)",
    ]
    for k in range(11, 10 + DEPTH):
        parts.append(f"""front{k} AS (SELECT host, node, {k - 9}::BIGINT AS depth, place FROM (SELECT f.host, f.node, before + row_number() OVER (PARTITION BY f.host ORDER BY f.first, f.node) AS place FROM (
          SELECT e.host, e.dst AS node, min({{'f1': p.place, 'f2': e.i}}) AS first FROM front{k - 1} p JOIN edges e ON e.host = p.host AND e.src = p.node GROUP BY 1, 2) f
          JOIN (SELECT host, max(place) AS before FROM seen{k - 1} GROUP BY 1) s USING (host) WHERE (f.host, f.node) NOT IN (SELECT (host, node) FROM seen{k - 1})) WHERE place <= {PAGES})""")
        parts.append(f"seen{k} AS (FROM seen{k - 1} UNION ALL FROM front{k})")
    return ",\n".join(parts) + f"\nSELECT host, node, depth, place, place IN (SELECT place FROM front10 p WHERE p.host = s.host) AS from_probe FROM seen{9 + DEPTH} s"


@register("gr01_crawl_with_probe", _probe_sql())
def gr01_probe(spark: S, d: str) -> DataFrame:
    """Each site crawled with one search. The given pages have no forms, so the first page's search stands in: it leads to the site's last page, which links may not reach."""
    pages = b.table(spark, d, "pages").select("page_id", host().alias("host"), urls.site_path(F.col("url"), F.col("url")).alias("path"))
    keep = lambda df: files.kept(df, "crawl")
    own = keep(pages.groupBy("host", "path").agg(F.min("page_id").alias("page_id")))
    edges = linked(spark, d).select("page_id", "ord", F.col("path").alias("dst")).join(own, "page_id").groupBy("host", F.col("path").alias("src"), "dst").agg(F.min("ord").alias("ord"))
    roots = own.groupBy("host").agg(F.min_by("path", "page_id").alias("node"), F.max_by("path", "page_id").alias("result"))
    return graphs.crawl_with_probe(roots.select("host", "node"), keep(edges), roots, DEPTH, PAGES, keep=keep)


#: Fixed values of a rendered page: most headings, link labels, link targets, buttons, fields and roles; and characters of a site.
SHOWN = {"headings": 20, "links": 40, "targets": 25, "buttons": 20, "inputs": 20, "roles": 25}
SITE_CHARS = 60_000


def _line_sql(name: str, listed: str, separator: str, most: str = "") -> str:
    return f"CASE WHEN len({listed}) > 0 THEN chr(10) || '{name}: ' || array_to_string({listed}{most}, '{separator}') ELSE '' END"


def _site_sql() -> str:
    head, _, _ = _crawl_sql().rpartition("\nSELECT s.host")
    roles = "[k || '=' || len(list_filter(ts, lambda y: y = k)) FOR k IN list_sort(list_distinct(ts))]"
    text = " || ".join([
        "'--- page ' || node || chr(10) || 'title: ' || title", _line_sql("headings", "heads", " | ", "[1:20]"), _line_sql("links", "labels", " | ", "[1:40]"), _line_sql("link targets", "targets", " ", "[1:25]"),
        _line_sql("buttons", "buttons", " | ", "[1:20]"), _line_sql("fields", "inputs", " | ", "[1:20]"), "chr(10) || 'forms: ' || forms", _line_sql("roles", roles, " ", "[1:25]")])
    return f"""{head}, pairs AS (SELECT page_id, label, path, min(i) AS i FROM links GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM pairs),
said AS (SELECT page_id, list(label ORDER BY k) FILTER (label <> '') AS labels FROM numbered GROUP BY 1), led AS (SELECT page_id, list(path ORDER BY k) AS targets FROM (SELECT page_id, path, min(k) AS k FROM numbered WHERE k <= 40 GROUP BY ALL) GROUP BY 1),
fields AS (SELECT page_id, {urls.label_sql(f"regexp_extract(html, '{urls.TITLE}', 1)")} AS title, {HEADS} AS heads, {_texts(urls.BUTTON)} AS buttons, {_texts(urls.INPUT)} AS inputs, len(regexp_extract_all(html, '(?i)<form\\b')) AS forms, [lower(x) FOR x IN regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)] AS ts FROM pages)
SELECT host, count(*) AS n_pages, left('site: ' || host || chr(10) || 'pages crawled: ' || count(*) || chr(10) || string_agg(text, chr(10) ORDER BY place), {SITE_CHARS}) AS rendered FROM (
  SELECT s.host, place, {text} AS text FROM seen{DEPTH} s JOIN own ON own.host = s.host AND own.path = node JOIN fields USING (page_id) LEFT JOIN said USING (page_id) LEFT JOIN led USING (page_id) WHERE place <= {PAGES}) GROUP BY 1"""


def rendered(pages: DataFrame) -> DataFrame:
    """``host, n_pages, rendered``: the crawled pages of each site as text, in the order of their visits, with what each holds (columns host, place, path, url, html).

    A site has no more pages than its crawl's budget, so what is gathered is bounded; so is each list, and the whole text.
    """
    html = F.col("html")
    line = lambda name, listed, how, most: F.when(F.size(listed) > 0, F.concat(F.lit(f"\n{name}: "), F.array_join(F.slice(listed, 1, most), how))).otherwise(F.lit(""))
    texts = lambda p: F.transform(urls.every(html, p), urls.label)
    p = pages.withColumn("l", urls.links(html, F.col("url"))).withColumn("ts", F.transform(urls.every(html, r"<([a-zA-Z][a-zA-Z0-9]*)"), lambda x: F.lower(x)))
    roles = F.transform(F.array_sort(F.array_distinct("ts")), lambda k: F.concat_ws("=", k, F.size(F.filter("ts", lambda y: y == k)).cast("string")))
    labels = F.filter(F.transform("l", lambda x: x.label), lambda x: x != "")
    targets = F.array_distinct(F.transform(F.slice("l", 1, SHOWN["links"]), lambda x: x.path))
    text = F.concat(
        F.lit("--- page "), "path", F.lit("\ntitle: "), urls.label(F.regexp_extract("html", urls.TITLE, 1)), line("headings", urls.headings(html), " | ", SHOWN["headings"]), line("links", labels, " | ", SHOWN["links"]),
        line("link targets", targets, " ", SHOWN["targets"]), line("buttons", texts(urls.BUTTON), " | ", SHOWN["buttons"]), line("fields", texts(urls.INPUT), " | ", SHOWN["inputs"]),
        F.lit("\nforms: "), F.size(urls.every(html, r"(?i)<form\b", 0)).cast("string"), line("roles", roles, " ", SHOWN["roles"]))
    g = p.select("host", F.struct("place", text.alias("text")).alias("page")).groupBy("host").agg(F.array_sort(F.collect_list("page")).alias("p"))
    whole = F.concat(F.lit("site: "), "host", F.lit("\npages crawled: "), F.size("p").cast("string"), F.lit("\n"), F.array_join(F.transform("p", lambda x: x.text), "\n"))
    return g.select("host", F.size("p").cast("long").alias("n_pages"), F.left(whole, F.lit(SITE_CHARS)).alias("rendered"))


@register("fn08_rendered_sites", _site_sql())
def fn08_sites(spark: S, d: str) -> DataFrame:
    """What a reader of a crawl gets of each site: title, headings, links and where they lead, buttons, fields, forms and roles of each page, each list capped."""
    walk = gr01(spark, d).where("there").select("host", F.col("node").alias("path"), "place")
    p = b.table(spark, d, "pages").select("page_id", host().alias("host"), urls.site_path(F.col("url"), F.col("url")).alias("path"), "url", "html")
    own = p.groupBy("host", "path").agg(F.min("page_id").alias("page_id"))
    return rendered(walk.join(own, ["host", "path"]).join(p.drop("host", "path"), "page_id"))


@register("fn08_render_with_caps", f"SELECT host, left(string_agg('## ' || path || ' ' || title, chr(10) ORDER BY page_id), 60000) AS rendered FROM (SELECT {HOST} AS host, page_id, {OWN} AS path, {urls.label_sql(f"regexp_extract(html, '{urls.TITLE}', 1)")} AS title, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS rn FROM pages) WHERE rn <= {PAGES} GROUP BY 1")
def fn08(spark: S, d: str) -> DataFrame:
    """A site's first pages as text: paths and titles of 25 at most, 60,000 characters at most. The smallest ids are picked before pages are gathered, so a hot host has no large group."""
    p = b.table(spark, d, "pages").select(host().alias("host"), "page_id", urls.site_path(F.col("url"), F.col("url")).alias("path"), urls.label(F.regexp_extract("html", urls.TITLE, 1)).alias("title"))
    top = p.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where(F.col("rn") <= PAGES)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "path", "title"))), lambda x: F.concat(F.lit("## "), x.path, F.lit(" "), x.title))
    return top.groupBy("host").agg(F.left(F.array_join(lines, "\n"), F.lit(60_000)).alias("rendered"))


CSS = f"regexp_replace(array_to_string(regexp_extract_all(html, '{styles.STYLE}', 1), chr(10)), '{styles.COMMENT}', ' ', 'g')"
#: Declarations of plain sheets: what stands between an opening brace and the next closing one, cut at semicolons and at the first colon.
DECLARED = """[{'p': lower(trim(left(c, strpos(c, ':') - 1))), 'v': lower(trim(substr(c, strpos(c, ':') + 1)))} FOR c IN flatten([string_split(list_last(string_split(x, '{')), ';') FOR x IN string_split(css, '}') IF contains(x, '{')]) IF strpos(c, ':') > 1 AND trim(substr(c, strpos(c, ':') + 1)) <> '']"""
COUNTED = "concat_ws(' ', " + ", ".join(f"CASE WHEN len([x FOR x IN ds IF {styles.condition(n, 'duckdb')}]) > 0 THEN '{n}=' || len([x FOR x IN ds IF {styles.condition(n, 'duckdb')}]) END" for n in sorted(styles.COUNTED)) + ")"


@register("fn13_css_and_colours", rf"""SELECT page_id, len(ds)::BIGINT AS declarations, len(regexp_extract_all(css, '@media'))::BIGINT AS media, len(regexp_extract_all(css, '@keyframes'))::BIGINT AS keyframes, len(regexp_extract_all(css, '(?m)^\s*--[-a-zA-Z0-9_]+\s*:'))::BIGINT AS custom, len(regexp_extract_all(css, 'var[(]\s*--'))::BIGINT AS vars,
    {COUNTED} AS counters, array_to_string(list_sort(list_distinct([trim(translate(string_split(x.v, ',')[1], '"' || chr(39), ''), ' ') FOR x IN ds IF x.p = 'font-family'])), ',') AS families FROM (SELECT page_id, css, {DECLARED} AS ds FROM (SELECT page_id, {CSS} AS css FROM pages))""")
def fn13(spark: S, d: str) -> DataFrame:
    """What a page's own style sheets declare; ``colours`` gives hue, saturation and lightness of their colours."""
    p = b.table(spark, d, "pages").select("page_id", styles.sheet(F.col("html")).alias("css")).withColumn("ds", styles.declarations(F.col("css")))
    n = lambda pattern: F.size(F.regexp_extract_all("css", F.lit(pattern), 0)).cast("long")
    return p.select(
        "page_id", F.size("ds").cast("long").alias("declarations"), n("@media").alias("media"), n("@keyframes").alias("keyframes"), n(r"(?m)^\s*--[-a-zA-Z0-9_]+\s*:").alias("custom"), n(r"var[(]\s*--").alias("vars"),
        styles.counters("ds").alias("counters"), styles.families("ds").alias("families"))


def colours(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """``key, hex, hue, saturation, lightness`` of each distinct colour that a style sheet writes in hex."""
    found = sheets.select(key, styles.declarations(F.col(css)).alias("ds")).select(key, F.explode(styles.palette("ds")).alias("hex"))
    h, s, light = hue(F.col("hex"))
    return found.select(key, "hex", F.round(h, 6).alias("hue"), F.round(s, 6).alias("saturation"), F.round(light, 6).alias("lightness"))


#: Fixed values of a signature: bins of hue, saturation from which a colour has one, and where each count saturates.
HUES, CHROMATIC = 8, 0.15
SATURATES = {
    "float": 1.0, "flex": 2.0, "grid": 1.0, "pos_absolute": 1.0, "pos_fixed": 0.5, "border_radius": 2.0, "shadow": 1.5, "gradient": 0.5, "transition": 1.5, "animation": 0.5, "transform": 0.5, "important": 0.5, "vendor": 1.0,
    "fluid_unit": 5.0, "fixed_px_width": 2.0,
}
FONTS = {
    "serif": "times|georgia|garamond|palatino|book antiqua|serif|cambria|constantia|didot|bodoni|merriweather",
    "sans": "arial|helvetica|verdana|tahoma|geneva|trebuchet|segoe|calibri|lato|roboto|open sans|inter|sans-serif|futura|gill sans|franklin",
    "mono": "courier|monaco|consolas|menlo|monospace|lucida console",
}


def signatures(pages: DataFrame, by: str) -> DataFrame:
    """``by, doctype, blocks``: what the sheets and tags of each group of pages look like; a block's numbers by name, scaled to length 1.

    Blocks are colour (palette, saturation, lightness, notations and a histogram of hues), font, layout (counts for a hundred
    declarations, saturating) and structure. The document type is that of most pages that declare one. Pages are counted one by one and
    summed up, so a hot group is no special case; only a group's distinct colours and families are told apart.
    """
    html = F.col("html")
    kinds = F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), lambda x: F.lower(x))
    dt = F.lower(F.regexp_extract("html", r"(?i)<!doctype([^>]*)>", 1))
    doctype = F.when(F.contains(dt, F.lit("xhtml")), "xhtml").when(F.contains(dt, F.lit("html 4")), "html4").when(F.trim(dt).isin("html", ""), "html5").otherwise("html4")
    p = pages.select(by, "html", styles.sheet(html).alias("css")).withColumn("ds", styles.declarations(F.col("css"))).withColumn("ts", kinds)
    p = files.kept(p.withColumn("doctype", F.when(F.rlike("html", F.lit("(?i)<!doctype[^>]*>")), doctype)).withColumn("cs", styles.colours(F.col("ds"))), "sheets")
    times = lambda pattern: F.sum(F.size(F.regexp_extract_all("css", F.lit(pattern), 0)))
    tags = lambda *names: F.sum(F.size(F.filter("ts", lambda x: x.isin(*names))))
    sums = p.groupBy(by).agg(
        F.mode(F.col("doctype"), True).alias("doctype"), F.sum(F.size("ds")).alias("n"), *[F.sum(styles.count("ds", k)).alias(k) for k in styles.COUNTED],
        (times("@media") + times("@keyframes")).alias("media"), times(r"(?m)^\s*--[-a-zA-Z0-9_]+\s*:").alias("custom"), times(r"var[(]\s*--").alias("vars"), F.sum(F.size("ts")).alias("tags"),
        tags("table").alias("tables"), tags("article", "aside", "footer", "header", "main", "nav", "section").alias("semantic"), tags("button", "input", "label", "option", "select", "textarea").alias("controls"), tags("script").alias("scripts"))
    c = p.select(by, F.explode("cs").alias("c")).select(by, "c.*").withColumn("hex", F.format_string("%02x%02x%02x", "r", "g", "b"))
    h, s, light = hue(F.col("hex"))
    safe = F.col("r").isin(*styles.WEB_SAFE) & F.col("g").isin(*styles.WEB_SAFE) & F.col("b").isin(*styles.WEB_SAFE)
    bin_ = F.when(s >= CHROMATIC, F.least(F.lit(HUES - 1), F.floor(h / 360 * HUES)))
    share = lambda what: F.avg(what.cast("double"))
    paint = c.groupBy(by).agg(
        F.count_distinct("hex").alias("palette"), F.avg(s).alias("mean_saturation"), F.avg(light).alias("mean_lightness"), F.stddev_pop(light).alias("std_lightness"), share((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("grayscale"),
        share(safe).alias("websafe"), share(F.col("notation") == "hex3").alias("hex3"), share(F.col("notation") == "named").alias("named"), share(F.col("notation").isin("rgb", "hsl")).alias("rgb_hsl"),
        *[F.coalesce(F.count_if(bin_ == k) / F.nullif(F.count(bin_), F.lit(0)), F.lit(0.0)).alias(f"hue_{k}") for k in range(HUES)])
    f = p.select(by, F.explode(styles.first_families("ds")).alias("f"))
    type_ = f.groupBy(by).agg(F.count_distinct("f").alias("families"), *[share(F.rlike("f", F.lit(v))).alias(k) for k, v in FONTS.items()])
    g = sums.join(paint, by, "left").join(type_, by, "left").fillna(0).withColumn("n", F.greatest("n", F.lit(1))).withColumn("tags", F.greatest("tags", F.lit(1)))
    sat = lambda x, at: F.coalesce(x / (x + F.lit(float(at))), F.lit(0.0))
    per_hundred = lambda k, at: sat(100.0 * F.col(k) / F.col("n"), at)
    sizes = F.greatest(sum((F.col(f"unit_{u}") for u in ("rem", "em", "pt", "px", "percent")), F.lit(0)), F.lit(1))
    blocks = {
        "colour": {"palette": sat(F.col("palette"), 40)} | {k: F.col(k) for k in ("mean_saturation", "mean_lightness", "std_lightness", "grayscale", "websafe", "hex3", "named", "rgb_hsl", *(f"hue_{k}" for k in range(HUES)))},
        "font": {"families": sat(F.col("families"), 6)} | {k: F.col(k) for k in FONTS} | {"pt": F.col("unit_pt") / sizes, "px": F.col("unit_px") / sizes, "relative": (F.col("unit_rem") + F.col("unit_em") + F.col("unit_percent")) / sizes},
        "layout": {k: per_hundred(k, at) for k, at in SATURATES.items()} | {"media": sat(F.col("media"), 4), "custom": sat(F.col("custom"), 8), "vars": per_hundred("vars", 5)},
        "structure": {"tables": sat(1000.0 * F.col("tables") / F.col("tags"), 5), "semantic": F.col("semantic") / F.col("tags"), "controls": F.col("controls") / F.col("tags"), "scripts": sat(1000.0 * F.col("scripts") / F.col("tags"), 8)},
    }
    parts = []
    for name, own in blocks.items():
        length = F.sqrt(sum((v * v for v in own.values()), F.lit(0.0)))
        parts.append(F.struct(*[F.coalesce(F.round(v / F.nullif(length, F.lit(0.0)), 6), F.lit(0.0)).alias(k) for k, v in own.items()]).alias(name))
    return g.select(by, F.coalesce("doctype", F.lit("none")).alias("doctype"), F.struct(*parts).alias("blocks"))


@register("fn15_signature_by_block")
def fn15_blocks(spark: S, d: str) -> DataFrame:
    """Each site's signature: its document type and the blocks of colours, fonts, layout and structure."""
    return signatures(b.table(spark, d, "pages").select(host().alias("host"), "html"), "host").select("host", "doctype", *[F.to_json(F.col(f"blocks.{k}")).alias(k) for k in ("colour", "font", "layout", "structure")])


#: Attributes that only say how something looks.
LOOKS = "bgcolor|background|align|valign|cellpadding|cellspacing|hspace|vspace|nowrap|border|width|height"
BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)[{][%{#].*?[%}#][}]', ' ', 'g')"
KINDS = "[lower(x) FOR x IN regexp_extract_all(bare, '<([a-zA-Z][a-zA-Z0-9]*)', 1)]"
DOCTYPE = "lower(regexp_extract(html, '(?i)<!doctype([^>]*)>', 1))"


@register("fn14_html_histogram", rf"""SELECT page_id, CASE WHEN NOT regexp_matches(html, '(?i)<!doctype[^>]*>') THEN 'none' WHEN contains(dt, 'xhtml') THEN 'xhtml' WHEN contains(dt, 'html 4') THEN 'html4' WHEN trim(dt) IN ('html', '') THEN 'html5' ELSE 'html4' END AS doctype,
    len(ts)::BIGINT AS tags, array_to_string([k || '=' || len(list_filter(ts, lambda y: y = k)) FOR k IN list_sort(list_distinct(ts))], ' ') AS histogram, len(regexp_extract_all(bare, '\s[-a-zA-Z_:][-a-zA-Z0-9_:.]*\s*="'))::BIGINT AS attributes,
    len(regexp_extract_all(bare, '(?i)<(?:table|td|th|tr)\b[^>]*\s(?:{LOOKS})\s*='))::BIGINT AS presentational, regexp_matches(html, '(?i)<meta[^>]+name\s*=\s*.viewport') AS viewport, regexp_matches(html, '(?i)<meta[^>]+charset') AS charset
  FROM (SELECT page_id, html, bare, {DOCTYPE} AS dt, {KINDS} AS ts FROM (SELECT page_id, html, {BARE} AS bare FROM pages))""")
def fn14(spark: S, d: str) -> DataFrame:
    """A page's document type, its tags by kind, attributes, tables that only lay out, and flags of its head; styles, comments and template code don't count."""
    bare = F.col("html")
    for pattern in (r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)[{][%{#].*?[%}#][}]"):
        bare = F.regexp_replace(bare, pattern, " ")
    dt = F.lower(F.regexp_extract("html", r"(?i)<!doctype([^>]*)>", 1))
    doctype = F.when(~F.rlike("html", F.lit(r"(?i)<!doctype[^>]*>")), "none").when(F.contains(dt, F.lit("xhtml")), "xhtml").when(F.contains(dt, F.lit("html 4")), "html4").when(F.trim(dt).isin("html", ""), "html5").otherwise("html4")
    p = b.table(spark, d, "pages").select("page_id", "html", bare.alias("bare")).withColumn("ts", F.transform(F.regexp_extract_all("bare", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), lambda x: F.lower(x)))
    n = lambda pattern: F.size(F.regexp_extract_all("bare", F.lit(pattern), 0)).cast("long")
    each = F.expr("array_join(transform(array_sort(array_distinct(ts)), k -> concat(k, '=', size(filter(ts, y -> y = k)))), ' ')")
    return p.select(
        "page_id", doctype.alias("doctype"), F.size("ts").cast("long").alias("tags"), each.alias("histogram"), n(r'\s[-a-zA-Z_:][-a-zA-Z0-9_:.]*\s*="').alias("attributes"),
        n(rf"(?i)<(?:table|td|th|tr)\b[^>]*\s(?:{LOOKS})\s*=").alias("presentational"), F.rlike("html", F.lit(r"(?i)<meta[^>]+name\s*=\s*.viewport")).alias("viewport"), F.rlike("html", F.lit(r"(?i)<meta[^>]+charset")).alias("charset"))
