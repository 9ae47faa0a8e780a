"""Web pages: main text, links, ids and dates in URLs, calendars of constructed URLs, gaps."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is no content.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
# Attributes and elements that hold the content, the first that a page has.
CONTENT_IDS = ["main-content", "article", "content"]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Main(HTMLParser):
    """Collects the text of the content element; elements that are not closed end with their parent."""

    def __init__(self, wanted: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.out = wanted, [], []
        self.inside, self.skip, self.found = wanted is None, 0, wanted is None

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        mark = not self.inside and not self.found and (dict(attrs).get("id") == self.wanted or (self.wanted == "body" and tag == "body"))
        skip = tag in SKIPPED
        self.stack.append((tag, mark, skip))
        self.skip += skip
        if mark:
            self.inside = self.found = True

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, mark, skip = self.stack.pop()
            self.skip -= skip
            if mark:
                self.inside = False
            if t == tag:
                break

    def handle_data(self, data):
        if self.inside and not self.skip and data.strip():
            self.out.append(data.strip())


def main_text_of(html: str) -> str:
    for wanted in [*CONTENT_IDS, "body", None]:
        if wanted and wanted != "body" and f'"{wanted}"' not in html and f"'{wanted}'" not in html and f"={wanted}" not in html:
            continue
        p = _Main(wanted)
        p.feed(html)
        p.close()
        if p.found and p.out:
            return "\n".join(p.out)
    return ""


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """Text of the main content, a line for each piece; navigation, scripts, forms and comments left out."""
    return html.map(lambda h: None if h is None else main_text_of(h))


def tag_stripped(html: str | Column) -> Column:
    """Text without markup by expressions only: for pages without a content element."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer|aside|form|noscript)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", "\n")
    for name, char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n"), r"\n{2,}", "\n"))


def links(pages: DataFrame, key: str, html: str, base: str | None = None) -> DataFrame:
    """(key, pos, href, url): every link in order; url is absolute where a base column is given."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""<a\b[^>]*?\bhref=["']([^"'>]+)["']"""), F.lit(1))
    rows = pages.select(key, *([base] if base else []), F.posexplode(hrefs).alias("pos", "href"))
    return rows.select(key, "pos", "href", absolute(F.col("href"), F.col(base)).alias("url")) if base else rows


def absolute(href: Column, base: Column) -> Column:
    """A link seen from a page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(site, href)).when(href.startswith("#") | href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href)).otherwise(F.concat(folder, href))


def attribute_list(html: str | Column, name: str) -> Column:
    """The comma list in an attribute."""
    value = F.regexp_extract(F.col(html) if isinstance(html, str) else html, rf'\b{name}="([^"]*)"', 1)
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda x: x != "")


def parse_id(c: str | Column) -> Column:
    """struct(year, month, day, part, shown) of YYMMDD, YYMMDD_N, YYYYMM, YYYYNN and YYYY; years 00-89 are 20xx.

    YYYYNN with NN over 12 is an issue number. Fields that an id does not have are 0; other ids give null.
    """
    c = F.col(c) if isinstance(c, str) else c
    num = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    day, month, year = r"^(\d{2})(\d{2})(\d{2})(?:_(\d+))?$", r"^((?:19|20)\d{2})(\d{2})$", r"^((?:19|20)\d{2})$"
    yy = num(day, 1)
    full = F.when(yy < 90, 2000 + yy).otherwise(1900 + yy)
    part = F.coalesce(num(day, 4), F.lit(0))
    zero = F.lit(0)
    shape = lambda y, m, d, p, s: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"), p.cast("int").alias("part"), s.alias("shown"))
    issue = num(month, 2)
    by_month = F.when(issue.between(1, 12), shape(num(month, 1), issue, zero, zero, F.format_string("%d-%02d", num(month, 1), issue))).otherwise(shape(num(month, 1), zero, zero, issue, F.format_string("%d-i%02d", num(month, 1), issue)))
    shown = F.format_string("%d-%02d-%02d", full, num(day, 2), num(day, 3))
    by_day = shape(full, num(day, 2), num(day, 3), part, F.when(part > 0, F.format_string("%s-%d", shown, part)).otherwise(shown))
    return F.when(c.rlike(year), shape(num(year, 1), zero, zero, zero, c)).when(c.rlike(month), by_month).when(c.rlike(day) & num(day, 2).between(1, 12) & num(day, 3).between(1, 31), by_day)


def year_in_href(c: str | Column) -> Column:
    """A year from irregular links: four digits, else two after `ar` or before the extension, with the pivot at 90."""
    c = F.col(c) if isinstance(c, str) else c
    four = F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")
    two = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"(?i)ar(\d{2})(?!\d)", r"(?i)(\d{2})\.(?:pdf|html?)$"))).try_cast("int")
    return F.coalesce(four, F.when(two >= 90, 1900 + two).when(two.isNotNull(), 2000 + two))


def letter_suffix(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The second row of a key gets -b, the third -c, and so on by code points past z; the first its key."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order))
    # F.char is of the code modulo 256
    letter = F.decode(F.unhex(F.lpad(F.hex(96 + n), 8, "0")), "UTF-32")
    return df.withColumn(name, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("-"), letter)))


def topics(html: str | Column) -> Column:
    """Distinct topic tags in `topic=` parts of links, in order of first use."""
    c = F.col(html) if isinstance(html, str) else html
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[?&]topic=([^&\"'#>\s]+)"), F.lit(1)), F.try_url_decode))


def missing_years(found: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """Years of a range that a table does not have."""
    years = found.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(year))
    return years.join(found.select(year).distinct(), year, "left_anti")


def constructed_urls(spark, template: str, first: str, last: str, step: str) -> DataFrame:
    """(day, url): a URL for each step of a calendar; the template takes %1$tY and the like."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval {step})")).alias("day"))
    return days.select("day", F.format_string(template, F.year("day"), F.month("day")).alias("url"))


def merge_routes(routes: list[DataFrame], key: str) -> DataFrame:
    """Rows of several routes; of a key, the one of the earliest route."""
    out = None
    for k, r in enumerate(routes):
        r = r.withColumn("route", F.lit(k))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    packed = out.groupBy(key).agg(F.min_by(F.struct(*out.columns), F.struct("route")).alias("_r"))
    return packed.select("_r.*")
