"""Landed HTML pages -> rows (IO8-IO10, S10, S11, S20).

No DOM parser runs on the cluster: pages are reduced with built-in regex
functions (script/style/comments removed, block tags turned into line
breaks, other tags dropped, common entities decoded), then split into
ordered lines with ``posexplode``.  Each page is processed inside its own
row; nothing is grouped across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import alert_number, strip_ws

# Block-level tags that end a line, and decoded entities (in order).
BLOCK_TAGS = "br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|nav|article|section|header|footer|title|dt|dd"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
HEADING_MARK = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(c) -> Column:
    e = _c(c)
    for a, b in ENTITIES:
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def html_text(html) -> Column:
    """HTML -> text with one block per line; heading lines start with a marker."""
    h = _c(html)
    h = F.regexp_replace(h, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?i)<h[1-6]\b[^>]*>", "\n" + HEADING_MARK)
    h = F.regexp_replace(h, r"(?i)</?(" + BLOCK_TAGS + r")\b[^>]*>", "\n")
    h = F.regexp_replace(h, r"<[^>]*>", "")
    return decode_entities(h)


def html_lines(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """IO8: ``(page_id, pos, kind, line)`` for every non-empty text line;
    ``kind`` is ``heading`` for h1-h6 text, else ``text``."""
    t = pages.select(F.col(id_col).alias("page_id"),
                     F.posexplode(F.split(html_text(F.col(html_col)), "\n")).alias("pos", "raw"))
    t = t.select("page_id", "pos", strip_ws(F.col("raw")).alias("raw"))
    kind = F.when(F.col("raw").startswith(HEADING_MARK), F.lit("heading")).otherwise(F.lit("text"))
    line = strip_ws(F.regexp_replace(F.col("raw"), "^" + HEADING_MARK, ""))
    return t.select("page_id", "pos", kind.alias("kind"), line.alias("line")).where(F.col("line") != "")


LINK_RE = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""


def html_links(pages: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """IO9/IO10 + S20: every ``<a href>`` of a page in order, with its text and
    the absolute URL (relative links resolved against the page's host)."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(LINK_RE), 1)
    texts = F.regexp_extract_all(F.col(html_col), F.lit(LINK_RE), 2)
    base = F.regexp_extract(F.col(url_col), r"^(https?://[^/]+)", 1)
    t = pages.select(F.col(id_col).alias("page_id"), base.alias("_base"),
                     F.posexplode(F.arrays_zip(hrefs.alias("h"), texts.alias("t"))).alias("link_pos", "l"))
    href = F.col("l.h")
    absu = (F.when(href.rlike("^https?://"), href)
            .when(href.startswith("/"), F.concat(F.col("_base"), href))
            .otherwise(F.concat(F.col("_base"), F.lit("/"), href)))
    txt = strip_ws(decode_entities(F.regexp_replace(F.col("l.t"), "<[^>]*>", "")))
    return t.select("page_id", "link_pos", href.alias("href"), absu.alias("url"), txt.alias("text"))


# What an alert page is searched for.
CHARGE_RE = r"(?i)(OASIS charge code:[^\n]*)"
DESCRIPTION_RE = r"(?is)Product Description:\s*\n*(.*?)(?:\n\n|\n[A-Z]|$)"
NOT_GIVEN = "N/A"
# Tags of which the first with text after the description's header is the description.
_BLOCK = "div|p|ul|ol|table|span|pre|blockquote|h4|h5|dl"


def plain_text(html) -> Column:
    """Non-empty lines of a page, stripped and joined by line breaks."""
    lines = F.transform(F.split(html_text(html), "\n"), lambda x: strip_ws(F.regexp_replace(x, HEADING_MARK, "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_meta(pages: DataFrame, id_col: str, html_col: str, fallback_len: int = 500) -> DataFrame:
    """Fields of an alert page: the charge code line, which lists it names,
    and the product description, i.e. the first block with text after its h3
    header, whole; only where that header is missing, the text after the words
    themselves, which the rule cuts at ``fallback_len`` characters."""
    # the lines are made once; every field reads them
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("_html"), plain_text(F.col(html_col)).alias("_text"))
    h, text = F.col("_html"), F.col("_text")
    after = F.regexp_extract(h, r"(?is)<h3\b[^>]*>[^<]*Product Description[^<]*</h3>(.*)", 1)
    blocks = F.regexp_extract_all(after, F.lit(rf"(?is)<(?:{_BLOCK})\b[^>]*>(.*?)</(?:{_BLOCK})>"), 1)
    stripped = F.transform(blocks, lambda b: strip_ws(decode_entities(F.regexp_replace(b, "<[^>]*>", ""))))
    headed = F.try_element_at(F.filter(stripped, lambda x: x != ""), F.lit(1))
    has_header = h.rlike(r"(?is)<h3\b[^>]*>[^<]*Product Description[^<]*</h3>")
    loose = F.when(text.rlike(r"(?is)Product Description:"), F.substring(strip_ws(F.regexp_extract(text, DESCRIPTION_RE, 1)), 1, fallback_len))
    charge = F.nullif(strip_ws(F.regexp_extract(text, CHARGE_RE, 1)), F.lit(""))
    return pages.select(
        "page_id",
        F.coalesce(charge, F.lit(NOT_GIVEN)).alias("charge_code_line"),
        F.coalesce(F.when(has_header, headed).otherwise(loose), F.lit(NOT_GIVEN)).alias("product_description"),
        *[text.rlike(rf"(?i){color}\s*list").alias(f"has_{color}_list") for color in ("red", "yellow", "green")],
    )


def titled_fields(pages: DataFrame, id_col: str, html_col: str, titles: dict, item_re: str = r"(?is)<li\b[^>]*>(.*?)</li>") -> DataFrame:
    """IO10: listing cards.  Each item (``item_re``) of a page is a row; its
    fields are the texts of the elements whose ``title`` attribute is the given
    one (``titles``: column -> title), null where there is none."""
    items = pages.select(F.col(id_col).alias("page_id"),
                         F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(item_re), 1)).alias("card", "item"))

    def field(title: str) -> Column:
        found = F.regexp_extract_all(F.col("item"), F.lit(rf'(?is)<[a-z0-9]+\b[^>]*?\btitle=["\']{title}["\'][^>]*>([^<]*)<'), 1)
        return strip_ws(decode_entities(F.try_element_at(found, F.lit(1))))

    return items.select("page_id", "card", *[field(t).alias(c) for c, t in titles.items()])


TR_RE = r"(?is)<tr\b[^>]*>(.*?)</tr>"
TD_RE = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"


def row_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """IO9: every table row as ``(page_id, row_pos, tr, cells)``, cells as texts."""
    rows = pages.select(F.col(id_col).alias("page_id"),
                        F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(TR_RE), 1)).alias("row_pos", "tr"))
    cells = F.transform(F.regexp_extract_all(F.col("tr"), F.lit(TD_RE), 1),
                        lambda x: strip_ws(decode_entities(F.regexp_replace(x, "<[^>]*>", ""))))
    return rows.withColumn("cells", cells).where(F.size("cells") > 0)


# What marks an alert link, and the value of a field that is not there.
ALERT_LINK = "importalert_"
UNKNOWN = "Unknown"


def table_rows(pages: DataFrame, id_col: str, html_col: str, link_mark: str = ALERT_LINK) -> DataFrame:
    """IO9 + S10: index-table rows with an alert link -> alert fields.

    With 4 or more cells: number, type, date, title; with 3: number, date,
    title; else the link's text is the title unless it is the number.  A title
    that is still unknown is the last of several cells.  The number is the
    link's text when it looks like ``NN-NN``, else the first ``N-N`` of the
    first cell, else the link's text."""
    r = row_cells(pages, id_col, html_col)
    link = F.regexp_extract_all(F.col("tr"), F.lit(rf"""(?is)<a\s[^>]*?href="[^"]*{link_mark}[^"]*"[^>]*>(.*?)</a>"""), 1)
    r = r.withColumn("link_text", strip_ws(decode_entities(F.regexp_replace(F.try_element_at(link, F.lit(1)), "<[^>]*>", "")))) \
        .where(F.col("link_text").isNotNull())
    n, cell = F.size("cells"), lambda k: F.try_element_at("cells", F.lit(k))
    number = F.coalesce(alert_number(cell(1), F.col("link_text")), F.col("link_text"))
    title = (F.when(n >= 4, cell(4)).when(n == 3, cell(3))
             .when(number != F.col("link_text"), F.col("link_text"))
             .when(n > 1, F.try_element_at("cells", n)).otherwise(F.lit(UNKNOWN)))
    return r.select(
        "page_id", "row_pos", number.alias("alert_no"),
        F.when(n >= 4, cell(2)).otherwise(F.lit(UNKNOWN)).alias("type"),
        F.when(n >= 4, cell(3)).when(n == 3, cell(2)).otherwise(F.lit(UNKNOWN)).alias("date"),
        title.alias("title"),
    )


def listing_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """IO10: listing rows (date, reference, origin, subject, category) that the
    listing mapper takes; rows with fewer than five cells are skipped."""
    c = lambda k: F.try_element_at("cells", F.lit(k))
    return row_cells(pages, id_col, html_col).where(F.size("cells") >= 5).select(
        "page_id", "row_pos", c(1).alias("date"), c(2).alias("reference"), c(3).alias("origin"),
        c(4).alias("subject"), c(5).alias("category"))
