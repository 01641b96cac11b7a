"""Page records: what one page says about itself, as one row of expressions over its HTML.

Only `site`, `page_id`, `url` and `html` have to be there; columns measured while fetching (status,
elapsed_ms, final_url, ...) pass through where they exist and stay null otherwise: unmeasured is never
the same as measured and false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import urls

SCRIPTS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Columns measured while fetching, with the type they get where they are missing.
MEASURED = {
    "status": "int",
    "is_html": "boolean",
    "elapsed_ms": "long",
    "redirected": "boolean",
    "final_url": "string",
    "x_robots_tag": "string",
    "refused": "boolean",
    "discovered_via": "string",
    "duplicate_of": "string",
}
PHONE = r"\+?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Rendered text: scripts, styles and tags go, white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(html, SCRIPTS, " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(bare), r"[\s\x{a0}]+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element, tags inside removed; null if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    found = html.rlike(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>")
    return F.when(found, F.trim(F.regexp_replace(unescaped(F.regexp_replace(inner, r"(?s)<[^>]*>", "")), r"\s+", " ")))


def tag_texts(html: Column, tag: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", "")), r"\s+", " ")))


def attribute(element: Column, name: str) -> Column:
    """An attribute's value in either kind of quotes; null if it is not there."""
    double = F.regexp_extract(element, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(element, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    return F.when(element.rlike(rf'(?is)\s{name}\s*=\s*"'), double).when(element.rlike(rf"(?is)\s{name}\s*=\s*'"), single)


def meta(html: Column, name: str) -> Column:
    """Content of the first <meta> with this name or property, trimmed."""
    element = F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return F.when(element != "", F.trim(unescaped(F.coalesce(attribute(element, "content"), F.lit("")))))


def elements(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>"), F.lit(0))


def link_name(element: Column) -> Column:
    """What names a link beside its text: a label or title of its own, else the text of an image in it."""
    opening = F.regexp_extract(element, r"(?is)^<a\s[^>]*>", 0)
    own = F.filter(F.array(attribute(opening, "aria-label"), attribute(opening, "title")), lambda v: F.coalesce(v, F.lit("")) != "")
    alts = F.filter(F.transform(elements(element, "img"), lambda e: attribute(e, "alt")), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    return F.try_element_at(F.concat(own, alts), F.lit(1))


def insecure(html: Column, tag: str, name: str) -> Column:
    """Values of an attribute that load something by plain http."""
    return F.filter(F.transform(elements(html, tag), lambda e: attribute(e, name)), lambda v: F.coalesce(v, F.lit("")).startswith("http://"))


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def document_base(html: Column, served: Column) -> Column:
    """What a page's references resolve against: its first base element with an href, itself resolved against the
    URL that answered, else that URL."""
    based = F.filter(elements(html, "base"), lambda e: attribute(e, "href").isNotNull())
    own = F.trim(attribute(F.try_element_at(based, F.lit(1)), "href"))
    return F.when(F.coalesce(own, F.lit("")) != "", urls.absolute(served, own)).otherwise(F.regexp_replace(served, "(?s)#.*$", ""))


def page_records(pages: DataFrame) -> DataFrame:
    """One record a page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    served = F.coalesce(F.col("final_url"), F.col("url")) if "final_url" in pages.columns else F.col("url")
    images, text = elements(html, "img"), plain_text(html)
    title, description = tag_text(html, "title"), meta(html, "description")
    h1, link = tag_texts(html, "h1"), F.filter(elements(html, "link"), lambda e: F.coalesce(F.lower(attribute(e, "rel")), F.lit("")).rlike(r"(^|\s)canonical(\s|$)"))
    alternates = F.filter(elements(html, "link"), lambda e: F.coalesce(F.lower(attribute(e, "rel")), F.lit("")).rlike(r"(^|\s)alternate(\s|$)") & attribute(e, "hreflang").isNotNull() & attribute(e, "href").isNotNull())
    anchors = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0)), lambda e: F.struct(attribute(e, "href").alias("href"), F.trim(F.regexp_replace(F.regexp_replace(e, r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("anchor"), link_name(e).alias("label")))
    hrefs = F.transform(elements(html, "a"), lambda e: attribute(e, "href"))
    tel = F.filter(hrefs, lambda h: F.coalesce(h, F.lit("")).startswith("tel:"))
    mixed = F.concat(*[insecure(html, t, a) for t, a in (("img", "src"), ("script", "src"), ("iframe", "src"), ("link", "href"))])
    page = pages.select(
        F.col("site") if "site" in pages.columns else urls.bare_host(F.col("url")).alias("site"),
        F.col("page_id"),
        F.col("url"),
        html.alias("html"),
        *[(F.col(c).cast(t) if c in pages.columns else F.lit(None).cast(t)).alias(c) for c, t in MEASURED.items()],
        title.alias("title"),
        description.alias("meta_description"),
        meta(html, "robots").alias("meta_robots"),
        meta(html, "viewport").alias("viewport"),
        attribute(F.regexp_extract(html, r"(?is)<html(?:\s[^>]*)?>", 0), "lang").alias("lang"),
        *[meta(html, p).alias(c) for p, c in (("og:title", "og_title"), ("og:description", "og_description"), ("og:image", "og_image"), ("twitter:card", "twitter_card"))],
        attribute(F.try_element_at(link, F.lit(1)), "href").alias("canonical_href"),
        document_base(html, served).alias("base_url"),
        F.transform(alternates, lambda e: F.struct(F.lower(attribute(e, "hreflang")).alias("lang"), attribute(e, "href").alias("href"))).alias("hreflang"),
        h1.alias("h1"),
        F.size(elements(html, "h2")).alias("h2_count"),
        anchors.alias("anchors"),
        F.size(images).alias("img_total"),
        F.size(F.filter(images, lambda e: attribute(e, "alt").isNull())).alias("img_no_alt"),
        F.size(F.filter(images, lambda e: F.trim(attribute(e, "alt")) == "")).alias("img_empty_alt"),
        F.size(F.filter(images, lambda e: attribute(e, "width").isNull() | attribute(e, "height").isNull())).alias("img_no_dims"),
        F.transform(images, lambda e: F.struct(attribute(e, "src").alias("src"), attribute(e, "alt").alias("alt"))).alias("images"),
        F.filter(tel, lambda h: ~h.rlike(r"^tel:\+?[0-9]+$")).alias("tel_malformed"),
        mixed.alias("mixed_content"),
        F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)).alias("jsonld"),
        text.alias("text"),
    )
    return page.withColumns(
        {
            "title_len": F.length("title"),
            "desc_len": F.length("meta_description"),
            "h1_count": F.size("h1"),
            "canonical": F.when(F.trim("canonical_href") == "", F.lit("")).otherwise(urls.absolute(F.col("base_url"), F.col("canonical_href"))),
            "hreflang": F.transform("hreflang", lambda h: F.struct(h.lang.alias("lang"), urls.absolute(F.col("base_url"), h.href).alias("href"))),
            "links_no_anchor_text": F.size(F.filter("anchors", lambda a: (a.anchor == "") & (F.coalesce(a.label, F.lit("")) == ""))),
            "word_count": word_count(F.col("text")),
            "phones": F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)))),
            "emails": F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)))),
            "noindex": F.lower(F.concat_ws(" ", "meta_robots", "x_robots_tag")).contains("noindex"),
            "is_page": (F.coalesce("status", F.lit(200)) == 200) & F.coalesce("is_html", F.lit(True)) & F.col("duplicate_of").isNull(),
        }
    )


def page_links(records: DataFrame) -> DataFrame:
    """A row per link that leads somewhere, first anchor of a target first: site, page_id, src, href, target, anchor,
    pos, internal, page.  Hrefs are resolved against the document's base."""
    skip = r"(?i)^(tel:|mailto:|javascript:|data:|sms:|#)"
    out = records.select("site", "page_id", F.col("url").alias("src"), "base_url", F.posexplode("anchors").alias("pos", "a")).select("site", "page_id", "src", "base_url", "pos", F.trim(F.col("a.href")).alias("href"), F.substring("a.anchor", 1, 80).alias("anchor"))
    out = out.filter(F.col("href").isNotNull() & (F.col("href") != "") & ~F.col("href").rlike(skip))
    out = out.withColumn("target", urls.absolute(F.col("base_url"), F.col("href"))).drop("base_url").filter(F.col("target").rlike("(?i)^https?:"))
    return out.withColumns({"internal": urls.same_site(F.col("target"), urls.host(F.col("src"))), "page": urls.is_page(F.col("target"))})
