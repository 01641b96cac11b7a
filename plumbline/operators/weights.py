"""What images weigh: fetched sizes, the renditions worth fetching, and what browsers transferred instead.

markup: site, image (the rendition a desktop is served), retina, widest (other renditions, '' or null where
they are the same).  measured: site, image, bytes, and optionally status, content_type.  An image is one row
whatever its renditions: their sizes are stated beside its own and never added to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes that differ by a larger share are both kept.
AGREEMENT = 0.1
MAX_VARIANTS = 300


def _said(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value)


def variants(markup: DataFrame) -> DataFrame:
    """site, image, rank (0 retina, 1 widest), rendition: those that differ from the image itself."""
    kinds = F.array(*[F.struct(F.lit(i).alias("rank"), _said(F.col(c)).alias("rendition")) for i, c in enumerate(("retina", "widest"))])
    return markup.select("site", "image", F.explode(kinds).alias("k")).select("site", "image", "k.rank", "k.rendition").filter(F.col("rendition").isNotNull() & (F.col("rendition") != F.col("image")))


def variant_targets(found: DataFrame, measured: DataFrame, most: int = MAX_VARIANTS) -> DataFrame:
    """site, rendition, place: what is worth a request, each once and nothing that was measured; retina
    renditions, which devices select, before the widest ones, `most` a site."""
    once = found.groupBy("site", "rendition").agg(F.min(F.struct("rank", "image")).alias("first"))
    new = once.join(measured.select("site", F.col("image").alias("rendition")), ["site", "rendition"], "left_anti")
    place = F.row_number().over(Window.partitionBy("site").orderBy("first", "rendition"))
    return new.withColumn("place", place).filter(F.col("place") <= most).select("site", "rendition", "place")


def with_variants(measured: DataFrame, markup: DataFrame, extra: DataFrame) -> DataFrame:
    """measured with retina, retina_bytes, widest, widest_bytes.  extra: sizes of renditions, in the form of
    measured; a rendition that is an image of its own is known from there."""
    known = extra.select("site", "image", "bytes", F.lit(0).alias("rank")).unionByName(measured.select("site", "image", "bytes", F.lit(1).alias("rank"))).filter("bytes > 0")
    sizes = known.groupBy("site", "image").agg(F.min_by("bytes", "rank").alias("bytes"))
    out = measured.join(markup.select("site", "image", *[F.when(_said(F.col(c)) != F.col("image"), F.col(c)).alias(c) for c in ("retina", "widest")]), ["site", "image"], "left")
    for kind in ("retina", "widest"):
        out = out.join(sizes.select("site", F.col("image").alias(kind), F.col("bytes").alias(f"{kind}_bytes")), ["site", kind], "left")
    return out


def aliases(found: DataFrame) -> DataFrame:
    """site, url, image: the image that each rendition belongs to, the first one if several have it."""
    return found.groupBy("site", F.col("rendition").alias("url")).agg(F.min("image").alias("image"))


def transferred(loads: DataFrame, measured: DataFrame, alias: DataFrame) -> DataFrame:
    """site, page, url, image, bytes of what browsers transferred: loads (site, page, url, bytes) under the image
    that the URL is, or is a rendition of, or by itself.  Nothing transferred says nothing of a weight."""
    own = loads.filter("bytes > 0").join(measured.select("site", F.col("image").alias("url"), F.lit(True).alias("_measured")), ["site", "url"], "left")
    named = own.join(alias.withColumnRenamed("image", "_of"), ["site", "url"], "left")
    return named.select("site", "page", "url", F.when(F.col("_measured"), F.col("url")).otherwise(F.coalesce("_of", "url")).alias("image"), F.col("bytes").cast("long").alias("bytes"))


def merged(measured: DataFrame, loads: DataFrame, alias: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, image_pages).  weights: every image that was fetched or transferred, with bytes, how (head or
    browser), head_bytes where the two differ by more than AGREEMENT, browser_url where the browser took another
    rendition, and the other columns of measured.  The browser's size replaces the fetched one, also where it is
    smaller; of several pages the last one's counts, by page and URL.  image_pages: site, image, page, those of
    `pages` and those on which only a browser saw it."""
    seen = transferred(loads, measured, alias)
    last = seen.groupBy("site", "image").agg(F.max_by(F.struct("url", "bytes"), F.struct("page", "url", "bytes")).alias("b"))
    others = [c for c in measured.columns if c not in ("site", "image", "bytes", "status", "content_type")]
    out = measured.withColumn("_head", F.lit(True)).join(last, ["site", "image"], "full_outer")
    head, browser = F.coalesce("bytes", F.lit(0)), F.col("b.bytes")
    weights = out.select(
        "site", "image", F.coalesce(browser, F.col("bytes")).cast("long").alias("bytes"), F.when(browser.isNotNull(), "browser").otherwise("head").alias("how"),
        F.when((head > 0) & (F.abs(head - browser) > AGREEMENT * browser), head).cast("long").alias("head_bytes"), F.when(F.col("b.url") != F.col("image"), F.col("b.url")).alias("browser_url"),
        *([F.coalesce("status", F.when(F.col("_head").isNull(), 200)).alias("status")] if "status" in measured.columns else []), *(["content_type"] if "content_type" in measured.columns else []), *others,
    )
    places = seen.select("site", "image", "page")
    return weights, (places if pages is None else pages.select("site", "image", "page").unionByName(places)).distinct()


def site_weight(weights: DataFrame) -> DataFrame:
    """site, images, bytes, replaced: how much all images of a site weigh, and how many by what a browser took."""
    return weights.groupBy("site").agg(F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("bytes"), F.count_if(F.col("how") == "browser").alias("replaced"))
