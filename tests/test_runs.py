"""Image weights, categories, feed snapshots and saved runs on small cases."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import corpus, scores, weights
from plumbline.operators import vitals as lab
from plumbline.operators.records import page_records
from plumbline.sources import feeds, sinks, tables

MEASURED = "site string, image string, bytes long, status int, content_type string"
MARKUP = "site string, image string, retina string, widest string"
LOADS = "site string, page string, url string, bytes long"


@pytest.fixture(scope="module")
def markup(spark):
    return spark.createDataFrame([("s", "/a?w=1080", "/a?w=1920", "/a?w=3840"), ("s", "/plain", "", None), ("s", "/b", "/b", "/a?w=3840")], MARKUP)


def merged(spark, measured, loads, alias=None):
    alias = spark.createDataFrame([], "site string, url string, image string") if alias is None else alias
    out, places = weights.merged(spark.createDataFrame(measured, MEASURED), spark.createDataFrame(loads, LOADS), alias)
    return {r.image: r for r in out.collect()}, {(r.image, r.page) for r in places.collect()}


@pytest.mark.parametrize("head, browser, want", [(5_706_840, 2_130_340, (2_130_340, "browser", 5_706_840)), (100_000, 400_000, (400_000, "browser", 100_000)), (201_000, 200_000, (200_000, "browser", None)), (2_130_340, 0, (2_130_340, "head", None)), (None, 7, (7, "browser", None))])
def test_the_browser_wins_unless_it_saw_nothing(spark, head, browser, want):
    got, _ = merged(spark, [("s", "/a", head, 200, "image/png")], [("s", "/p", "/a", browser)])
    assert (got["/a"].bytes, got["/a"].how, got["/a"].head_bytes) == want and got["/a"].content_type == "image/png"


def test_what_only_the_browser_saw_has_its_page(spark):
    got, places = merged(spark, [], [("s", "/p", "/hero.jpg", 900_000), ("s", "/q", "/hero.jpg", 800_000)])
    assert (got["/hero.jpg"].bytes, got["/hero.jpg"].how, got["/hero.jpg"].status) == (800_000, "browser", 200) and places == {("/hero.jpg", "/p"), ("/hero.jpg", "/q")}


def test_renditions_are_listed_once_and_retina_comes_first(spark, markup):
    found = weights.variants(markup)
    assert {tuple(r) for r in found.collect()} == {("s", "/a?w=1080", 0, "/a?w=1920"), ("s", "/a?w=1080", 1, "/a?w=3840"), ("s", "/b", 1, "/a?w=3840")}
    measured = spark.createDataFrame([("s", "/a?w=1080", 1, 200, "")], MEASURED)
    assert [r.rendition for r in weights.variant_targets(found, measured, 1).collect()] == ["/a?w=1920"]
    assert [r.rendition for r in weights.variant_targets(found, measured).orderBy("place").collect()] == ["/a?w=1920", "/a?w=3840"]
    assert weights.variant_targets(found, spark.createDataFrame([("s", "/a?w=1920", 1, 200, ""), ("s", "/a?w=3840", 1, 200, "")], MEASURED)).count() == 0


def test_sizes_of_renditions_stand_beside_the_image(spark, markup):
    measured = spark.createDataFrame([("s", "/a?w=1080", 135_914, 200, ""), ("s", "/plain", 5, 200, "")], MEASURED)
    extra = spark.createDataFrame([("s", "/a?w=1920", 216_424, 200, ""), ("s", "/a?w=3840", 0, 200, "")], MEASURED)
    got = {r.image: r for r in weights.with_variants(measured, markup, extra).collect()}
    assert (got["/a?w=1080"].bytes, got["/a?w=1080"].retina_bytes, got["/a?w=1080"].widest, got["/a?w=1080"].widest_bytes) == (135_914, 216_424, "/a?w=3840", None)
    assert len(got) == 2 and got["/plain"].retina is None


def test_a_transfer_of_a_rendition_is_the_images_own(spark, markup):
    alias = weights.aliases(weights.variants(markup))
    got, places = merged(spark, [("s", "/a?w=1080", 135_914, 200, "")], [("s", "/p", "/a?w=1920", 216_424), ("t", "/p", "/a?w=1920", 3)], alias)
    assert (got["/a?w=1080"].bytes, got["/a?w=1080"].browser_url) == (216_424, "/a?w=1920") and got["/a?w=1920"].site == "t"
    assert places == {("/a?w=1080", "/p"), ("/a?w=1920", "/p")}


def test_complementary_error_function():
    x = np.concatenate([np.linspace(-30, 30, 4001), [0.0, 2.4999999, 2.5, 1e-300, np.nan]])
    got = scoring.erfc(x)
    want = np.array([math.erfc(v) for v in x[:-1]])
    assert np.isnan(got[-1]) and np.all(np.abs(got[:-1] - want) <= 2e-15)


def test_performance_is_the_median_page_and_counts_in_the_overall(spark):
    p10 = {m: float(p[0]) for m, p in scoring.VITAL_POINTS["desktop"].items()}
    mid = {m: float(p[1]) for m, p in scoring.VITAL_POINTS["desktop"].items()}
    rows = [("a", f"/{i}", 200, v["fcp"], v["lcp"], v["tbt"], v["cls"]) for i, v in enumerate((p10, mid, mid))] + [("a", "/refused", 403, 1.0, 1.0, 1.0, 0.0), ("b", "/", 403, 1.0, 1.0, 1.0, 0.0)]
    vitals = spark.createDataFrame(rows, "site string, url string, status int, fcp double, lcp double, tbt double, cls double")
    performance = scores.performance_category(lab.site_vitals(lab.page_scores(vitals)))
    assert [(r.site, round(r.score, 6), r.total, round(r.coverage, 6)) for r in performance.collect()] == [("a", 50.0, 50.0, 0.9)]
    seo = spark.createDataFrame([("a", 80.0, 1.0), ("b", 80.0, 1.0)], "site string, score double, coverage double")
    none = spark.createDataFrame([], "site string, cap int")
    got = {r.site: (r.raw, r.overall, round(r.coverage, 6)) for r in scores.overall(seo, performance, none).collect()}
    assert got["a"] == (pytest.approx(68.0), 68.0, 0.96) and got["b"] == (80.0, 80.0, 0.6)


def test_effective_weights_leave_out_what_was_not_scored(spark):
    groups = spark.createDataFrame([("a", "indexability", 50.0), ("a", "metadata", None), ("a", "trust", 10.0), ("b", "metadata", None)], "site string, group string, score double")
    got = {(r.site, r.group): round(r.effective, 6) for r in scores.effective_weights(groups).collect()}
    assert got == {("a", "indexability"): round(2400 / 29, 6), ("a", "metadata"): 0, ("a", "trust"): round(500 / 29, 6), ("b", "metadata"): 0}


def test_findings_that_did_not_fire_are_not_cited(spark):
    metrics = spark.createDataFrame([("a", "sitemap"), ("a", "h1"), ("b", "sitemap"), ("b", "https")], "site string, metric string")
    fired = spark.createDataFrame([("a", "IDX-06"), ("a", "IDX-06"), ("a", "MET-10"), ("b", "ORP-05")], "site string, finding string")
    assert {(r.site, r.metric): r.findings for r in scores.explained(metrics, fired).collect()} == {("a", "sitemap"): ["IDX-06"], ("a", "h1"): ["MET-10"], ("b", "sitemap"): [], ("b", "https"): []}


def test_fresh_stale_and_absent_snapshots(spark):
    def at(day, hour=0):
        return datetime.datetime(2024, 5, day, hour)

    kept = spark.createDataFrame([("f", at(2, 6), False, "x"), ("f", at(2, 9), None, "y"), ("f", at(2, 10), True, "lost"), ("g", at(1), True, "lost"), ("f", at(2, 9), False, "a")], "feed string, taken timestamp, failed boolean, path string")
    runs = spark.createDataFrame([("s", "f", at(2, 8)), ("s", "f", at(2, 9)), ("s", "f", at(2, 20)), ("s", "f", at(2, 21)), ("s", "f", at(9)), ("s", "f", at(2, 5)), ("s", "g", at(3)), ("s", "h", at(3)), ("s", None, at(3))], "site string, feed string, started timestamp")
    got = sorted((str(r.feed), r.started.day, r.started.hour, r.snapshot and r.snapshot.path, r.age_s, r.state) for r in feeds.chosen(runs, kept).collect())
    assert got == [
        ("None", 3, 0, None, None, "absent"), ("f", 2, 5, None, None, "absent"), ("f", 2, 8, "x", 7200, "fresh"), ("f", 2, 9, "y", 0, "fresh"), ("f", 2, 20, "y", 39_600, "fresh"), ("f", 2, 21, "y", 43_200, "stale"), ("f", 9, 0, "y", 572_400, "stale"),
        ("g", 3, 0, None, None, "absent"), ("h", 3, 0, None, None, "absent"),
    ]


def test_documents_are_written_read_dropped_and_calibrated(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    html = "<html lang='en'><head><title>A title of some length</title></head><body><h1>Head</h1></body></html>"
    pages = page_records(spark.createDataFrame([(i, f"https://{s}.com/{i}", html if i % 2 else "<p>none</p>") for s, n in (("a", 4), ("b", 2)) for i in range(n)], "page_id long, url string, html string"))
    sites = spark.createDataFrame([("a.com", 70.0), ("b.com", 60.0)], "site string, overall double")
    hits = spark.createDataFrame([("a.com", "MET-01", "high", "metadata", f"/{i:03}", "no title") for i in range(700)] + [("a.com", "IDX-01", "critical", "indexing", "/1", "noindex")], "site string, finding string, severity string, category string, url string, detail string")
    sinks.write_documents(sinks.run_documents(sites, hits, pages), pages, path)
    read = {r.site: r for r in tables.run_documents(spark, path).collect()}
    assert [(f.id, f.severity, f.n, f.urls, len(f.hits)) for f in read["a.com"].findings] == [("IDX-01", "critical", 1, 1, 1), ("MET-01", "high", 700, 700, 500)]
    assert (read["a.com"].pages, read["b.com"].pages, read["b.com"].findings) == (4, 2, None)
    # what was read back gives the same ratios as the run's own pages
    ratios = corpus.run_ratios(tables.run_pages(spark, path))
    assert {(r.site, r.metric): r.value for r in ratios.collect()} == {(r.site, r.metric): r.value for r in corpus.run_ratios(pages).collect()}
    assert {r.metric: (r.sites, r.low, r.high) for r in corpus.calibration(ratios).collect()}["title_present"] == (2, 0.5, 0.5)
    # one site's run is replaced, the other's stays
    sinks.write_documents(sinks.run_documents(sites.filter("site = 'b.com'").withColumn("overall", F.lit(99.0)), hits, pages), pages.filter("site = 'b.com'").limit(1), path)
    assert {r.site: r.overall for r in tables.run_documents(spark, path).collect()} == {"a.com": 70.0, "b.com": 99.0}
    assert tables.run_pages(spark, path).count() == 5
    assert sinks.delete_run(spark, path, "www.A.com") and not sinks.delete_run(spark, path, "a.com") and not sinks.delete_run(spark, path, "../..")
    assert [r.site for r in tables.run_documents(spark, path).collect()] == ["b.com"]
    assert {r.sites for r in corpus.calibration(corpus.run_ratios(tables.run_pages(spark, path))).collect()} == {1}
