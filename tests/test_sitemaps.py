"""Sitemap indexes and discovery: what a site's crawl begins from."""

import pytest

from plumbline.operators import sitemaps

HOST = "shop.test"
BASE = f"https://{HOST}"
NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
DECLARED = '<?xml version="1.0" encoding="UTF-8"?>'


def leaf(*locs):
    return f"{DECLARED}<urlset {NS}>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def index(*locs):
    return f"{DECLARED}\n<sitemapindex {NS}>" + "".join(f"<sitemap>\n<loc> {u} </loc></sitemap>" for u in locs) + "</sitemapindex>"


def files(spark, pages, status=200):
    return spark.createDataFrame([(HOST, u, status, b) for u, b in pages.items()], "site string, url string, status int, body string")


def found(spark, pages, robots=(), most=300):
    robots = spark.createDataFrame([(HOST, 200, "\n".join(f"Sitemap: {r}" for r in robots))], "site string, status int, body string")
    pages, sites, summary = sitemaps.discover(files(spark, pages) if isinstance(pages, dict) else pages, robots, most)
    listed = [r.url for r in sorted(pages.collect(), key=lambda r: r.pos)]
    own = sorted(summary.collect(), key=lambda r: (r["rank"] is None, r["rank"], r.path))
    return listed, sites.first(), [(r.sitemap, r.urls, r.host_urls) for r in own], own


def test_a_leaf_counts_its_own_urls_and_names_some_others(spark):
    others = [f"https://elsewhere.test/{i}/" for i in range(9)]
    listed, site, summary, rows = found(spark, {f"{BASE}/sitemap.xml": leaf(f"{BASE}/", f"https://www.{HOST}/a/", f"http://{HOST}/b/", *others)})
    assert summary == [(f"{BASE}/sitemap.xml", 12, 3)] and rows[0].off_host == others[:3]
    assert listed == [f"{BASE}/", f"https://www.{HOST}/a/", f"http://{HOST}/b/"]
    assert (site.method, site.found, site.kept, site.left_out) == ("sitemap", 3, 3, 0)


def test_an_index_is_followed_and_each_leaf_keeps_its_counts(spark):
    pages = {f"{BASE}/sitemap_index.xml": index("/sm-1.xml", "sub/../sm-2.xml", f"{BASE}/gone.xml"), f"{BASE}/sm-1.xml": leaf(f"{BASE}/a/"), f"{BASE}/sm-2.xml": leaf(f"{BASE}/b/?x=1&amp;y=2", "https://elsewhere.test/c/")}
    listed, _, summary, rows = found(spark, pages)
    assert summary == [(f"{BASE}/sm-1.xml", 1, 1), (f"{BASE}/sm-2.xml", 2, 1), (f"{BASE}/gone.xml", 0, 0)]
    assert [r.status for r in rows] == ["200", "200", None]
    assert listed == [f"{BASE}/", f"{BASE}/a/", f"{BASE}/b/?x=1&y=2"]


def test_indexes_are_followed_two_deep_and_loops_end(spark):
    pages = {f"{BASE}/sitemap.xml": index("/one.xml", "/sitemap.xml"), f"{BASE}/one.xml": index("/two.xml", "/leaf.xml"), f"{BASE}/two.xml": index("/three.xml"), f"{BASE}/three.xml": leaf(f"{BASE}/too-deep/"), f"{BASE}/leaf.xml": leaf(f"{BASE}/in/")}
    listed, _, summary, _ = found(spark, pages)
    assert listed == [f"{BASE}/", f"{BASE}/in/"]
    assert summary == [(f"{BASE}/two.xml", 0, 0), (f"{BASE}/leaf.xml", 1, 1), (f"{BASE}/one.xml", 0, 0), (f"{BASE}/sitemap.xml", 0, 0)]


def test_what_robots_names_beats_a_guess_and_the_rest_is_not_listed(spark):
    pages = {f"{BASE}/named.xml": leaf(f"{BASE}/from-robots/"), f"{BASE}/sitemap.xml": leaf(f"{BASE}/from-guess/")}
    listed, _, summary, _ = found(spark, pages, [f"{BASE}/named.xml", f"{BASE}/sitemap.xml"])
    assert listed == [f"{BASE}/", f"{BASE}/from-robots/"] and summary == [(f"{BASE}/named.xml", 1, 1)]


def test_a_sitemap_of_another_host_is_evidence_and_links_are_followed(spark):
    listed, site, summary, _ = found(spark, {f"{BASE}/sitemap.xml": leaf(*[f"https://elsewhere.test/{i}/" for i in range(12)]), f"{BASE}/wp-sitemap.xml": leaf("https://elsewhere.test/")})
    assert listed == [f"{BASE}/"] and (site.method, site.found) == ("crawl", 1)
    assert summary == [(f"{BASE}/sitemap.xml", 12, 0), (f"{BASE}/wp-sitemap.xml", 1, 0), (sitemaps.FROM_HOME, 0, 0)]


@pytest.mark.parametrize("body", [None, "", "<html>nothing</html>", f"<urlset {NS}><url><loc>{BASE}/a/</loc></url>", leaf()])
def test_no_sitemap_and_broken_ones(spark, body):
    listed, site, summary, _ = found(spark, files(spark, {f"{BASE}/sitemap.xml": body}))
    assert listed == [f"{BASE}/"] and site.method == "crawl" and summary == [(sitemaps.FROM_HOME, 0, 0)]


def test_errors_are_no_sitemaps(spark):
    assert found(spark, files(spark, {f"{BASE}/sitemap.xml": leaf(f"{BASE}/a/")}, 404))[0] == [f"{BASE}/"]


def test_pages_once_as_written_assets_left_out_and_the_cap_says_so(spark):
    own = [f"{BASE}/real", f"{BASE}/real/", f"{BASE}/real/?q", f"{BASE}/style.css", f"{BASE}/doc.pdf", f"{BASE}/cdn-cgi/l/x", f"{BASE}/wp-json/wp", *[f"{BASE}/p{i}/" for i in range(10)]]
    listed, site, _, _ = found(spark, {f"{BASE}/sitemap.xml": leaf(*own)}, most=4)
    assert listed == [f"{BASE}/", f"{BASE}/real", f"{BASE}/p0/", f"{BASE}/p1/"]
    assert (site.found, site.kept, site.left_out) == (12, 4, 8)


def test_a_root_at_another_spelling_is_the_home_page(spark):
    assert found(spark, {f"{BASE}/sitemap.xml": leaf(f"{BASE}/a/", f"https://www.{HOST}")})[0] == [f"{BASE}/a/", f"https://www.{HOST}"]


def test_prefixes_pictures_comments_and_character_data(spark):
    body = f'<s:urlset xmlns:s="x" xmlns:image="y"><!-- <s:url><s:loc>{BASE}/no/</s:loc></s:url> --><s:url><image:image><image:loc>{BASE}/picture/</image:loc></image:image><s:loc><![CDATA[{BASE}/yes/]]></s:loc></s:url></s:urlset>'
    assert found(spark, {f"{BASE}/sitemap.xml": body})[0] == [f"{BASE}/", f"{BASE}/yes/"]


def test_children_of_a_moved_index(spark):
    moved = spark.createDataFrame([(HOST, f"{BASE}/sitemap.xml", f"{BASE}/new/index.xml", 200, index("leaf.xml")), (HOST, f"{BASE}/new/leaf.xml", None, 200, leaf("here/"))], "site string, url string, served string, status int, body string")
    assert found(spark, moved)[0] == [f"{BASE}/", f"{BASE}/new/here/"]


def test_empty(spark):
    none = files(spark, {}), spark.createDataFrame([], "site string, status int, body string")
    assert [t.count() for t in sitemaps.discover(*none)] == [0, 0, 0]
