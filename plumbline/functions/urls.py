"""URL and link functions as Catalyst expressions.

None of them raises on a malformed URL: parts come from one regular expression, and a string it does
not fit has empty parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STATIC_EXTENSIONS = r"(?i)\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|mjson|json|pdf|zip|gz|rar|mp4|webm|mp3|wav|woff2?|ttf|eot|xml|txt|csv|xlsx?|docx?)$"
ENDPOINT_PATHS = r"(?i)^/(cdn-cgi|wp-json|xmlrpc\.php|feed)(/|$)"
ARCHIVE_PATHS = r"(?i)/(page|tag|category|author|attachment|comment-page-\d+)/"
STAGING_HOSTS = r"(?i)(^|[.\-])(staging|stage|test|testing|dev|develop|uat|preview|demo|qa|sandbox)([.\-]|$)|\.local$|\.test$|localhost"
FEED_TYPES = ("Article", "BlogPosting", "NewsArticle", "TechArticle", "Report", "ScholarlyArticle", "LiveBlogPosting", "SocialMediaPosting", "Review")
FEED_SEGMENTS = ("blog", "blogs", "news", "article", "articles", "post", "posts", "insights", "resources", "updates", "press", "press-releases", "stories", "case-studies", "newsroom", "events", "podcast", "podcasts")
MITIGATION_HEADERS = (
    ("x-vercel-mitigated", "Vercel"),
    ("x-vercel-challenge-token", "Vercel"),
    ("cf-mitigated", "Cloudflare"),
    ("x-amzn-waf-action", "AWS WAF"),
    ("x-sucuri-block", "Sucuri"),
    ("x-datadome", "DataDome"),
    ("x-iinfo", "Imperva"),
)
CHALLENGE_BODIES = (
    r"(?i)vercel security checkpoint|just a moment\.\.\.|checking your browser|attention required!|enable javascript and cookies to continue|"
    r"verifying your browser|ddos protection by|captcha-delivery\.com|_incapsula_resource|px-captcha|cf-browser-verification|access denied[^<]{0,40}sucuri"
)
ALWAYS_REFUSAL, MAYBE_REFUSAL = (401, 403, 429), (406, 409, 503)
REGISTRY_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.nz", "co.za", "com.br", "co.jp", "co.in", "com.mx", "co.kr", "co.th", "co.id", "co.il", "co.ke")
IMAGE_TOKENS = (("webp", "WebP"), ("avif", "AVIF"), ("svg", "SVG"), ("png", "PNG"), ("gif", "GIF"), ("jpeg", "JPEG"), ("jpg", "JPEG"))
IMAGE_ENDINGS = (*((f".{a}", b) for a, b in IMAGE_TOKENS), (".ico", "ICO"), (".bmp", "BMP"))
OPTIMIZER_PATHS = ("/_next/image", "/_vercel/image")
SIZE_SUFFIX = r"-\d{2,5}x\d{2,5}(?=\.[A-Za-z0-9]+$)"

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    """Host and port, in lower case."""
    return F.lower(F.regexp_extract(url, _URL, 2))


def authority(url: Column) -> Column:
    """Host and port as written."""
    return F.regexp_extract(url, _URL, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 4)


def without_dots(own: Column) -> Column:
    """A path without its `.` and `..` segments (RFC 3986, 5.2.4); one that begins with a slash stays within
    its root."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    def folded(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.aggregate(rest, F.slice(parts, F.lit(1), F.lit(1)), step), ends), "/")

    return F.when(own.rlike(r"/\.\.?(/|$)"), let(F.split(own, "/"), folded)).otherwise(own)


def absolute(base: Column, ref: Column) -> Column:
    """A reference against its base, without the fragment; dot segments of relative references go."""
    return let(F.regexp_replace(F.trim(ref), "(?s)#.*$", ""), lambda own: _joined(base, own))


def _joined(base: Column, own: Column) -> Column:
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_replace(path(base), "[^/]*$", ""))
    own_path, own_query = F.regexp_extract(own, r"^[^?]*", 0), F.regexp_extract(own, r"(?s)\?.*$", 0)
    return (
        F.when(own == "", F.regexp_replace(base, "(?s)#.*$", ""))
        .when(own.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), own)
        .when(own.startswith("//"), F.concat(scheme(base), F.lit(":"), own))
        .when(own.startswith("/"), F.concat(origin, without_dots(own_path), own_query))
        .when(own.startswith("?"), F.concat(origin, F.when(path(base) == "", F.lit("/")).otherwise(path(base)), own))
        .otherwise(F.concat(origin, without_dots(F.regexp_replace(F.concat(folder, own_path), "//+", "/")), own_query))
    )


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalise(url: Column) -> Column:
    """A page's identity in the link graph: no query, no fragment, scheme and host in lower case, and a
    slash at the end unless the last segment has a dot.  The path's case is kept."""
    own = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    dotted = F.regexp_extract(own, r"([^/]*)$", 1).contains(".")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(own.endswith("/") | dotted, own).otherwise(F.concat(own, F.lit("/"))))


def normalise_base(seed: Column) -> Column:
    """A seed's origin; https where it names no scheme; null where there is no host."""
    trimmed = F.trim(seed)
    full = F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    return F.when((trimmed != "") & (host(full) != ""), F.concat(scheme(full), F.lit("://"), host(full)))


def is_page(url: Column) -> Column:
    return ~path(url).rlike(STATIC_EXTENSIONS) & ~path(url).rlike(ENDPOINT_PATHS)


def same_site(url: Column, site_host: Column) -> Column:
    """Equal hosts, or one is the other with a leading www."""
    own = host(url)
    return (own == site_host) | (own == F.concat(F.lit("www."), site_host)) | (F.concat(F.lit("www."), own) == site_host)


def is_archive(url: Column) -> Column:
    return path(url).rlike(ARCHIVE_PATHS)


def is_staging_host(name: Column) -> Column:
    return name.rlike(STAGING_HOSTS)


def is_feed_item(url: Column, schema_types: Column | None = None) -> Column:
    """An archive item: its structured data says so, or a segment before its last one does."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    before = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    by_path = F.arrays_overlap(before, F.array(*map(F.lit, FEED_SEGMENTS)))
    if schema_types is None:
        return by_path
    return F.coalesce(F.arrays_overlap(schema_types, F.array(*map(F.lit, FEED_TYPES))), F.lit(False)) | by_path


def lookup_hosts(name: Column) -> Column:
    """The host, and its apex where it is the plain www of one."""
    own = F.lower(F.trim(name))
    apex = F.regexp_replace(own, r"^www\.", "")
    worth = own.startswith("www.") & apex.contains(".") & ~apex.isin(*REGISTRY_SUFFIXES)
    return F.when(own == "", F.array().cast("array<string>")).when(worth, F.array(own, apex)).otherwise(F.array(own))


def image_identity(url: Column) -> Column:
    """Which image a URL is, whatever its rendition: optimiser URLs are unwrapped (two deep at most),
    size suffixes go."""

    def unwrapped(u: Column) -> Column:
        origin = F.concat(scheme(u), F.lit("://"), host(u))
        inner = F.try_url_decode(F.regexp_extract(query(u), r"(?:^|&)url=([^&]*)", 1))
        options = F.regexp_extract(path(u), r"^/cdn-cgi/image/[^/]*/(.+)$", 1)
        optimised = F.regexp_replace(path(u), "/+$", "").isin(*OPTIMIZER_PATHS) & (inner != "")

        def absolute(x: Column) -> Column:
            return F.when(x.contains("://"), x).when(x.startswith("/"), F.concat(origin, x)).otherwise(F.concat(origin, F.lit("/"), x))

        return F.when(optimised, absolute(inner)).when(options != "", absolute(options)).otherwise(u)

    def named(own: Column) -> Column:
        rest = F.when(query(own) != "", F.concat(F.lit("?"), query(own))).otherwise(F.lit(""))
        return F.concat(scheme(own), F.lit("://"), host(own), F.regexp_replace(path(own), SIZE_SUFFIX, ""), rest)

    return let(url, lambda u: let(unwrapped(u), lambda once: let(unwrapped(once), named)))


def image_kind(url: Column, content_type: Column) -> Column:
    """Format label from the content type, else from the extension."""
    kind, lower = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(path(url))
    chain = F.when(F.lit(False), "")
    for token, label in IMAGE_TOKENS:
        chain = chain.when(kind.contains(token), label)
    for ending, label in IMAGE_ENDINGS:
        chain = chain.when(lower.endswith(ending), label)
    return chain.otherwise("image")


def is_modern(kind: Column) -> Column:
    return kind.isin("WebP", "AVIF", "SVG")


def is_vector(kind: Column) -> Column:
    return kind == "SVG"


def verdict(status: Column) -> Column:
    """Of a link's status: dead, blocked (it refuses us, it is not missing), error, or ok."""
    return F.when(status.isin(404, 410), "dead").when((status >= 500) | status.isin(401, 403, 405, 429, 999), "blocked").when(status >= 400, "error").when(status.isNotNull(), "ok").otherwise("unreachable")


def refusal(status: Column, headers: Column, body: Column) -> Column:
    """struct<vendor, signal, kind> if the response declines an automated request, else null.
    headers: map<string, string> with names in lower case."""
    maybe = status.isin(*ALWAYS_REFUSAL, *MAYBE_REFUSAL)

    def made(vendor: Column, signal: Column, kind: str) -> Column:
        return F.struct(vendor.alias("vendor"), signal.alias("signal"), F.lit(kind).alias("kind"))

    chain = F.when(F.lit(False), made(F.lit(""), F.lit(""), ""))
    for name, vendor in MITIGATION_HEADERS:
        chain = chain.when(maybe & headers[name].isNotNull(), made(F.lit(vendor), F.substring(F.concat(F.lit(f"{name}: "), headers[name]), 1, 140), "challenge"))
    chain = chain.when((status == 403) & (F.lower(headers["server"]) == "akamaighost"), made(F.lit("Akamai"), F.lit("server: AkamaiGHost"), "challenge"))
    phrase = F.regexp_extract(F.coalesce(body, F.lit("")), CHALLENGE_BODIES, 0)
    chain = chain.when(maybe & (phrase != ""), made(F.lit(""), phrase, "challenge"))
    return chain.when(status.isin(*ALWAYS_REFUSAL), made(F.lit(""), F.concat(F.lit("HTTP "), status.cast("string")), "block"))


def href_defect(href: Column, target: Column, final: Column, canonical_host: Column) -> Column:
    """What is wrong with an href as written that a redirect repairs; '' if nothing is."""
    own = F.trim(F.coalesce(href, F.lit("")))
    slash = (host(target) == host(final)) & (scheme(target) == scheme(final)) & ~path(target).endswith("/") & (path(final) == F.concat(path(target), F.lit("/")))
    foreign = own.contains("//") & (host(target) != "") & (F.coalesce(canonical_host, F.lit("")) != "") & (host(target) != canonical_host)
    return (
        F.when(F.lower(own).startswith("http://") & (scheme(final) == "https"), "http")
        .when(own.startswith("//"), "protocol-relative")
        .when(foreign, F.concat(F.lit("host "), host(target)))
        .when(slash, "slash")
        .otherwise("")
    )


def hop_cause(href: Column, target: Column, final: Column, canonical_host: Column) -> Column:
    """The href's own defect, else whose redirect it is: moved, or domain."""
    defect = href_defect(href, target, final, canonical_host)
    return F.when(defect != "", defect).when(bare_host(target) == bare_host(final), "moved").otherwise("domain")
