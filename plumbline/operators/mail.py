"""Mail authentication from DNS answers (name, rtype, values): null values were unreadable, an empty
list is no record.  SPF includes are followed by joins, a level a round, along each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

# Fixed values.
SPF_DEPTH, REDIRECTS = 6, 3
DKIM_BITS = ((300, 1024), (600, 2048))
#: What a policy asks of receivers; the name whose SPF record proves that a resolver answers.
DMARC_STATES = {"reject": "enforcing", "quarantine": "partial", "none": "monitor only"}
CONTROL = "_spf.google.com"
_SPF = r"(?i)^\s*v=spf1(\s|$)"
_ALL = r"(?i)^([+\-~?]?)all$"


def unquoted(value: Column) -> Column:
    """TXT data as DNS-over-HTTPS gives it: quoted chunks are joined."""
    chunks = F.regexp_extract_all(value, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.when(F.size(chunks) > 0, F.array_join(chunks, "")).otherwise(value)


def _txt(answers: DataFrame) -> DataFrame:
    return answers.filter("rtype = 'TXT'").select(F.lower("name").alias("name"), F.transform("values", unquoted).alias("values"))


def _spf_of(values: Column) -> Column:
    return F.filter(values, lambda v: v.rlike(_SPF))


def _tokens(record: Column) -> Column:
    return F.filter(F.split(record, r"\s+"), lambda t: t != "")


def _own_cost(tokens: Column) -> Column:
    """Mechanisms that query DNS by themselves, and includes and a reachable redirect (one each)."""
    has_all = F.exists(tokens, lambda t: t.rlike(_ALL))

    def costs(t: Column) -> Column:
        bare = F.lower(F.regexp_replace(t, r"^[+\-~?]+", ""))
        return bare.rlike(r"^(a|mx|ptr)([:/]|$)|^exists:|^include:") | (bare.startswith("redirect=") & ~has_all)

    return F.size(F.filter(tokens, costs)).cast("long")


def _targets(tokens: Column) -> Column:
    has_all = F.exists(tokens, lambda t: t.rlike(_ALL))
    bare = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, r"^[+\-~?]+", "")))
    used = F.filter(bare, lambda t: t.startswith("include:") | (t.startswith("redirect=") & ~has_all))
    return F.filter(F.transform(used, lambda t: F.regexp_replace(F.regexp_replace(t, r"^(include:|redirect=)", ""), r"\.$", "")), lambda t: t != "")


def spf_cost(domains: DataFrame, answers: DataFrame) -> DataFrame:
    """domain, spf_cost: lookups a receiver would spend, as mechanisms evaluated (an include reached
    twice costs twice); loops along one path stop, and so do paths deeper than SPF_DEPTH."""
    records = cut(_txt(answers).withColumn("record", F.try_element_at(_spf_of(F.col("values")), F.lit(1))).filter("record is not null").select("name", _own_cost(_tokens(F.col("record"))).alias("own"), _targets(_tokens(F.col("record"))).alias("targets")), "spf")
    step = domains.select("domain", F.lower("domain").alias("name"), F.array(F.lower("domain")).alias("path")).join(records, "name")
    total = step.select("domain", "own")
    for _ in range(SPF_DEPTH):
        step = step.select("domain", "path", F.explode("targets").alias("name")).filter(~F.array_contains("path", F.col("name"))).join(records, "name").select("domain", "name", F.concat("path", F.array("name")).alias("path"), "own", "targets")
        step = cut(step, "spf-step")
        total = total.unionByName(step.select("domain", "own"))
        if step.isEmpty():
            break
    return total.groupBy("domain").agg(F.sum("own").alias("spf_cost"))


def _redirect(record: Column) -> Column:
    token = F.try_element_at(F.filter(_tokens(record), lambda t: F.lower(t).startswith("redirect=")), F.lit(1))
    return F.regexp_replace(F.lower(F.regexp_replace(token, "(?i)^redirect=", "")), r"\.$", "")


def _qualifier(record: Column) -> Column:
    token = F.try_element_at(F.filter(_tokens(record), lambda t: t.rlike(_ALL)), F.lit(1))
    return F.when(token.isNotNull(), F.when(F.regexp_extract(token, _ALL, 1) == "", "+").otherwise(F.regexp_extract(token, _ALL, 1)))


def mail_records(domains: DataFrame, answers: DataFrame, selectors: tuple[str, ...] = ("default", "google", "selector1", "selector2", "k1", "mail", "dkim")) -> DataFrame:
    """domains: site, domain -> one row each of the columns the mail rules and scores read; what could
    not be read stays null."""
    txt = _txt(answers)
    records = txt.select("name", F.try_element_at(_spf_of(F.col("values")), F.lit(1)).alias("record"))
    own = domains.select("site", "domain", F.lower("domain").alias("name")).join(txt, "name", "left")
    out = own.select("site", "domain", F.size(_spf_of(F.col("values"))).alias("n"), F.try_element_at(_spf_of(F.col("values")), F.lit(1)).alias("record"), F.col("values").isNotNull().alias("read"))
    out = out.select("site", "domain", F.when(F.col("read"), F.col("n") > 0).alias("spf_present"), F.when(F.col("read"), F.col("n")).alias("spf_count"), "record")
    for i in range(REDIRECTS):  # a record without `all` takes its redirect's
        out = out.withColumn("_next", F.when(_qualifier(F.col("record")).isNull(), _redirect(F.col("record"))))
        step = records.select(F.col("name").alias("_next"), F.col("record").alias("_record"))
        out = out.join(step, "_next", "left").withColumn("record", F.coalesce("_record", "record")).drop("_next", "_record")
    out = out.withColumn("spf_all", F.when(F.col("spf_present"), F.coalesce(_qualifier(F.col("record")), F.lit("")))).drop("record")
    out = out.join(spf_cost(domains, answers), "domain", "left")

    dmarc = txt.filter(F.col("name").startswith("_dmarc.")).select(F.substring("name", 8, 300).alias("_d"), F.filter("values", lambda v: F.lower(v).startswith("v=dmarc1")).alias("r"))
    tags = F.map_from_entries(F.transform(F.filter(F.split(F.col("r")[0], ";"), lambda p: p.contains("=")), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))), F.trim(F.regexp_replace(p, "^[^=]*=", "")))))
    dmarc = dmarc.select("_d", F.when(F.col("r").isNotNull(), F.size("r") > 0).alias("dmarc_present"), F.when(F.size("r") > 0, tags).alias("t"))
    dmarc = dmarc.select("_d", "dmarc_present", F.lower(F.coalesce(F.col("t")["p"], F.lit(""))).alias("dmarc_policy"), F.coalesce(F.expr("try_cast(t['pct'] as int)"), F.lit(100)).alias("dmarc_pct"), F.coalesce(F.col("t")["rua"], F.lit("")).alias("dmarc_rua"))

    keys = txt.filter(F.col("name").contains("._domainkey.")).select(F.substring_index("name", "._domainkey.", 1).alias("selector"), F.substring_index("name", "._domainkey.", -1).alias("_k"), F.explode("values").alias("v")).filter(F.col("selector").isin(*selectors) & F.lower("v").contains("p="))
    length = F.length(F.regexp_extract("v", "p=([A-Za-z0-9+/=]+)", 1))
    bits = F.when(length == 0, 0).when(length < DKIM_BITS[0][0], DKIM_BITS[0][1]).when(length < DKIM_BITS[1][0], DKIM_BITS[1][1]).otherwise(4096)
    dkim = keys.groupBy("_k", "selector").agg(F.max(bits).alias("bits")).groupBy("_k").agg(F.count_if(F.col("bits") > 0).alias("live"), F.count_if(F.col("bits").between(1, 2047)).alias("weak"))

    mx = answers.filter("rtype = 'MX'").select(F.lower("name").alias("_m"), "values")
    exchange = F.transform("values", lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"^\s*\d+\s+", "")), r"\.$", ""))
    mx = mx.select("_m", F.when(F.col("values").isNotNull(), F.size("values") > 0).alias("has"), ((F.size("values") > 0) & F.forall(exchange, lambda e: e == "")).alias("mx_null"))
    name = F.lower("domain")
    out = out.join(dmarc, name == F.col("_d"), "left").join(dkim, name == F.col("_k"), "left").join(mx, name == F.col("_m"), "left")
    return out.select(
        "site", "domain", "spf_present", "spf_count", "spf_all", "spf_cost", "dmarc_present", "dmarc_policy", "dmarc_pct", "dmarc_rua",
        F.coalesce("live", F.lit(0)).alias("dkim_live"), F.coalesce("weak", F.lit(0)).alias("dkim_weak"), (F.col("has") & ~F.col("mx_null")).alias("mx_present"), F.coalesce("mx_null", F.lit(False)).alias("mx_null"),
    )


def controlled(answers: DataFrame) -> DataFrame:
    """Answers (with network) of the networks that see the control's SPF record: elsewhere a record that is
    missing and a resolver that does not answer look alike."""
    seen = answers.filter((F.lower("name") == CONTROL) & (F.col("rtype") == "TXT")).filter(F.exists(F.transform("values", unquoted), lambda v: F.lower(v).startswith("v=spf1")))
    return answers.join(seen.select("network").distinct(), "network", "left_semi")


def _tags(record: Column) -> Column:
    """A record's tag=value parts; of a repeated tag the last counts."""
    parts = F.filter(F.split(record, ";"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k)) == 0)
    return F.map_from_entries(last)


def mail_details(domains: DataFrame, answers: DataFrame) -> DataFrame:
    """What the records say beyond presence, a row a domain: whether the SPF record takes effect and is
    broad, the DMARC state, policy for subdomains, alignment and failure reports, DKIM selectors with a live
    and with a revoked key, and the optional MTA-STS and BIMI.  Null: not asked or not read.

    All answers of a domain meet in one aggregation by the name they belong to."""
    txt = _txt(answers)
    prefix = F.regexp_extract("name", r"^(_dmarc|_mta-sts|default\._bimi|[^.]+\._domainkey)\.", 1)
    role = F.when(prefix == "", "spf").when(prefix.endswith("._domainkey"), "dkim").otherwise(F.regexp_replace(prefix, r"^default\.", ""))
    own = txt.select("values", role.alias("role"), F.when(prefix == "", F.col("name")).otherwise(F.expr("substring(name, length(regexp_extract(name, '^(_dmarc|_mta-sts|default[.]_bimi|[^.]+[.]_domainkey)[.]', 0)) + 1)")).alias("name"))

    def of(role: str, value: Column) -> Column:
        return F.max(F.when(F.col("role") == role, value))

    v = F.col("values")
    spf, dmarc = _spf_of(v), F.filter(v, lambda x: F.lower(x).startswith("v=dmarc1"))
    first, tags = F.get(spf, F.lit(0)), _tags(F.get(dmarc, F.lit(0)))
    key = F.get(F.filter(v, lambda x: F.lower(x).contains("p=")), F.lit(0))
    live = F.regexp_extract(key, "p=([A-Za-z0-9+/=]+)", 1) != ""
    said = lambda tag, default: of("_dmarc", F.when(F.size(dmarc) > 0, F.coalesce(tags[tag], F.lit(default))))
    policy = F.lower(F.coalesce(tags["p"], F.lit("")))
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in DMARC_STATES.items() for x in pair]), policy), F.lit("unrecognised"))
    told = own.groupBy("name").agg(
        of("spf", F.when(F.size(spf) > 0, F.size(spf) == 1)).alias("spf_effective"), of("spf", first.rlike(r"(?i)(^|\s)\+?(a|mx)(\s|$)")).alias("spf_broad"), of("_dmarc", F.when(F.size(dmarc) > 0, state)).alias("dmarc_state"),
        F.lower(said("sp", "")).alias("dmarc_subdomains"), said("adkim", "r").alias("adkim"), said("aspf", "r").alias("aspf"), said("ruf", "").alias("dmarc_ruf"),
        F.count_if((F.col("role") == "dkim") & key.isNotNull() & live).alias("dkim_live"), F.count_if((F.col("role") == "dkim") & key.isNotNull() & ~live).alias("dkim_revoked"),
        of("_mta-sts", F.size(v) > 0).alias("mta_sts"), of("_bimi", F.size(v) > 0).alias("bimi"),
    )
    out = domains.select("site", "domain", F.lower("domain").alias("name")).join(told, "name", "left").drop("name")
    return out.na.fill(0, ["dkim_live", "dkim_revoked"])
