"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier over hashed words, word beginnings and a few shape measures gives each document two log-odds
(quality, toxicity).  The documents' probabilities are then aggregated by path and host; each site's
rate is shrunk towards its parent's (path -> host -> all documents) with a strength that the spread
between sites tells, and a document's final log-odds are its own plus what its path is better or
worse than the corpus.  Sparse sites thus change nothing, large ones shift their documents.

Hosts are `source` and paths `lang` below it where a table has no better metadata.
Defined results: null and empty texts carry no evidence but their shape and are judged as such;
null hosts or paths form a site of their own (''); repeated rows count each time; an empty table
gives an empty table; labels whose doc_id is missing, null or in doubt (two labels that differ: the
mean, >= 0.5) are handled; without both classes among the labels the head is a constant (the rate
with one row added to either class).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import WORD_BYTE, fresh, keyed_join, mix, power_tables, prepare, staged, table, text_slices, texts_of, trim, word_hashes, word_spans

#: Hashed word features; the shape measures follow them.
BUCKETS = 1 << 17
#: Beginnings of words, in bytes, that are features beside the words; at least so many times found.
PREFIX_BYTES = (5, 6, 7)
LEVELS = (1, 2, 4)
#: Features of a head.
MAX_FEATURES = 256
#: Labelled rows the classifier is fitted on: those with the smallest hash of doc_id.
MAX_TRAIN_ROWS = 12_000
SHAPES = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[*b"!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = WORD_BYTE >= 97


def shape_measures(raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: shares of symbols, '!' and capitals, words that repeat their predecessor, repeated
    words, symbols a word, words a line, log length; each 0 to about 1."""
    n_words = np.diff(first).astype(float)
    n = np.maximum(n_words, 1)
    size = np.maximum(np.diff(offsets), 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    symbols, letters = per_text(_SYMBOL[raw]), np.maximum(per_text(_LETTER[raw]), 1)
    same = np.zeros(len(hashes), np.int64)
    if len(hashes) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = 0
    total = np.concatenate([[0], np.cumsum(same)])
    doc = np.repeat(np.arange(len(n_words)), np.diff(first))
    order = np.lexsort((hashes, doc))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], weights=new, minlength=len(n_words))
    lines = per_text(raw == 10) + 1
    return np.stack([
        np.minimum(symbols / size * 10, 1), np.minimum(per_text(_SHOUT[raw]) / n, 1), per_text(_UPPER[raw]) / letters,
        (total[first[1:]] - total[first[:-1]]) / n, 1 - distinct / n, np.minimum(symbols / n, 1),
        np.minimum(n_words / lines / 50, 1), np.log1p(n_words) / 10,
    ], axis=1)


def word_levels(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, feature) pairs of a slice.  A feature is a hashed word or word beginning together
    with a level: found at least once, twice, four times.  wanted: buckets to look at, all if None."""
    low, starts, ends, first = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = power_tables(len(low))
    total = np.cumsum(low * power[: len(low)], dtype=np.uint64)
    base = total[starts] - low[starts] * power[starts]
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    keys = []
    for length in (0, *PREFIX_BYTES):
        end = ends if not length else np.minimum(starts + length, ends)
        value = mix((total[end - 1] - base) * inverse[starts] + np.uint64(length * 1_000_003 + 7))
        bucket = (value >> np.uint64(40)).astype(np.int64) % BUCKETS
        use = np.ones(len(starts), bool) if not length else ends - starts >= length
        if wanted is not None:
            use &= wanted[bucket]
        keys.append(doc[use] * BUCKETS + bucket[use])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    pairs = np.concatenate([key[count >= least] * len(LEVELS) + level for level, least in enumerate(LEVELS)])
    pairs.sort()
    return pairs // (BUCKETS * len(LEVELS)), pairs % (BUCKETS * len(LEVELS))


@dataclass(frozen=True)
class Head:
    """One logistic head: its features, their weights, the weights of the shapes, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    shapes: np.ndarray
    bias: float

    def log_odds(self, doc: np.ndarray, feature: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.features, feature)
        found = np.flatnonzero(at < len(self.features))
        found = found[self.features[at[found]] == feature[found]]
        return np.bincount(doc[found], weights=self.weights[at[found]], minlength=len(shapes)) + shapes @ self.shapes + self.bias


def _association(feature: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """G-squared of every feature against the class, 0 for features of fewer than 5 rows."""
    n, pos = len(y), y.sum()
    size = BUCKETS * len(LEVELS)
    seen = np.bincount(feature, minlength=size).astype(float)
    hit = np.bincount(feature[(y > 0)[doc]], minlength=size).astype(float)

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0)

    g = part(hit, seen * pos / n) + part(seen - hit, seen * (n - pos) / n) + part(pos - hit, (n - seen) * pos / n) + part(n - pos - seen + hit, (n - seen) * (n - pos) / n)
    g[seen < 5] = 0
    return 2 * g


def fit_head(doc: np.ndarray, feature: np.ndarray, shapes: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> Head:
    """Logistic regression by Adam on the MAX_FEATURES features most associated with the class."""
    n = len(y)
    bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if not n or y.min() == y.max():
        return Head(np.zeros(0, np.int64), np.zeros(0), np.zeros(SHAPES), bias)
    g = _association(feature, doc, y)
    chosen = np.argsort(-g, kind="stable")[:MAX_FEATURES]
    chosen = np.sort(chosen[g[chosen] > 10])
    x = np.zeros((n, len(chosen) + SHAPES + 1), np.float32)
    column = np.full(BUCKETS * len(LEVELS), -1, np.int16)
    column[chosen] = np.arange(len(chosen))
    at = column[feature]
    x[doc[at >= 0], at[at >= 0]] = 1
    x[:, len(chosen) : -1], x[:, -1] = shapes, 1
    w = np.zeros(x.shape[1])
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / n
        grad = x.T @ error
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Head(chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def log_odds(texts: pa.Array, heads: tuple[Head, ...]) -> list[np.ndarray]:
    out = [np.zeros(len(texts)) for _ in heads]
    wanted = np.zeros(BUCKETS, bool)
    for h in heads:
        wanted[h.features // len(LEVELS)] = True
    for at, to, raw, offsets in text_slices(texts):
        hashes, first = word_hashes(raw, offsets)
        shapes = shape_measures(raw, offsets, hashes, first)
        doc, feature = word_levels(raw, offsets, wanted)
        for o, h in zip(out, heads, strict=True):
            o[at:to] = h.log_odds(doc, feature, shapes)
    trim()
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[Head, Head]:
    """Fit both heads on at most max_rows labelled documents; features are made on the executors and
    only feature numbers and measures reach the driver."""
    labels = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("_quality"), (F.avg("toxic") >= 0.5).cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    labelled = texts_of(docs).join(F.broadcast(labels), "doc_id")  # at most max_rows narrow rows

    def features(batches):
        for batch in batches:
            texts = batch["text"]
            for at, to, raw, offsets in text_slices(texts):
                hashes, first = word_hashes(raw, offsets)
                doc, bucket = word_levels(raw, offsets)
                cut = np.searchsorted(doc, np.arange(to - at + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][at:to], pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32())),
                     pa.array(list(shape_measures(raw, offsets, hashes, first)), pa.list_(pa.float64())), batch["_quality"][at:to], batch["_toxic"][at:to]],
                    names=["doc_id", "feature", "shapes", "quality", "toxic"],
                )

    rows = labelled.mapInArrow(features, "doc_id long, feature array<int>, shapes array<double>, quality int, toxic int").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    n = rows.num_rows
    if not n:
        none = np.zeros(0, np.int64)
        return tuple(fit_head(none, none, np.zeros((0, SHAPES)), np.zeros(0)) for _ in range(2))
    lists = rows["feature"].combine_chunks()
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets))
    feature = np.asarray(lists.flatten())
    shapes = np.asarray(rows["shapes"].combine_chunks().flatten()).reshape(n, SHAPES)
    return tuple(fit_head(doc, feature, shapes, np.nan_to_num(np.asarray(rows[y].to_numpy(), float))) for y in ("quality", "toxic"))


def evidence(heads: tuple[Head, Head]):
    """Arrow UDF: text -> struct of both log-odds."""

    @F.arrow_udf("struct<quality: double, toxic: double>")
    def score(texts: pa.Array) -> pa.Array:
        quality, toxic = log_odds(texts.fill_null(""), heads)
        return pa.StructArray.from_arrays([pa.array(quality), pa.array(toxic)], names=["quality", "toxic"])

    return score


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(n: Column, total: Column, mean: Column) -> Column:
    """Pseudo-rows of a Beta prior by moments: the spread of site rates beyond what rows of such a
    rate show by chance.  1 to 10,000; with no spread the prior rules."""
    rate = total / n
    between = F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n)
    # each site's own parent: a row of a site varies by mean (1 - mean), its rate by an n-th of that
    noise = F.sum(mean * (1 - mean)) / F.sum(n)
    spread = F.greatest(between - noise, F.lit(1e-9))
    return F.least(F.greatest(F.sum(n * mean * (1 - mean)) / F.sum(n) / spread - 1, F.lit(1.0)), F.lit(10_000.0))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(_host, _path, p_quality, p_toxic) -> a row per path with the shift of log-odds of either
    head.  Rows are pre-aggregated map-side, so a host with a third of all rows costs no more than
    others."""
    paths = scored.groupBy("_host", "_path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("p_quality").alias("s_quality"), F.sum("p_toxic").alias("s_toxic")
    )
    paths = staged(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s_quality").alias("s_quality"), F.sum("s_toxic").alias("s_toxic"))
    heads = ("quality", "toxic")
    total = hosts.agg(F.sum("n").alias("n_all"), *[(F.sum(f"s_{h}") / F.sum("n")).alias(f"mean_{h}") for h in heads])
    hosts = hosts.join(F.broadcast(total))  # one row
    host_strength = hosts.agg(*[_strength(F.col("n"), F.col(f"s_{h}"), F.col(f"mean_{h}")).alias(f"k_{h}") for h in heads])
    hosts = hosts.join(F.broadcast(host_strength)).select(
        "_host", *[((F.col(f"s_{h}") + F.col(f"k_{h}") * F.col(f"mean_{h}")) / (F.col("n") + F.col(f"k_{h}"))).alias(f"host_{h}") for h in heads], *[f"mean_{h}" for h in heads]
    )
    joined = paths.join(hosts, "_host")
    path_strength = joined.agg(*[_strength(F.col("n"), F.col(f"s_{h}"), F.col(f"host_{h}")).alias(f"k_{h}") for h in heads])
    joined = joined.join(F.broadcast(path_strength))
    posterior = {h: (F.col(f"s_{h}") + F.col(f"k_{h}") * F.col(f"host_{h}")) / (F.col("n") + F.col(f"k_{h}")) for h in heads}
    return joined.select(
        "_host", "_path", F.col("n").cast("long").alias("n"), *[posterior[h].alias(f"site_{h}") for h in heads], *[(_logit(posterior[h]) - _logit(F.col(f"mean_{h}"))).alias(f"shift_{h}") for h in heads]
    )


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Every row of docs, its columns first, with `_verdict` (underscores are added where docs has that): struct<p_quality, p_toxic,
    site_quality, site_toxic, keep>.  keep: good rather than bad, and not rather toxic.

    The texts are read twice and scored twice, once for the sites' rates and once for the verdicts;
    that is cheaper than to shuffle or store them beside their scores."""
    prepare(docs.sparkSession)
    heads = train(docs, labels, max_train_rows)
    score = evidence(heads)
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((host, "_host"), (path, "_path"))]

    def key(a: Column, b: Column) -> Column:
        return F.concat(F.length(a).cast("string"), F.lit(":"), a, b)

    first = docs.select(*site, score(F.coalesce("text", F.lit(""))).alias("_e")).select(
        "_host", "_path", _sigmoid(F.col("_e.quality")).alias("p_quality"), _sigmoid(F.col("_e.toxic")).alias("p_toxic")
    )
    sites = site_posteriors(first).withColumn("key", key(F.col("_host"), F.col("_path")))
    # names that no column of docs has, whatever those are
    name = {c: fresh(docs, f"_{c}") for c in ("e", "site_quality", "site_toxic", "shift_quality", "shift_toxic")}
    sites = staged(sites.select("key", "n", *[F.col(c).alias(n) for c, n in name.items() if c != "e"]), "sites")  # its size is known once written
    scored = docs.withColumn(name["e"], score(F.coalesce("text", F.lit(""))))
    scored = keyed_join(scored, key(*site), sites, [n for c, n in name.items() if c != "e"])
    p_quality = _sigmoid(F.col(f"{name['e']}.quality") + F.col(name["shift_quality"]))
    p_toxic = _sigmoid(F.col(f"{name['e']}.toxic") + F.col(name["shift_toxic"]))
    verdict = F.struct(p_quality.alias("p_quality"), p_toxic.alias("p_toxic"), F.col(name["site_quality"]).alias("site_quality"), F.col(name["site_toxic"]).alias("site_toxic"), ((p_quality >= 0.5) & (p_toxic < 0.5)).alias("keep"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias(fresh(docs, "_verdict")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    verdicts = classify(docs, table(spark, sf_dir, "labels"))
    return verdicts.filter(F.col(f"{fresh(docs, '_verdict')}.keep")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents the classifier keeps, with their posteriors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).filter("_verdict.keep").select("doc_id", "_verdict.*")


__all__ = ["classify", "common", "evidence", "fit_head", "log_odds", "op10_quality_bayes", "site_posteriors", "stage", "train"]
