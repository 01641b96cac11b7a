"""A Merkle manifest of a table: proofs by nested-interval labels.

Rows are leaves, ranked within their group (here: source) by order columns.  Every node of a group's tree
carries the interval of leaf ranks that it covers, [lo, hi], next to its digest; the nodes of one level are
a table.  A level is made from the one below by grouping on the bucket lo / 3**level, three nodes a group at
most.  Ancestors are attached from the top down by containment joins bucketed by level: a node meets the
node one level up whose interval holds its own, in the bucket that its rank falls in, and takes over that
node's path.  The siblings of a node are the parent's children whose intervals differ from its own: those
that end before it stand left of it, those that begin after it stand right.  Paths are thus built once for
each inner node and not once for each leaf.  The groups' roots are the leaves of one more tree.

Ranks come from a range-partitioned sort: each range is numbered by itself and begins after the ranges
before it, so a group that holds a third of all rows is numbered by many tasks.  Every table goes to the
shared folder once; texts are read once, for their digests.

Defined results: null fields are hashed as '-'; rows without a group form a group of their own, before all
others; rows that repeat the order columns are ordered by their digests, and equal rows among them are
leaves of their own; a group of one row has its leaf as its root; an empty table gives an empty table;
other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range that is numbered by itself, and of a file of inner nodes, about.
RANGE_ROWS = 500_000
FILE_ROWS = 20_000
_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A field as it is hashed: '-' if null, else its UTF-8 bytes' count, a colon and the value."""
    own = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """rows (key, ...) with rank, from 0 within key, and n, the rows of the key."""
    pieces = max(int(rows.sparkSession.sparkContext.defaultParallelism), -(-total // RANGE_ROWS))
    tie = F.monotonically_increasing_id()  # of files in the shared folder: the same in every attempt
    placed = rows.withColumn("_tie", tie).repartitionByRange(pieces, "key", *order, "_tie").withColumn("_piece", F.spark_partition_id())
    placed = staged(placed, "merkle-ranges")
    counts = placed.groupBy("key", "_piece").agg(F.count(F.lit(1)).alias("_here"))
    of_key = Window.partitionBy("key")  # a row for each range that the key reaches into
    before = of_key.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "_piece", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_offset"), F.sum("_here").over(of_key).alias("n"))
    nth = F.row_number().over(Window.partitionBy("key", "_piece").orderBy(*order, "_tie")) - 1
    return placed.withColumn("_nth", nth).join(offsets, ["key", "_piece"]).withColumn("rank", F.col("_offset") + F.col("_nth")).drop("_tie", "_piece", "_nth", "_offset")


def _bucket(level: int, arity: int) -> Column:
    """The bucket of the node at this level that covers the rank `lo`."""
    return F.floor(F.col("lo") / F.lit(arity**level)) if level else F.col("lo")


def _few_files(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def build_levels(leaves: DataFrame, longest: int, total: int, groups: int, arity: int = ARITY) -> list[DataFrame]:
    """Tables of nodes, leaves first: key, n, lo, hi, digest, and kids (the children with their intervals)
    from level 1 on.  leaves: key, n, rank, digest and what else the leaves carry."""
    own = [c for c in leaves.columns if c not in ("key", "n", "rank", "digest")]
    levels = [leaves.select("key", "n", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest", *own)]
    level = 0
    while arity**level < longest:
        kid = F.struct("lo", "hi", "digest", *(own if level == 0 else []))
        live = levels[level].filter(F.col("n") > arity**level).withColumn("_bucket", _bucket(level + 1, arity))
        met = live.groupBy("key", "_bucket").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
        level += 1
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: k.digest), ""), 256)
        nodes = met.select("key", "n", F.array_min(F.transform("kids", lambda k: k.lo)).alias("lo"), F.array_max(F.transform("kids", lambda k: k.hi)).alias("hi"), digest.alias("digest"), "kids")
        levels.append(staged(_few_files(nodes, total // arity**level + groups), f"merkle-level{level}"))
    return levels


def roots_of(levels: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """key, digest: what remains of each group."""
    alone = [nodes.filter((F.col("n") <= arity**level) & (F.col("n") > (arity ** (level - 1) if level else 0))).select("key", "digest") for level, nodes in enumerate(levels)]
    return reduce(DataFrame.union, alone)


def siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """struct<left, right>: the digests of a parent's children whose intervals lie before and behind [lo, hi]."""

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter(kids, keep), lambda k: k.digest), "")

    return F.struct(joined(lambda k: k.hi < lo).alias("left"), joined(lambda k: k.lo > hi).alias("right"))


def with_paths(levels: list[DataFrame], above: DataFrame, total: int, groups: int, arity: int = ARITY) -> DataFrame:
    """The leaves with path, an array of struct<left, right> from the leaf up to the group's root and on by
    what `above` (key, path, and what else a group hands down) says of the group."""
    handed = [c for c in above.columns if c not in ("key", "path")]
    own = [c for c in levels[0].columns if c not in ("key", "n", "lo", "hi", "digest")]
    upper: DataFrame | None = None
    for level in range(len(levels) - 1, 0, -1):
        size = arity**level
        nodes = levels[level]
        out = nodes.filter(F.col("n") <= size).join(above, "key").select("key", "lo", "hi", "kids", "path", *handed)
        if upper is not None:
            parent = upper.select(F.col("key"), F.floor(F.col("lo") / F.lit(size * arity)).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), *handed)
            child = nodes.filter(F.col("n") > size).withColumn("_bucket", _bucket(level + 1, arity))
            held = child.join(parent, ["key", "_bucket"]).filter((F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
            step = F.array(siblings(F.col("_kids"), F.col("lo"), F.col("hi")))
            out = out.unionByName(held.select("key", "lo", "hi", "kids", F.concat(step, "_path").alias("path"), *handed))
        upper = staged(_few_files(out, total // size + groups), f"merkle-paths{level}")
    alone = levels[0].filter("n = 1").join(above, "key").select("key", "lo", "digest", *own, "path", *handed)
    if upper is None:
        return alone
    kid = upper.select("key", "kids", F.col("path").alias("_path"), *handed, F.explode("kids").alias("_kid"))
    step = F.array(siblings(F.col("kids"), F.col("_kid.lo"), F.col("_kid.hi")))
    return alone.unionByName(kid.select("key", F.col("_kid.lo").alias("lo"), F.col("_kid.digest").alias("digest"), *[F.col(f"_kid.{c}").alias(c) for c in own], F.concat(step, "_path").alias("path"), *handed))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda done, s: F.sha2(F.concat(s.left, done, s.right), 256))


def manifest(rows: DataFrame, values: list[Column], group: Column, order: list[Column], claimed: Column | None = None, carry: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """A row per row of `rows`: what `carry` names, rank within its group, leaf, subroot (its group's root),
    root, path (struct<left, right> a level), claimed (the leaf that is put forward for the row; by itself
    the same).  values: what a leaf hashes; group: null is a group; order: of the leaves."""
    leaf, carry = leaf_digest(values), carry or {}
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))  # null sorts first
    names = [f"_o{i}" for i in range(len(order))]
    leaves = rows.select(key.alias("key"), *[c.alias(n) for c, n in zip(order, names, strict=True)], leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed"), *[c.alias(n) for n, c in carry.items()])
    leaves = staged(leaves, "merkle-leaves")
    sizes = staged(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "merkle-groups")
    total, longest, groups = sizes.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    if not total:
        paths = F.lit(None).cast(f"array<{_STEP}>")
        return leaves.select(*carry, F.lit(None).cast("long").alias("rank"), F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), paths.alias("path"), "claimed")
    placed = ranked(leaves, [*names, "digest"], total).drop(*names)
    levels = build_levels(staged(placed, "merkle-ranked"), longest, total, groups, arity)
    subroots = staged(roots_of(levels, arity), "merkle-subroots")
    tops = ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"], groups)
    top_levels = build_levels(staged(tops, "merkle-tops"), groups, groups, 1, arity)
    root = roots_of(top_levels, arity).first()["digest"]  # one row
    start = rows.sparkSession.range(1).select(F.lit("").alias("key"), F.array().cast(f"array<{_STEP}>").alias("path"))
    above = with_paths(top_levels, start, groups, 1, arity).select(F.col("group").alias("key"), "path", F.col("digest").alias("subroot"))
    out = with_paths(levels, staged(above, "merkle-above"), total, groups, arity)
    return out.select(*carry, F.col("lo").alias("rank"), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", "claimed")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; the proofs of documents with an even checksum are put to the
    test with a text that has lost its line breaks."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = [F.col(c) for c in FIELDS]
    out = manifest(docs, values, F.col("source"), [F.col("doc_id")], leaf_digest([*values[:-1], text]), {"doc_id": F.col("doc_id")})
    back = folded(F.col("claimed"), F.col("path"))
    found = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR END"


def _sql_tree(name: str, leaves: str, key: str) -> str:
    """Nodes and steps of the trees over `leaves` (key, idx, digest, n)."""
    return f"""
{name} AS (SELECT {key} AS key, 0 AS level, idx, digest, n FROM {leaves}
  UNION ALL SELECT key, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3)
  FROM {name} WHERE n > 1 GROUP BY key, level, idx // 3),
{name}_steps AS (SELECT a.key, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name} a LEFT JOIN {name} b ON a.key = b.key AND a.level = b.level AND a.idx // 3 = b.idx // 3 AND a.idx <> b.idx
  WHERE a.n > 1 GROUP BY ALL)"""


CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"

SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE_SQL}),
marked AS (SELECT d.*, coalesce(xor(list_reduce(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0, false) AS chosen FROM documents d, crc),
hashed AS (SELECT doc_id, coalesce('=' || source, '') AS key, {" || ".join(_sql_field(f) for f in FIELDS[:-1])} AS head, {_sql_field("text")} AS body,
    {_sql_field("CASE WHEN chosen THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM marked),
digests AS (SELECT doc_id, key, sha256(head || body) AS digest, sha256(head || changed) AS claimed FROM hashed),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM digests),
{_sql_tree("nodes", "leaves", "key")},
subroots AS (SELECT key AS grp, level AS height, digest, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_sql_tree("tops", "subroots", "0")},
fold AS (SELECT doc_id, digest AS leaf, key, 0 AS level, idx, claimed AS d, '' AS proof FROM leaves
  UNION ALL SELECT doc_id, leaf, f.key, f.level + 1, f.idx // 3, sha256(l || d || r), proof || l || r FROM fold f JOIN nodes_steps s ON f.key = s.key AND f.level = s.level AND f.idx = s.idx),
top_fold AS (SELECT doc_id, leaf, digest AS subroot, 0 AS level, s.idx, d, proof FROM fold f JOIN subroots s ON f.key = s.grp AND f.level = s.height
  UNION ALL SELECT doc_id, leaf, subroot, f.level + 1, f.idx // 3, sha256(l || d || r), proof || l || r FROM top_fold f JOIN tops_steps s ON f.level = s.level AND f.idx = s.idx)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = digest AS verified
FROM top_fold f JOIN tops r ON r.n = 1 AND f.level = r.level
"""
