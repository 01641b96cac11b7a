"""Sharding by a k-d tree over document metadata.

Documents are points in a few metadata dimensions.  A node that has to give k shards is cut along its
widest dimension, measured against the dimension's width over all documents, at the weighted quantile k_left / k of bytes (the median where k is even), until each
leaf is one shard of the target bytes.  Quantiles are found by histograms: each pass sums bytes by bin
for all open nodes at once and narrows the interval that holds the cut, so the driver sees at most
BINS rows a node, whatever the number of documents.

A cut is a bound on a key of the dimension's value, the text's CRC and a hash of doc_id.  Equal texts
lie side by side in every dimension; a cut goes through such a group only where keeping it whole would
miss the target by more than TOLERANCE of a shard.

Defined results: a null text weighs as none; null metadata is a value of its own; repeated rows are
rows of their own; fewer documents than shards leave shards empty; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SHARDS = 24
ROW_BYTES = 8
BINS = 1024
#: Largest error of a cut, as a share of a shard's target bytes.
TOLERANCE = 0.001
#: Rows of a shard that are numbered together, about.
SLOT_ROWS = 50_000
_VALUE_BITS, _CRC_BITS, _ID_BITS = 20, 32, 10
_TOP = (1 << _VALUE_BITS) - 1


@dataclass
class Node:
    first: int
    shards: int
    dimension: int | None = None
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None


def metadata_dimensions(docs: DataFrame) -> list[Column]:
    """0 to 2**20 - 1 each: log of the bytes, language, characters a byte.  All three follow from the text or
    are the same for equal texts, as a rule."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    log_size = F.least(F.log2(size + F.lit(1.0)) / 40, F.lit(1.0))
    language = F.pmod(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit(""))), F.lit(1 << _VALUE_BITS)) / float(1 << _VALUE_BITS) if "lang" in docs.columns else F.lit(0.0)
    density = F.length(F.coalesce("text", F.lit(""))) / F.greatest(size, F.lit(1))
    return [F.floor(x * _TOP).cast("long") for x in (log_size, language, density)]


def _key(value: Column, crc: Column, doc_id: Column) -> Column:
    hashed = F.pmod(F.xxhash64(doc_id), F.lit(1 << _ID_BITS))
    return F.shiftleft(value, _CRC_BITS + _ID_BITS) + F.shiftleft(crc, _ID_BITS) + hashed


def _where(node: Node, ids: dict[int, int]) -> Column:
    """The open node or leaf a row lies in, as its number."""
    if node.cut is None:
        return F.lit(ids[id(node)])
    return F.when(F.col(f"_key{node.dimension}") < F.lit(node.cut), _where(node.left, ids)).otherwise(_where(node.right, ids))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.cut is None else _leaves(node.left) + _leaves(node.right)


def build_tree(points: DataFrame, dimensions: int, shards: int, tolerance: float = TOLERANCE) -> Node:
    """points: size and _key0, _key1, ..."""
    root = Node(0, shards)
    total = points.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    whole: list[int] = []  # the root's width in each dimension
    while total:
        leaves = _leaves(root)
        live = [n for n in leaves if n.shards > 1]
        if not live:
            break
        ids = {id(n): i for i, n in enumerate(leaves)}
        placed = points.withColumn("_node", _where(root, ids))
        bounds = [f(F.col(f"_key{d}")).alias(f"{f.__name__}{d}") for d in range(dimensions) for f in (F.min, F.max)]
        found = {r["_node"]: r for r in placed.groupBy("_node").agg(F.sum("size").alias("bytes"), *bounds).collect()}  # a row a node
        open_: dict[int, list[int]] = {}  # node -> [low, high, bytes below low]
        goal: dict[int, float] = {}
        for n in live:
            i, row = ids[id(n)], found.get(ids[id(n)])
            if row is None:  # no rows: any cut will do
                n.dimension, n.cut = 0, 0
                continue
            width = [(row[f"max{d}"] >> (_CRC_BITS + _ID_BITS)) - (row[f"min{d}"] >> (_CRC_BITS + _ID_BITS)) for d in range(dimensions)]
            whole = whole or [max(w, 1) for w in width]
            relative = [w / all_ for w, all_ in zip(width, whole, strict=True)]
            n.dimension = relative.index(max(relative))
            open_[i] = [row[f"min{n.dimension}"], row[f"max{n.dimension}"] + 1, 0]
            goal[i] = row["bytes"] * (n.shards // 2) / n.shards
        while open_:
            node, key = F.col("_node"), F.lit(None).cast("long")
            low, width, within = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(False)
            for i, (a, b, _) in open_.items():
                here, own = node == i, F.col(f"_key{leaves[i].dimension}")
                key, low, width = F.when(here, own).otherwise(key), F.when(here, a).otherwise(low), F.when(here, -(-(b - a) // BINS)).otherwise(width)
                within |= here & (own >= a) & (own < b)
            bins = placed.filter(within).groupBy("_node", ((key - low) / width).cast("long").alias("bin")).agg(F.sum("size").alias("bytes")).collect()  # BINS rows a node
            by_node: dict[int, list] = {}
            for r in bins:
                by_node.setdefault(r["_node"], []).append((r["bin"], r["bytes"]))
            for i in list(open_):
                a, b, below = open_[i]
                step = -(-(b - a) // BINS)
                for number, size in sorted(by_node[i]):
                    if below + size >= goal[i]:
                        break
                    below += size
                begin, end = a + number * step, min(b, a + (number + 1) * step)
                if size <= slack or end - begin <= 1:
                    leaves[i].cut = end if below + size - goal[i] < goal[i] - below else begin
                    del open_[i]
                else:
                    open_[i] = [begin, end, below]
        for n in live:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
    return root


def points_of(docs: DataFrame, dimensions: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, and a key for each dimension."""
    text = F.coalesce(F.col("text"), F.lit(""))
    values = dimensions or metadata_dimensions(docs)
    crc, doc_id = F.crc32(F.encode(text, "UTF-8")), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), crc.alias("text_crc32"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    return rows.select("doc_id", "size", "text_crc32", *[_key(F.col(f"_v{i}"), F.col("text_crc32"), F.col("doc_id")).alias(f"_key{i}") for i in range(len(values))])


def kd_shards(docs: DataFrame, shards: int = SHARDS, dimensions: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    points = staged(points_of(docs, dimensions), "points")
    width = sum(c.startswith("_key") for c in points.columns)
    root = build_tree(points, width, shards)
    leaves = _leaves(root)
    shard = _where(root, {id(n): n.first for n in leaves}).cast("int")
    rows = points.count()
    pieces = max(8, -(-rows // (shards * SLOT_ROWS)))
    placed = points.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(pieces)).alias("_piece"))
    # slots: each piece of a shard is numbered by itself and begins after the pieces before it
    counts = placed.groupBy("shard", "_piece").count()
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("_nth", nth).join(offsets, ["shard", "_piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_nth")).alias("slot"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
