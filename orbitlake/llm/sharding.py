"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards, each with a weight.  A row descends from the root: at each
level every child draws -ln(u) / weight, u being a hash of the row's id and the child's name in
(0, 1), and the smallest draw wins.  A child's draw depends on its own name and weight only, so a
changed weight moves rows into or out of the subtrees whose weights change and nowhere else.

`tree(n)` has 40 shards planned as 5 regions of 2 racks of 4; each shard beyond them is a region
of its own.  So the id and the number of shards decide (law `key`), and with one more shard the
only rows that move are those that the new region draws, all of them into the new shard.  Fewer
shards than planned fill the first regions.

A null id is hashed as the empty string.  Null and empty texts count 16 bytes and have CRC 0.
Rows with the same id share a shard; equal rows are merged to one with a count before they are
shuffled and get slots one after another.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLANNED, RACK, RACKS = 40, 4, 2
#: Parts of a shard that are numbered apart from one another.
PARTS = 64

#: Children of each inner node with their weights; shards are named s0, s1, ...
Tree = dict[str, list[tuple[str, float]]]
ROOT = "root"


def tree(shards: int, planned: int = PLANNED) -> Tree:
    """The tree of the shards 0 to shards - 1, each of weight 1."""
    racks: dict[str, list[int]] = {}
    for shard in range(shards):
        region = f"r{shard // (RACK * RACKS)}" if shard < planned else f"x{shard}"
        racks.setdefault(f"{region}.{shard // RACK % RACKS if shard < planned else 0}",
                         []).append(shard)
    return weighted({k: {f"s{x}": 1.0 for x in v} for k, v in racks.items()})


def weighted(racks: dict[str, dict[str, float]]) -> Tree:
    """The tree of racks named region.rack with the weights of their shards."""
    out: Tree = {ROOT: []}
    regions: dict[str, float] = {}
    for rack, leaves in racks.items():
        region = rack.split(".")[0]
        out[rack] = list(leaves.items())
        out.setdefault(region, []).append((rack, sum(leaves.values())))
        regions[region] = regions.get(region, 0.0) + sum(leaves.values())
    out[ROOT] = list(regions.items())
    return out


def placed(rows: DataFrame, of: Tree, name: str = "shard", key: str = "__key") -> DataFrame:
    """The rows with the shard that their key descends to: region, rack, shard."""
    children = F.create_map(*[x for node, below in of.items() for x in (
        F.lit(node), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight"))
                               for c, w in below if w > 0]))])

    def draw(child: F.Column) -> F.Column:
        head = F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit("/"), child["name"])), 1, 12),
                      16, 10).cast("double")
        return F.struct((-F.ln((head + 0.5) / float(1 << 48)) / child["weight"]).alias("draw"),
                        child["name"].alias("name"))

    node = F.lit(ROOT)
    for level in ("__region", "__rack", "__shard"):
        rows = rows.withColumn(level, F.array_min(
            F.transform(F.element_at(children, node), draw))["name"])
        node = F.col(level)
    return (rows.withColumn(name, F.substring("__shard", 2, 9).cast("int"))
            .drop("__region", "__rack", "__shard"))


def sharded(docs: DataFrame, shards: int = PLANNED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots number the rows of a shard from 0 without gaps, in the order of a hash part, the id, the
    size and the CRC.
    """
    text = docs["text"].cast("string")
    rows = (docs.select(docs["doc_id"].alias("doc_id"),
                        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
                        .alias("size"),
                        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
            .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("__copies")))
    rows = rows.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = placed(placed(rows, tree(shards)), tree(shards + 1), "grown_shard")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(PARTS)).cast("int"))
    # at most shards * PARTS counts; a window over one shard's parts turns them into first slots
    counts = rows.groupBy("shard", "__part").agg(F.sum("__copies").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0))
                           .alias("__first"))
    inside = Window.partitionBy("shard", "__part").orderBy("doc_id", "size", "text_crc32") \
        .rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__seen", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    return (numbered.join(F.broadcast(firsts), ["shard", "__part"])
            .withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.col("__copies") - 1)))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("__first") + F.col("__seen") + F.col("__nth")).alias("slot"),
                    "grown_shard"))


def with_shards(docs: DataFrame, shards: int = PLANNED) -> DataFrame:
    """Every row of `docs`, its columns, and its shard as the column `shard` (a column of that
    name that is there already is replaced)."""
    keyed = docs.withColumn("__key", F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    return placed(keyed, tree(shards)).drop("__key")
