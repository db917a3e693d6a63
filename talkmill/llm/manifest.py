"""A Merkle manifest of a table: leaves, node tables, and a proof for every leaf by looking up coordinates.

The leaves of a group stand in order; every two consecutive nodes become their hash, level by level, until one is left, the group's
subroot. The subroots in the order of their groups give the root in the same way. All node hashes are lowercase hex of SHA-256.

A tree is worked on in tiers of DEPTH levels. A block is the 2 ** DEPTH nodes at most that share an ancestor a tier up, so that it is a bounded
group: its inner nodes are computed at once and written as a table of nodes by coordinate (tree, level, index). Each leaf explodes the
coordinates of the siblings inside its block and looks them up in that table; each block does the same one tier up. No node is asked for
by more than 2 ** (DEPTH - 1) rows, however large the tree is, and the number of jobs grows with the logarithm of the largest group.

Places of leaves: rows are range-partitioned and sorted, so a place is the place in its partition after all earlier partitions' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.shared import written

#: Levels of a tier; a block has 2 ** DEPTH nodes at most.
DEPTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: what stands left and right of the node; both are empty where the node is alone.
STEP = "array<struct<level:int,before:string,after:string>>"


def encoded(value: Column) -> Column:
    """A value as a leaf has it: `-` for null, else the number of its UTF-8 bytes, a colon, the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: dict[str, Column]) -> Column:
    return digest(*(encoded(values[c]) for c in FIELDS))


def placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """The rows with `index` (their place in their tree, from 0) and `size` (the rows of the tree).

    Equal rows stand in any order. Which partition a row is in is settled by writing the sorted rows once.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    spread = salted.repartitionByRange(tree, *order, "_salt").sortWithinPartitions(tree, *order, "_salt").drop("_salt")
    at = F.monotonically_increasing_id()
    kept = written(spread.withColumn("_at", at), name).withColumn("_part", F.shiftright("_at", 33))
    starts = kept.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("size"))
    return kept.join(starts, [tree, "_part"]).withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def depth(size: Column) -> Column:
    """How many levels lie above the leaves of a tree of so many leaves; read from the binary digits, so it is exact."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def above(row: Column):
    """For a place: the node above the nodes at twice the place and beside it, which may be alone."""
    return lambda i: digest(F.get(row, 2 * i), F.coalesce(F.get(row, 2 * i + 1), F.lit("")))


def tier_nodes(nodes: DataFrame, tier: int) -> DataFrame:
    """(tree, size, level, index, hash) of the nodes of DEPTH levels from those of the lowest on; nodes has (tree, size, index, hash)."""
    base = tier * DEPTH
    block = nodes.groupBy("tree", "size", F.shiftright("index", DEPTH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("index", "hash"))).alias("row"))
    rows = block.select("tree", "size", "block", F.col("row.hash").alias("h0"))
    for k in range(1, DEPTH + 1):
        places = F.sequence(F.lit(0), F.expr(f"(size(h{k - 1}) + 1) div 2 - 1").cast("int"))
        rows = rows.withColumn(f"h{k}", F.when(depth(F.col("size")) >= base + k, F.transform(places, above(F.col(f"h{k - 1}")))))
    levels = F.array(*(F.struct(F.lit(base + k).alias("level"), F.lit(k).alias("k"), F.col(f"h{k}").alias("hashes")) for k in range(DEPTH + 1)))
    rows = rows.select("tree", "size", "block", F.explode(levels).alias("l")).where("l.hashes is not null")
    rows = rows.select("tree", "size", "block", "l.level", "l.k", F.posexplode("l.hashes").alias("i", "hash"))
    return rows.select("tree", "size", "level", F.expr(f"shiftleft(block, {DEPTH} - k) + i").alias("index"), "hash")


def tiers(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The node tables of all trees, tier by tier; leaves has (tree, size, index, hash). A tree is done in the tier that holds its root."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    out, nodes = [], leaves
    for tier in range(max(1, -(-max(largest - 1, 0).bit_length() // DEPTH)) if largest else 0):
        out.append(written(tier_nodes(nodes, tier), name))
        top = (tier + 1) * DEPTH
        nodes = out[-1].where((F.col("level") == top) & (depth(F.col("size")) > top)).select("tree", "size", "index", "hash")
    return out


def roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, hash): the last node of each tree."""
    found = [t.where(F.col("level") == depth(F.col("size"))).select("tree", "hash") for t in tables]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def looked_up(asking: DataFrame, table: DataFrame, tier: int) -> DataFrame:
    """(tree, index, steps) of each of the nodes (tree, size, index) of the tier's lowest level: the siblings up to the end of the tier.

    Each node explodes their coordinates from its index; a coordinate without a node is that of a node which is alone.
    """
    base = tier * DEPTH
    height = F.least(depth(F.col("size")), F.lit(base + DEPTH)) - base
    upward = F.when(height > 0, F.sequence(F.lit(0), height - 1))
    wanted = asking.select("tree", F.col("index").alias("at"), F.explode_outer(upward).alias("k"))
    wanted = wanted.select("tree", "at", (F.col("k") + base).alias("level"), F.expr("shiftright(at, k)").alias("own"))
    wanted = wanted.select("tree", "at", "level", (F.col("own") % 2 == 1).alias("right"), F.col("own").bitwiseXOR(F.lit(1)).alias("index"))
    found = wanted.join(table.select("tree", "level", "index", "hash"), ["tree", "level", "index"], "left")
    side = lambda right: F.when(F.col("right") == right, F.coalesce("hash", F.lit(""))).otherwise("")
    step = F.when(F.col("level").isNotNull(), F.struct(F.col("level").cast("int").alias("level"), side(True).alias("before"), side(False).alias("after")))
    return found.groupBy("tree", F.col("at").alias("index")).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def proofs(leaves: DataFrame, tables: list[DataFrame], name: str) -> DataFrame:
    """(tree, index, steps): for each leaf, what stands beside its path to the root of its tree, from the bottom up."""
    above = None
    for tier in range(len(tables) - 1, -1, -1):
        lowest = leaves if not tier else tables[tier].where(F.col("level") == tier * DEPTH)
        own = looked_up(lowest.select("tree", "size", "index"), tables[tier], tier)
        if above is not None:
            upper = above.select("tree", F.col("index").alias("block"), F.col("steps").alias("rest"))
            own = own.withColumn("block", F.shiftright("index", DEPTH)).join(upper, ["tree", "block"], "left")
            own = own.select("tree", "index", F.concat("steps", F.coalesce("rest", F.array().cast(STEP))).alias("steps"))
        above = written(own, name)
    return above


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(steps, start, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, steps) for each row of documents(doc_id, source, lang, n_chars, text).

    Groups are the values of lang, null being one; leaves ascend by doc_id, null first, those of one doc_id by their hash. Repeated rows are
    leaves of their own. `tampered` is the leaf with one more in n_chars where 7 divides the CRC-32 of the decimal doc_id, else null; a null
    doc_id or n_chars tampers nothing (for a null n_chars the leaf stays as it is). steps is the proof up to the root, bottom up.
    Null, empty and very long texts are hashed as they are. No rows give no rows; further columns are not read.
    """
    own = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(chosen, leaf(own | {"n_chars": F.col("n_chars") + 1}))
    # Null is a group before all others, also before the empty text.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(own).alias("hash"), more.alias("tampered"))
    leaves = written(placed(rows, "tree", ["doc_id", "hash"], "ordered-leaves"), "leaves")
    nodes = tiers(leaves.select("tree", "size", "index", "hash"), "nodes")
    if not nodes:
        return leaves.select("doc_id", F.col("hash").alias("leaf"), "tampered", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(STEP).alias("steps"))
    subroots = written(roots(nodes).withColumnRenamed("hash", "subroot"), "subroots")
    ranked = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("subroot").alias("hash")), "tree", ["group"], "ordered-subroots")
    ranked = written(ranked, "ranked-subroots")
    top = tiers(ranked.select("tree", "size", "index", "hash"), "top-nodes")
    upper = proofs(ranked, top, "top-proofs").join(ranked.select("index", "group", "hash"), "index")
    upper = upper.crossJoin(F.broadcast(roots(top).select(F.col("hash").alias("root"))))  # one row
    upper = upper.select(F.col("group").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("steps").alias("rest"))
    lower = proofs(leaves, nodes, "proofs")
    found = leaves.select("tree", "index", "doc_id", F.col("hash").alias("leaf"), "tampered").join(lower, ["tree", "index"]).join(upper, "tree")
    return found.select("doc_id", "leaf", "tampered", "subroot", "root", F.concat("steps", "rest").alias("steps"))


def verified(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the rows of `manifest`.

    folded_root is what the tampered leaf, or the untouched one where nothing was tampered with, gives with the original siblings.
    """
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
