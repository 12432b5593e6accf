"""Merkle manifest of a dataset by butterfly exchange.

A row's leaf is the SHA-256 of its columns, each ``-`` if null, else its UTF-8 byte
count, ``:`` and its value. Per group (source) the leaves ascend by id; every 16
consecutive nodes (the last run: fewer, even one) become the hash of their hex
texts until one is left, the subroot. The subroots in order of group (null first,
then bytewise) give the root in the same way. A row's proof is its siblings, from
leaf to root.

Leaves lie in aligned *blocks* of 4,096 consecutive positions of one group, one
block to a task at a time. A block hashes its own subtree; then the blocks exchange
roots as the partners of a butterfly network do. In round r the 16 blocks (or as
many as there are) that agree in all base-16 digits of their number but the r-th
form one exchange group: they swap the roots of the subtrees that they have so far,
every one of them hashes the same parent and keeps its siblings. After the last
round each block holds the proof of its own root up to the group's, and nothing has
to travel down again. Where the last subtree of a level has fewer blocks than its
siblings, its blocks stand in for the missing partners in turn. The groups' subroots
are exchanged by the same blocks in further rounds, in which a group of few blocks
stands in for as many as its largest sibling has. At the end each block folds its
own upper proof into its rows' proofs.

Defined results: a lone leaf is its group's subroot, a lone subroot the root; an
empty table has no rows. Null ids come first. Rows that repeat an id follow the order
of their leaves; equal rows each have a place and a proof. Null, empty and long texts
are hashed as said; columns that aren't hashed are not looked at.

At scale: texts are read once and hashed in the JVM; 32-byte leaves move. Places
within a group are a range-partitioned running order, so a group that holds a third
of all rows is split by id (and equal rows by their place in the input). A task holds
one block; a round moves one row per block, and per stand-in one without its proof.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlens.operators.ordering import prefix_sum

from .storage import staged

FANOUT = 16
DEPTH = 3  # levels of a whole block: 16 ** 3 leaves
ROWS_PER_BUCKET = 250_000
BUCKETS = 64  # as many range buckets at least, where there are blocks enough, so that a large group is split at any size
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 (32 bytes) of the columns' canonical text."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], n: int, depth: int) -> list[list[str]]:
    """The nodes of a block level by level, its leaves first: ``depth`` levels up, or to one node in a group of one block."""
    out = [leaves]
    while len(out) <= depth and (n > FANOUT ** depth or len(out[-1]) > 1):
        below = out[-1]
        out.append([_hash("".join(below[i: i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def _sorted_leaves(table: pa.Table) -> tuple[np.ndarray, list[str]]:
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    return order, [x.hex() for x in table.column("leaf").take(pa.array(order)).to_pylist()]


def ordered_leaves(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, depth: int = DEPTH) -> DataFrame:
    """``rows`` (key, id, leaf, ...) with place (from 0) in the key, n of the key, and block."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    rows_per_bucket = min(rows_per_bucket, max(FANOUT ** depth, -(-rows.count() // BUCKETS)))
    placed = prefix_sum(tied, [("id", True), ("leaf", True), ("_tie", True)], partition_by=["key"], rows_per_bucket=rows_per_bucket,
                        row_number="place", count_col="n").drop("_tie")
    placed = placed.withColumn("place", F.col("place") - 1)
    return placed.withColumn("block", F.expr(f"place DIV {FANOUT ** depth}"))


def block_roots(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, block, n, root): each block's subtree, hashed in one task."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        root = _levels(_sorted_leaves(table)[1], n, depth)[-1][0]
        return pa.table({"key": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([n], pa.int64()), "root": [root]})

    return leaves.select("key", "block", "place", "n", "leaf").groupBy("key", "block").applyInArrow(
        run, "key string, block bigint, n bigint, root string")


def _swap(state: DataFrame, group: list[str]) -> DataFrame:
    """One round: the members of each exchange group (``group`` and ``lane``) get all their roots and hash the parent.

    ``state`` says for each block its ``digit`` among the siblings, its ``index`` among the ``members`` blocks of its
    subtree, the ``lanes`` of the largest sibling, and whether it is ``active``; a block is on lane ``index`` and stands
    in on every ``members``-th after it.
    """
    lanes = F.when(F.col("active"), F.sequence("index", F.col("lanes") - 1, "members")).otherwise(F.array("index"))
    sent = state.withColumn("lane", F.explode(lanes)).withColumn("path", F.when(F.col("lane") == F.col("index"), F.col("path")))
    swapped = F.array_sort(F.collect_list(F.struct("digit", "root")).over(Window.partitionBy(*group, "lane")))
    got = sent.withColumn("swapped", swapped).where("lane = index")

    def side(beside):
        return F.concat_ws("", F.transform(F.filter("swapped", beside), lambda x: x["root"]))

    got = got.withColumns({"before": side(lambda x: x["digit"] < F.col("digit")), "after": side(lambda x: x["digit"] > F.col("digit"))})
    return got.withColumns({
        "path": F.when(F.col("active"), F.concat("path", F.array(F.struct("before", "after")))).otherwise(F.col("path")),
        "root": F.when(F.col("active"), F.sha2(F.concat("before", "root", "after"), 256)).otherwise(F.col("root"))})


def _rounds(n: int) -> int:
    """Levels above ``n`` nodes."""
    r = 0
    while n > 1:
        n, r = -(-n // FANOUT), r + 1
    return r


def exchange_in_groups(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, block, blocks, subroot, path): each block's siblings up to its group's subroot."""
    state = blocks.select("key", "block", F.expr(f"(n + {FANOUT ** depth - 1}) DIV {FANOUT ** depth}").alias("blocks"), "root",
                          F.expr("CAST(array() AS array<struct<before: string, after: string>>)").alias("path"))
    most = blocks.agg(F.max("n")).first()[0] or 0
    for r in range(_rounds(-(-most // FANOUT ** depth))):
        width = FANOUT ** r
        active = F.col("blocks") > width
        child, parent = F.expr(f"block DIV {width}"), F.expr(f"block DIV {width * FANOUT}")
        state = _swap(state.withColumns({
            "active": active, "parent": F.when(active, parent).otherwise(F.lit(-1)),
            "digit": child % FANOUT, "index": F.when(active, F.col("block") % width).otherwise(F.col("block")),
            "members": F.least(F.lit(width).cast("bigint"), F.col("blocks") - child * width),
            "lanes": F.least(F.lit(width).cast("bigint"), F.col("blocks") - parent * width * FANOUT),
        }), ["key", "parent"]).select("key", "block", "blocks", "root", "path")
    return state.withColumnRenamed("root", "subroot")


def group_places(groups: DataFrame) -> tuple[DataFrame, int]:
    """(key, at): for each level above the groups' subroots a struct of digit, parent, members, lanes and the group's first index.

    ``groups`` is (key, blocks), one row per group; the number of levels comes back too.
    """
    ranked = staged(prefix_sum(groups, [("key", True)], {"upto": F.col("blocks")}, row_number="rank", count_col=None, totals=False)
                    .select("key", "blocks", (F.col("rank") - 1).alias("rank"), (F.col("upto") - F.col("blocks")).alias("ahead")),
                    "merkle-groups")
    levels = _rounds(ranked.count())
    at = ranked
    for r in range(levels):
        width = FANOUT ** r
        child = ranked.groupBy(F.expr(f"rank DIV {width}").alias("child")).agg(F.sum("blocks").alias("members"), F.min("ahead").alias("first"))
        child = child.withColumn("parent", F.expr(f"child DIV {FANOUT}"))
        largest = child.groupBy("parent").agg(F.max("members").alias("lanes"))
        level = child.join(largest, "parent").select("child", F.struct(
            (F.col("child") % FANOUT).alias("digit"), "parent", "members", "lanes", "first").alias(f"l{r}"))
        at = at.withColumn("child", F.expr(f"rank DIV {width}")).join(level, "child").drop("child")
    values = [F.struct(F.col(f"l{r}.digit"), F.col(f"l{r}.parent"), F.col(f"l{r}.members"), F.col(f"l{r}.lanes"),
                       (F.col("ahead") - F.col(f"l{r}.first")).alias("index")) for r in range(levels)]
    kind = "array<struct<digit: bigint, parent: bigint, members: bigint, lanes: bigint, index: bigint>>"
    return at.select("key", (F.array(*values) if values else F.array()).cast(kind).alias("at")), levels


def exchange(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, block, subroot, root, path): every block's upper proof after the rounds within groups and those among them."""
    inner = staged(exchange_in_groups(blocks, depth), "merkle-subroots")
    places, levels = group_places(inner.where("block = 0").select("key", "blocks"))
    state = inner.join(places, "key").withColumn("root", F.col("subroot"))
    for r in range(levels):
        level = F.col("at")[r]
        state = _swap(state.withColumns({
            "active": F.lit(True), "parent": level["parent"], "digit": level["digit"], "members": level["members"],
            "lanes": level["lanes"], "index": level["index"] + F.col("block")}), ["parent"]
        ).select("key", "block", "subroot", "root", "path", "at")
    return state.select("key", "block", "subroot", "root", "path")


def _folded(depth: int):
    """A block's rows with their proofs, and the root that each row's (tampered) leaf folds to."""
    def run(leaves: pa.Table, upper: pa.Table) -> pa.Table:
        order, hexes = _sorted_leaves(leaves)
        n, path = leaves.column("n")[0].as_py(), [(p["before"], p["after"]) for p in upper.column("path")[0].as_py()]
        levels = _levels(hexes, n, depth)
        rest = ["".join(a + b for a, b in path)]  # siblings above each node of the level at hand
        beside: list[list[tuple[str, str]]] = []
        for nodes in reversed(levels[:-1]):
            own = []
            for i in range(len(nodes)):
                run_at = i // FANOUT * FANOUT
                own.append(("".join(nodes[run_at:i]), "".join(nodes[i + 1: run_at + FANOUT])))
            rest = [a + b + rest[i // FANOUT] for i, (a, b) in enumerate(own)]
            beside.insert(0, own)
        ids, tampered = (leaves.column(c).take(pa.array(order)).to_pylist() for c in ("id", "tampered"))
        folded = []
        for i, other in enumerate(tampered):
            h, at = hexes[i] if other is None else other.hex(), i
            for own in beside:
                h, at = _hash(own[at][0] + h + own[at][1]), at // FANOUT
            for before, after in path:
                h = _hash(before + h + after)
            folded.append(h)
        subroot, root = (upper.column(c)[0].as_py() for c in ("subroot", "root"))
        m = len(hexes)
        return pa.table({"id": pa.array(ids, pa.int64()), "leaf": hexes, "subroot": [subroot] * m, "root": [root] * m,
                         "proof_sha256": [_hash(p) for p in rest], "folded_root": folded, "verified": [h == root for h in folded]})
    return run


def proofs(leaves: DataFrame, upper: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; its ``tampered`` leaf, if any, is folded."""
    own = leaves.select("key", "block", "place", "n", "id", "leaf", "tampered").groupBy("key", "block")
    return own.cogroup(upper.groupBy("key", "block")).applyInArrow(
        _folded(depth), "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, id_column: str = "doc_id", group_column: str = "source", columns: tuple[str, ...] = COLUMNS,
             tampered: dict[str, Column] | None = None, where: Column | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
             depth: int = DEPTH) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether it folds to the root.

    With ``tampered`` (column: its altered value) the rows for which ``where`` holds are folded from the leaf of the altered
    columns, as a copy of the dataset that was changed would be; all other outputs stay those of the rows as they are.
    """
    altered = F.when(where if where is not None else F.lit(True), leaf_hash(*[(tampered or {}).get(c, F.col(c)) for c in columns]))
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), F.col(group_column)), F.lit("")).alias("key"),
                       F.col(id_column).cast("bigint").alias("id"), leaf_hash(*[F.col(c) for c in columns]).alias("leaf"),
                       (altered if tampered else F.lit(None).cast("binary")).alias("tampered"))
    leaves = staged(ordered_leaves(staged(rows, "merkle-rows"), rows_per_bucket, depth), "merkle-leaves")
    upper = staged(exchange(staged(block_roots(leaves, depth), "merkle-blocks"), depth), "merkle-paths")
    return proofs(leaves, upper, depth).withColumnRenamed("id", id_column)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and proofs of all rows of ``documents``; ids whose CRC-32 5 divides have a lower-cased text."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered={"text": lower},
                    where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
