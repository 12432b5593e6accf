"""Filter interaction audit: recursive enumeration of every order in which a chain of filters can be applied.

Each document gets a mask with one bit per filter that it fails; documents are
counted per (part, mask) *cell*. A recursive CTE then walks the filter orders:
it starts with the empty prefix, each level extends every prefix with a letter
not yet used, carries the bits applied so far, and joins the mask cells, so that
a level says for each cell whether its documents go at this step, fail a filter
after they are gone, or are still there. k filters make sum k!/(k-j)! prefixes
and 2**k masks (326 and 32 for five), whatever the table's size: this recursion
is the only thing broadcast. Its join with the counted cells gives the metrics
of each prefix and part; the full orders read theirs from their prefixes.

The five filters of :func:`document_cells` (words: maximal runs of other than
white space, case-sensitive; a null text is empty):

- A: under 50 words;
- B: 100 * distinct words < 65 * words;
- C: 100 * capitals A-Z > 5 * code points;
- D: holds any of ``#$%&*|``;
- E: identical to the text of any smaller doc_id in the whole table, removed or not.

Defined results: an empty table has no parts and no rows. A null source is the
part of the empty string. Each repeated row counts; rows that share the smallest
doc_id of a text all pass E, and so does a row without doc_id, which is neither
labelled nor smaller than another. Labels that repeat a doc_id count as good
(toxic) if any of them is. Other columns are not looked at.

Rows of equal (doc_id, text, part) are added up before any join, the smallest
doc_id of a text is found by a pre-aggregated minimum, and E joins on (text
digest, doc_id), so neither a text that a third of all rows hold nor a null
doc_id makes a hot key. Texts never move: only their SHA-256.

The documents are read twice, once for the minimum, which needs the digests only.
Neither they nor the cells are staged: on a local file system each staged file
makes an executor start processes (Hadoop's ``chmod``), hundreds of them where
partitions are many and small. Only the walk, of a fixed size, is staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import staged

LETTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5


def text_digest():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")


def first_ids(docs: DataFrame) -> DataFrame:
    """(digest, doc_id): the smallest doc_id of each text that has any."""
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest())
    return ids.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, n): equal rows of these added up; ``mask`` holds the filters A to D, which need the text only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    seen = seen.withColumn("words", words)
    fails = [F.size("words") < MIN_WORDS,
             F.size(F.array_distinct("words")) * 100 < F.size("words") * DISTINCT_PERCENT,
             F.regexp_count("text", F.lit("[A-Z]")).cast("bigint") * 100 > F.length("text").cast("bigint") * CAPITALS_PERCENT,
             F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return (seen.select("doc_id", "part", text_digest(), mask.alias("mask"))
            .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled quality = 1 and toxic = 1, per part and set of failed filters."""
    rows = text_failures(docs)
    least = first_ids(docs).withColumn("first", F.lit(True))
    # A row without doc_id finds nothing; its key is spread by the digest.
    known = (F.coalesce("doc_id", F.xxhash64("digest")).alias("id"), F.col("doc_id").isNotNull().alias("has_id"))
    lab = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id"))
           .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
           .withColumn("has_id", F.lit(True)))
    judged = (rows.join(least, ["digest", "doc_id"], "left")
              .select(*known, "part", "n", F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.col("mask") + 16)
                      .otherwise(F.col("mask")).alias("mask"))
              .join(lab, ["id", "has_id"], "left"))
    return judged.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"))


def prefixes(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(prefix, step, letter, mask, alive, goes, late, only): every non-empty filter prefix with every mask cell.

    ``goes``: documents of the cell are removed by the prefix's last filter;
    ``late``: they fail it, but an earlier one has removed them; ``alive``: no
    filter of the prefix removes them; ``only``: it is the one filter they fail.
    """
    values = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {values}),
        cells(mask) AS (SELECT explode(sequence(0, {(1 << len(letters)) - 1}))),
        walk(prefix, step, letter, bit, applied, mask, alive, goes, late) AS (
            SELECT '', 0, '', 0, 0, mask, true, false, false FROM cells
            UNION ALL
            SELECT concat(w.prefix, l.letter), w.step + 1, l.letter, l.bit, w.applied | l.bit, w.mask,
                   c.mask & (w.applied | l.bit) = 0,
                   c.mask & w.applied = 0 AND c.mask & l.bit <> 0,
                   c.mask & w.applied <> 0 AND c.mask & l.bit <> 0
            FROM walk w JOIN letters l ON w.applied & l.bit = 0 JOIN cells c ON c.mask = w.mask
        )
        SELECT prefix, step, letter, mask, alive, goes, late, mask = bit AS only FROM walk WHERE step > 0""")


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, full filter order and step, from counted cells (part, mask, n, good, toxic).

    kept, removed, redundant, unique_fails, good_lost and toxic_lost are those of
    the step; shapley is what the step's filter removes, added up over all orders.
    """
    walk = staged(prefixes(cells.sparkSession, letters), "audit-walk")  # the recursion runs once

    def total(flag: str, counted: str = "n"):
        return F.sum(F.when(F.col(flag), F.col(counted)).otherwise(0)).cast("bigint")

    # A part has 2**k cells at most; dealt by part, what follows needs no further shuffle.
    by_prefix = (cells.repartition("part").join(F.broadcast(walk), "mask").groupBy("part", "prefix", "step", "letter")
                 .agg(total("alive").alias("kept"), total("goes").alias("removed"), total("late").alias("redundant"),
                      total("only").alias("unique_fails"), total("goes", "good").alias("good_lost"),
                      total("goes", "toxic").alias("toxic_lost")))
    full = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.select("filter_order", F.substring("filter_order", F.lit(1), F.col("step")).alias("prefix"))
    rows = by_prefix.join(F.broadcast(orders), "prefix")
    worth = F.sum("removed").over(Window.partitionBy("part", "letter"))  # as many rows as there are orders
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                       worth.alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over the whole of ``documents``, with ``labels``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(document_cells(docs, labels))
