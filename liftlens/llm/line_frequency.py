"""Quality rules, with the frequency of lines across documents as the last one.

A host's boilerplate (menus, license lines, notices) stands in many of its
documents. Each line with a word is normalised (A-Z lower-cased, its words one
space apart) and hashed; per host, the documents that hold a hash are counted; a
line in more than ``least`` documents and in more than one of ``share`` of the
host's documents is removed; a document that keeps less than half of its words is
depleted and rejected. Documents of one host with equal texts count as one
document: copies are for deduplication to judge, and don't make their lines
boilerplate. Base rules reject a text with under 50 words, or with more than half
of its words in 3-word windows that the text repeats; such texts still count.

Defined results: a null text is empty, has no words and fails the base rules. A
null source is a host of its own, apart from the empty string. Rows repeat in the
result as they do in the table, each judged by its text; an empty table gives
none. Columns other than id, text and host are not looked at (``clean`` carries
them through whatever their names).

At scale: texts are read in one pass; what is shuffled is a 16-byte digest, the
measures, and 12 bytes for each distinct line. Counting is pre-aggregated. A line, a
text or a host that a third of all rows hold is looked up by broadcast (at most
10,000 keys, see ``skew.lookup``), all others by a shuffled join. ``clean`` moves the
texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import lookup
from .storage import staged
from .text import _STEP, inverse_powers, mix, slices, words

LEAST = 10
SHARE = 1000
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = ("doc_id bigint, host string, digest binary, " + ", ".join(f"{m} bigint" for m in MEASURES)
          + ", lines array<struct<line: bigint, words: int>>")


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _twins(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner and key, and for its places but the first whether the entry before is equal."""
    order = np.lexsort((keys, owner))
    return order, (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])


class Lines:
    """The lines with a word of a slice of texts: owner, byte range, number of words, hash of the normalised line."""

    def __init__(self, column: pa.Array):
        w = self.words = words(column, lower_ascii=False)
        n_words = np.diff(w.ptr)
        self.word_owner = np.repeat(np.arange(len(n_words)), n_words)
        breaks = np.flatnonzero(w.data == 10)
        at = np.searchsorted(breaks, w.starts)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (self.word_owner[1:] != self.word_owner[:-1])
        first = np.flatnonzero(new)
        self.owner, at = self.word_owner[first], at[first]
        around = np.concatenate([[-1], breaks, [len(w.data)]])
        self.starts = np.maximum(around[at] + 1, w.offsets[self.owner])
        self.ends = np.minimum(around[at + 1], w.offsets[self.owner + 1])
        self.n_words = np.diff(np.append(first, len(w.starts)))
        lower = words(column, lower_ascii=True).hashes
        place = np.arange(len(lower)) - np.repeat(first, self.n_words)
        placed = mix(lower + (place + 1).astype(np.uint64) * np.uint64(_STEP))
        self.hashes = mix(np.add.reduceat(placed, first)) if len(first) else placed

    def repeated(self) -> np.ndarray:
        """Per text, its lines that are equal to an earlier one."""
        w = self.words
        raw = (w.total[self.ends] - w.total[self.starts]) * inverse_powers(self.starts, len(w.data))
        order, same = _twins(mix(raw + (self.ends - self.starts).astype(np.uint64)), self.owner)
        return np.bincount(self.owner[order][1:][same], minlength=len(w.ptr) - 1)

    def repeated_words(self, size: int = 3) -> np.ndarray:
        """Per text, its words in runs of ``size`` words that it holds twice or more."""
        h, own = self.words.hashes, self.word_owner
        covered = np.zeros(len(h), bool)
        if len(h) >= size:
            runs = np.full(len(h) - size + 1, np.uint64(size))
            for k in range(size):
                runs = runs * np.uint64(_STEP) + h[k: len(h) - size + 1 + k]
            whole = np.flatnonzero(own[size - 1:] == own[: len(h) - size + 1])
            order, same = _twins(mix(runs[whole]), own[whole])
            twice = np.zeros(len(whole), bool)
            twice[1:] |= same
            twice[:-1] |= same
            for k in range(size):
                covered[whole[order[twice]] + k] = True
        return _sums(covered, self.words.ptr)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text, its distinct normalised lines and their words: offsets, hashes, words."""
        order, same = _twins(self.hashes, self.owner)
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
        held = np.bincount(self.owner[order][first], minlength=len(self.words.ptr) - 1)
        n = np.add.reduceat(self.n_words[order], first) if len(first) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(held)]), self.hashes[order][first], n


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column("text")):
            part = batch.slice(start, stop - start)
            found = Lines(part.column("text"))
            w = found.words
            lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
            raw = w.data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
            offsets, hashes, n = found.distinct()
            lines = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int32))], ["line", "words"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), pa.array(digests, pa.binary()), pa.array(np.diff(w.ptr).astype(np.int64)),
                 pa.array(_sums(lead[w.ends] - lead[w.starts], w.ptr)), pa.array(_sums(SYMBOLS[w.data], w.offsets)),
                 pa.array(found.repeated().astype(np.int64)), pa.array(found.repeated_words()),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), lines)],
                ["doc_id", "host", "digest", *MEASURES, "lines"])


def host_key(column: str):
    """A key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("+"), F.col(column)), F.lit(""))


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Per row its id, host key, text digest, the five base measures, and its distinct normalised lines with their words."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), host_key(host_column).alias("host"),
                       F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_measured, SCHEMA)


def distinct_documents(measured: DataFrame) -> DataFrame:
    """(host, digest, copies, n_words, lines): equal texts of a host are one document."""
    return measured.groupBy("host", "digest").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
                                                  F.first("lines").alias("lines"))


def frequent_lines(documents: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(host, line, n): lines in n documents of the host, more than ``least`` and than one of ``share`` of them."""
    counts = (documents.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line")
              .agg(F.count("*").alias("n")).where(F.col("n") > least))
    hosts = documents.groupBy("host").agg(F.count("*").alias("n_documents"), F.sum(F.size("lines")).alias("held"))
    return (lookup(counts, hosts, ["host"], "held", ["n_documents"])
            .where(F.col("n") * share > F.col("n_documents")).select("host", "line", "n"))


def verdicts(documents: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, digest, copies, removed, n_removed_words, depleted): the frequent lines that a document loses, and whether too few words stay."""
    lines = documents.select("host", "digest", F.explode("lines").alias("l")).select("host", "digest", "l.line", "l.words")
    lost = (lookup(lines, frequent, ["host", "line"], "n", ["n"]).where("n IS NOT NULL").groupBy("host", "digest")
            .agg(F.sum("words").alias("n_lost"), F.collect_list("line").alias("removed")))
    gone = F.coalesce("n_lost", F.lit(0))
    return documents.select("host", "digest", "copies", "n_words").join(lost, ["host", "digest"], "left").select(
        "host", "digest", "copies", "removed", gone.alias("n_removed_words"), (gone * 2 > F.col("n_words")).alias("depleted"))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          least: int = LEAST, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, the five base measures, base_failed, kept, the verdict of all rules, and the
    words in the lines it loses (null if the base rules reject it)."""
    measured = staged(measures(docs, id_column, text_column, host_column), "line-measures")
    documents = staged(distinct_documents(measured), "line-documents")
    frequent = staged(frequent_lines(documents, least, share), "frequent-lines")
    rows = measured.select("doc_id", "host", "digest", *MEASURES, base_failed().alias("base_failed"))
    judged = lookup(rows.where("NOT base_failed"), staged(verdicts(documents, frequent).drop("removed"), "line-verdicts"),
                    ["host", "digest"], "copies", ["depleted", "n_removed_words"])
    out = ["doc_id", *MEASURES, "base_failed"]
    failed = rows.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("bigint").alias("n_removed_words"))
    return judged.select(*out, (~F.col("depleted")).alias("kept"), "n_removed_words").unionByName(failed)


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Each text without the lines of the given hashes."""
    out = []
    for text, gone in zip(texts, removed, strict=True):
        if gone is not None and len(gone):
            column = pa.array([text])
            found = Lines(column)
            raw = found.words.data.tobytes()
            drop = np.isin(found.hashes.view(np.int64), np.asarray(gone, np.int64))
            pieces, at = [], 0
            for a, b in zip(found.starts[drop], found.ends[drop], strict=True):
                pieces.append(raw[at:a])
                at = min(b + 1, len(raw))  # the line's break goes too
            text = b"".join([*pieces, raw[at:]]).decode()
        out.append(text)
    return pd.Series(out, dtype=object)


def clean(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The documents that no rule rejects, all their columns, their texts without the host's frequent lines."""
    measured = staged(measures(docs, id_column, text_column, host_column), "line-measures")
    documents = staged(distinct_documents(measured), "line-documents")
    frequent = staged(frequent_lines(documents, least, share), "frequent-lines")
    passed = measured.where(~base_failed()).select("host", "digest").distinct().withColumn("passed", F.lit(True))
    table = verdicts(documents, frequent).join(passed, ["host", "digest"], "left")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), host_key(host_column).alias("host"),
                       F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))
    kept = lookup(rows, staged(table, "line-verdicts"), ["host", "digest"], "copies", ["removed", "depleted", "passed"])
    cut = F.pandas_udf(_without, "string")
    new = F.when(F.col("removed").isNull(), F.col("row")[text_column]).otherwise(cut(F.col("row")[text_column], "removed"))
    return kept.where("passed AND NOT depleted").withColumn("new", new).select(
        *[(F.col("new") if c == text_column else F.col("row")[c]).alias(c) for c in docs.columns])


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every row of ``documents``; its source is its host."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
