"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's UTF-8 bytes (16-bit, so a value depends on
the last 16 bytes only); a chunk ends where its top bits are zero and weren't at
any of the QUIET bytes before, at most MAX_CHUNK bytes on, and only between
characters. That rule is local: a passage's cuts are the same in every text, and
insertions shift texts but not the cuts behind them. Chunks with equal digests
(128-bit BLAKE2) are one chunk; the first holder, by doc_id, keeps it. In every
other place, runs of consecutive known chunks are extended on both sides by the
bytes that an earlier holder has there too, and runs of at least ``min_bytes``
bytes are cut out, from word to word where an extension ends within one. Shorter
coincidences stay. The earlier holders compared are those of every chunk within
REACH bytes of the run's end, so that an outer chunk that stands in a foreign
text too doesn't hide the passage's own. An extension reaches CONTEXT bytes past
the run; a longer common stretch has cuts, and so chunks, of its own.

One shuffle carries (digest, place) rows, pre-aggregated per batch: of a digest's
places in a batch only the least one can be the first, the others are dealt out
by place. One more brings the cut ordinals, each with an earlier place of its chunk, to
their texts. Then each distinct chunk asked for fetches the bytes beside it from that
earlier place. A chunk that a third of all documents hold costs one row per batch in
its digest's partition.

Rows with equal doc_id and text count as one document and stay alike. Rows with
a null doc_id come last. Null texts stay null, empty texts empty; a text that
consists of known chunks becomes empty, its row stays. Extra columns of any name
pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import free, mix, slices, text_buffers

QUIET, MAX_CHUNK = 16, 160
WINDOW = 16  # bytes that a gear hash depends on
CONTEXT = 256  # bytes compared beside a run, on each side
REACH = 160  # bytes from a run's end within which every chunk's earlier holder is compared
CUT_BITS = 4  # one byte in 2**4 may end a chunk; with QUIET chunks have 41 bytes on average
MIN_BYTES = 100
NO_ID = np.iinfo(np.int64).max
KEY_DIGITS = 15  # hex digits of a text's SHA-256 that tell rows of one doc_id apart


def _text_key(raw) -> int:
    return int(hashlib.sha256(raw).hexdigest()[:KEY_DIGITS], 16)


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: ``h = 2 h + G[byte]``, summed by doubling windows."""
    table = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
    h = table[data]
    for k in (1, 2, 4, 8):
        shifted = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += shifted
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text (byte range between offsets): where its chunks end, ascending; empty text: none.

    A cut depends on the WINDOW + QUIET bytes before it only, so two texts with a common stretch have
    the same cuts in it from there on; forced cuts of long chunks count from the cut before.
    """
    out = []
    lead = (data & 0xC0) != 0x80  # bytes that start a character
    low = np.flatnonzero(gear(data) >> np.uint16(16 - CUT_BITS) == 0) + 1
    bounds = np.searchsorted(low, offsets, "right")
    for i in range(len(offsets) - 1):
        start, stop = int(offsets[i]), int(offsets[i + 1])
        if start == stop:
            out.append(np.zeros(0, np.int64))
            continue
        c = low[bounds[i]:bounds[i + 1]]
        c = c[(c - start >= WINDOW) & (c < stop)]  # before, the hash holds bytes of another text
        c = c[np.diff(c, prepend=start - QUIET) > QUIET]
        ends = np.append(c[lead[c]], stop)
        if len(wide := np.flatnonzero(np.diff(ends, prepend=start) > MAX_CHUNK)):
            forced = []
            for j in wide.tolist():
                at, to = int(ends[j - 1]) if j else start, int(ends[j])
                while to - at > MAX_CHUNK:
                    at += MAX_CHUNK
                    while not lead[at]:
                        at -= 1
                    forced.append(at)
            ends = np.sort(np.append(ends, forced))
        out.append(ends.astype(np.int64))
    return out


PLACES = "known boolean, h1 bigint, h2 bigint, doc bigint, tkey bigint, k int, doc0 bigint, tkey0 bigint, k0 int"
LATER = "doc bigint, tkey bigint, k int, doc0 bigint, tkey0 bigint, k0 int"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of (doc_id, text) rows; ``known``: certainly not the first of their digest."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            data, off = text_buffers(batch.column(1).slice(a, b - a))
            raw = data.tobytes()
            ids = pc.fill_null(batch.column(0).slice(a, b - a), NO_ID).to_numpy()
            digests, counts, keys_ = [], [], []
            for i, ends in enumerate(chunk_ends(data, off)):
                at = int(off[i])
                keys_.append(_text_key(raw[at:int(off[i + 1])]))
                counts.append(len(ends))
                for e in ends.tolist():
                    digests.append(hashlib.blake2b(raw[at:e], digest_size=16).digest())
                    at = e
            if not digests:
                continue
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            n = np.array(counts)
            doc, tkey = np.repeat(ids, n), np.repeat(np.array(keys_, np.int64), n)
            k = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((k, tkey, doc, h[:, 1], h[:, 0]))
            same = np.zeros(len(h), bool)
            same[1:] = (h[order[1:]] == h[order[:-1]]).all(axis=1)
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
            known = same & ((doc[order] != doc[first]) | (tkey[order] != tkey[first]) | (k[order] != k[first]))
            drop = same & ~known  # the same place again, of a repeated row
            o, known, of = order[~drop], known[~drop], first[~drop]
            dealt = mix(doc[o].astype(np.uint64) * np.uint64(31) + k[o].astype(np.uint64)).astype(np.int64)  # a known place needs no digest
            h1, h2 = np.where(known, dealt, h[o, 0]), np.where(known, 0, h[o, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(known), pa.array(h1), pa.array(h2), pa.array(doc[o]), pa.array(tkey[o]),
                 pa.array(k[o].astype(np.int32)), *(pa.array(np.where(known, c[of], 0).astype(t)) for c, t in ((doc, np.int64), (tkey, np.int64), (k, np.int32)))],
                ["known", "h1", "h2", "doc", "tkey", "k", "doc0", "tkey0", "k0"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (known, digest, place): every place that isn't its digest's first, with an earlier place."""
    lead = None  # (h1, h2, doc, tkey, k) of the first place of the digest at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        known, *cols = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "h1", "h2", "doc", "tkey", "k"))
        m = np.stack([c.astype(np.int64) for c in cols], axis=1)
        of = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("doc0", "tkey0", "k0")], axis=1)
        if lead is not None:
            m = np.vstack([lead, m])
            known = np.concatenate([[False], known])
            of = np.vstack([np.zeros((1, 3), np.int64), of])
        same = np.zeros(len(m), bool)
        same[1:] = (m[1:, :2] == m[:-1, :2]).all(axis=1)
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(m))))
        later = known | (m != m[first]).any(axis=1)
        lead = m[first[-1]][None] if not known[-1] else lead
        out = np.hstack([m[:, 2:], np.where(known[:, None], of, m[first, 2:])])[later]
        yield pa.RecordBatch.from_arrays([pa.array(out[:, c].astype(np.int32 if c % 3 == 2 else np.int64)) for c in range(6)],
                                         ["doc", "tkey", "k", "doc0", "tkey0", "k0"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc, tkey, ks): per text (doc_id, text key) the ordinals of its chunks that an earlier place holds, each with such a place."""
    places = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_places, PLACES)
    dealt = places.repartition("h1").sortWithinPartitions("known", "h1", "h2", "doc", "tkey", "k")
    later = dealt.mapInArrow(_later, LATER)
    return later.groupBy("doc", "tkey").agg(F.collect_set(F.struct("k", "doc0", "tkey0", "k0")).alias("ks"))


def _ends(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return chunk_ends(data, np.array([0, len(data)]))[0]


def _beside(raw: bytes, ends: np.ndarray, k: int, side: int, size: int) -> bytes:
    """At most ``size`` bytes before (side 0) or behind (side 1) chunk ``k``, the nearest first."""
    if side:
        return raw[ends[k]:ends[k] + size]
    start = int(ends[k - 1]) if k else 0
    return raw[max(start - size, 0):start][::-1]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n:
        return 0
    other = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(other[0]) if len(other) else n


def _chunk_runs(ks: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive ordinals."""
    ks = np.unique(ks)
    cut = np.flatnonzero(np.diff(ks) != 1)
    return list(zip(ks[np.r_[0, cut + 1]].tolist(), ks[np.r_[cut, len(ks) - 1]].tolist(), strict=True))


def _asked(of: dict[int, tuple], ends: np.ndarray, run: tuple[int, int], side: int) -> Iterator[tuple[int, int]]:
    """(chunk, bytes from there to the run's end): the outermost chunk of each earlier holder within REACH of that end.

    Chunks that follow each other in the holder as in this text are compared once.
    """
    seen = set()
    for k in range(run[1], run[0] - 1, -1) if side else range(run[0], run[1] + 1):
        if side:
            gap = int(ends[run[1]] - ends[k])
        else:
            gap = int(ends[k - 1] if k else 0) - int(ends[run[0] - 1] if run[0] else 0)
        if gap > REACH:
            return
        doc0, tkey0, k0 = of[k]
        if (doc0, tkey0, k0 - k) not in seen:
            seen.add((doc0, tkey0, k0 - k))
            yield k, gap


EDGES = "doc0 bigint, tkey0 bigint, k0 int, side int, doc bigint, tkey bigint, k int, gap int, near binary"
THERE = "doc0 bigint, tkey0 bigint, k0 int, side int, there binary"


def _edges(doc_name: str, tkey_name: str, ks_name: str):
    """For each end of each run: the earlier places asked there, and this text's bytes from the asked chunk outwards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tkey, text, ks in zip(*(batch.column(c).to_pylist() for c in (doc_name, tkey_name, "text", ks_name)), strict=True):
                if not text or not ks:
                    continue
                raw = text.encode()
                ends, of = _ends(raw), {}
                for m in ks:
                    place = (m["doc0"], m["tkey0"], m["k0"])
                    of[m["k"]] = min(of.get(m["k"], place), place)
                for chunks in _chunk_runs(np.array(list(of))):
                    for side, outer in enumerate(chunks):
                        for k, gap in _asked(of, ends, chunks, side):
                            near = _beside(raw, ends, k, side, gap + CONTEXT)
                            if len(near) > gap:
                                rows.append((*of[k], side, doc, tkey, outer, gap, near))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["doc0", "tkey0", "k0", "side", "doc", "tkey", "k", "gap", "near"])
    return run


def _contexts(doc_name: str, tkey_name: str, asked_name: str):
    """The bytes beside the chunks that edges ask for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tkey, text, asked in zip(*(batch.column(c).to_pylist() for c in (doc_name, tkey_name, "text", asked_name)), strict=True):
                raw = text.encode()
                ends = _ends(raw)
                rows += [(doc, tkey, a["k0"], a["side"], _beside(raw, ends, a["k0"], a["side"], a["gap"] + CONTEXT)) for a in asked]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc0", "tkey0", "k0", "side", "there"])
    return run


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [_common(a, b) - gap for a, b, gap in zip(*(batch.column(c).to_pylist() for c in ("near", "there", "gap")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "tkey", "k", "side")), pa.array(n, pa.int32())], ["doc", "tkey", "k", "side", "n"])


def extents(texts: DataFrame, marked: DataFrame, doc: str, tkey: str, ks: str) -> DataFrame:
    """(doc, tkey, ext): per text how many bytes past the ends of its runs an earlier holder has too."""
    asks = free("chunk_asked", texts.columns)
    edges = marked.mapInArrow(_edges(doc, tkey, ks), EDGES)  # all columns, so that the texts' one exchange serves every join
    asked = edges.groupBy("doc0", "tkey0", "k0", "side").agg(F.max("gap").alias("gap")) \
        .groupBy(F.col("doc0").alias(doc), F.col("tkey0").alias(tkey)).agg(F.collect_list(F.struct("k0", "side", "gap")).alias(asks))
    there = texts.join(asked, [doc, tkey]).mapInArrow(_contexts(doc, tkey, asks), THERE)
    met = edges.join(there, ["doc0", "tkey0", "k0", "side"]).mapInArrow(_extents, "doc bigint, tkey bigint, k int, side int, n int")
    return met.where("n > 0").groupBy("doc", "tkey", "k", "side").agg(F.max("n").alias("n")) \
        .groupBy("doc", "tkey").agg(F.collect_list(F.struct("k", "side", "n")).alias("ext"))


def _word_ends(raw: bytes) -> np.ndarray:
    """Whether a cut may start or end at each byte position: beside white space, or between non-ASCII characters."""
    data = np.frombuffer(raw, np.uint8)
    space, wide = np.isin(data, [0x20, *range(0x09, 0x0E)]), data >= 128
    ok = np.ones(len(data) + 1, bool)
    ok[1:-1] = (space[1:] != space[:-1]) | (wide[1:] & wide[:-1] & ((data[1:] & 0xC0) != 0x80))
    return ok


def without(text: str, ks: list[int], min_bytes: int, ext: list[tuple[int, int, int]] = ()) -> tuple[str, int]:
    """``text`` without its runs of the chunks ``ks`` of at least ``min_bytes`` bytes, and how many code points went.

    ``ext`` (chunk, side, bytes): how far runs reach beyond their outer chunks.
    """
    raw = text.encode()
    ends = _ends(raw)
    more: dict[tuple[int, int], int] = {}
    for k, side, n in ext:
        more[k, side] = max(n, more.get((k, side), 0))
    ok, data = _word_ends(raw), np.frombuffer(raw, np.uint8)
    space = np.append(np.isin(data, [0x20, *range(0x09, 0x0E)]), False)
    runs: list[list[int]] = []  # exact start and end, start and end at words
    for i, j in _chunk_runs(np.asarray(ks)):
        start, stop = int(ends[i - 1]) if i else 0, int(ends[j])
        low, high = start - more.get((i, 0), 0), stop + more.get((j, 1), 0)
        at = low + np.flatnonzero(ok[low:start] & ~space[low:start])
        to = stop + 1 + np.flatnonzero(ok[stop + 1:high + 1] & ~space[stop:high])
        new = [low, high, int(at[0]) if len(at) else start, int(to[-1]) if len(to) else stop]
        if runs and low <= runs[-1][1]:  # both reach the bytes between them
            runs[-1] = [min(low, runs[-1][0]), max(high, runs[-1][1]), min(new[2], runs[-1][2]), max(new[3], runs[-1][3])]
        else:
            runs.append(new)
    kept, at = [], 0
    for low, high, start, stop in runs:
        if high - low >= min_bytes:
            kept.append(raw[at:start])
            at = stop
    kept.append(raw[at:])
    out = b"".join(kept).decode()
    return out, len(text) - len(out)


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES, removed: str | None = None) -> DataFrame:
    """``docs`` with ``text`` free of repeated runs and, if it has it, ``n_chars`` set anew; ``removed``: a column for what went."""
    doc, tkey, known, more = (free(n, docs.columns) for n in ("chunk_doc", "chunk_text", "chunk_known", "chunk_ext"))
    digest = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, KEY_DIGITS), 16, 10).cast("bigint")
    # neither key is nullable: a join that filters nulls out would shuffle the texts once more
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_ID))), F.coalesce(digest, F.lit(0).cast("bigint"))]
    fields = [f for f in docs.schema.fields if f.name != removed]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in fields], key[0].alias(doc), key[1].alias(tkey))
    ks = repeated_chunks(docs).select(F.col("doc").alias(doc), F.col("tkey").alias(tkey), F.col("ks").alias(known))
    marked = frame.join(ks, [doc, tkey], "left")
    ext = extents(frame, marked, doc, tkey, known).select(F.col("doc").alias(doc), F.col("tkey").alias(tkey), F.col("ext").alias(more))
    joined = marked.join(ext, [doc, tkey], "left").select(
        *[F.col(f"`{f.name}`") for f in fields], F.col(f"{known}.k").alias(known), more)
    out = [*fields, *([T.StructField(removed, T.LongType())] if removed else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, gone = part.column("text").to_pylist(), [0] * part.num_rows
                ext = part.column(more).to_pylist()
                for i, marked in enumerate(part.column(known)):
                    if marked.is_valid and texts[i]:
                        texts[i], gone[i] = without(texts[i], marked.values.to_numpy(), min_bytes, [(e["k"], e["side"], e["n"]) for e in ext[i] or ()])
                columns = {n: part.column(n) for n in part.schema.names if n not in (known, more)}
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    kind = columns["n_chars"].type
                    columns["n_chars"] = pc.if_else(pa.array([g > 0 for g in gone]), pa.array(map(lambda t: len(t or ""), texts), pa.int64()).cast(kind), columns["n_chars"])
                if removed:
                    columns[removed] = pa.array(gone, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, T.StructType(out))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text free of runs that an earlier document (or place) holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, removed="n_removed").select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), "n_removed")
