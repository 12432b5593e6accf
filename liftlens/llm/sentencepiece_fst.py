"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled transducer is N o P: N is the normaliser (dummy prefix, spaces to
U+2581), P has one arc sequence per piece, and byte-fallback arcs for characters
that no piece spells. Composed with one input, it is a lattice over the input's
positions, and its tropical-semiring shortest path is the encoding:

- unigram models: an arc weighs minus its piece's score; the least sum wins;
- BPE models: a state is (position, last piece). Piece y may follow x only where
  merging the string x + y gives exactly x, y; such arcs weigh 0, others
  infinity. A piece sequence whose neighbours all agree is the merge result, so
  every reachable position has one finite path, and no merge queue is run.
  Byte-fallback arcs weigh 0 too and exist only for characters without a piece.

No piece has U+2581 behind another character, so the lattice falls apart at
every such place; equal segments are composed once per worker, in a memo that
starts anew at MEMO entries. Decoding is the inverse: pieces to bytes, U+2581 to
a space, the dummy prefix dropped. U+2581 in a text decodes to a space; any other text returns
exactly. Null text: null ids and null decoded text; empty text: no ids.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound_batches, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO = 100_000  # segments of each of the two generations that a worker remembers
PAIRS = 600_000  # pairs of pieces whose order a worker remembers
LONG = 64  # characters above which a segment isn't remembered (unspaced text is one segment)
SPACE = "▁"


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and normaliser settings of a model file (read on the driver, sent to the tasks)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only identity normalisers that keep white space are compiled")
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("unigram and BPE models only")
    return {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "kinds": [p.type for p in m.pieces],
            "bpe": m.trainer_spec.model_type == 2, "prefix": m.normalizer_spec.add_dummy_prefix}


class Speller:
    """What each piece of a model spells: decode ids to a text."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, model: dict):
        self.pieces, self.prefix = model["pieces"], model["prefix"]
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i, k in enumerate(model["kinds"]):
            if k == self.BYTE:
                out[i] = bytes([int(self.pieces[i][1:-1], 16)])
            elif k not in (1, 4):
                out[i] = b" \xe2\x81\x87 " if k == self.UNKNOWN else b""
        self.spelled = out
        self.spelling = pa.array(out, pa.large_binary())

    def decode(self, ids: np.ndarray) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode_all(self, column: pa.ListArray) -> pa.Array:
        """The text of each list of ids, null for null: all ids spelled at once."""
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        data = self.spelling.take(column.flatten())
        at = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1)[ends]
        raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
        start, end = at[:-1].copy(), at[1:]
        if self.prefix:
            some = np.flatnonzero(start < end)
            start[some] += raw[start[some]] == 32
        whole = memoryview(raw)
        valid = column.is_valid().to_pylist()
        return pa.array([str(whole[a:b], "utf-8", "replace") if v else None
                         for v, a, b in zip(valid, start.tolist(), end.tolist(), strict=True)], pa.string())


class Transducer(Speller):
    """The compiled model: encode a text to piece ids as well."""

    def __init__(self, model: dict):
        super().__init__(model)
        self.bpe, self.scores = model["bpe"], model["scores"]
        self.ids = {p: i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k in (1, 4)}
        self.bytes_ = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"], strict=True)) if k == self.BYTE}
        self.spells = self.ids
        self.unknown = model["kinds"].index(self.UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.chars = {p for p in self.ids if len(p) == 1}
        self.agree: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the full memo before; what is met again moves on
        if self.bpe:  # a piece that its own string doesn't merge to has no arc
            self.ids = {p: i for p, i in self.ids.items() if self._merged(p) == [p]}
        self._link_arcs()
        cut = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = (lambda t: [t]) if cut else re.compile(" +[^ ]*|[^ ]+").findall

    def _link_arcs(self) -> None:
        """Arcs as a tree of characters, whose nodes hold the longest piece on the way there ("": its id), and per piece
        its size and the next longest piece that it begins with. Id -1 stands for none, and for a character without a piece."""
        self.sizes, self.shorter = [1] * (len(self.pieces) + 1), [-1] * (len(self.pieces) + 1)
        self.tree: dict = {"": -1}
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            node = self.tree
            for ch in p:
                node = node.setdefault(ch, {"": node[""]})
            self.sizes[i], self.shorter[i] = len(p), node[""]
            node[""] = i

    def _merged(self, text: str) -> list[str]:
        """The merge result of a piece or two: repeatedly the best-scored neighbouring pair, leftmost first."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                k = self.spells.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best[0]):
                    best = (self.scores[k], i)
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _follows(self, x: int, y: int) -> bool:
        """Whether piece y may come behind piece x (weight 0) or not (weight infinity)."""
        key = x << 20 | y
        known = self.agree.get(key)
        if known is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            a, b = self.pieces[x], self.pieces[y]
            known = self.agree[key] = self._merged(a + b) == [a, b]
        return known

    def _fallback(self, ch: str) -> list[int]:
        return [self.bytes_[b] for b in ch.encode()] if self.bytes_ else [self.unknown]

    def shortest_path(self, text: str) -> list[int]:
        """Piece ids along the least-weight path of the composition with ``text`` (already normalised)."""
        return self._free_path(text) if self.bpe else self._least_path(text)

    def _free_path(self, text: str) -> list[int]:
        """BPE: arcs weigh 0 or infinity, so depth-first search, long arcs first, meets the one path of weight 0."""
        n, agree, longest, tree, shorter, sizes = len(text), self.agree, self.longest, self.tree, self.shorter, self.sizes
        out: list[int] = []
        dead: set[tuple[int, int]] = set()
        pos, last, new = 0, -1, True
        while pos < n:
            if new:  # the longest arc here; the shorter ones hang on it
                node = tree
                for ch in text[pos:pos + longest]:
                    further = node.get(ch)
                    if further is None:
                        break
                    node = further
                piece = node[""]
            while piece >= 0:
                if not dead or (pos + sizes[piece], piece) not in dead:
                    if last < 0:
                        break
                    ok = agree.get(last << 20 | piece)
                    if ok or ok is None and self._follows(last, piece):
                        break
                piece = shorter[piece]
            new = piece >= 0 or text[pos] not in self.chars
            if new:
                out.append(piece)
                pos += sizes[piece]
                last = piece
            else:  # no arc leads on from here: this state is dead, go back one arc
                last = out.pop()
                dead.add((pos, last))
                pos -= sizes[last]
                piece, last = shorter[last], out[-1] if out else -1
        if -1 not in out:
            return out
        at, found = 0, []
        for piece in out:
            found += [piece] if piece >= 0 else self._fallback(text[at])
            at += sizes[piece]
        return found

    def _least_path(self, text: str) -> list[int]:
        """Unigram: the path of the greatest score sum; a character without a piece falls back at a weight below any piece."""
        n, ids = len(text), self.ids
        cost = [0.0] + [float("inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        penalty = 10.0 - min(self.scores)
        for start in range(n):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = ids.get(text[start:end])
                if piece is not None and cost[start] - self.scores[piece] < cost[end]:
                    cost[end], back[end] = cost[start] - self.scores[piece], (start, piece)
            if text[start] not in self.chars and cost[start] + penalty < cost[start + 1]:
                cost[start + 1], back[start + 1] = cost[start] + penalty, (start, -1)
        out: list[list[int]] = []
        at = n
        while at:
            start, piece = back[at]
            out.append([piece] if piece >= 0 else self._fallback(text[start:at]))
            at = start
        return [i for part in reversed(out) for i in part]

    def _segment(self, s: str) -> bytes:
        got = self.older.get(s)
        if got is None:
            got = array("i", self.shortest_path(s.replace(" ", SPACE))).tobytes()
        if len(s) <= LONG:
            if len(self.memo) >= MEMO:
                self.older = dict(self.memo)
                self.memo.clear()
            self.memo[s] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        t = text.replace(SPACE, " ")  # the same input; segments of ASCII text are remembered at a byte a character
        known, miss = self.memo.get, self._segment
        return np.frombuffer(b"".join([known(s) or miss(s) for s in self.segments(" " + t if self.prefix else t)]), np.int32)


def _compiled(sent, key: str, kind: type[Speller] = Transducer) -> Speller:
    """The worker's transducer, or only a speller where it decodes; workers serve many tasks, so it and its memo are kept between
    them, but never both: a task that encodes and decodes holds two workers, of which one needs no memo."""
    kept = sys.__dict__.setdefault("_llm_transducers", {})
    if (key, kind.__name__) not in kept:
        kept.clear()
        kept[key, kind.__name__] = kind(sent.value)
    return kept[key, kind.__name__]


def encode(docs: DataFrame, model_path: str = MODEL, column: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the piece ids of ``column`` as array<int> ``into`` (replaced if present); all other columns as they are."""
    docs = docs.drop(into)
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(sent, model_path)
        for batch in batches:
            for a, b in slices(batch.column(column)):
                part = batch.slice(a, b - a)
                found = [None if t is None else fst.encode(t) for t in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], [*part.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_path: str = MODEL, column: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the ids in ``column`` as string ``into`` (replaced if present)."""
    encoded = encoded.drop(into)
    bound_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = _compiled(sent, model_path, Speller)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, speller.decode_all(part.column(column))], [*part.schema.names, into])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, with a digest of the text decoded from them and whether it equals the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs))
    return both.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids",
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))
