"""Chat formatting as a prefix tree.

Template of a turn: ``<turn ROLE>TEXT</turn>`` and a line feed; in ROLE and TEXT
a backslash becomes two and ``<`` (in ROLE also ``>``) gets one in front, so no
text can spell a mark and every text reads back exactly.

Conversations with equal initial turns share them as nodes of a tree, which is
emitted depth-first, each shared node once: a row per node with the range
``start``-``stop`` its characters take in the packed tree, the ``position`` of its
first character (position ids run on from the parent's), ``sees``, the packed
ranges of its ancestors that its characters attend to besides their own
predecessors, and the loss range (an assistant's text). A row with a
``conv_id`` follows the node at which that conversation ends. Units are code
points, so that any tokenizer can be run over the nodes' texts.

Turns come together in one shuffle by conversation and go, deflated, to ranges of
their paths (hashes from the first turn on) in a second. Ranges of a sorted
path are depth-first order already: a task emits its stretch with a stack as deep
as one conversation. A range border may fall inside a tree, or among equal
conversations, so a hot first turn or conversation is split; each
stretch is a pack of its own and repeats the ancestors it needs once.
Paths are hashes, but nodes merge only when role and text are equal.

Null text or role: empty. Turns are ordered by turn, null first, then role and
text; repeated rows are turns of their own. Rows with a null conv_id are one
conversation without id. Memory: one conversation at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEARNT = "assistant"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<]|\\.)*)</turn>\n", re.S)
FLUSH = 2_000  # turns a task gathers before it deflates them
PACKED = ("pack string, node bigint, conv_id bigint, ends boolean, start bigint, stop bigint, position bigint, "
          "sees array<struct<start: bigint, stop: bigint>>, role string, text string, loss_start bigint, loss_stop bigint")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and stops."""
    lead = f"<turn {escape(role).replace('>', chr(92) + '>')}>"
    body = escape(text)
    return f"{lead}{body}</turn>\n", len(lead), len(lead) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; anything else in it is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _deflate(turns: list) -> bytes:
    return zlib.compress(json.dumps(turns, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 6)


def _inflate(blob: bytes) -> list:
    return json.loads(zlib.decompress(blob).decode("utf-8", "surrogatepass"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns to (conv_id, blob), the turns of a conversation that lie near one another in one blob."""
    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([_deflate(t) for t in held.values()], pa.binary())],
                                          ["conv_id", "blob"])

    held: dict = {}
    n = 0
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if n >= FLUSH and conv not in held:
                yield out(held)
                held, n = {}, 0
            held.setdefault(conv, []).append((turn, role or "", text or ""))
            n += 1
    if held:
        yield out(held)


def _ordered(turns: list) -> list[tuple[str, str]]:
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    return [(r, t) for _, r, t in turns]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by conv_id to one row per conversation: path of node hashes, conv_id, blob of its ordered turns."""
    def out(done: list) -> pa.RecordBatch:
        rows = []
        for conv, turns in done:
            turns = _ordered(turns)
            path, h = [], b""
            for role, text in turns:
                h = hashlib.blake2b(b"\0".join((h, role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass"))), digest_size=8).digest()
                path.append(h)
            rows.append((b"".join(path), conv, _deflate(turns)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.binary())], ["path", "conv_id", "blob"])

    done: list = []
    conv, turns = None, None
    for batch in batches:
        for c, blob in zip(batch.column("conv_id").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if turns is None or c != conv:
                if turns is not None:
                    done.append((conv, turns))
                conv, turns = c, []
                if len(done) >= 500:
                    yield out(done)
                    done = []
            turns.extend(tuple(t) for t in _inflate(blob))
    if turns is not None:
        done.append((conv, turns))
    if done:
        yield out(done)


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations sorted by path to the rows of their trees, depth-first."""
    stack: list[dict] = []
    pack, node, at, serial = "", 0, 0, 0
    for batch in batches:
        rows: list[dict] = []
        for path, conv, blob in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "blob")), strict=True):
            turns = [tuple(t) for t in _inflate(blob)]
            depth = 0
            while depth < len(stack) and depth < len(turns) and stack[depth]["turn"] == turns[depth]:
                depth += 1
            del stack[depth:]
            if not depth:  # another tree begins
                pack, node, at, serial = f"{path[:8].hex()}-{conv}-{serial}", 0, 0, serial + 1
            for turn in turns[depth:]:
                text, a, b = format_turn(*turn)
                parent = stack[-1] if stack else None
                sees = [dict(r) for r in parent["sees"]] if parent else []
                if parent:
                    if sees and sees[-1]["stop"] == parent["start"]:
                        sees[-1]["stop"] = parent["stop"]
                    else:
                        sees.append({"start": parent["start"], "stop": parent["stop"]})
                position = parent["position"] + parent["stop"] - parent["start"] if parent else 0
                learnt = turn[0] == LEARNT
                top = {"turn": turn, "start": at, "stop": at + len(text), "position": position, "sees": sees}
                stack.append(top)
                rows.append({"pack": pack, "node": node, "conv_id": None, "ends": False, "start": at, "stop": at + len(text), "position": position,
                             "sees": sees, "role": turn[0], "text": text, "loss_start": at + a if learnt else None,
                             "loss_stop": at + b if learnt else None})
                node, at = node + 1, at + len(text)
            rows.append({"pack": pack, "node": node - 1, "conv_id": conv, "ends": True})
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([("pack", pa.string()), ("node", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.bool_()), ("start", pa.int64()),
                     ("stop", pa.int64()), ("position", pa.int64()),
                     ("sees", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("role", pa.string()), ("text", pa.string()),
                     ("loss_start", pa.int64()), ("loss_stop", pa.int64())])


def pack_conversations(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to the depth-first rows of their prefix trees; other columns are ignored."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    blobs = rows.mapInArrow(_gathered, "conv_id bigint, blob binary").repartition("conv_id").sortWithinPartitions("conv_id")
    whole = blobs.mapInArrow(_paths, "path binary, conv_id bigint, blob binary")
    ordered = whole.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_emitted, PACKED)


def read_back(packed: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, stop>>) of every conversation, from rows in the order in which they were emitted.

    ``loss`` counts from the conversation's start. Rows read from storage need
    ``repartition("pack").sortWithinPartitions("pack", "node", "ends")`` first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, int, str, tuple[int, int] | None]] = []
        for batch in batches:
            convs, texts, losses = [], [], []
            for r in batch.select(["conv_id", "ends", "start", "stop", "position", "text", "loss_start", "loss_stop"]).to_pylist():
                if r["ends"]:
                    convs.append(r["conv_id"])
                    texts.append("".join(s[2] for s in stack))
                    losses.append([{"start": s[3][0], "stop": s[3][1]} for s in stack if s[3]])
                    continue
                while stack and stack[-1][0] >= r["position"]:
                    stack.pop()
                shift = r["position"] - r["start"]
                loss = (r["loss_start"] + shift, r["loss_stop"] + shift) if r["loss_start"] is not None else None
                stack.append((r["position"], r["stop"] + shift, r["text"], loss))
            if convs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(convs, pa.int64()), pa.array(texts, pa.string()),
                     pa.array(losses, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["conv_id", "formatted", "loss"])

    return packed.mapInArrow(run, "conv_id bigint, formatted string, loss array<struct<start: bigint, stop: bigint>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text = r["formatted"]
            turns = parse(text)
            learnt = [unescape(text[x["start"]:x["stop"]]) for x in r["loss"]]
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in ("".join(f"{a}\n{b}\n" for a, b in turns), "".join(learnt))]
            rows.append((r["conv_id"], len(turns), sha[0], sum(map(len, learnt)), sha[1], len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)


# The conversation that the registered query adds.
PROBE = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation (and of conversation -7), read back from the packed trees."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(pack_conversations(turns.unionByName(probe))).mapInArrow(
        _digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
