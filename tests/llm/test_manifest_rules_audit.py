"""Merkle manifest, line-frequency rules and filter audit against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liftlens.llm import filter_audit, line_frequency, merkle, skew, storage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, path string, root string, host string, mask string"


def _docs(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source, n_chars), with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "k", "p", "r", "h", "m") for r in rows], DOCS).repartition(parts)


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h("".join(below[i:i + 16])) for i in range(0, len(below), 16)])
    return levels


def _path(levels, i):
    out = []
    for nodes in levels[:-1]:
        at = i // 16 * 16
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + 16])))
        i //= 16
    return out


def _brute_manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = _leaf((doc_id, source, lang, n, text))
        small = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        groups[source].append((doc_id is not None, doc_id or 0, leaf, doc_id, _leaf((doc_id, source, lang, n, small)) if bad else leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = _tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, doc_id, other) in enumerate(sorted(groups[s])):
            path, h = _path(trees[s], i) + _path(top, k), other
            for before, after in path:
                h = _h(before + h + after)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], _h("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


def _manifest_rows(docs, **kw):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = merkle.manifest(docs, tampered={"text": lower}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **kw)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sizes", [[700, 1, 17, 16, 300, 33, 5], [40] * 40, [1], [257]])
def test_manifest_equals_brute_force_over_many_blocks(spark, sizes):
    rows = [(1000 * s + i if i % 7 else 1000 * s, f"Text {i}" if i % 3 else None, "en", f"s{s}" if s else None, i)
            for s, n in enumerate(sizes) for i in range(n)]
    assert _manifest_rows(_docs(spark, rows), depth=1, rows_per_bucket=100) == Counter(_brute_manifest(rows))


def test_manifest_edge_rows(spark):
    rows = [(1, None, None, None, None), (None, "A", "en", "", 1), (2, "", "", "", 0), (2, "", "", "", 0), (3, "Ä" * 300_000 + "Z", "é", "ü", 7),
            (10, "B", "en", "é", 1), (5, "AbC", None, "z", None), (5, "AbD", None, "z", None), (-4, "same", "x", "Z", 4)]
    assert _manifest_rows(_docs(spark, rows)) == Counter(_brute_manifest(rows))
    assert _manifest_rows(_docs(spark, rows, 1).limit(0)) == Counter()


def test_manifest_finds_what_was_changed(spark):
    rows = [(i, f"Doc {i}", "en", f"s{i % 3}", 5) for i in range(200)]
    df = merkle.manifest(_docs(spark, rows), tampered={"lang": F.lit("de")}, where=F.col("doc_id") % 10 == 3, depth=1)
    assert {r["doc_id"] for r in df.where("NOT verified").collect()} == {i for i in range(200) if i % 10 == 3}
    assert merkle.manifest(_docs(spark, rows), depth=1).where("NOT verified").count() == 0


def _normal(line):
    return " ".join(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))


def _brute_rules(rows, least, share):
    texts = defaultdict(set)
    for _, text, _, source, _ in rows:
        texts[source].add(text or "")
    held = defaultdict(set)
    for s, found in texts.items():
        for t in found:
            for line in t.split("\n"):
                if WORD.search(line):
                    held[s, _normal(line)].add(t)
    often = {k for k, v in held.items() if len(v) > least and len(v) * share > len(texts[k[0]])}
    out = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        runs = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        lost = sum(len(WORD.findall(x)) for x in lines if (source, _normal(x)) in often)
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
                    failed, not failed and 2 * lost <= len(w), None if failed else lost))
    return out, often


def _site(rnd):
    def line(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    menu = [line(9), "Home | About\t$ & <b>", line(30)]
    rows = []
    for i in range(120):
        own = [line(rnd.randrange(3, 25)) for _ in range(rnd.randrange(1, 8))]
        extra = [rnd.choice((m, m.upper(), "  " + m.replace(" ", "  "))) for m in menu if rnd.random() < 0.7]
        rows.append((i, "\n".join(rnd.sample(own + extra, len(own) + len(extra)) + own[:rnd.randrange(2)]), "en", rnd.choice(("a", "a", "b", None)), 0))
    rows += [(200 + i, rows[3][1], "en", rows[3][3], 0) for i in range(30)]
    return rows + [(300, None, None, None, None), (301, "", "", "", 0), (None, "é 日本 " * 60, None, "a", 1), (302, "\n \n\t\n", "x", "a", 2),
                   (303, "long word " * 30_000, "en", "b", 3), (303, "long word " * 30_000, "en", "b", 3)]


@pytest.mark.parametrize("least,share", [(10, 1000), (3, 4)])
def test_rules_equal_brute_force(spark, least, share, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 20)  # some keys broadcast, some not
    rows = _site(random.Random(3))
    want, often = _brute_rules(rows, least, share)
    assert often and any(not r[6] and not r[7] for r in want)
    docs = _docs(spark, rows)
    got = line_frequency.judge(docs, least=least, share=share)
    assert got.columns == ["doc_id", *line_frequency.MEASURES, "base_failed", "kept", "n_removed_words"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)

    kept = Counter()
    for row, verdict in zip(rows, want, strict=True):
        if verdict[7]:
            lines = (row[1] or "").split("\n")
            kept[row[0], "\n".join(x for x in lines if (row[3], _normal(x)) not in often)] += 1
    clean = line_frequency.clean(docs, least=least, share=share)
    assert clean.columns == docs.columns
    assert Counter((r["doc_id"], r["text"].rstrip("\n")) for r in clean.collect()) == Counter({(i, t.rstrip("\n")): n for (i, t), n in kept.items()})


def test_rules_of_an_empty_table(spark):
    docs = _docs(spark, [(1, "x", "en", "a", 1)]).limit(0)
    assert line_frequency.judge(docs).count() == 0 and line_frequency.clean(docs).count() == 0


def test_lines_of_many_texts_in_one_slice():
    texts = ["a b\nA b\n\nc d e a b", "", "\n", "x\n", "\nx y\r\nx  y", "a b\n"]
    found = line_frequency.Lines(pa.array(texts))
    assert found.repeated().tolist() == [0] * 6 and found.repeated_words().tolist() == [0] * 6
    offsets, hashes, n = found.distinct()
    assert np.diff(offsets).tolist() == [2, 0, 0, 1, 1, 1] and sorted(n[:2].tolist()) == [4, 5]
    assert len(set(hashes.tolist())) == 4


def _brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    failing = defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {c for c, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                              bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > least[t]), strict=True) if f}
        failing[source or ""].append((doc_id, fails))
    out = set()
    for part, docs in failing.items():
        made, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                gone = [i for i, f in docs if letter in f and not f & before]
                shapley[letter] += len(gone)
                made.append(("".join(order), k + 1, sum(not f & (before | {letter}) for _, f in docs), len(gone),
                             sum(letter in f and bool(f & before) for _, f in docs), sum(f == {letter} for _, f in docs),
                             sum(i in good for i in gone), sum(i in bad for i in gone)))
        out |= {(part, *m, shapley[m[0][m[1] - 1]]) for m in made}
    return out


def test_audit_equals_brute_force(spark):
    rnd = random.Random(8)
    bodies = [" ".join(f"{rnd.choice('abcXY')}{rnd.randrange(rnd.choice((5, 500)))}" for _ in range(rnd.randrange(30, 90))) + rnd.choice(("", " #", " %|"))
              for _ in range(40)]
    rows = [(rnd.randrange(60) if rnd.random() < 0.9 else None, rnd.choice((*bodies, None, "", "ABC")), "en", rnd.choice(("a", "b", "", None)), 0)
            for _ in range(200)]
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*x, "c") for x in labels], "doc_id bigint, quality int, toxic int, mask string")
    got = filter_audit.audit(filter_audit.document_cells(_docs(spark, rows), table))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 3 * 600 and set(found) == _brute_audit(rows, labels)
    empty = filter_audit.document_cells(_docs(spark, rows).limit(0), table.limit(0))
    assert filter_audit.audit(empty).count() == 0


def test_audit_stages_nothing_that_grows(spark, tmpdir_path):
    """Each staged file makes an executor start processes; only the walk, of a fixed size, is staged."""
    rnd = random.Random(9)
    rows = [(i % 250 if i % 9 else None, rnd.choice(("same text", None, f"Own {i} " * 60, f"word{i} #")), "en", rnd.choice(("a", "b", None)), 0)
            for i in range(300)]
    labels = [(i, i % 2, i % 3) for i in range(0, 250, 5)]
    _docs(spark, rows).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    folder = Path(storage.shared_folder(spark).removeprefix("file:")) / storage.FOLDER
    old = set(folder.glob("*"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = filter_audit.op13_filter_audit(spark, tmpdir_path)
        got.write.parquet(f"{tmpdir_path}/out")
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert {x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - old} == {"audit-walk"}
    assert len(list(Path(tmpdir_path, "out").glob("part-*.parquet"))) <= 4  # three parts, and an empty first file
    found = [tuple(r) for r in spark.read.parquet(f"{tmpdir_path}/out").collect()]
    assert len(found) == 3 * 600 and set(found) == _brute_audit(rows, labels)
