"""Training-text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import html
import os
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from liftlens.llm import chat, chunks, decontaminate, html_tree, jaccard, sentencepiece_fst, syncmers, text, toxicity, urls, warc
from liftlens.llm.storage import new_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, rejected string, token_ids string, bits string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOCS)


EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "word " * 20000), (None, "no id at all in this row"), (5, "one"), (6, "é 日本 😀 \\ <a>")]


def _brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    head = {i: i for i in sets}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                head[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rnd = random.Random(5)
    texts = [(1000, None), (1001, ""), (1002, "A b"), (1003, "a B")]
    for base in range(4):
        words = [rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(60)]
        for copy in range(12):
            w = list(words)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"new{rnd.random()}"
            texts.append((base * 100 + copy, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(_docs(spark, texts)).collect()}
    assert got == _brute_components(texts)


def test_unrelated_sets_of_any_size_leave_no_candidates():
    rnd = np.random.default_rng(3)
    sizes = np.sort(np.concatenate([rnd.integers(60, 9000, 200), [6000, 6000]]))
    sets = [np.unique(rnd.integers(0, 1 << 63, k).astype(np.uint64)) for k in sizes]
    at = np.flatnonzero(sizes == 6000)
    sets[at[-1]] = np.concatenate([sets[at[0]][:-200], sets[at[-1]][:200]])
    tree = jaccard.SignatureTree(sizes, [jaccard.bitmap(s).tobytes() for s in sets], np.arange(len(sets)))
    assert [s for span in tree.spans for s in range(*span)] == list(range(len(sets)))
    assert [(r, ys.tolist()) for r, ys in jaccard.traverse(tree, tree, True, 80)] == [(at[0], [at[-1]])]


def test_one_row_of_each_group_stays(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    near = f"{y} more"
    rows = [(3, y), (3, y), (3, near), (5, x), (5, y), (9, x), (None, x), (None, z), (None, z), (7, ""), (7, ""), (8, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.first_of_each(_docs(spark, rows)).collect()), key=str)
    one = next(t for i, t in got if i == 3)
    assert one in (y, near)
    assert got == sorted([(3, one), (5, x), (None, z), (7, ""), (7, ""), (8, None)], key=str)
    assert jaccard.first_of_each(_docs(spark, rows)).columns == _docs(spark, rows).columns


def test_tables_of_the_whole_corpus_are_added_up_by_the_executors(spark, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("every task's whole table on the driver")

    monkeypatch.setattr("pyspark.rdd.RDD.treeAggregate", refused)
    collected = []
    monkeypatch.setattr(jaccard, "release", collected.append)
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = _docs(spark, [(-9, x), (1, f"{x} more"), (2, y), (3, None), (None, y), (8, f"{y} end"), (-(1 << 40), "alone")]).repartition(4)
    counts = np.zeros(jaccard.CELLS, np.int64)
    for r in docs.collect():
        w = jaccard.words(jaccard.pa.array([r["text"]]))
        np.add.at(counts, (np.unique(jaccard.shingles(w.hashes, 5)) % np.uint64(jaccard.CELLS)).astype(np.int64), 1)
    assert np.array_equal(jaccard._order_counts(docs, 5), counts)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(-9, -9), (1, -9), (2, 2), (3, 3), (None, 2), (8, 2), (-(1 << 40), -(1 << 40))}
    assert len(collected) >= 2  # finished steps leave the driver


@pytest.mark.parametrize("texts", [[], EDGE])
def test_every_document_operator_takes_edge_rows(spark, texts):
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(3, 1, 0), (4, None, 1)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "item_id bigint, text string")
    assert jaccard.jaccard_components(docs).count() == len(texts)
    assert chunks.dedup_substrings(docs).columns == docs.columns and chunks.dedup_substrings(docs).count() == len(texts)
    assert toxicity.not_toxic(docs, labels).columns == docs.columns and toxicity.not_toxic(docs, labels).count() == len(texts)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found == ({(3, 3), (5, 3)} if texts else set())
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()
    assert len(back) == len(texts) and all(r["decoded"] == r["text"] for r in back)
    assert syncmers.beside_next(docs).count() == len(texts)
    prints = {r["text"]: r["fingerprint"] for r in syncmers.fingerprints(docs).collect()}
    assert not texts or prints[""] == prints[None] == "" and prints["one"]


def test_encoding_equals_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.MODEL))
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "▁", "é", "日", "\n", "\0", "😀", "the", " of", "ing", "</s>", "<0x41>", "23", "    "]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        assert fst.encode(text).tolist() == sp.encode(text)
        assert fst.decode(fst.encode(text)) == text.replace("▁", " ")


def test_arcs_are_walked_not_probed_and_lists_spelled_at_once():
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.MODEL))
    texts = ["", " ", "some words, and more of them", "日本語 の 😀 text", "▁ mixed \n\t", "Ooverstate unthinkables hhhhaaaa"]
    want = [fst.encode(t) for t in texts]
    fst.memo.clear()
    fst.ids = None  # no slice of the text is looked up
    assert all(np.array_equal(fst.encode(t), ids) for t, ids in zip(texts, want))
    broken = [[fst.bytes_[0xC3]], [fst.bytes_[0xA9], 300], [fst.unknown], []]
    lists = sentencepiece_fst.pa.array([*want, None, *broken], sentencepiece_fst.pa.list_(sentencepiece_fst.pa.int32()))
    plain = [None if x is None else fst.decode(np.array(x, np.int32)) for x in lists.to_pylist()]
    assert fst.decode_all(lists).to_pylist() == plain and fst.decode_all(lists.slice(3, 5)).to_pylist() == plain[3:8]
    assert fst.decode_all(lists.slice(0, 0)).to_pylist() == []


def test_unigram_shortest_path():
    model = {"pieces": ["<unk>", "a", "b", "ab", "▁", "▁ab"], "scores": [0, -1.0, -1.0, -1.5, -0.1, -3.0], "kinds": [2, 1, 1, 1, 1, 1],
             "bpe": False, "prefix": True}
    fst = sentencepiece_fst.Transducer(model)
    assert [fst.pieces[i] for i in fst.encode("abc")] == ["▁", "ab", "<unk>"]


def test_shared_passages_stay_once(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = words(60)
    texts = [(i, f"{words(30 + i)} {passage} {words(25)}") for i in range(8)] + [(50, words(100))]
    got = {r["doc_id"]: r["text"] for r in chunks.dedup_substrings(_docs(spark, texts)).collect()}
    assert got[0] == texts[0][1] and got[50] == texts[-1][1]
    middle = passage[150:300]
    assert sum(middle in t for t in got.values()) == 1
    assert all(got[i].startswith(t.split(passage)[0]) and got[i].endswith(t.split(passage)[1]) for i, t in texts[:8])


def test_shared_passages_go_whole(spark):
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passages = [words(51) for _ in range(60)]
    texts = [(100 * c + i, f"{words(20 + c)} {p} {words(25)}") for i, p in enumerate(passages) for c in range(3)]
    got = {r["doc_id"]: r["text"] for r in chunks.dedup_substrings(_docs(spark, texts)).collect()}
    for i, t in texts:
        before, behind = t.split(passages[i % 100])
        assert got[i] == t if i < 100 else got[i].split() == (before + behind).split()


def test_passages_whose_chunks_stand_elsewhere_too_go_whole(spark):
    """Pieces of each passage, its ends among them, also stand in earlier foreign documents."""
    rnd = random.Random(16)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passages = [words(60) for _ in range(40)]
    foreign = []
    for p in passages:
        w = p.split()
        foreign += [" ".join(w[4:16]), " ".join(w[-16:-4])]
    texts = [(i, f"{words(20)} {f} {words(20)}") for i, f in enumerate(foreign)]
    texts += [(1000 * c + i, f"{words(20 + c)} {p} {words(25)}") for i, p in enumerate(passages) for c in (1, 2)]
    got = {r["doc_id"]: r["text"] for r in chunks.dedup_substrings(_docs(spark, texts)).collect()}
    cut = 0
    for i, t in texts:
        if i >= 2000:
            before, behind = t.split(passages[i % 1000])
            cut += got[i].split() == (before + behind).split()
    assert cut == 40


def test_cuts_depend_on_what_lies_before_only():
    rnd = random.Random(17)
    shared = "".join(rnd.choice("abcdefgh é日") for _ in range(3000)).encode()
    a, b = b"x" * 37 + shared, "other words é ".encode() * 11 + shared
    ends = [{int(e) - (len(raw) - len(shared)) for e in chunks._ends(raw)} for raw in (a, b)]
    far = chunks.MAX_CHUNK * 2
    assert {e for e in ends[0] if e > far} == {e for e in ends[1] if e > far}
    assert all(raw[:e].decode() is not None for raw in (a, b) for e in chunks._ends(raw).tolist())


def test_clashing_names_pass_through(spark):
    names = ["chunk_doc", "_chunk_doc", "chunk_text", "chunk_known", "chunk_ext", "chunk_asked", "_doc", "_best", "_toxicity_p_toxic", "_Host"]
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} double" for n in names)
    docs = spark.createDataFrame([(i, f"text {i}", *[7.0] * len(names)) for i in range(3)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    for out in (chunks.dedup_substrings(docs), toxicity.not_toxic(docs, labels), urls.judge(docs, url="text").drop("host", "path", "rule", "verdict")):
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_rows_without_id_and_with_equal_crc_are_told_apart(spark):
    rnd = random.Random(11)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage, seen, pair = words(60), {}, None
    for i in range(1 << 20):
        text = f"{i} alone" if i % 2 else f"{i} {passage} {i}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if len(other) != len(text) and abs(len(other) - len(text)) > 100:
            pair = sorted((other, text), key=len)
            break
    short, long = pair
    rows = [(1, f"first {passage} holder"), (None, short), (None, long)]
    got = [r["text"] for r in chunks.dedup_substrings(_docs(spark, rows)).collect()]
    assert rows[0][1] in got and short in got and long not in got and sum(passage[100:200] in t for t in got) == 1


def test_edited_copies_are_leaks(spark):
    rnd = random.Random(4)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
    edited = [x if i % 9 else "changed" for i, x in enumerate(w)]
    shorter = w[:15] + w[18:]
    docs = _docs(spark, [(1, "x y " + " ".join(w).upper()), (2, " ".join(edited)), (3, "a " * 50 + ", ".join(shorter)), (4, " ".join(w[:12])), (5, "else " * 90)])
    items = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["score"], r["first_word"], r["last_word"]) for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {1, 2, 3} and got[1] == (1.0, 2, 41) and got[3][1:] == (50, 86)
    assert {r["doc_id"] for r in decontaminate.clean_of(docs, items).collect()} == {4, 5}


AWAY = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, sys.argv[1])  # the driver alone
from liftlens.llm.decontaminate import clean_of, leaks
from liftlens.llm.sentencepiece_fst import decode, encode
docs = spark.createDataFrame([(1, "so one two three four five six it is"), (2, "nothing of that kind")], "doc_id bigint, text string")
items = spark.createDataFrame([(7, "one two three four five six")], "item_id bigint, text string")
assert [(r.doc_id, r.item_id, r.score) for r in leaks(docs, items).collect()] == [(1, 7, 1.0)]
assert [(r.doc_id, r.text) for r in decode(encode(clean_of(docs, items)), into="text").collect()] == [(2, "nothing of that kind")]
"""


def test_executors_need_no_copy_of_the_library(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", AWAY, root], cwd=tmp_path, env=env, check=True, timeout=300)


def test_every_alignment_of_half_the_score_is_found(spark):
    rnd = random.Random(9)
    common = [f"c{k}" for k in range(12)]
    texts, items = [], []
    for n in (4, 5, 16, 24, 39, 59):
        w = [rnd.choice(common) if rnd.random() < 0.4 else f"w{rnd.randrange(10**6)}" for _ in range(n)]
        items.append((n, w))
        copies = [[x if i % step != off else "changed" for i, x in enumerate(w)] for step in (3, 4, 5, 6) for off in (step - 1, step // 2)]
        copies += [[y for x in w for y in (x, "put")], [x for i, x in enumerate(w) if i % 4 != 2], w, w[:n // 2], w[n // 3:]]
        for _ in range(25):
            copies.append([y for x in w for y in ([x], [x], [x], ["changed"], [], [x, "put"])[rnd.randrange(6)]])
        texts += [[rnd.choice(common) for _ in range(20)] + c + [rnd.choice(common) for _ in range(20)] for c in copies]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(
        _docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]),
        spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id bigint, text string")).collect()}
    code = {x: np.uint64(i + 2) for i, x in enumerate({x for t in texts for x in t})}
    want = {}
    for i, t in enumerate(texts):
        for n, w in items:
            score = decontaminate.align([np.array([code[x] for x in w])], [np.array([code[x] for x in t])])[0][0] / (2 * n)
            if score >= 0.5:
                want[i, n] = score
    assert got == pytest.approx(want) and len(want) > 120


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    chain = toxicity.fit_chain(docs, train)
    rows = toxicity.score(docs, chain).join(held, "doc_id").select(F.array_contains("rejected", "toxic").alias("p"), "toxic").collect()
    assert sum(r["p"] == bool(r["toxic"]) for r in rows) >= 0.95 * len(rows)


def test_chat_reads_back_and_shares_nodes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</turn>\\<b"), (2, 0, "user", "hi"), (2, 1, "assistant", "c"), (3, 0, None, None),
            (None, 5, "system", "s"), (4, 0, "user", "hi"), (4, 1, "assistant", "c")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, pack int")
    packed = chat.pack_conversations(turns.coalesce(1))
    back = {r["conv_id"]: r for r in chat.read_back(packed).collect()}
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: chat.parse(r["formatted"]) for c, r in back.items()} == want
    learnt = [chat.unescape(back[1]["formatted"][x["start"]:x["stop"]]) for x in back[1]["loss"]]
    assert learnt == ["a</turn>\\<b"]
    for r in packed.where("NOT ends").collect():
        assert r["stop"] - r["start"] == len(r["text"]) and r["position"] == sum(s["stop"] - s["start"] for s in r["sees"])
    assert chat.pack_conversations(turns.limit(0)).count() == 0


def test_html_text_of_whole_pages(spark):
    rows = {r["page_id"]: r["text"] for r in entry.queries()["op3_html_text"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.sub(r"</?(?:p|h1|br)>", "\n\n", re.search(r"<article>(.*)</article>", p["html"], re.S)[1])
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in article.split("\n\n"))
        assert rows[p["page_id"]] == " ".join(b for b in blocks if b)


def test_html_edge_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "", "t"), (3, None, "<article><p>a<b>b</b> &eacute;\n c<div class='sidebar'>x</div>"
                                   "<script>'</p>'</script><!-- <p>no --></article><form><p>long enough to look like text, but a form</form>", "t")],
                                  "page_id bigint, url string, html string, text string")
    model = html_tree.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    got = {r["page_id"]: r["text"] for r in html_tree.main_text(pages, model).collect()}
    assert got == {1: "", 2: "", 3: "ab é c"}


def test_syncmer_results_equal_brute_force(spark):
    texts = [(5, "b" * 40), (1, "the quick brown fox jumps over the lazy dog " * 3), (9, None), (7, "xyz"), (8, "xyz")]
    got = {r["doc_id"]: r for r in syncmers.beside_next(_docs(spark, texts)).collect()}
    order = sorted((i, t or "") for i, t in texts)
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[:len(t) - half] + order[(k + 1) % len(order)][1][:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for text, name in ((t, "fingerprint"), (edited, "edited_fingerprint")):
            h = syncmers.anchors(syncmers.code_points(text))[1]
            assert got[i][name] == syncmers.as_text(np.unique((h >> np.uint64(32)).astype(np.uint32))[:syncmers.SKETCH])
    assert got[7]["near_next"] == 1.0 and got[7]["fingerprint"] == got[8]["fingerprint"]


def test_urls_edge_rows_and_many_rules(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Sub.Example.COM/en/x?q=/es/"), (4, "http://xexample.com/en/"), (5, "http://example.com")]
    df = spark.createDataFrame([(*r, "v") for r in rows], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("sub.example.com", "/en/x", "example.com/en/", "block"),
                   4: ("xexample.com", "/en/", "com/", "allow"), 5: ("example.com", "", None, "allow")}


def test_unclosed_elements_dont_cut_pages_and_tags_are_read_in_linear_time():
    def words(page):
        return " ".join(" ".join(t for _, t in html_tree.parse(page)[1] if t).split())

    for tag in ("svg", "object", "video", "select", "iframe"):
        assert words(f"<p>one</p><{tag}><p>two</p>") == "one two"
        assert words(f"<p>one</p><{tag}>gone</{tag}><p>two</p>") == "one two"
    assert words("<p>let <math>x</math> be</p>") == "let x be"
    assert words("<p>one</p><script>gone <p>gone</p>") == "one"
    assert words("<p>one</p><!-- gone > gone") == "one" and words("<p>one</p><!-- gone --> two") == "one two"
    assert words("a < b and c <d") == "a < b and c"
    start = time.monotonic()
    html_tree.parse("<a " * 100_000), html_tree.parse("<svg>" * 30_000), html_tree.parse("<p>x</p>" + "<!-- <a " * 50_000)
    assert time.monotonic() - start < 10


def test_long_segments_are_not_remembered():
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.MODEL))
    long = "日本語" * 3000
    assert fst.decode(fst.encode(long)) == long and fst.decode(fst.encode("some words here")) == "some words here"
    assert fst.memo and max(map(len, fst.memo)) <= sentencepiece_fst.LONG


def test_word_hashes_need_no_table_as_long_as_the_text():
    rnd = random.Random(8)
    parts = ["".join(rnd.choice("abcé ") for _ in range(n)) for n in (0, 1, text.POWERS - 1, text.POWERS, text.POWERS + 1, 1 << 19)]
    column = text.pa.array([*parts, None])
    base = text._BASE
    tracemalloc.start()
    w = text.words(column)
    peak = tracemalloc.get_traced_memory()[1] / len(w.data)
    kept = tracemalloc.get_traced_memory()[0] - sum(x.nbytes for x in (w.starts, w.ends, w.hashes, w.ptr, w.total))
    tracemalloc.stop()
    assert peak < 45 and kept < 1 << 20
    data = "".join(parts).encode()
    value, power, sums = text._byte_values(True), 1, [0]
    for byte in data:
        sums.append((sums[-1] + int(value[byte]) * power) % 2**64)
        power = power * base % 2**64
    assert w.total.tolist() == sums
    down = text.inverse_powers(w.starts, len(data))
    assert all(int(d) * pow(base, int(a), 2**64) % 2**64 == 1 for d, a in zip(down[::97], w.starts[::97], strict=True))


def test_batches_and_workers_of_the_encoder_are_small(spark):
    import corpus_pipeline

    docs = _docs(spark, [(i, f"{i} " + "words and more " * 4000) for i in range(200)]).coalesce(1)

    def largest(df):
        sizes = df.mapInArrow(lambda batches: (text.pa.RecordBatch.from_arrays([text.pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint")
        return max(r["n"] for r in sizes.collect())

    spark.conf.unset(text.BATCH_CONF)
    assert largest(docs) > 2 * text.BATCH_BYTES
    sentencepiece_fst.encode(docs)
    assert largest(docs) < 1.1 * text.BATCH_BYTES
    spark.conf.set(text.BATCH_CONF, "1m")
    toxicity.score(docs, toxicity.Chain(("toxic",), np.zeros(0, np.uint64), [np.zeros(1)], [0.5]))
    assert spark.conf.get(text.BATCH_CONF) == "1m"
    spark.conf.unset(text.BATCH_CONF)

    model = sentencepiece_fst.read_model(sentencepiece_fst.MODEL)
    fst, speller = sentencepiece_fst.Transducer(model), sentencepiece_fst.Speller(model)
    ids = fst.encode("some words, 日本語 ▁ and 😀")
    assert speller.decode(ids) == fst.decode(ids) == "some words, 日本語   and 😀" and not hasattr(speller, "memo")
    assert all(s.isascii() for s in fst.memo if s.strip(" ").isascii())
    out = corpus_pipeline.encoding(spark, docs, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}


def test_warc_round_trip(spark):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/ b", big, 0), (2, "http://b", big, 0), (3, None, None, 0), (4, "http://c", "x", 0), (5, "http://d", "x", 0)],
                                  "page_id bigint, url string, html string, key int")
    folder = warc.write_archive(pages, new_path(spark, "test-warc"))
    got = {r["id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_back(spark, folder).collect()}
    assert got == {1: (1200, "revisit", 2), 2: (1200, "response", None), 3: (0, "response", None), 4: (1, "response", None), 5: (1, "response", None)}
    for r in warc.records(spark, folder).collect():
        record, payload = bytes(r["record"]), bytes(r["payload"])
        length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", record)[1])
        head = record.index(b"\r\n\r\n") + 4
        assert len(record) == head + length + 4
        assert payload.decode() == ({1: big, 2: big, 3: "", 4: "x", 5: "x"}[r["id"]])
        assert (r["record_type"] == "revisit") == (not record[head:-4].endswith(payload))
        assert warc.parse_record(record, payload) == (r["id"], r["record_type"], r["refers_to"], hashlib.sha1(payload).hexdigest())
        for wrong in (record.replace(b"Content-Length: ", b"Content-Length: 1", 1), record[:-5] + b"\r\n\r\n", record.replace(b"sha1:", b"sha1:A", 1)[:-1]):
            with pytest.raises(ValueError):
                warc.parse_record(wrong, payload)
    assert all(warc._page_id(warc._record_id(i)) == i for i in (None, 0, 1, -1, 15, 16, 2**63 - 1, -2**63, 987654321987654321))
    empty = warc.write_archive(pages.limit(0), new_path(spark, "test-warc"))
    assert warc.read_back(spark, empty).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "sentencepiece"]
    assert out.columns == [*docs.columns, "token_ids"]
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    brute = _brute_components([(r["doc_id"], r["text"]) for r in kept.collect()])
    firsts = {i for i, (_, c) in brute.items() if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, kept, SF).collect()} == firsts
    assert {r["doc_id"] for r in out.collect()} <= firsts
