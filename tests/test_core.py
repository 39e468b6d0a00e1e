"""Functions, pairs, training, tokenizers, files: against brute force and known results."""

from __future__ import annotations

import itertools
import json
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import arrays as A
from tokenloom.functions.bytes_table import byte_order, byte_table, byte_to_char, parse, render
from tokenloom.functions.cells import cells_to_text, merge_cells, pairs, symbols, to_cells
from tokenloom.functions.patterns import check_specials, python_pattern
from tokenloom.operators import neural as N
from tokenloom.operators import pairs as P
from tokenloom.operators import train
from tokenloom.operators.indexed import IndexedWords
from tokenloom.operators.pretokenize import (
    chunks_of,
    lines_of,
    pretokenize,
    segment,
    word_histogram,
)
from tokenloom.operators.tokenizer import Tokenizer, make_tokenizer, register
from tokenloom.operators.progress import Progress, mib
from tokenloom.operators.train import LocalTrainer, driver_bytes, load_merges, train_bpe, train_merges
from tokenloom.sources import shared, storage

TEXTS = [
    "low lower lowest newest widest<|endoftext|>low",
    "  two  spaces \n\n and\ttabs  ",
    "Héllò hôw are ü? 🙃 日本語 don't we'll",
    "",
    None,
    "1234567 ++-- '' 's",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def word_frame(spark, words: dict[str, int]):
    rows = spark.createDataFrame(list(words.items()), "w string, n bigint")
    return rows.withColumn("cells", to_cells(F.col("w")))


def brute_merges(words: dict[str, int], merges: int) -> list[tuple[str, str, int]]:
    split = {w: [bytes([b]) for b in w.encode()] for w in words}
    out = []
    for _ in range(merges):
        count: dict[tuple[bytes, bytes], int] = {}
        for w, parts in split.items():
            for p in zip(parts, parts[1:]):
                count[p] = count.get(p, 0) + words[w]
        if not count:
            break
        best = max(count, key=lambda p: (count[p], p))
        out.append((best[0].hex().upper(), best[1].hex().upper(), count[best]))
        for parts in split.values():
            k = 0
            while k + 1 < len(parts):
                if (parts[k], parts[k + 1]) == best:
                    parts[k : k + 2] = [best[0] + best[1]]
                k += 1
    return out


def test_byte_table(spark) -> None:
    rows = {r.byte: (r.pos, r.shown) for r in byte_table(spark).collect()}
    order, shown = byte_order(), byte_to_char()
    assert rows == {b: (order.index(b), shown[b]) for b in range(256)}
    assert order.index(32) == 220 and shown[32] == "Ġ"
    assert parse(render(bytes(range(256)))) == bytes(range(256))


def test_cells_and_merges(spark) -> None:
    words = {"aaaa": 1, "babab": 2, "hell": 3, "a": 4, "é": 1}
    df = word_frame(spark, words)
    one = {r.w: r for r in df.select("w", symbols(F.col("cells")).alias("s"), pairs(F.col("cells")).alias("p"), cells_to_text(F.col("cells")).alias("t"), merge_cells(F.col("cells"), "61", "61").alias("m")).collect()}
    assert one["é"].s == ["C3", "A9"] and one["a"].p == []
    assert one["aaaa"].m == "<6161><6161>" and len(one["aaaa"].p) == 3
    assert all(r.t == w for w, r in one.items())


@pytest.mark.parametrize("pair", [("61", "62"), ("6C", "6C"), ("61", "61"), ("62", "61")])
def test_deltas_are_exact(spark, pair) -> None:
    df = word_frame(spark, {"babab": 2, "hell": 3, "aaaa": 5, "aabaab": 1})
    changed = P.apply_delta(P.pair_counts(df), P.merge_delta(df, *pair))
    assert {tuple(r) for r in changed.collect()} == {tuple(r) for r in P.pair_counts(P.merge(df, *pair)).collect()}


def test_pair_index_and_changes(spark) -> None:
    df = word_frame(spark, {"ab": 1, "cab": 1, "x": 9})
    found = {(r.l, r.r): r.words for r in P.pair_index(df).collect()}
    assert found == {("61", "62"): ["ab", "cab"], ("63", "61"): ["cab"]}
    postings = {tuple(r) for r in P.pair_postings(df).collect()}
    assert postings == {(*pair, w) for pair, ws in found.items() for w in ws}
    (row,) = P.changed_pairs(df.filter("w = 'cab'"), "61", "62").collect()
    assert {tuple(p) for p in row.gone} == {("63", "61"), ("61", "62")}
    assert [tuple(p) for p in row.come] == [("63", "6162")]


def test_top_pairs_break_ties_by_bytes(spark) -> None:
    df = word_frame(spark, {"ab": 2, "zz": 2, "a": 50})
    assert [tuple(r) for r in P.top_pairs(P.pair_counts(df), 2).collect()] == [("7A", "7A", 2), ("61", "62", 2)]
    assert P.pair_counts(df, 3).collect() == []


def test_all_modes_train_alike(spark) -> None:
    rng = random.Random(1)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(60)}
    df, want = word_frame(spark, words), brute_merges(words, 13)
    for mode in ("local", "distributed"):
        seen = []
        got = train_merges(df, 13, mode, on_merge=seen.append)
        assert [m[1:] for m in got] == want and len(seen) == 13
    assert [m[1:] for m in train_merges(df, 13, resume=train_merges(df, 5))] == want
    assert train_merges(df, 13, min_freq=10**6) == []
    with pytest.raises(ValueError):
        train_merges(df, 1, "other")


def test_segments_and_words(spark, docs) -> None:
    specials = ["<|endoftext|>", "<|endoftext|><|endoftext|>"]
    got = {}
    for r in pretokenize(docs, "text", specials).collect():
        got.setdefault(r.doc_id, []).append((r.sp, r.wp, r.w))
    find = regex.compile(python_pattern()).findall
    for k, t in enumerate(TEXTS):
        want = [p for part in (t or "").split("<|endoftext|>") for p in [*find(part), "<|endoftext|>"]][:-1]
        assert [w for _, _, w in sorted(got.get(k, []))] == want
    two = spark.createDataFrame([("a<|endoftext|><|endoftext|>b\n",)], "text string")
    assert [(r.seg, r.is_special) for r in segment(two, "text", specials).orderBy("sp").collect()] == [("a", False), (specials[1], True), ("b\n", False)]
    with pytest.raises(ValueError):
        check_specials([""])


def test_cs336_words(spark, docs) -> None:
    find = regex.compile(python_pattern("cs336")).findall
    rows = pretokenize(docs, "text", None, "cs336").orderBy("doc_id", "wp").collect()
    assert [r.w for r in rows] == [w for t in TEXTS for w in find(t or "")]


def long_text(words: int, seed: int) -> str:
    """A text of words that are frequent by rank, made of syllables."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"] + ["é", "ing", "the"]
    known = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(known[int(400 * rng.random() ** 3)] for _ in range(words)) + "."


def test_training_to_500_tokens(spark) -> None:
    """As many merges as a vocabulary of 500 has, against brute force, with a special token."""
    text = long_text(4000, 1) + "<|endoftext|>" + long_text(1000, 2)
    words: dict[str, int] = {}
    for part in text.split("<|endoftext|>"):
        for w in regex.findall(python_pattern(), part):
            words[w] = words.get(w, 0) + 1
    want = brute_merges(words, 243)
    vocab, merges = train_bpe(spark.createDataFrame([(text,)], "text string"), 500, ["<|endoftext|>"])
    assert [(r.l, r.r, r.n) for r in merges.orderBy("rank").collect()] == want
    assert vocab.count() == 500


def test_training_goes_on_from_a_file(spark, tmp_path) -> None:
    df = spark.createDataFrame([(long_text(600, 3),)], "text string")
    whole = [tuple(r) for r in train_bpe(df, 290)[1].orderBy("rank").collect()]
    folder = str(tmp_path / "state")
    told: list[dict] = []
    train_bpe(df, 270, workdir=folder, every=4, on_merge=told.append)
    assert len(told) == 14 and len(load_merges(spark, folder)) == 14
    assert [p.name for p in (tmp_path / "state").iterdir()] == ["step-000000014"]
    (tmp_path / "state" / "step-000000020").mkdir()
    again: list[dict] = []
    merges = train_bpe(df, 290, workdir=folder, mode="distributed", cut_every=7, on_merge=again.append)[1]
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == whole
    assert [m["merge"] for m in again] == list(range(14, 34))
    assert load_merges(spark, str(tmp_path / "nothing")) == []


def test_the_mode_follows_the_memory(spark, monkeypatch) -> None:
    df = word_frame(spark, {"abab": 3, "ba": 2}).cache()
    df.count()
    assert driver_bytes(df) == 2 * train.WORD_BYTES + 6 * train.TOKEN_BYTES
    want = train_merges(df, 3)
    monkeypatch.setattr(train, "LOCAL_BYTES", 1)
    monkeypatch.setattr(train, "_local", None)
    assert train_merges(df, 3) == want and df.is_cached
    df.unpersist()


def test_local_merges_tell_their_changes(spark) -> None:
    words = {"babab": 2, "hell": 3, "aaaa": 5}
    trainer = LocalTrainer([("".join(f"<{b:02X}>" for b in w.encode()), n) for w, n in words.items()])
    for pair in (("61", "62"), ("61", "61")):
        before = dict(trainer.counts)
        changes = trainer.merge(*pair)
        assert changes == {p: trainer.counts.get(p, 0) - before.get(p, 0) for p in {*before, *trainer.counts} if trainer.counts.get(p, 0) != before.get(p, 0)}


def test_indexed_words(spark, tmp_path) -> None:
    df = word_frame(spark, {"babab": 2, "hell": 3, "aaaa": 5, "aabaab": 1, "x": 1})
    held = IndexedWords(df, every=2)
    for pair in (("61", "62"), ("61", "61"), ("62", "6162"), ("7A", "7A")):
        counts, before = P.pair_counts(held.words), {tuple(r) for r in P.pair_counts(held.words).collect()}
        delta = held.merge(*pair)
        after = {tuple(r) for r in P.pair_counts(held.words).collect()}
        assert {tuple(r) for r in P.apply_delta(counts, delta).collect()} == after
        assert before == after or pair != ("7A", "7A")
        assert {tuple(r) for r in held.postings.collect()} == {tuple(r) for r in P.pair_postings(held.words).collect()}
    held.save(str(tmp_path / "w"))
    again = IndexedWords.load(spark, str(tmp_path / "w"))
    again.build_index()
    assert {tuple(r) for r in again.words.collect()} == {tuple(r) for r in held.words.collect()}
    words, index = storage.load_indexed_words(spark, str(tmp_path / "w"))
    assert words.count() == 5 and index.count() == len({(r.l, r.r) for r in held.postings.collect()})
    held.close()


def test_progress_lines(caplog) -> None:
    now = [0.0]
    p = Progress("merges", 200, every=50, seconds=1e9, clock=lambda: now[0])
    with caplog.at_level("INFO", "tokenloom"):
        for _ in range(100):
            now[0] += 0.1
            p.on_merge({})
    assert [r.getMessage() for r in caplog.records] == [
        "merges: 50 of 200, 25 %, 10.0/s, 15 s left", "merges: 100 of 200, 50 %, 10.0/s, 10 s left"
    ]
    assert "no end in sight" in Progress("x", 5, "MiB", clock=lambda: 0.0).line(1.0)
    assert mib(3 << 19) == 1.5


def test_shared_folder(spark, tmp_path, monkeypatch) -> None:
    assert shared.shared_dir(spark) == shared.shared_dir(spark)
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    steps = shared.Steps(spark, "test")
    df = spark.range(3)
    for _ in range(4):
        df = steps.keep("ids", df.select((df.id + 1).alias("id")))
    assert sorted(r.id for r in df.collect()) == [4, 5, 6]
    (folder,) = tmp_path.iterdir()
    assert len(list(folder.iterdir())) == 2
    steps.close()
    assert not list(tmp_path.iterdir())


class OfCluster:
    """As much of a session as the choice of the folder asks for."""

    def __init__(self, master: str, folder: str | None) -> None:
        self.sparkContext, self.conf, self.folder, self.master = self, self, folder, master

    def get(self, key: str, default: str | None) -> str | None:
        return self.folder or default


def test_a_cluster_must_name_its_folder() -> None:
    assert shared.shared_dir(OfCluster("spark://x:7077", "/shared")) == "/shared"
    for master in ("spark://x:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(OfCluster(master, None))


def test_long_pieces_take_no_square_of_steps() -> None:
    import time

    merges = [(b"a", b"b"), (b"ab", b"ab"), (b"abab", b"a")]
    t = Tokenizer({k: x for k, x in enumerate([*(bytes([b]) for b in range(256)), *(a + b for a, b in merges)])}, merges)
    began = time.process_time()
    assert t.encode_piece("ab" * 40_000) == [t.ids[b"abab"]] * 20_000
    assert time.process_time() - began < 3


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("abc", min_size=1, max_size=3)), max_size=12, unique=True))
def test_pieces_equal_the_plain_rule(text: str, pairs_: list[tuple[str, str]]) -> None:
    """Again and again the leftmost pair of least rank, whatever the merges."""
    merges = [(a.encode(), b.encode()) for a, b in pairs_]
    tokens = {bytes([b]): b for b in range(256)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}
    t = Tokenizer({k: x for x, k in tokens.items()}, merges)
    parts = [bytes([b]) for b in text.encode()]
    while found := [(t.ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in t.ranks]:
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert t.encode_piece(text) == [t.ids[p] for p in parts]


def trained(spark, docs) -> Tokenizer:
    vocab, merges = train_bpe(docs, 290, ["<|endoftext|>"])
    return Tokenizer.from_frames(vocab, merges, ["<|endoftext|>"])


def test_encode_and_decode(spark, docs) -> None:
    t = trained(spark, docs)
    assert t.rank_safe
    for how in ("column", "words", "arrow"):
        ids = t.encode_frame(docs, how=how)
        got = {r.doc_id: r.ids for r in ids.collect()}
        assert got == {k: None if x is None else t.encode(x) for k, x in enumerate(TEXTS)}
        more = t.encode_frame(docs.withColumn("k0", F.col("doc_id") + 1), how=how, keep=["k0", "text"])
        assert more.columns == ["doc_id", "k0", "text", "ids"]
        assert {r.k0 - 1: (r.text, r.ids) for r in more.collect()} == {k: (x, got[k]) for k, x in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in t.decode_frame(ids).collect()}
    assert back == dict(enumerate(TEXTS))
    assert t.decode([t.ids[b"\xc3"]]) == "�"
    register(spark, t)
    assert spark.sql("select bpe_decode(bpe_encode('low é')) as x").first().x == "low é"


def test_encoding_equals_an_independent_encoder(spark, docs) -> None:
    import tiktoken

    t = trained(spark, docs)
    ranks = {bytes([b]): k for k, b in enumerate(byte_order())}
    ranks |= {a + b: 256 + k for k, (a, b) in enumerate(t.merges)}
    own = tiktoken.Encoding("own", pat_str=python_pattern().replace(r"\Z", "$"), mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 5000})
    for x in filter(None, TEXTS):
        want = [0 if i == 5000 else i + 1 for i in own.encode(x, allowed_special="all")]
        assert t.encode(x) == want


def test_order_matters_without_rank_safety(spark) -> None:
    merges = [(b"b", b"c"), (b"x", b"y"), (b"a", b"b"), (b"ab", b"c"), (b"abc", b"d"), (b"a", b"bc")]
    tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
    t = make_tokenizer(dict(enumerate(tokens)), merges)
    assert not t.rank_safe
    assert [t.vocab[i] for i in t.encode("abcd")] == [b"abcd"]
    df = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")
    assert t.encode_frame(df).first().ids == t.encode("abcd")
    with pytest.raises(ValueError):
        t.encode_frame(df, how="other")
    assert t.ids[b"abc"] == 261


SMALL = Tokenizer(
    dict(enumerate([b"<|e|>", b"<|e|><|e|>", *(bytes([b]) for b in range(256)), b"ll", b" a"])),
    [(b"l", b"l"), (b" ", b"a")],
    ["<|e|>", "<|e|><|e|>"],
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'", "l", "a", " ", "  ", "\n", "<|e", "|>", "<|e|>", "é", "1", "!"]), max_size=12))
def test_strict_streams_equal_batches(chunks: list[str]) -> None:
    assert list(SMALL.encode_iterable(chunks)) == SMALL.encode("".join(chunks))
    assert SMALL.decode(SMALL.encode_iterable(chunks, strict=False)) == "".join(chunks)


def test_missing_specials_and_tokens(spark) -> None:
    t = Tokenizer({0: b"a"}, [], ["<s>"], add_missing=True)
    assert t.encode("a<s>") == [0, 1]
    with pytest.raises(KeyError):
        t.encode("b")
    with pytest.raises(Exception, match="no id for token"):
        t.encode_frame(spark.createDataFrame([(1, "b")], "doc_id bigint, text string"), how="column").collect()
    with pytest.raises(Exception, match="no token for id 9"):
        t.decode_frame(spark.createDataFrame([(1, [9])], "doc_id bigint, ids array<int>")).collect()
    for far in (7, 1_000_000):
        gap = Tokenizer({0: b"a", far: b"b"}, [])
        rows = spark.createDataFrame([(1, [far, 0], "x"), (2, None, None)], "doc_id bigint, ids array<int>, more string")
        assert [tuple(r) for r in gap.decode_frame(rows, keep=["more"]).orderBy("doc_id").collect()] == [(1, "x", "ba"), (2, None, None)]


def test_files(spark, docs, tmp_path) -> None:
    t = trained(spark, docs)
    storage.save_checkpoint(spark, str(tmp_path / "new" / "c"), t.vocab, t.merges)
    assert storage.load_checkpoint(spark, str(tmp_path / "new" / "c")) == (t.vocab, t.merges)
    (part,) = (tmp_path / "new" / "c").glob("*.txt")
    assert set(json.loads(part.read_text())) == {"vocab", "merges"}
    assert storage.load_checkpoint(spark, str(part)) == (t.vocab, t.merges)
    assert storage.from_checkpoint(None, None) == ({}, [])
    paths = str(tmp_path / "v.json"), str(tmp_path / "m.txt")
    storage.save_printed(spark, *paths, t.vocab, t.merges, t.specials)
    assert storage.load_printed(spark, *paths, t.specials) == (t.vocab, t.merges)
    more = storage.load_printed(spark, *paths, [*t.specials, "<new>", "<other>"])[0]
    assert more == t.vocab | {len(t.vocab): b"<new>", len(t.vocab) + 1: b"<other>"}
    (tmp_path / "m2.txt").write_text("#version\n\u0120 t\r\nt h\nodd line here\n\n", encoding="utf-8")
    assert storage.load_printed(spark, paths[0], str(tmp_path / "m2.txt"))[1] == [(b" ", b"t"), (b"t", b"h")]
    (tmp_path / "corpus.txt").write_bytes(b"one\nline<|endoftext|>two\xff<|endoftext|>")
    assert sorted(r.text for r in storage.read_corpus(spark, str(tmp_path / "corpus.txt")).collect()) == ["one\nline", "two�"]
    assert storage.read_corpus(spark, str(tmp_path / "corpus.txt"), None).count() == 1
    (tmp_path / "two.txt").write_text("a<s>b<ss>c<s><s>d\n")
    assert sorted(r.text for r in storage.read_corpus(spark, str(tmp_path / "two.txt"), ["<s>", "<ss>"]).collect()) == ["a", "b", "c", "d\n"]
    assert storage.corpus_bytes(spark, str(tmp_path / "corpus.txt")).first().bytes == 38
    words = word_histogram(docs)
    storage.save_words(words, str(tmp_path / "w"))
    assert storage.load_words(spark, str(tmp_path / "w")).count() == words.count()
    ids = spark.createDataFrame([([1, 2],)], "ids array<int>")
    assert storage.ids_as_json(ids).first().ids == "[1,2]" and storage.ids_as_text(ids).first().ids == "1 2"


def test_lines_and_chunks(spark) -> None:
    rows = ["a\n\nb", "", None, "x" * 7, "é🙂" * 4]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select(lines_of(F.col("t")).alias("l"), chunks_of(F.col("t"), 3).alias("c")).collect()
    assert [r.l for r in got] == [["a\n", "\n", "b"], [], None, ["x" * 7], ["é🙂" * 4]]
    assert [r.c for r in got] == [["a\n\n", "b"], [], None, ["xxx", "xxx", "x"], ["é🙂é", "🙂é🙂", "é🙂"]]


def test_array_arithmetic(spark) -> None:
    import numpy as np

    rng = np.random.default_rng(0)
    x, m = rng.normal(size=6), rng.normal(size=(4, 6))
    keys, values = rng.normal(size=(5, 6)), rng.normal(size=(5, 3))
    df = spark.createDataFrame(
        [(x.tolist(), m.tolist(), keys.tolist(), values.tolist(), 3, [True, True, False, True, True])],
        "x array<double>, m array<array<double>>, k array<array<double>>, v array<array<double>>, p int, a array<boolean>",
    )
    c = F.col
    row = df.select(
        A.linear(c("m"), c("x")).alias("linear"), A.softmax(c("x")).alias("softmax"), A.rmsnorm(c("x")).alias("rms"),
        A.silu(c("x")).alias("silu"), A.cross_entropy(c("x"), c("p")).alias("ce"), A.rope(c("x"), c("p")).alias("rope"),
        A.attention(c("x"), c("k"), c("v"), c("a")).alias("att"), A.swiglu(c("m"), F.transform(c("m"), lambda r: F.slice(r, 1, 4)), c("m"), c("x")).alias("glu"),
    ).first()
    e = np.exp(x - x.max())
    assert np.allclose(row.linear, m @ x) and np.allclose(row.softmax, e / e.sum())
    assert np.allclose(row.rms, x / np.sqrt((x * x).mean() + 1e-5)) and np.allclose(row.silu, x / (1 + np.exp(-x)))
    assert np.isclose(row.ce, np.log(np.exp(x).sum()) - x[3])
    s = keys @ x / np.sqrt(6)
    s[2] = -np.inf
    w = np.exp(s - s.max())
    assert np.allclose(row.att, w @ values / w.sum())
    h = m @ x
    assert np.allclose(row.glu, m[:, :4] @ (h / (1 + np.exp(-h)) * h))
    z = (x[0::2] + 1j * x[1::2]) * np.exp(3j / 10_000 ** (np.arange(3) * 2 / 6))
    assert np.allclose(row.rope[0::2], z.real) and np.allclose(row.rope[1::2], z.imag)


def test_overflow_is_avoided(spark) -> None:
    df = spark.createDataFrame([([1000.0, 1000.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(A.softmax(F.col("x"))).collect()] == [[0.5, 0.5], [], None]


def test_windows(spark) -> None:
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1],)], "x array<int>")
    got = [[(p.x, p.y) for p in r[0]] for r in df.select(A.windows(F.col("x"), 2)).collect()]
    assert got == [[([1, 2], [2, 3]), ([2, 3], [3, 4])], []]


def test_streams(spark, docs, tmp_path) -> None:
    from tokenloom.streaming import encode as S

    docs.write.parquet(str(tmp_path / "docs"))
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    run = S.streaming_words(source).writeStream.outputMode("complete").format("memory").queryName("words").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.w, r.n) for r in spark.table("words").collect()} == {(r.w, r.n) for r in word_histogram(docs).collect()}


def test_streams_of_chunks(spark, tmp_path) -> None:
    from tokenloom.streaming import encode as S

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    texts = {"s": "he'll go <|e|> é", "t": "a ll <|e|><|e|>x"}
    rows = []
    for name, text in texts.items():
        cuts = [text[k : k + 3] for k in range(0, len(text), 3)]
        rows += [(name, k, c, k == len(cuts) - 1) for k, c in enumerate(cuts)]
    rows = rows[::-1] + rows[:2]
    kind = "stream_id string, seq bigint, chunk string, is_last boolean"
    for part in range(2):
        spark.createDataFrame(rows[part::2], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    run = (
        S.encode_chunks(source, SMALL).writeStream.outputMode("append").format("memory").queryName("ids")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    run.processAllAvailable()
    run.stop()
    got = spark.table("ids").orderBy("stream_id", "part").collect()
    for name, text in texts.items():
        assert list(itertools.chain(*(r.ids for r in got if r.stream_id == name))) == SMALL.encode(text)
    assert {r.stream_id for r in got if r.ended} == set(texts) and all(r.story == 0 for r in got)
    whole = S.joined_streams(spark.createDataFrame(rows, kind)).collect()
    assert {(r.stream_id, r.story): r.text for r in whole} == {(k, 0): x for k, x in texts.items()}


def test_stories_of_a_long_stream(spark, monkeypatch) -> None:
    from tokenloom.streaming import encode as S

    monkeypatch.setattr(S, "BLOCK", 3)
    rows = [("s", k, f"{k} ", k % 4 == 1) for k in range(20)] + [("s", 3, "3 ", False), ("t", 0, None, None), (None, 1, "x", True)]
    got = {(r.stream_id, r.story): r.text for r in S.joined_streams(spark.createDataFrame(rows, "stream_id string, seq bigint, chunk string, is_last boolean")).collect()}
    assert got == {("s", 0): "0 1 ", **{("s", n + 1): "".join(f"{k} " for k in range(4 * n + 2, 4 * n + 6) if k < 20) for n in range(5)}, ("t", 0): ""}


class FakeState:
    """A state store of one value, with timers that are only remembered."""

    def __init__(self) -> None:
        self.value, self.timers = None, []

    def getValueState(self, name: str, schema: str) -> FakeState:  # noqa: N802
        return self

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def listTimers(self) -> list[int]:  # noqa: N802
        return self.timers

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self) -> int:  # noqa: N802
        return 5000


def test_a_missing_chunk_is_not_waited_for_without_end() -> None:
    import pandas as pd

    from tokenloom.streaming import encode as S

    one, state = S.ChunkEncoder(SMALL, patience=2), FakeState()
    one.init(state)
    give = lambda *rows: list(one.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["seq", "chunk", "is_last"])]), state))
    assert give((1, "b a", False), (2, " a", True), (2, "again", True)) == [] and state.timers == [7000]
    assert give((3, "c", False)) == [] and state.timers == [7000]
    (out,) = one.handleExpiredTimer(("s",), state, None)
    assert out[["part", "story", "ended"]].values.tolist() == [[0, 0, True]]
    assert out["ids"][0] == SMALL.encode("b a a")
    assert give((0, "late", False)) == [] and state.value[1] == 4
    (out,) = give((4, "d", True))
    assert out["story"].tolist() == [1] and out["ids"][0] == SMALL.encode("cd")


def test_streams_over_all_that_is_there(spark, docs, tmp_path) -> None:
    from tokenloom.streaming import encode as S

    docs.write.parquet(str(tmp_path / "docs.parquet"))
    source = S.file_stream(spark, str(tmp_path / "docs.parquet"))
    words = S.run_available(S.streaming_words(source.select("doc_id", "text")), "complete")
    assert {(r.w, r.n) for r in words.collect()} == {(r.w, r.n) for r in word_histogram(docs).collect()}
    ids = S.run_available(S.streaming_encode(source, SMALL).select("doc_id", "ids"))
    assert {r.doc_id: r.ids for r in ids.collect()} == {k: None if x is None else SMALL.encode(x) for k, x in enumerate(TEXTS)}


def test_neural_operators(spark) -> None:
    import numpy as np

    rng = np.random.default_rng(1)
    q, k, v = rng.normal(size=(2, 3, 4, 6)), rng.normal(size=(2, 3, 5, 6)), rng.normal(size=(2, 3, 5, 3))
    mask = rng.random((4, 5)) < 0.6
    mask[0] = True
    mask[3] = False
    out = N.attention(q, k, v, mask)
    for i, j in itertools.product(range(2), range(3)):
        for row in range(4):
            s = np.array([q[i, j, row] @ k[i, j, c] / np.sqrt(6) if mask[row, c] else -np.inf for c in range(5)])
            e = np.exp(s - s[mask[row]].max()) if mask[row].any() else np.zeros(5)
            assert np.allclose(out[i, j, row], e @ v[i, j] / max(e.sum(), 1e-300))
    d, heads, length = 8, 2, 5
    x = rng.normal(size=(length, d))
    w = {n: rng.normal(size=(d, d)) for n in "qkvo"}
    per = []
    for h in range(heads):
        cut = slice(4 * h, 4 * h + 4)
        a, b, c = (x @ w[n][cut].T for n in "qkv")
        a, b = (np.stack([N.rope(y[r : r + 1], np.array([r]), 100.0)[0] for r in range(length)]) for y in (a, b))
        per.append(np.stack([N.softmax((a[r] @ b[: r + 1].T / 2)[None])[0] @ c[: r + 1] for r in range(length)]))
    want = np.concatenate(per, axis=1) @ w["o"].T
    assert np.allclose(N.multihead(x, *(w[n] for n in "qkvo"), heads, 100.0), want)
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [])], "id int, x array<array<double>>")
    got = {r.id: r.attended for r in N.attended(df, w, heads, 100.0).collect()}
    assert np.allclose(got[1], want) and got[2] is None and got[3] is None

    vocab = 11
    lm = {"token_embeddings.weight": rng.normal(size=(vocab, d)), "ln_final.weight": rng.normal(size=d), "lm_head.weight": rng.normal(size=(vocab, d))}
    for layer in range(2):
        for name, shape in (("ln1", d), ("ln2", d), *((f"attn.{n}_proj", (d, d)) for n in ("q", "k", "v", "output")), ("ffn.w1", (12, d)), ("ffn.w2", (d, 12)), ("ffn.w3", (12, d))):
            lm[f"layers.{layer}.{name}.weight"] = rng.normal(size=shape)
    ids = np.array([[1, 2, 3, 4], [5, 6, 7, 0]])
    every = N.language_model(ids, lm, 2, heads, 1000.0)
    assert every.shape == (2, 4, vocab)
    # A causal model gives a prefix the same logits, and one row the same as many.
    assert np.allclose(N.language_model(ids[0, :2], lm, 2, heads, 1000.0), every[0, :2])
    rows = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, []), (3, None)], "id int, ids array<int>")
    got = {r.id: r.logits for r in N.next_token_logits(rows, lm, 2, heads, 1000.0).collect()}
    assert np.allclose(got[1], every[0, -1]) and got[2] is None and got[3] is None


def test_adamw_and_states(spark, tmp_path) -> None:
    import numpy as np

    rng = np.random.default_rng(2)
    p, m, v = rng.normal(size=5), np.zeros(5), np.zeros(5)
    df = spark.createDataFrame([(p.tolist(), m.tolist(), v.tolist())], "p array<double>, m array<double>, v array<double>")
    for step in (1, 2, 3):
        g = rng.normal(size=5)
        new = N.adamw(F.col("p"), F.lit(g.tolist()).cast("array<double>"), F.col("m"), F.col("v"), F.lit(step), rate=0.1, decay=0.05)
        df = df.select(new.alias("s")).select("s.*")
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p * (1 - 0.1 * 0.05) - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(df.first().p, p, atol=1e-6) and np.allclose(df.first().v, v)
    N.save_state(df, str(tmp_path / "s"), 3)
    state, iteration = N.load_state(spark, str(tmp_path / "s"))
    assert iteration == 3 and state.first() == df.first()
    still = df.select(N.adamw(F.col("p"), F.lit(None).cast("array<double>"), F.col("m"), F.col("v"), F.lit(4)).alias("s")).select("s.*")
    assert still.first() == df.first()


def test_batches_are_drawn_evenly_and_again_the_same(spark) -> None:
    df = spark.range(400).select("id", F.sequence(F.lit(0), F.lit(99)).alias("t"))
    draw = lambda seed: df.select(F.explode(A.sample_batch(F.col("t"), F.col("id"), 32, 7, seed)).alias("p")).select("p.x", "p.y").collect()
    rows = draw(1)
    starts = [r.x[0] for r in rows]
    assert all(r.x == list(range(s, s + 7)) and r.y == list(range(s + 1, s + 8)) for r, s in zip(rows, starts))
    each = [starts.count(k) for k in range(93)]
    mean = 400 * 32 / 93
    assert set(starts) == set(range(93)) and max(abs(n - mean) for n in each) < 5 * mean**0.5
    assert draw(1) == rows != draw(2)
    short = spark.createDataFrame([([1, 2],), (None,)], "t array<int>")
    assert [r[0] for r in short.select(A.sample_batch(F.col("t"), F.lit(1), 3, 2, 1)).collect()] == [[], None]


def test_command_line(spark, tmp_path, capsys) -> None:
    from tokenloom.__main__ import main

    (tmp_path / "c.txt").write_text("low lower lowest<|endoftext|>newest widest low", encoding="utf-8")
    saved = str(tmp_path / "t")
    special = ["--special-token", "<|endoftext|>"]
    job = ["train", "--input", str(tmp_path / "c.txt"), *special, "--output", saved, "--checkpoint-dir", str(tmp_path / "state")]
    assert main([*job, "--vocab-size", "262", "--checkpoint-every", "2", "--verbose"]) == 0
    with pytest.raises(SystemExit, match="--resume"):
        main([*job, "--vocab-size", "270"])
    assert main([*job, "--vocab-size", "270", "--resume", "--min-frequency", "1"]) == 0
    assert capsys.readouterr().out.splitlines()[-1].startswith("270 tokens, 13 merges")
    with pytest.raises(SystemExit, match="--checkpoint"):
        main(["encode", "--text", "x"])
    capsys.readouterr()
    main(["encode", "--checkpoint", saved, *special, "--text", "low<|endoftext|>er"])
    ids = capsys.readouterr().out
    main(["encode-stream", "--checkpoint", saved, *special, "--file", str(tmp_path / "c.txt"), "--chunk-size", "4", "--format", "space"])
    stream = capsys.readouterr().out.split()
    main(["decode", "--checkpoint", saved, *special, *ids.strip()[1:-1].split(", ")])
    assert capsys.readouterr().out == "low<|endoftext|>er\n"
    main(["decode", "--checkpoint", saved, *special, *stream])
    assert capsys.readouterr().out == (tmp_path / "c.txt").read_text() + "\n"
