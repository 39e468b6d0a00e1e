"""The training-data operators against brute force, on small tables with every odd case."""

from __future__ import annotations

import base64
import itertools
import random

import numpy as np
import pytest
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import automaton, bpe, encoding, neardup, packing, pieces, repetition, sketch, subjects, terms
from tokenloom.llm import words as W

ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (None, "no id at all " * 30), (5, "x" * 70_000)]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in regex.findall(r"\p{L}+", text)]


@pytest.fixture(scope="module")
def odd(spark: SparkSession):
    """Odd texts, a repeated row, and other columns with clashing names."""
    rows = [(i, t, 7, "r", "c") for i, t in [*ODD, ODD[3]]]
    kind = "doc_id bigint, text string, id bigint, row string, class string"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="module")
def nothing(spark: SparkSession):
    return spark.createDataFrame([], "doc_id bigint, text string, input_path string")


def test_word_hashes_tell_words_apart() -> None:
    texts = ["Ab ab, AB! straße STRASSE", "", "日本 語 x1y", "İx Σς"]
    w = W.words(texts)
    spelled = [w.joined[a:b] for a, b in zip(w.start, w.end)]
    assert spelled == [x for t in texts for x in regex.findall(r"\p{L}+", t)]
    assert len(set(w.hash[:3].tolist())) == 1
    assert len(set(w.hash.tolist())) == len({s.lower().replace("ς", "σ") for s in spelled})
    assert w.doc.tolist() == [0] * 5 + [2] * 4 + [3] * 2


def brute_share(text: str) -> tuple[int, int]:
    ws = words_of(text)
    seen, hit = set(), set()
    for k in range(len(ws) - 5):
        run = tuple(ws[k : k + 6])
        if run in seen:
            hit |= set(range(k, k + 6))
        seen.add(run)
    return len(ws), len(hit)


def test_repetition_equals_brute_force(spark: SparkSession) -> None:
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["the cat sat on the mat now. " * 9, "a b c d e f g " * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    for k, t in enumerate(texts):
        n, again = brute_share(t)
        assert got[k].n_words == n
        assert got[k].repeated_share == pytest.approx(again / max(n, 1))
    want = {k for k, t in enumerate(texts) if brute_share(t)[0] and brute_share(t)[1] >= 0.3 * brute_share(t)[0]}
    assert {r[0] for r in repetition.repetitive_records(df).collect()} == want


def test_repetition_in_a_text_that_compresses_badly(spark: SparkSession) -> None:
    rng = random.Random(11)
    text = "the cat sat on the mat now " * 2 + "".join(rng.choice("0123456789+/=#%&!?<>") for _ in range(9000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert brute_share(text) == (14, 7)
    assert [r[0] for r in repetition.repetitive_records(df).collect()] == [1]


def test_the_compressor_decides_who_is_counted() -> None:
    """Plain texts are settled by compression alone; no case is."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    compress = repetition.Compressor()
    texts = []
    for k in range(400):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 300, 900, 3000]))]
        if k % 2:
            places = list(range(6, len(ws) - 6, 6))
            for at in rng.sample(places, -(-len(ws) // 19)):
                ws[at : at + 6] = ws[0:6] if at == 6 else ws[at - 6 : at]
        texts.append(" ".join(ws))
    got = repetition._measured(list(range(400)), texts, compress, False).to_pydict()
    for k, text in enumerate(texts):
        n, again = brute_share(text)
        if 10 * again >= 3 * n:
            assert got["verdict"][k] == "repetitive" and got["repeated_share"][k] == pytest.approx(again / n)
        elif got["verdict"][k] != "repetitive":
            assert got["repeated_share"][k] is None
    plain = [got["verdict"][k] for k in range(0, 400, 2)]
    assert sum(v in ("plain", "incompressible") for v in plain) > 100


def test_the_window_is_as_long_as_the_text() -> None:
    rng = np.random.default_rng(13)
    data = rng.integers(0, 256, 3_000_000, np.uint8).tobytes()
    assert repetition.Compressor().size(data + data) < 1.1 * len(data)


def test_repetition_of_odd_rows(odd, nothing) -> None:
    rows = repetition.repetition(odd).collect()
    assert len(rows) == len(ODD) + 1
    assert [r.verdict for r in rows if r.doc_id == 1] == ["missing"]
    assert repetition.repetitive_records(odd).collect() == []
    assert repetition.repetition(nothing).collect() == []


def test_pieces_keep_the_text_and_the_limit() -> None:
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "é", "日本。", ". ", "\n\n", "<|e|>", "xyz", "🙂"]) for _ in range(rng.randint(1, 80)))
        limit, overlap = rng.randint(4, 60), rng.randint(0, 80)
        parts = pieces.split(text, limit, overlap, ["<|e|>"])
        assert parts[0][0] == 0 and parts[-1][1] == len(text)
        for a, b, _ in parts:
            assert len(text[a:b].encode()) <= limit
        for (_, end, _), (a, b, _) in zip(parts, parts[1:]):
            assert a <= end < b
            assert len(text[a:end].encode()) <= overlap


def test_pieces_end_at_the_best_boundary() -> None:
    text = "aaaa bbbb. cccc<|e|>dddd eeee\n\nffff gggg"
    cut = lambda limit, specials=("<|e|>",): [text[a:b] for a, b, _ in pieces.split(text, limit, 0, list(specials))]
    assert cut(25)[0] == "aaaa bbbb. cccc<|e|>"
    assert cut(25, ())[0] == "aaaa bbbb. "
    assert pieces.split("", 5) == []
    assert pieces.split("x" * 10, 4, 1) == [(0, 4, "hard"), (3, 7, "hard"), (6, 10, "end")]
    with pytest.raises(ValueError):
        pieces.split("a", 0)


@pytest.mark.parametrize("limit", [pieces.RUNS_BYTES, 0])
def test_pieces_of_tables(spark: SparkSession, nothing, monkeypatch, limit: int) -> None:
    monkeypatch.setattr(pieces, "RUNS_BYTES", limit)
    kind = "run_id bigint, input_path string, special_tokens array<string>, stream_chunk_chars bigint, overlap_chars bigint, started_at string"
    runs = spark.createDataFrame(
        [(1, "p", None, 8, None, "a"), (1, "p", None, 8, None, "b"), (2, "p", ["|"], None, 3, "a"), (3, None, None, 1, 1, "a"), (4, "p", [], 0, 0, "a")],
        kind,
    )
    rows = [(1, "aaaa bbbb cccc", "p"), (1, "aaaa bbbb cccc", "p"), (2, None, "p"), (3, "", "p"), (4, "short", "p"), (5, "long enough text", None)]
    stories = spark.createDataFrame(rows, "doc_id bigint, text string, input_path string")
    got = pieces.oversized_pieces(stories, runs).orderBy("piece").collect()
    assert [(r.run_id, r.doc_id, r.piece_text) for r in got] == [(1, 1, "aaaa "), (1, 1, "bbbb "), (1, 1, "cccc")]
    assert [r.start_byte for r in got] == [0, 5, 10]
    whole = pieces.joined_pieces(pieces.oversized_pieces(stories, runs)).collect()
    assert [tuple(r) for r in whole] == [(1, 1, "aaaa bbbb cccc", 5)]
    overlapping = runs.select("run_id", "input_path", "special_tokens", F.lit(9).alias("stream_chunk_chars"), F.lit(4).alias("overlap_chars"), "started_at")
    texts = spark.createDataFrame([(1, "äöü日本 🙂🙂 ß" * 5, "p")], "doc_id bigint, text string, input_path string")
    whole = pieces.joined_pieces(pieces.oversized_pieces(texts, overlapping)).collect()
    assert {(r.text, r.longest <= 9) for r in whole} == {("äöü日本 🙂🙂 ß" * 5, True)} and len(whole) == 3
    assert pieces.oversized_pieces(nothing, runs).collect() == []
    assert pieces.oversized_pieces(stories, runs.filter("false")).collect() == []


def test_suffixes_and_intervals_equal_brute_force() -> None:
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.integers(0, 14, rng.integers(0, 8))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        symbol = rng.integers(0, 4, len(doc)).astype(np.uint64)
        found = terms.Suffixes(symbol, doc, 5)
        end = np.searchsorted(doc, doc, side="right")
        assert found.order.tolist() == sorted(range(len(doc)), key=lambda k: (symbol[k : end[k]].tolist(), k))
        for n in (1, 2, 3, 5):
            first, occurrences, records = found.intervals(n)
            grams: dict[tuple, list[int]] = {}
            for k in range(len(doc) - n + 1):
                if doc[k] == doc[k + n - 1]:
                    grams.setdefault(tuple(symbol[k : k + n].tolist()), []).append(int(doc[k]))
            got = {tuple(symbol[f : f + n].tolist()): (o, r) for f, o, r in zip(first, occurrences, records)}
            assert got == {g: (len(d), len(set(d))) for g, d in grams.items()}


def test_ngrams_of_tables(spark: SparkSession, odd, nothing, monkeypatch) -> None:
    monkeypatch.setattr(terms, "BLOCK_CHARS", 40)
    texts = ["the cat sat. The cat sat on", "a cat sat on the mat", "", None, "The cat"]
    rows = [*enumerate(texts), (0, texts[0]), (1, texts[1]), (None, "the cat")]
    for limit in (terms.BROADCAST_IDS, 0):
        monkeypatch.setattr(terms, "BROADCAST_IDS", limit)
        got = terms.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), n=[1, 2, 4]).collect()
        want: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            ws = words_of(t or "")
            for n in (1, 2, 4):
                for k in range(len(ws) - n + 1):
                    want.setdefault(" ".join(ws[k : k + n]), []).append(i)
        assert {(r.term, r.n_terms): (r.occurrences, r.records) for r in got} == {(t, t.count(" ") + 1): (len(d), len(set(d))) for t, d in want.items()}
    assert terms.frequent_ngrams(nothing, [1, 2]).collect() == []
    assert terms.frequent_ngrams(odd, [1, 2]).collect() == []
    with pytest.raises(ValueError):
        terms.word_counts(odd, n=0)


def test_term_counts_of_odd_rows(spark: SparkSession, odd, nothing) -> None:
    assert {(r.term, r.occurrences, r.records) for r in terms.word_counts(odd).collect()} == {("one", 1, 1), ("x" * 70_000, 1, 1)}
    assert terms.word_counts(nothing).collect() == []
    kind = "checkpoint_id bigint, vocab map<string,array<int>>, merges array<array<array<int>>>"
    saved = spark.createDataFrame(
        [(1, {"0": [97], "1": [97], "2": [98, 255]}, [[[97], [98, 1]]]), (1, {"0": [97], "1": [97], "2": [98, 255]}, [[[97], [98, 1]]]), (2, None, None)],
        kind,
    )
    got = {(r.field_name, r.term, r.occurrences, r.records, r.mark) for r in terms.term_frequencies(nothing, saved).collect()}
    assert got == {("vocab", "61", 2, 1, "rare"), ("vocab", "62FF", 1, 1, "rare"), ("merges", "61 6201", 1, 1, "rare")}


def brute_pairs(texts: dict[int, str]) -> set[tuple[int, int]]:
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in texts.items() if len(w := words_of(t)) >= 20}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}


def near_texts(n: int, seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        w = [rng.choice("abcdefghijkl") + rng.choice("mnopq") for _ in range(rng.randint(15, 60))]
        out[10 * k] = " ".join(w)
        for j in range(1, rng.randint(1, 5)):
            v = list(w)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = rng.choice("xyz")
            out[10 * k + j] = " ".join(v)
    return out


def test_near_duplicates_equal_brute_force(spark: SparkSession, monkeypatch) -> None:
    texts = near_texts(60, 4)
    df = spark.createDataFrame([*texts.items(), (0, texts[0]), (None, texts[0]), (9999, None)], "doc_id bigint, text string")
    want = brute_pairs(texts)
    assert want
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    # Small blocks, several of which share a task.
    monkeypatch.setattr(neardup, "BLOCK_ENTRIES", 100)
    monkeypatch.setattr(neardup, "MOST_TASKS", 3)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want


def test_near_duplicates_in_rounds_equal_brute_force(spark: SparkSession, monkeypatch) -> None:
    monkeypatch.setattr(neardup, "ROUND_BLOCKS", 1)
    monkeypatch.setattr(neardup, "MOST_TASKS", 2)
    texts = near_texts(40, 7)
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == brute_pairs(texts)


def test_rows_are_sorted_by_one_number_or_two() -> None:
    rng = np.random.default_rng(16)
    for spread in (np.uint64(1), np.uint64(1 << 40)):
        doc = np.sort(rng.integers(0, 50, 2000))
        h = rng.integers(0, 40, 2000).astype(np.uint64) * spread
        by = neardup.by_document(doc, h, 50)
        want = np.lexsort((h, doc))
        assert (doc[by] == doc[want]).all() and (h[by] == h[want]).all()


def test_hot_columns_are_split_without_loss() -> None:
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    texts = [" ".join(f"w{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26 % 26)}" for x in rng.permutation(400)[:40]) for _ in range(40)]
    texts += [t + " tail end" for t in texts]
    order = np.full(1 << 20, sketch.level(np.array([2])), np.uint8)
    hot = np.full(1 << 20, sketch.level(np.array([12 * neardup.HOT])), np.uint8)
    found = []
    for table in (order, hot):
        held = neardup._Held(4)
        held.add(neardup.Rows(texts, 3, 20), table, 60)
        blobs: dict[int, list[bytes]] = {}
        for batch in held.blobs():
            blobs.setdefault(batch.column(0)[0].as_py(), []).append(batch.column(1)[0].as_py())
        pairs = set()
        for b in blobs.values():
            for batch in neardup.product(b, 60):
                pairs |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        found.append(pairs)
    assert len(base) and found[0] == found[1] and len(found[0]) >= 40


def test_rows_that_share_little_leave_no_pairs_in_a_block() -> None:
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(5000)]
    texts = ["one two three " + " ".join(rng.choice(words) for _ in range(rng.randint(40, 200))) for _ in range(300)]
    texts += [t + " tail end" for t in texts[:50]]
    # The run that all of them share is their rarest, as all runs become common in large tables.
    order = np.full(1 << 20, 3, np.uint8)
    order[sketch.places(neardup.Rows(["one two three"], 3, 1).h, 20)] = 2
    held = neardup._Held(1)
    held.add(neardup.Rows(texts, 3, 20), order, 60)
    (blob,) = (b.column(1)[0].as_py() for b in held.blobs())
    pairs = [p for b in neardup.product([blob], 60) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    known = neardup.Rows(texts, 3, 20).classes().tolist()
    assert {tuple(sorted((known[k], known[300 + k]))) for k in range(50)} <= set(pairs)
    assert len(pairs) < 300


def test_counts_of_hot_keys_are_not_clipped(spark: SparkSession, monkeypatch) -> None:
    monkeypatch.setattr(sketch, "FAN_IN", 2)
    monkeypatch.setattr(sketch, "GATHERED", 1000)
    monkeypatch.setattr(sketch, "HELD", 50)
    n, hot = 300_000, np.uint64(0xABCDEF << 40)
    df = spark.range(n, numPartitions=7).select("id", "id")
    rare = np.arange(100, dtype=np.uint64) * np.uint64(0x01F00000 << 32)

    def keys(batch):
        yield np.full(batch.num_rows, hot)
        yield rare

    table = np.frombuffer(sketch.count_keys(df, keys, 20), np.uint8)
    (at,) = sketch.places(np.array([hot]), 20)
    assert 0.9 * n < sketch.from_level(table[at : at + 1])[0] <= n
    batches = table[sketch.places(rare, 20)]
    assert (batches == batches[0]).all() and batches[0] >= 7
    assert np.count_nonzero(table) == len({at, *sketch.places(rare, 20)})
    assert sketch.bits_for(0) == 20 and sketch.bits_for(10**12) == sketch.MOST_BITS


def test_large_classes_are_stars(spark: SparkSession, nothing, odd) -> None:
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(k, text) for k in range(neardup.EXPAND + 6)] + [(500, text + " more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    every = [*range(neardup.EXPAND + 6), 500]
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df, expand=None).collect()} == set(itertools.combinations(every, 2))
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    assert got == {(0, k) for k in range(1, neardup.EXPAND + 6)} | {(0, 500)}
    by = {r.doc_id: (r.class_id, r.links) for r in neardup.near_duplicate_classes(df).collect()}
    assert by == {k: (0, 1) for k in range(neardup.EXPAND + 6)} | {500: (500, 1)}
    assert neardup.near_duplicate_pairs(nothing).collect() == []
    assert neardup.near_duplicate_pairs(odd).collect() == []


def test_different_texts_of_a_large_class_are_all_paired(spark: SparkSession, monkeypatch) -> None:
    monkeypatch.setattr(neardup, "LIST", 9)
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    several = {k: text.replace(" ", "," * k + " ") for k in range(neardup.EXPAND + 6)}
    copies = {k: text.upper() for k in range(100, 101 + neardup.EXPAND)}
    similar = {k: (text + " more").replace(" ", "!" * (k - 500) + " ") for k in range(500, 500 + neardup.EXPAND + 2)}
    few = {k: text + ":" for k in range(700, 703)}
    every = {**several, **copies, **similar, **few}
    df = spark.createDataFrame([*every.items()], "doc_id bigint, text string")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df).collect()]
    others = set(copies) - {100}
    want = set(itertools.combinations(sorted(set(every) - others), 2)) | {(100, k) for k in others}
    assert len(got) == len(set(got)) and set(got) == want == (brute_pairs(every) & want)


def test_signatures_bound_the_difference() -> None:
    texts = list(near_texts(20, 6).values())
    r = neardup.Rows(texts, 3, 20)
    sets = [set(r.h[a : a + n].tolist()) for a, n in zip(r.first, r.size)]
    signs = r.signatures()
    for i, j in itertools.combinations(range(len(sets)), 2):
        assert neardup.differing([signs[i]], [signs[j]])[0] <= len(sets[i] ^ sets[j])


def ranks() -> dict[bytes, int]:
    lines = open(bpe.VOCAB, "rb").read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_the_automaton_finds_all_strings_that_end_at_a_place() -> None:
    rng = random.Random(14)
    for _ in range(200):
        every = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12))}
        strings = {s: k for k, s in enumerate(sorted(every))}
        a = automaton.build(strings)
        text = bytes(rng.choice(b"abcd") for _ in range(30))
        state = matched = 0
        for end, c in enumerate(text, 1):
            step = lambda v: a.labels.find(c, a.start[v], a.start[v + 1])  # noqa: B023, E731
            while step(state) < 0 and state:
                state = a.link[state]
                matched = a.length[state]
            got = set()
            if step(state) >= 0:
                state, matched = a.to[step(state)], matched + 1
                at = state if a.value[state] >= 0 and a.length[state] <= matched else a.upper[state]
                while at:
                    got.add(a.value[at])
                    at = a.upper[at]
            assert got == {k for s, k in strings.items() if text[:end].endswith(s)}


def test_ids_equal_an_independent_encoder(spark: SparkSession, odd, nothing) -> None:
    import tiktoken

    from tokenloom.functions.patterns import python_pattern

    own = tiktoken.Encoding("own", pat_str=python_pattern().replace(r"\Z", "$"), mergeable_ranks=ranks(), special_tokens={})
    rng = random.Random(7)
    bits = ["a", "the", "ing", " ", "é", "日", "🙂", "\n", "'s", "12", "-", "<|endoftext|>", "​", "ё"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["ab" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df).collect()}
    assert all(got[k] == own.encode_ordinary(t) for k, t in enumerate(texts))
    assert {r.doc_id: r.ids for r in bpe.token_ids(odd).collect() if r.doc_id in (1, 2)} == {1: None, 2: []}
    assert bpe.token_ids(nothing).collect() == []


def test_packing_places_every_item_once(spark: SparkSession) -> None:
    rng = np.random.default_rng(8)
    sizes = [int(x) for x in rng.integers(0, 150, 600)] + [100] * 40 + [250, 1000, 0, 0]
    rows = [(k, n) for k, n in enumerate(sizes)] + [(None, None), (3, sizes[3])]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 100).toPandas()
    assert (out.groupby("container").n_tokens.sum() <= 100).all()
    assert out.n_tokens.sum() == sum(n or 0 for _, n in rows)
    assert len(out) == sum(max(1, -(-(n or 0) // 100)) for _, n in rows)
    by = out[out.doc_id == sizes.index(1000)].sort_values("piece")
    assert by.start.tolist() == list(range(0, 1000, 100))
    assert out.container.nunique() <= 1.02 * out.n_tokens.sum() / 100 + 2
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(empty, 100).collect() == []
    packed = packing.pack(spark.createDataFrame([(1, 250), (2, 60), (3, 0)], "doc_id bigint, n_tokens bigint"), 100)
    assert {tuple(r) for r in packing.placed(packed, 100).collect()} == {(1, True), (2, True), (3, True)}
    wrong = packed.filter("doc_id <> 1 or piece <> 1").withColumn("container", F.lit(0))
    assert {tuple(r) for r in packing.placed(wrong, 100).collect()} == {(1, False), (2, False), (3, False)}


def test_packed_documents(odd) -> None:
    out = packing.pack_documents(odd).collect()
    assert {r.doc_id for r in out if r.piece > 0} == {5}


GARBLED = [
    ("Der Müller öffnete die Tür und fragte: „Wer hörte das Geräusch?“", "utf-8", "cp1252"),
    ("Le soir, Zoé rêvait : la clé dorée, l’étoile brisée…", "utf-8", "mac_roman"),
    ("Однажды старик нашёл красный мяч за мельницей.", "cp1251", "cp1252"),
    ("Утром сосед снова принёс старое зеркало.", "koi8-r", "cp1251"),
]


def test_garbled_texts_are_found_and_restored(spark: SparkSession, nothing, odd) -> None:
    clean = [t for t, _, _ in GARBLED] + ["Plain text, 20 °C. © story club ½ cup", "“É MINHA IRMÔ, disse ela.", "日本の話。"]
    rows = [(k, t) for k, t in enumerate(clean * 40)]
    bad = [(10_000 + k, t.encode(a).decode(b, "replace")) for k, (t, a, b) in enumerate(GARBLED)]
    df = spark.createDataFrame([*rows, *bad, (20_000, "ein B�r"), (None, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in encoding.restored(df).collect()}
    assert set(got) == {i for i, _ in bad} | {20_000}
    for k, (t, _, _) in enumerate(GARBLED):
        assert got[10_000 + k].restored == t
    assert got[20_000].chains == [encoding.LOST] and got[20_000].restored == "ein B�r"
    assert encoding.restored(nothing).collect() == []
    assert encoding.restored(odd).collect() == []


def test_rare_letters_are_restored(spark: SparkSession) -> None:
    clean = [t for t, _, _ in GARBLED] + ["Plain text.", "日本の話。"]
    rows = [(k, t) for k, t in enumerate(clean * 40)]
    once = "Однажды старик нашёл красный объект за мельницей, это был мяч."
    twice = "Der Müller fragte: „Wer hörte das Geräusch?“"
    bad = {
        1000: (once, once.encode("cp1251").decode("cp1252")),
        1001: (once, once.encode("utf-8").decode("gb18030", "ignore")),
        1002: (twice, twice.encode().decode("cp1252", "ignore").encode().decode("latin-1")),
    }
    df = spark.createDataFrame([*rows, *((k, b) for k, (_, b) in bad.items())], "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in encoding.restored(df).collect()}
    assert set(got) == set(bad)
    assert got[1000] == once
    assert len(set(got[1001].split()) & set(once.split())) >= 5


def test_texts_encoded_twice_are_restored(spark: SparkSession) -> None:
    clean = [t for t, _, _ in GARBLED] + ["Plain text.", "Der Bär sah ½ Brötchen: „Schön!“"]
    rows = [(k, t) for k, t in enumerate(clean * 40)]
    story = "Der Bär fragte: „Wer hörte das Geräusch?“ und aß ½ Brötchen."
    pairs = [("cp1252", "cp1252"), ("latin-1", "cp1252"), ("mac_roman", "mac_roman"), ("cp437", "cp437")]
    twice = {1000 + k: encoding.read_as(encoding.read_as(story.encode(), a).encode(), b) for k, (a, b) in enumerate(pairs)}
    df = spark.createDataFrame([*rows, *twice.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in encoding.restored(df).collect()}
    assert got == dict.fromkeys(twice, story)


def test_words_tell_garbled_stretches_from_correct_ones(spark: SparkSession) -> None:
    clean = ["Однажды старик нашёл красный мяч за мельницей.", "Утром сосед снова украл старое зеркало.", "Please don’t touch the lamp. It’s only a map."]
    rows = [(k, t) for k, t in enumerate(clean * 60)]
    russian = clean[0] + " " + clean[1].encode("koi8-r").decode("cp1251") + " " + clean[0]
    lowered = clean[0].lower() + " " + clean[1].lower().encode("koi8-r").decode("cp1251").lower()
    english = "The otter said, please don’t wait. " + "Please don’t touch the lamp.".encode("mac_roman").decode("cp1252") + " The lamp fell."
    df = spark.createDataFrame([*rows, (1000, russian), (1001, english), (1002, lowered)], "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in encoding.restored(df).collect()}
    assert got[1000] == " ".join([clean[0], clean[1], clean[0]])
    assert got[1001] == "The otter said, please don’t wait. Please don’t touch the lamp. The lamp fell."
    assert got[1002] == f"{clean[0]} {clean[1]}".lower() and len(got) == 3


def test_chains_are_picked_by_their_marks() -> None:
    rng = random.Random(15)
    letters = sorted({c for chain in encoding.chains() for m in chain.marks for c in m})
    for k in range(200):
        chars, is_lower = set(rng.sample(letters, rng.randint(0, 12))), k % 2 == 0
        assert list(encoding.possible(chars, is_lower)) == [c for c in encoding.chains() if c.may_be_in(chars, is_lower)]


def test_characters_are_counted_over_all_texts() -> None:
    seen = encoding.characters([(1, "é и"), (2, "é"), (2, "ж"), (3, "plain"), (4, "Ã©Ã©Ã© €")])
    assert seen == {"é": (2, 1, 2), "и": (1, 1, 1), "ж": (1, 2, 2)}
    made = encoding.with_known({"letters": "э".encode()}, seen, 5)
    costs = encoding.Costs(made)
    assert "é" in costs.known and "э" in costs.rare - costs.known and "ж" not in costs.rare
    assert costs.may_restore("Ñý", "э", "", True)
    chain = next(c for c in encoding.chains() if c.name == "cp1251 as cp1252")
    assert [p for p in chain.split(frozenset("один"))("îäèíжîäèí")] == [(0, 4, "один"), (5, 9, "один")]


def test_single_letters_of_one_byte_encodings_are_restored(spark: SparkSession) -> None:
    clean = [t for t, _, _ in GARBLED] + ["Der Müller öffnete die Tür.", "Der Bäcker trug ein Mädchen.", "日本の話。これは古い時計です。"]
    rows = [(k, t) for k, t in enumerate(clean * 40)]
    story = "Der {} trug den schweren Korb bis zum Fluss und wartete dort auf den alten Nachbarn."
    pairs = [("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]
    bad = {1000 + k: (story, "Müller", *pair) for k, pair in enumerate(pairs)}
    bad[1100] = (story, "Bäcker", "cp1252", "cp850")
    bad[1200] = ("{}", "これは古い時計です。", "shift_jis", "latin-1")
    garbled = [(k, t.format(w.encode(a).decode(b))) for k, (t, w, a, b) in bad.items()]
    df = spark.createDataFrame([*rows, *garbled], "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in encoding.restored(df).collect()}
    assert got == {k: t.format(w) for k, (t, w, _, _) in bad.items()}


def test_subjects_of_held_out_documents(spark: SparkSession, nothing) -> None:
    rng = random.Random(9)
    topics = {"law": "court judge trial appeal verdict".split(), "sport": "goal match team coach score".split()}
    filler = "garden river morning lantern kettle".split()

    def text(mix: list[str]) -> str:
        return " ".join(" ".join(rng.choice(topics.get(m, filler)) for _ in range(7)) + "." for m in mix)

    docs, labels = [], []
    for k in range(300):
        own = [[], ["law"], ["sport"], ["law", "sport"]][k % 4]
        docs.append((k, text([*own * 4, *["none"] * 4])))
        if k < 200:
            labels += [(k, s.upper() if k % 7 == 0 else s) for s in own or ["none"]]
    d = spark.createDataFrame([*docs, (None, "court."), (900, None), (901, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (5, None), (None, "law"), (6, "cookery")], "doc_id bigint, subject string")
    names = spark.createDataFrame([(1, "law"), (2, "sport")], "subject_id int, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects_of(d, lab, names).collect()}
    want = {(k, s) for k in range(300) for s in [[], ["law"], ["sport"], ["law", "sport"]][k % 4]}
    assert len(got & want) > 0.97 * len(want) and len(got - want) < 0.03 * len(want)
    assert subjects.subjects_of(nothing, lab, names).collect() == []
    assert subjects.subjects_of(d, lab.filter("false"), names).collect() == []
