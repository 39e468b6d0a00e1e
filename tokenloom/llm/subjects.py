"""Problem 8: the subject areas of a document.

Each subject has an interpolated model of pairs of words, and so has the background, the
texts of no subject: the probability of a word after another is a part of how often the
subject has the pair, a part of how often it has the word, and a part of how often all
texts have it. A sentence deals with a subject whose model gives it fewer bits per word than the background does,
by more than the margin of that subject; with several, if they come near the best one. A document
deals with every subject of more than a fifth of its sentences. The margins and how near
is near are calibrated on labelled documents that the models have not seen.

Labels are given for documents, not for sentences, so training is repeated: the sentences
of a labelled document start with its subjects, and after each round only those that the
models themselves give to one of these subjects stay with it; the others go to the
background.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import id_text
from tokenloom.llm.words import Words, chunks, mix, words

#: Bounds of what the models are fitted on: about so many labelled documents, and of these
#: only those of at most so many characters.
SAMPLE, LONGEST = 8_000, 50_000
#: Parts of the interpolation: of the pairs behind a frequent word, and of all texts; and
#: the occurrences of a word that give its pairs half their part.
PAIR_PART, COMMON_PART, HALF = 0.5, 0.1, 8
#: Rounds of training, and the bits per word that keep a sentence with a subject there.
ROUNDS, KEPT = 2, 0.1
#: One document in so many is held out to calibrate on.
HELD = 5
MARGINS = np.arange(0.0, 4.01, 0.05)
NEAR = (0.0, 0.25, 0.5, 1.0)
SHARE = 5
_SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”]*|\s*[\r\n]+\s*")
_JAPANESE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LETTER = regex.compile(r"\p{L}").search
_U = np.uint64


class Models(NamedTuple):
    """Bits that each subject saves against the background, by column: ``pair`` for the
    sorted hashes ``pairs``; for other pairs ``after`` of the first word and ``word`` of the
    second, by the sorted hashes ``words``. Words that are not there say nothing."""

    names: list[str]
    words: np.ndarray
    pairs: np.ndarray
    word: np.ndarray
    after: np.ndarray
    pair: np.ndarray
    margin: np.ndarray
    near: float


def sentences(text: str) -> list[str]:
    """Sentences with at least one letter."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return [s for s in out if _LETTER(s)]


class Grams:
    """The words and pairs of the sentences of some texts; 0 stands before the first word."""

    def __init__(self, texts: list[str]) -> None:
        parts, of = [], []
        for k, text in enumerate(texts):
            mine = sentences(text)
            parts += mine
            of += [k] * len(mine)
        self.of = np.array(of, np.int64)
        self.n, self.texts = len(parts), len(texts)
        w: Words = words([_spread(p) for p in parts])
        self.word, self.sentence = w.hash, w.doc
        self.before = np.zeros(len(w.hash), np.uint64)
        self.before[1:] = w.hash[:-1]
        first = np.ones(len(w.hash), bool)
        first[1:] = w.doc[1:] != w.doc[:-1]
        self.before[first] = 0
        self.pair = mix(self.before + self.word * _U(3))
        self.start = np.flatnonzero(first)
        self.words = np.bincount(w.doc, minlength=self.n)
        self.all = np.bincount(self.of, minlength=self.texts)

    def per_sentence(self, gain: np.ndarray) -> np.ndarray:
        """Mean over the words of each sentence."""
        out = np.zeros((self.n, gain.shape[1]), np.float32)
        out[self.sentence[self.start]] = np.add.reduceat(gain, self.start)
        return out / np.maximum(self.words, 1).astype(np.float32)[:, None]


def _spread(sentence: str) -> str:
    """Text without spaces between words gets them between its characters."""
    if _JAPANESE.search(sentence):
        return " ".join(a + b for a, b in zip(sentence, sentence[1:] + " "))
    return sentence


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array, -1 where they are not."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def scores(m: Models, g: Grams) -> np.ndarray:
    """Bits per word that each subject saves against the background, by sentence."""
    out = np.zeros((g.n, len(m.names)), np.float32)
    if not len(g.word) or not len(m.words):
        return out
    word, pair = _places(m.words, g.word), _places(m.pairs, g.pair)
    before = np.r_[-1, word[:-1]]
    before[g.start] = -1
    seen = pair >= 0
    backed = np.flatnonzero((word >= 0) & ~seen)
    both = backed[before[backed] >= 0]
    seen = np.flatnonzero(seen)
    gain = np.zeros((len(word), len(m.names)), np.float32)
    gain[seen] = m.pair[pair[seen]]
    gain[backed] = m.word[word[backed]]
    gain[both] += m.after[before[both]]
    return g.per_sentence(gain)


def dealt(m: Models, s: np.ndarray) -> np.ndarray:
    """Which subjects each sentence deals with."""
    if not len(s):
        return np.zeros(s.shape, bool)
    return (s > m.margin) & (s >= s.max(axis=1, keepdims=True) - m.near)


def shares(which: np.ndarray, g: Grams) -> np.ndarray:
    """Sentences of each subject by text."""
    out = np.zeros((g.texts, which.shape[1]), np.int64)
    sentence, k = np.nonzero(which)
    np.add.at(out, (g.of[sentence], k), 1)
    return out


def fit(texts: list[str], labels: list[frozenset[str]], names: list[str]) -> Models:
    """Models from labelled texts; an empty set of labels means no subject."""
    held = np.arange(len(texts)) % HELD == HELD - 1
    allowed = np.array([[n in x for n in names] for x in labels], bool).reshape(len(texts), len(names))
    if not allowed.any():
        none = np.zeros(0, np.uint64)
        table = np.zeros((0, len(names)), np.float16)
        return Models(names, none, none, table, table, table, np.full(len(names), np.inf), 0.0)
    g = Grams([t for t, h in zip(texts, held) if not h])
    own = allowed[~held][g.of]
    share = own / np.maximum(own.sum(axis=1), 1)[:, None]
    m = _models(names, g, share)
    for _ in range(ROUNDS):
        m = _models(names, g, _kept(m, g, own))
    m = _calibrated(m, Grams([t for t, h in zip(texts, held) if h]), allowed[held])
    g = Grams(texts)
    whole = _models(names, g, _kept(m, g, allowed[g.of]))
    return whole._replace(margin=m.margin, near=m.near)


def _kept(m: Models, g: Grams, own: np.ndarray) -> np.ndarray:
    """Each sentence with the best of its document's subjects, or with none."""
    s = np.where(own, scores(m, g), -np.inf)
    best = s.argmax(axis=1)
    ok = np.flatnonzero(s[np.arange(len(s)), best] > KEPT)
    share = np.zeros(s.shape)
    share[ok, best[ok]] = 1
    return share


def _models(names: list[str], g: Grams, share: np.ndarray) -> Models:
    """Log2 ratios of the interpolated probabilities to those of the background."""
    known, word = np.unique(g.word, return_inverse=True)
    pairs, first, pair = np.unique(g.pair, return_index=True, return_inverse=True)
    # The start of a sentence is a context of its own behind all words.
    context = np.where(g.before == 0, len(known), _places(known, g.before))
    of_pair, in_pair = context[first], word[first]
    common = np.bincount(word, minlength=len(known)) / max(1, len(word))
    logs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(len(names) + 1):
        weight = (share[:, k] if k < len(names) else np.maximum(1 - share.sum(axis=1), 0))[g.sentence]
        n = np.bincount(word, weight, len(known))
        before = np.bincount(context, weight, len(known) + 1)
        alone = (1 - COMMON_PART) * n / max(n.sum(), 1) + COMMON_PART * common
        part = PAIR_PART * before / (before + HALF)
        seen = np.bincount(pair, weight, len(pairs)) / np.maximum(before, 1e-9)[of_pair]
        p = part[of_pair] * seen + (1 - part[of_pair]) * alone[in_pair]
        logs.append((np.log2(alone), np.log2(1 - part[:-1]), np.log2(p)))
    tables = (
        np.stack([(own - rest).astype(np.float16) for own, rest in zip(kind[:-1], kind[-1:] * len(names))], axis=1)
        for kind in zip(*logs)
    )
    return Models(names, known, pairs, *tables, np.full(len(names), KEPT), 0.0)


def _calibrated(m: Models, g: Grams, want: np.ndarray) -> Models:
    """The margin of each subject, and how near to the best one is near enough, with the
    best balance of found and true subjects of documents.

    A subject takes the margin nearest to that of all subjects together among those that
    are as good as its best one but for half a document.
    """
    s = scores(m, g)
    if not len(s):
        return m
    best = s.max(axis=1, keepdims=True)
    true = want.sum(axis=0)
    found: list[tuple[float, Models]] = []
    for near in NEAR:
        right, got = (np.zeros((len(MARGINS), len(m.names)), np.int64) for _ in range(2))
        for k in range(len(m.names)):
            close = s[:, k] >= best[:, 0] - near
            for j, x in enumerate(MARGINS):
                n = np.bincount(g.of[close & (s[:, k] > x)], minlength=g.texts)
                ok = n * SHARE > g.all
                right[j, k], got[j, k] = (ok & want[:, k]).sum(), ok.sum()
        balance = 2 * right / np.maximum(1, got + true)
        whole = 2 * right.sum(axis=1) / np.maximum(1, got.sum(axis=1) + true.sum())
        good = np.flatnonzero(whole >= whole.max() - 0.003)
        middle = good[len(good) // 4]
        enough = balance >= balance.max(axis=0) - 0.5 / np.maximum(1, true)
        far = np.where(enough, np.abs(np.arange(len(MARGINS)) - middle)[:, None], len(MARGINS))
        at = far.argmin(axis=0)
        hits, other = right[at, range(len(at))].sum(), got[at, range(len(at))].sum()
        found.append((2 * hits / max(1, other + true.sum()), m._replace(margin=MARGINS[at], near=near)))
    return max(found, key=lambda f: (f[0], -f[1].near))[1]


def labelled(docs: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE) -> DataFrame:
    """``text, given`` of at most about ``sample`` labelled documents, picked by a hash of
    their ids; ``given`` lists the subjects as spelled in ``names``. Labels that are null or
    unknown are left out, ``none`` gives an empty list. Documents of more than ``LONGEST``
    characters are not fitted on."""
    known = F.create_map(*(F.lit(v) for n in [*names, "none"] for v in (n.lower(), n)))
    clean = labels.select(
        F.col("doc_id").alias("id"), F.element_at(known, F.lower(F.trim("subject"))).alias("s")
    ).filter("id is not null and s is not null")
    given = clean.groupBy("id").agg(F.array_remove(F.collect_set("s"), "none").alias("given"))
    n = given.count()
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    texts = id_text(docs, "doc_id", "text").filter((F.col("text") != "") & (F.length("text") <= LONGEST))
    # The sample is bounded, so it goes to the texts and these stay where they are.
    return texts.join(F.broadcast(given.filter(part)), "id").select("id", "text", "given")


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> Models:
    """Models fitted in one task on the bounded sample of labelled documents."""
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect()]
    names.sort()

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        given = [frozenset(x) for x in rows["given"].to_pylist()]
        m = fit(rows["text"].to_pylist(), given, names)
        return pa.table({"model": pa.array([zstandard.compress(pickle.dumps(m), 1)], pa.binary())})

    rows = labelled(docs, labels, names, sample).withColumn("one", F.lit(1))
    made = rows.groupBy("one").applyInArrow(learn, "model binary").collect()
    return pickle.loads(zstandard.decompress(made[0][0])) if made else fit([], [], names)


def subjects_of(
    docs: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id, subject, sentences, of_all`` for each subject of each document.

    A document has a subject if more than a fifth of its sentences deal with it. Null,
    empty and wordless texts and rows without an id have none; repeated rows come out as
    often. Without labels no subject is found.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, subjects, sample)
    packed = zstandard.compress(pickle.dumps(model), 1)
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha1(packed).hexdigest(), packed))

    def classify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _held(shared.value)
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, 500_000):
                g = Grams(texts[a:b])
                n = shares(dealt(m, scores(m, g)), g)
                doc, k = np.nonzero(n * SHARE > g.all[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[a + d] for d in doc], pa.int64()),
                        pa.array([m.names[j] for j in k], pa.string()),
                        pa.array(n[doc, k]),
                        pa.array(g.all[doc]),
                    ],
                    ["doc_id", "subject", "sentences", "of_all"],
                )

    rows = id_text(docs, id_col, text_col).filter("id is not null and text <> ''")
    return rows.mapInArrow(
        classify, "doc_id bigint, subject string, sentences bigint, of_all bigint"
    )


_MODEL: dict[str, Models] = {}


def _held(named: tuple[str, bytes]) -> Models:
    """The models in a worker, which unpacks them once."""
    name, packed = named
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = pickle.loads(zstandard.decompress(packed))
    return _MODEL[name]
