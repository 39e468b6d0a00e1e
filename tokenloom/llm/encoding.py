"""Problem 3: text that was decoded with a wrong character encoding.

A chain is a pair (written, read): the bytes of one encoding, decoded by another. For each
chain the places of a text are looked up that could have come from it. With and without
undoing the chain there, they are compressed by a zstandard dictionary of the text's
language, and the shortest description wins, the cost of naming the chain included; if
none is shorter, the text stays as it is. This is repeated, for chains come in chains.

The dictionaries are trained on a bounded sample of the texts themselves. Which characters
are known, and so may be restored, is counted over all of them.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, id_text

#: Rows that the dictionaries are trained on, about; bytes of a dictionary, and of those that
#: the training texts are judged by; and of the rows the most texts of one language, those
#: with the least hash of their id.
SAMPLE, DICT_BYTES, PROBE_BYTES, PER_LANGUAGE = 6_000, 32 << 10, 8 << 10, 1_500
#: Bytes that naming a chain costs, and that a place of three characters or more is worth,
#: for hardly any other text decodes as UTF-8 at such a length, and one of replacement or
#: control characters.
CHAIN_COST, SURE = 1, 4
#: A chain of one-byte encodings, which says nothing about its places by itself, must save
#: this part of their description, unless the restored words are words of the corpus, so
#: many times as frequent as the words in their place, and in two texts at least. Half that
#: part will do where all its places in a text together save so many bytes.
ONE_BYTE_SHARE, MORE_FREQUENT, TOGETHER = 0.2, 10, 6
#: A restored character is known if it is in this part of all texts, and in two at least. It
#: is rare if it is in two texts or in an alphabet; that is enough in runs and places of three characters,
#: and for letters of an alphabet in shorter places that do not read as correct text.
KNOWN_PART = 0.0003
#: Least length of a part of a run that is restored where the whole run cannot be.
PART = 4
ROUNDS, AROUND, LEVEL = 4, 24, 12
#: The language of a text may be another one after undoing a chain in this part of it.
TURNED = 10

# Encodings that UTF-8 is wrongly read by, pairs of one-byte encodings, and
# frequent words that tell languages apart.
UTF8_READ_AS = (
    "cp1252 latin-1 cp1250 cp1251 cp437 cp850 cp866 mac_roman koi8-r".split()
)
ONE_BYTE = (
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"),
    ("cp866", "cp1251"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"),
    ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1252"), ("cp866", "latin-1"),
    ("cp866", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp1251", "mac_roman"),
    ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp437", "latin-1"), ("cp850", "cp1252"),
    ("cp850", "latin-1"), ("shift_jis", "cp1252"), ("shift_jis", "latin-1"),
    ("euc_jp", "cp1252"), ("euc_jp", "latin-1"),
)
CYRILLIC = ("cp1251", "koi8-r", "cp866")
LETTERS = "äöüßÄÖÜéèêëàâçîïôûùœÉÈÊÀÂÇÔñáíóúÑÁÍÓÚãõÃÕìòÌÒ"
MARKS = "“”‘’„—–…«»¿¡€£©°½"
FREQUENT = {
    "en": "the and was with that said".split(),
    "de": "der die und das ein den".split(),
    "fr": "le est et dans un était".split(),
    "es": "el una y en los había".split(),
    "pt": "o um uma não os levou".split(),
}
#: Letters that may be restored, however rare, if the sample has texts of the language.
ALPHABET = {
    "de": "äöüßÄÖÜẞ",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíñóúüÁÉÍÑÓÚÜ",
    "pt": "áâãàçéêíóôõúÁÂÃÀÇÉÊÍÓÔÕÚ",
    "ru": "".join(map(chr, range(0x410, 0x450))) + "ёЁ",
    "ja": "".join(map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FD)])),
}

_WORD = re.compile(r"[^\W\d_]+")
#: Shapes of places: characters that are no ASCII, next to each other or nearly so.
_RUN = re.compile(r"[^\x00-\x7f]{3}")
_DENSE = re.compile(r"[^\x00-\x7f](?:[ -~]?[^\x00-\x7f]){3}")
_LOST = re.compile("[�\x80-\x9f\uf8ff]+|(?<=[^\\W\\d_])[─-▟√≠≥⌐]+|[─-▟√≠≥⌐]+(?=[^\\W\\d_])")
_LOST_CHARS = frozenset(c for c in map(chr, range(0x80, 0x10000)) if _LOST.search(f"a{c}"))
#: The name of the chain whose characters cannot be had back.
LOST = "lost characters"


def byte_of(encoding: str) -> dict[int, str]:
    """Characters of the bytes from 128 on; holes of Windows encodings are control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            if encoding.startswith("cp125"):
                out[b] = chr(b)
    return out


def read_as(raw: bytes, encoding: str) -> str:
    """Bytes wrongly read; None where a byte has no character."""
    table = byte_of(encoding)
    return "".join(chr(b) if b < 128 else table[b] for b in raw)


Place = tuple[int, int, str]


class Chain:
    """One wrong reading: where it may have been, and how to undo it there.

    ``hint`` finds what every place holds, and ``shape`` is such a pattern that several
    chains share. Where a run may also hold correct words of the same letters (``by_word``),
    only its words that the corpus knows better when undone are places. ``split`` gives, for a set of characters, the parts of a run that give only these, for
    runs that cannot be undone as a whole.
    """

    def __init__(
        self,
        name: str,
        places: re.Pattern[str],
        undo: Callable[[str], str | None],
        marks: tuple[str, ...],
        cost: int = CHAIN_COST,
        share: float = 0.0,
        lowered: bool = False,
        split: Callable[[frozenset[str]], Callable[[str], Iterator[Place]]] | None = None,
        hint: re.Pattern[str] | None = None,
        shape: re.Pattern[str] | None = None,
        by_word: bool = False,
    ) -> None:
        self.name, self.places, self.undo, self.cost, self.share = name, places, undo, cost, share
        self.marks, self.lowered, self.split = [frozenset(m) for m in marks], lowered, split
        self.hint, self.shape, self.by_word = hint, shape, by_word

    def may_be_in(self, chars: set[str], is_lower: bool) -> bool:
        """Whether a text of these characters can hold a place; saves most searches."""
        if self.lowered and not is_lower:
            return False
        for m in self.marks:
            if m.isdisjoint(chars):
                return False
        return True


def _utf8_chain(encoding: str) -> Chain:
    table = byte_of(encoding)
    back = {c: b for b, c in table.items()}

    def chars(low: int, high: int) -> str:
        return "".join(re.escape(table[b]) for b in range(low, high) if b in table)

    tail = f"[{chars(0x80, 0xC0)}]"
    places = re.compile(
        f"(?:[{chars(0xC2, 0xE0)}]{tail}|[{chars(0xE0, 0xF0)}]{tail}{{2}}|[{chars(0xF0, 0xF5)}]{tail}{{3}})"
    )

    def undo(found: str) -> str | None:
        try:
            return bytes([back[c] for c in found]).decode()
        except (UnicodeDecodeError, KeyError):
            return None

    marks = ("".join(table.get(b, "") for b in span) for span in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return Chain(f"utf-8 as {encoding}", places, undo, tuple(marks))


def _twice_chain(outer: str, inner: str) -> Chain | None:
    """UTF-8 read as ``inner``, written as UTF-8 and read as ``outer``. Only the end of the
    two steps is judged, not the characters between them."""
    first, second = _utf8_chain(outer), _utf8_chain(inner)
    table = byte_of(outer)
    leads = {table.get(c.encode()[0], "") for c in second.marks[0]} - {""}
    if not leads:
        return None
    whole = re.compile(f"(?:{second.places.pattern})+").fullmatch

    def undo(found: str) -> str | None:
        once = first.undo(found)
        return second.undo(once) if once and whole(once) else None

    places = re.compile(f"(?:{first.places.pattern}){{2,}}")
    return Chain(f"{first.name}, after {second.name}", places, undo, ("".join(leads), "".join(first.marks[1])), 2 * CHAIN_COST)


def _lowered_chain(outer: str, inner: str | None = None) -> Chain | None:
    """UTF-8 read as ``outer``, or twice, and then put in lower case."""
    table = {}
    letters = LETTERS + MARKS + "".join(map(chr, range(0x410, 0x450))) + "ёЁ🙂🌟✨"
    for c in letters:
        try:
            seen = read_as((read_as(c.encode(), inner) if inner else c).encode(), outer)
        except KeyError:
            continue
        if seen.lower() != seen:
            table[seen.lower()] = c.lower()
    if not table:
        return None
    longest = sorted(table, key=lambda s: (-len(s), s))
    places = re.compile("|".join(map(re.escape, longest)))
    marks = ("".join(k[0] for k in table), "".join(k[-1] for k in table))
    name = f"utf-8 as {outer}" + (f", after utf-8 as {inner}" if inner else "")
    return Chain(f"{name}, in lower case", places, table.get, marks, lowered=True)


def _gb_chain() -> Chain:
    def undo(found: str) -> str | None:
        for end in (len(found), len(found) - 1):
            try:
                return found[:end].encode("gb18030").decode() + found[end:] if end else None
            except (UnicodeDecodeError, UnicodeEncodeError):
                pass
        return None

    def split(rare: frozenset[str]) -> Callable[[str], Iterator[Place]]:
        def parts(found: str) -> Iterator[Place]:
            raw = found.encode("gb18030", "replace")
            runs = list(_UTF8_RUN.finditer(raw))
            if not runs:
                return
            ends = [0]
            for c in found:
                ends.append(ends[-1] + len(c.encode("gb18030", "replace")))
            for m in runs:
                size, low, new = m.start(), None, ""
                for c in m.group().decode():
                    at = bisect.bisect_left(ends, size)
                    if ends[at] == size:
                        if low is not None and new:
                            yield low, at, new
                        low, new = at, ""
                    size += len(c.encode())
                    new += c
                at = bisect.bisect_left(ends, size)
                if low is not None and new and ends[at] == size:
                    yield low, at, new

        def joined(found: str) -> Iterator[Place]:
            out: list[Place] = []
            for a, b, then in parts(found):
                if rare.issuperset(then):
                    if out and out[-1][1] == a:
                        a, then = out[-1][0], out.pop()[2] + then
                    out.append((a, b, then))
            return iter(out)

        return joined

    marks = (map(chr, range(0x4E00, 0xA000)),)
    return Chain("utf-8 as gb18030", re.compile(r"[^\x00-\xff]+"), undo, marks, split=split)


#: Characters of two bytes of UTF-8 or more, next to each other.
_UTF8_RUN = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}){2,}"
)


def _one_byte_chain(written: str, read: str) -> Chain:
    table, into = byte_of(read), byte_of(written)
    back = {c: b for b, c in table.items()}
    hint = shape = None
    multi = written in ("shift_jis", "euc_jp")
    if written in ("cp1251", "koi8-r", "cp866") or multi:
        # Whole words of letters that are no ASCII; two in a row, or one of three letters.
        inside = "".join(re.escape(c) for b, c in table.items())
        # The second byte of a Japanese character may be ASCII.
        many = f"[{inside}](?:[ -~]?[{inside}]){{3,}}[ -~]?" if multi else f"[{inside}]{{3,}}(?:[ -@]*[{inside}]+)*"
        seen, shape = re.compile(many), _DENSE if multi else _RUN
        marks = "".join(table.values())
    else:
        usual = set(LETTERS + MARKS) - set("õ" if read == "cp850" else "")
        image = {table[b] for b, c in into.items() if c in LETTERS + MARKS and b in table}
        strange = "".join(re.escape(c) for c in sorted(image - usual)) or "￾"
        upper = "".join(re.escape(c) for c in sorted(image) if c.isupper())
        marks = "".join(image - usual) + "".join(c for c in image if c.isupper())
        capital = f"[{upper or strange}]"
        # Capitals within words, before another capital of a word, or behind its end.
        sign = f"(?:[{strange}]|(?<=[a-zß-ÿ]){capital}|{capital}(?=[A-Z][a-zß-ÿ])|(?<=[?!.,]){capital}(?![^\\W\\d_]))"
        seen, hint = re.compile(f"[^\\s]*{sign}[^\\s]*"), re.compile(sign)

    good = {c: into[b] for c, b in back.items() if b in into}
    fine, over = frozenset(map(chr, range(128))) | frozenset(good), str.maketrans(good)

    def undo(found: str) -> str | None:
        if multi:
            for end in (len(found), len(found) - 1):
                try:
                    raw = bytes([ord(c) if ord(c) < 128 else back[c] for c in found[:end]])
                    return raw.decode(written) + found[end:]
                except (UnicodeDecodeError, KeyError):
                    pass
            return None
        return found.translate(over) if fine.issuperset(found) else None

    def split(rare: frozenset[str]) -> Callable[[str], Iterator[Place]]:
        inside = "".join(re.escape(c) for c in sorted(fine) if c.translate(over) in rare)
        runs = re.compile(f"[{inside}]{{{PART},}}").finditer if inside else lambda found: ()
        return lambda found: ((m.start(), m.end(), m.group().translate(over)) for m in runs(found))

    by_one = None if multi else split
    return Chain(f"{written} as {read}", seen, undo, (marks,), 2, ONE_BYTE_SHARE, split=by_one, hint=hint, shape=shape, by_word=written in CYRILLIC and read in CYRILLIC)


@functools.cache
def chains() -> list[Chain]:
    out = [_utf8_chain(e) for e in UTF8_READ_AS] + [_gb_chain()]
    out += [c for e in UTF8_READ_AS if (c := _lowered_chain(e))]
    twice = [(e, f) for e in UTF8_READ_AS for f in dict.fromkeys((e, "cp1252", "latin-1"))]
    out += [c for pair in twice for make in (_twice_chain, _lowered_chain) if (c := make(*pair))]
    return out + [_one_byte_chain(*pair) for pair in ONE_BYTE]


@functools.cache
def _marked() -> tuple[dict[str, int], dict[str, int], int, int]:
    """For each character the chains it is a first or a second mark of, as bits; the chains
    with one kind of marks; and those of lower case."""
    first: dict[str, int] = {}
    second: dict[str, int] = {}
    single = lowered = 0
    for k, chain in enumerate(chains()):
        for known, marks in zip((first, second), chain.marks):
            for c in marks:
                known[c] = known.get(c, 0) | 1 << k
        single |= (len(chain.marks) == 1) << k
        lowered |= chain.lowered << k
    return first, second, single, lowered


def possible(chars: set[str], is_lower: bool) -> Iterator[Chain]:
    """The chains that ``may_be_in`` a text of these characters, in their order."""
    first, second, single, lowered = _marked()
    a, b = 0, single
    for c in chars:
        a |= first.get(c, 0)
        b |= second.get(c, 0)
    bits = a & b & (-1 if is_lower else ~lowered)
    every = chains()
    while bits:
        k = (bits & -bits).bit_length() - 1
        bits &= bits - 1
        yield every[k]


def language(text: str) -> str:
    """A guess for picking samples, by script and frequent words."""
    if regex.search(r"[\p{Hiragana}\p{Katakana}]", text):
        return "ja"
    if len(regex.findall(r"\p{Cyrillic}", text)) * 3 > len(text):
        return "ru"
    count = {}
    for w in _WORD.findall(text.lower()):
        count[w] = count.get(w, 0) + 1
    score = {k: sum(count.get(w, 0) for w in ws) for k, ws in FREQUENT.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] else "other"


def train(texts: list[str], per_language: int = PER_LANGUAGE, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language that the texts have, and their ``letters``. Texts that
    look wrongly read, or consist of characters that hardly any other has, are left out."""
    by: dict[str, list[bytes]] = {}
    kinds = [{c for c in set(t) if c > "\x7f"} for t in texts]
    often = Counter(c for k in kinds for c in k)
    least = max(2, KNOWN_PART * len(texts))
    for t, own in zip(texts, kinds):
        strange = sum(often[c] < least for c in own)
        if t and 2 * strange <= len(own) and not _LOST.search(t) and _plain(t):
            mine = by.setdefault(language(t), [])
            if len(mine) < per_language:
                mine.append(t.encode("utf-8", "surrogatepass"))
    out = {}
    out["letters"] = "".join(ALPHABET.get(name, "") for name in sorted(by)).encode()
    for name, samples in sorted(by.items()):
        try:
            out[name] = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            out[name] = b"\n".join(samples)[-size:]
    return out


def trained(texts: list[str], per_language: int = PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionaries of the texts that do not look like cases, by words and by small
    dictionaries of all, in which wrong readings, being rare, hardly find room."""
    seen = {c: of for c, of in characters(list(enumerate(texts))).items() if of[1] < of[2]}
    first = Costs(with_known(train(texts, per_language, PROBE_BYTES), seen, len(texts)))
    clean = [t for t in texts if t.isascii() or not (suspicious(t, first) or restore(t, first)[1])]
    return train(clean, per_language)


def suspicious(text: str, costs: Costs) -> bool:
    """Whether a text has places that decode well or give frequent words, whatever they save:
    such a text must not teach how correct ones look."""
    chars, is_lower = {c for c in set(text) if c > "\x7f"}, text == text.lower()
    for chain in possible(chars, is_lower):
        if not chain.shape or chain.shape.search(text):
            for a, b, then in _places(chain, text, costs):
                if chain.by_word or (b - a > 2 and not chain.share) or (chain.share and costs.confirms(text[a:b], then)):
                    return True
    return False


def _plain(text: str) -> bool:
    """Whether a text has few places that look wrongly read."""
    if text.isascii():
        return True
    chars = set(text)
    for chain in chains()[: len(UTF8_READ_AS)]:
        if chain.name.endswith(("mac_roman", "koi8-r", "cp866")) or not chain.may_be_in(chars, False):
            continue
        found = [m for m in map(re.Match.group, chain.places.finditer(text)) if chain.undo(m)]
        if len(found) > 2 or any(len(m) > 2 for m in found):
            return False
    return True


Seen = dict[str, tuple[int, int, int]]


def characters(rows: list[tuple[int, str]]) -> Seen:
    """For the characters of plain texts with any that are no ASCII, and for the words, the
    number of texts, and the least and the largest id. ASCII characters are left out."""
    out: Seen = {}
    for i, t in rows:
        if not t.isascii() and _plain(t):
            words = {w for w in _WORD.findall(t.lower()) if len(w) > 1}
            for c in words.union(t):
                if c != "\ufffd" and (len(c) > 1 or c > "\x7f"):
                    n, low, high = out.get(c, (0, i, i))
                    out[c] = n + 1, min(i, low), max(i, high)
    return out


def with_known(made: dict[str, bytes], seen: Seen, texts: int) -> dict[str, bytes]:
    """The dictionaries with the ``known`` and the ``rare`` characters, and the ``words``."""
    ascii_ = set(map(chr, range(128)))
    often = {c for c, (_, low, high) in seen.items() if low < high}
    rare = {c for c in often if len(c) == 1}
    words = "\n".join(f"{w} {seen[w][0]}" for w in sorted(often - rare))
    known = {c for c in rare if seen[c][0] >= KNOWN_PART * texts}
    letters = set(made.get("letters", b"").decode())
    more = {"known": known | ascii_, "rare": rare | letters | ascii_, "letters": letters}
    return made | {k: "".join(sorted(v)).encode() for k, v in more.items()} | {"words": words.encode()}


class Costs:
    """Description lengths by the dictionaries of the languages, and the known characters."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.by = {}
        self.lengths: dict[tuple[str, str], int] = {}
        self.splits: dict[str, Callable[[str], Iterator[Place]]] = {}
        names = ("known", "rare", "letters")
        self.known, self.rare, self.letters = (set(dictionaries.get(k, b"").decode()) for k in names)
        lines = dictionaries.get("words", b"").decode().split("\n")
        self.words = {w: int(n) for w, _, n in (x.partition(" ") for x in lines) if w}
        for name, data in dictionaries.items():
            if name in (*names, "words"):
                continue
            kind = zstandard.DICT_TYPE_AUTO
            held = zstandard.ZstdCompressionDict(data, dict_type=kind)
            held.precompute_compress(level=LEVEL)
            self.by[name] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False
            )
        if not self.by:
            self.by["none"] = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def split(self, chain: Chain) -> Callable[[str], Iterator[Place]]:
        """How the chain splits runs into parts of the rare characters."""
        if chain.name not in self.splits:
            self.splits[chain.name] = chain.split(frozenset(self.rare))
        return self.splits[chain.name]

    def language(self, text: str) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        return min(self.by, key=lambda k: len(self.by[k].compress(raw)))

    def may_restore(self, found: str, then: str, before: str, run: bool) -> bool:
        """Whether the characters are known, or rare ones will do at this place."""
        if self.known.issuperset(then):
            return True
        if run:
            return all(c in self.rare or c in MARKS for c in then)
        natural = self.known.issuperset(found) and not (before.islower() and found[0].isupper())
        if not natural and len(found) > 2:
            return all(c in self.rare or c in MARKS for c in then)
        return not natural and all(c in self.known or c in self.letters for c in then)

    def confirms(self, found: str, then: str) -> bool:
        """Whether at least half of the restored words are words of the corpus, where there are
        no such words."""
        old, new = ([self.words.get(w, 0) for w in _WORD.findall(t.lower()) if len(w) > 1] for t in (found, then))
        least = max(2, MORE_FREQUENT * max(old, default=0))
        return bool(new) and 2 * sum(n >= least for n in new) >= len(new)

    def known_of(self, text: str, name: str) -> int:
        """The same as ``of``, remembered while one text is looked at."""
        key = text, name
        if key not in self.lengths:
            self.lengths[key] = self.of(text, name)
        return self.lengths[key]

    def of(self, text: str, name: str) -> int:
        return len(self.by[name].compress(text.encode("utf-8", "surrogatepass")))


def restore(text: str, costs: Costs) -> tuple[str, list[str]]:
    """The text with its chains undone where that is shorter, and the chains' names.

    Places near each other are decided on together, with the text around them.
    """
    if text.isascii():
        return text, []
    used: list[str] = []
    costs.lengths.clear()
    for _ in range(ROUNDS):
        best, was = (0, text, ""), ""
        chars, is_lower = {c for c in set(text) if c > "\x7f"}, text == text.lower()
        shapes = {None: True}
        for chain in possible(chars, is_lower):
            if chain.shape not in shapes:
                shapes[chain.shape] = chain.shape.search(text) is not None
            if not shapes[chain.shape]:
                continue
            places = _places(chain, text, costs)
            if not places:
                continue
            was = was or costs.language(text)
            names = {was}
            if TURNED * sum(b - a for a, b, _ in places) >= len(text):
                names.add(costs.language(_applied(text, places)))
            kept, saved, rest = [], -chain.cost, []
            for group in _groups(places):
                gain, before = _gain(text, group, costs, names)
                sure = not chain.share and any(b - a > 2 for a, b, _ in group)
                if chain.share and gain < chain.share * before:
                    rest.append((gain, before, group))
                    group = [p for p in group if chain.by_word or costs.confirms(text[p[0] : p[1]], p[2])]
                    if not group:
                        continue
                    gain, before = _gain(text, group, costs, names)
                    sure = True
                if sure and not chain.share:
                    gain += SURE
                least = 1 if sure and chain.share else max(chain.cost + 1, chain.share * before)
                if gain >= least:
                    kept += group
                    saved += gain + 2 * (sure and chain.share > 0)
            total = sum(gain for gain, _, _ in rest)
            if total >= TOGETHER and 2 * total >= chain.share * sum(before for _, before, _ in rest):
                kept = sorted({p for _, _, group in rest for p in group}.union(kept))
                saved += total
            if kept and saved > best[0]:
                best = (saved, _applied(text, kept), chain.name)
        if not best[0]:
            break
        text = best[1]
        used.append(best[2])
    if not _LOST_CHARS.isdisjoint(text) and lost(text, costs):
        used.append(LOST)
    return text, used


def lost(text: str, costs: Costs) -> bool:
    """Whether the text is described in fewer bytes, the chain's cost included, without the
    characters that stand where others were lost."""
    places = [(m.start(), m.end(), "") for m in _LOST.finditer(text)]
    if not places:
        return False
    names = {costs.language(text)}
    for group in _groups(places):
        # No correct text holds the first two kinds.
        sure = any(c == "\ufffd" or c < "\xa0" for a, b, _ in group for c in text[a:b])
        if _gain(text, group, costs, names)[0] + SURE * sure > CHAIN_COST:
            return True
    return False


def _gain(text: str, group: list[Place], costs: Costs, names: set[str]) -> tuple[int, int]:
    """What undoing saves of the description of the places and the text around, and the latter."""
    low, high = max(0, group[0][0] - AROUND), group[-1][1] + AROUND
    now = text[low:high]
    moved = [(a - low, b - low, new) for a, b, new in group]
    before = min(costs.known_of(now, name) for name in names)
    return before - min(costs.of(_applied(now, moved), name) for name in names), before


def _places(chain: Chain, text: str, costs: Costs) -> list[Place]:
    new: dict[tuple[str, bool], list[Place]] = {}
    out = []
    if chain.hint and not chain.hint.search(text):
        return out
    for m in chain.places.finditer(text):
        found, at = m.group(), m.start()
        if chain.by_word:
            out += [(at + a, at + b, then) for a, b, then in _better_words(chain, found, text, costs)]
            continue
        before = text[at - 1 : at]
        key = found, before.islower()
        if key not in new:
            then, run = chain.undo(found), chain.split is not None
            if then and then != found and costs.may_restore(found, then, before, run):
                new[key] = [(0, len(found), then)]
            else:
                new[key] = _parts(chain, found, costs)
        out += [(at + a, at + b, then) for a, b, then in new[key]]
    return out


def _better_words(chain: Chain, found: str, text: str, costs: Costs) -> Iterator[Place]:
    """Stretches of words that are frequent in the corpus when undone and not as they are;
    unknown words between these go with them."""
    first = last = None
    lowered = text == text.lower()
    for m in [*_WORD.finditer(found), None]:
        new = m and chain.undo(m.group())
        count = new and costs.words.get(new.lower(), 0)
        now = m and costs.words.get(m.group().lower(), 0)
        if count and count >= max(2, MORE_FREQUENT * now):
            first, last = m.start() if first is None else first, m.end()
        elif first is not None and (m is None or new is None or now):
            then = chain.undo(found[first:last])
            if then:
                yield first, last, then.lower() if lowered else then
            first = None


def _parts(chain: Chain, found: str, costs: Costs) -> list[Place]:
    """The parts of a run whose characters can all be restored."""
    if chain.split is None or len(found) < PART:
        return []
    return [(a, b, then) for a, b, then in costs.split(chain)(found) if b - a >= PART and then != found[a:b]]


def _groups(places: list[Place]) -> Iterator[list[Place]]:
    group = [places[0]]
    for p in places[1:]:
        if p[0] - group[-1][1] > 2 * AROUND:
            yield group
            group = []
        group.append(p)
    yield group


def _applied(text: str, places: list[Place]) -> str:
    out, done = [], 0
    for a, b, new in places:
        out += (text[done:a], new)
        done = b
    return "".join(out) + text[done:]


def dictionaries(
    df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, per_language: int = PER_LANGUAGE
) -> dict[str, bytes]:
    """Dictionaries trained in one task on about ``sample`` rows, picked by a hash of the id,
    and the known and rare characters and words, counted over all rows.

    One scan gives both. Words come to the driver only if they are in two texts and in one
    of 10,000, ASCII words if they are in one of 1,000, so there are at most so many times
    as many as an average text has.
    """
    rows = id_text(df, id_col, text_col).filter("id is not null and text <> ''")
    n = df.count()
    part = int(1_000_000 * min(1.0, sample / max(1, n)))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    kind = "c string, n bigint, low bigint, high bigint"

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, places = (batch.column(k).to_pylist() for k in range(3))
            seen = characters(list(zip(ids, texts)))
            out = [(c, *of) for c, of in seen.items()]
            out.append(("", len(ids), 0, 0))
            out += [(t, -1, h, i) for i, t, h in zip(ids, texts, places) if h < part]
            names = [x.split()[0] for x in kind.split(", ")]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    def learn(key: tuple, of: pa.Table) -> pa.Table:
        made = trained(of.sort_by([("low", "ascending"), ("high", "ascending")])["c"].to_pylist(), per_language)
        return pa.table({"language": pa.array(list(made)), "data": pa.array(list(made.values()), pa.binary())})

    looked = cut(rows.withColumn("place", place).mapInArrow(look, kind))
    made = dict(looked.filter("n < 0").groupBy("n").applyInArrow(learn, "language string, data binary").collect())
    counted = looked.filter("n > 0").groupBy("c").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    texts = counted.filter("c = ''").first()
    many = texts["n"] if texts else 0
    least = F.when(F.col("c").rlike("^[a-z]+$"), max(2, many // 1_000)).otherwise(max(2, many // 10_000))
    seen = counted.filter((F.col("low") < F.col("high")) & ((F.length("c") == 1) | (F.col("n") >= least))).collect()
    return with_known(made, {c: tuple(of) for c, *of in seen}, many)


def restored(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, chains, restored`` of the texts in which a wrong reading was found.

    ``restored`` is the text with the chains undone, as far as they can be; ``chains`` names
    them in the order in which they were undone, and last ``lost characters`` where some
    cannot be had back. Null, empty and plain
    ASCII texts have none. Repeated rows come out as often, rows without an id do not.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionaries(df, id_col, text_col, sample))

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(shared.value)
        for batch in it:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text.isascii():
                    continue
                new, used = restore(text, costs)
                if used:
                    rows.append((i, used, new))
            if rows:
                ids, used, new = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(used, pa.list_(pa.string())), pa.array(new)],
                    ["doc_id", "chains", "restored"],
                )

    rows = id_text(df, id_col, text_col).filter("id is not null and text <> ''")
    return rows.mapInArrow(find, "doc_id bigint, chains array<string>, restored string")
