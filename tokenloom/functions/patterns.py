"""Regular expressions of the pretokenizers, in Java's dialect and in Python's."""

from __future__ import annotations

import re

# The two public pretokenizer patterns, and the default special token.
GPT2 = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CS336 = r"""'(?:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"

PATTERNS = {"gpt2": GPT2, "cs336": CS336}


def python_pattern(name: str = "gpt2") -> str:
    """Pattern for Python's ``regex`` module, where ``$`` must mean the very end."""
    return _named(name).replace("$", r"\Z")


def java_pattern(name: str = "gpt2") -> str:
    """Pattern for Spark: Unicode classes on, ``$`` only at the very end."""
    return "(?U)" + _named(name).replace("$", r"\z")


def check_specials(specials: list[str] | None) -> list[str]:
    """Distinct special tokens, longest first; an empty token is an error."""
    specials = list(dict.fromkeys(specials or []))
    if any(not s for s in specials):
        raise ValueError("a special token must not be empty")
    return sorted(specials, key=lambda s: -len(s))


def segment_pattern(specials: list[str] | None) -> str:
    """Java pattern whose matches are the specials and the plain runs between them."""
    quoted = [java_quote(s) for s in check_specials(specials)]
    if not quoted:
        return r"(?s).+"
    any_of = "|".join(quoted)
    return f"(?s){any_of}|(?:(?!{any_of}).)+"


def java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def python_specials(specials: list[str] | None) -> re.Pattern[str] | None:
    specials = check_specials(specials)
    return re.compile("|".join(map(re.escape, specials))) if specials else None


def _named(name: str) -> str:
    if name not in PATTERNS:
        raise ValueError(f"pattern must be one of {sorted(PATTERNS)}, not {name!r}")
    return PATTERNS[name]
