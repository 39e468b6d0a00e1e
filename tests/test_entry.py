"""The driver's contract."""

from __future__ import annotations

import builtins
import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query() -> None:
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_a_missing_library_is_an_error_and_a_missing_part_is_not(monkeypatch) -> None:
    found = builtins.__import__

    def without(name: str):
        def load(module: str, *args: object) -> object:
            if module == "tokenloom.llm":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return found(module, *args)

        return load

    try:
        monkeypatch.setattr(builtins, "__import__", without("tokenloom.llm"))
        assert not any(q.startswith("p1_") for q in importlib.reload(entry).queries())
        monkeypatch.setattr(builtins, "__import__", without("zstandard"))
        with pytest.raises(ModuleNotFoundError, match="zstandard"):
            importlib.reload(entry)
    finally:
        monkeypatch.undo()
        importlib.reload(sys.modules["__spark_entry__"])
