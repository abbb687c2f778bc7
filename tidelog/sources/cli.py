"""Statements from lines of text; ~quit ends."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from ..engine import Engine
from ..lang.errors import ConstraintError, LanguageError


def run(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        text = line.strip()
        if text == "~quit":
            return
        if not text:
            continue
        try:
            results = engine.execute(text)
        except (LanguageError, ConstraintError) as e:
            yield f"error: {e}"
            continue
        yield "; ".join(f"{x.count()} rows" if isinstance(x, DataFrame) else f"{x} inserted" for x in results) or "ok"
