"""Errors of the stream language; a source's semantic errors are collected."""

from __future__ import annotations

from dataclasses import dataclass


class LanguageError(Exception):
    """Base of everything that a source text can be wrong about."""


class LexError(LanguageError):
    def __init__(self, kind: str, at: int, detail: str = ""):
        super().__init__(f"{kind} at {at}" + (f": {detail}" if detail else ""))
        self.kind, self.at, self.detail = kind, at, detail


class ParseError(LanguageError):
    def __init__(self, kind: str, at: int, expected: str, found: str = ""):
        super().__init__(f"{kind} at {at}: expected {expected}" + (f", found {found!r}" if found else ""))
        self.kind, self.at, self.expected, self.found = kind, at, expected, found


@dataclass(frozen=True)
class Issue:
    kind: str
    name: str = ""
    detail: str = ""

    def __str__(self) -> str:
        return " ".join(x for x in (self.kind, self.name, self.detail) if x)


class AnalysisError(LanguageError):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(map(str, issues)))
        self.issues = issues

    @property
    def kinds(self) -> list[str]:
        return [i.kind for i in self.issues]


class MigrationError(LanguageError):
    """kind: hash_mismatch (with the statement's index), language_error or structural_error."""

    def __init__(self, kind: str, message: str, statement_index: int | None = None):
        super().__init__(message)
        self.kind, self.statement_index = kind, statement_index


class ConstraintError(Exception):
    """Rows that a stream does not accept: a violated check, a null, a length, a repeated key."""
