"""Syntax tree of the query language."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


class QueryError(ValueError):
    """The query text is not in the language."""


@dataclass(frozen=True)
class Term:
    """field is one of FIELDS; value is kept as written. whole: name terms match whole words only."""

    field: str
    value: str
    whole: bool = False


@dataclass(frozen=True)
class Size:
    low: int | None
    high: int | None  # both inclusive


@dataclass(frozen=True)
class Date:
    low: dt.date | None
    high: dt.date | None  # both inclusive


@dataclass(frozen=True)
class Fuzzy:
    value: str
    distance: int


@dataclass(frozen=True)
class Whole:
    """Whole-word mode, as it stands in the text; applied() turns it into a property of the query's name terms."""

    on: bool


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


Node = Term | Size | Date | Fuzzy | Whole | Not | And | Or
FIELDS = ("name", "content", "author", "camera", "lens", "artist", "album", "title", "ext", "path", "regex")


def canonical(node: Node | None) -> str:
    """One text per tree, the key of result caches."""
    match node:
        case None:
            return "*"
        case Term(field, value, whole):
            return f'{field}:"{value}"' + ("w" if whole else "")
        case Size(low, high):
            return f"size:{'' if low is None else low}..{'' if high is None else high}"
        case Date(low, high):
            return f"dm:{low or ''}..{high or ''}"
        case Fuzzy(value, distance):
            return f'fuzzy:"{value}"~{distance}'
        case Whole(on):
            return f"whole:{'yes' if on else 'no'}"
        case Not(child):
            return f"(NOT {canonical(child)})"
        case And(left, right):
            return f"({canonical(left)} AND {canonical(right)})"
        case Or(left, right):
            return f"({canonical(left)} OR {canonical(right)})"
    raise TypeError(node)


def terms(node: Node | None) -> list[Term]:
    """All terms, left to right; those under NOT as well."""
    match node:
        case Term():
            return [node]
        case Not(child):
            return terms(child)
        case And(left, right) | Or(left, right):
            return terms(left) + terms(right)
    return []


def positive(node: Node | None) -> list[Term]:
    """The terms a match may hold: those not under NOT, left to right."""
    match node:
        case Term():
            return [node]
        case And(left, right) | Or(left, right):
            return positive(left) + positive(right)
    return []


def applied(node: Node | None) -> Node | None:
    """node without Whole: a flag is no condition, so it leaves the tree (negated as well), and name terms carry it. None if nothing else is there."""
    on = _flagged(node)

    def build(n: Node | None) -> Node | None:
        match n:
            case None | Whole():
                return None
            case Term("name", value, whole):
                return Term("name", value, whole or on)
            case Not(child):
                inner = build(child)
                return None if inner is None else Not(inner)
            case And(left, right) | Or(left, right):
                a, b = build(left), build(right)
                return b if a is None else a if b is None else type(n)(a, b)
        return n

    return build(node)


def _flagged(node: Node | None) -> bool:
    match node:
        case Whole(on):
            return on
        case Not(child):
            return _flagged(child)
        case And(left, right) | Or(left, right):
            return _flagged(left) or _flagged(right)
    return False
