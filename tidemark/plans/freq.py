"""Frequency rules such as ``3T``, ``2D`` or ``MS``."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

MICROS = {"N": 0, "U": 1, "us": 1, "L": 1_000, "ms": 1_000, "S": 1_000_000, "T": 60_000_000, "min": 60_000_000, "H": 3_600_000_000, "hrs": 3_600_000_000, "D": 86_400_000_000, "W": 7 * 86_400_000_000}
#: Months per step of a calendar unit; the S forms fall on a period's start.
MONTHS = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "Y": 12, "YS": 12}
#: First letters of ``downsample`` rules.
LETTERS = {"u": "microsecond", "U": "microsecond", "m": "millisecond", "L": "millisecond", "S": "second", "T": "minute", "H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


@dataclass(frozen=True)
class Rule:
    """A step of fixed length (micros) or of months."""

    count: int
    unit: str

    @property
    def micros(self) -> int | None:
        return MICROS[self.unit] * self.count if self.unit in MICROS else None

    @property
    def months(self) -> int | None:
        return MONTHS[self.unit] * self.count if self.unit in MONTHS else None

    def __mul__(self, k: int) -> Rule:
        return Rule(self.count * k, self.unit)


def parse(rule: str | timedelta | Rule) -> Rule:
    """Digits, if any, then a unit; anything else is an error."""
    if isinstance(rule, Rule):
        return rule
    if isinstance(rule, timedelta):
        return Rule(round(rule / timedelta(microseconds=1)), "U")
    if not (m := re.fullmatch(r"(\d*)([A-Za-z]+)", rule)) or m[2] not in MICROS and m[2] not in MONTHS and m[2] != "WS":
        raise ValueError(f"unknown frequency: {rule!r}")
    count = int(m[1] or 1)
    if count < 1:
        raise ValueError("a frequency must be positive")
    return Rule(count, "W" if m[2] == "WS" else m[2])


def split(rule: str) -> tuple[int, str]:
    """("3T") -> (3, "T"): digits and letters are both needed."""
    if not (m := re.fullmatch(r"(\d+)([A-Za-z]+)", rule)):
        raise ValueError(f"not a number and a unit: {rule!r}")
    return int(m[1]), m[2]


def calendar_unit(rule: str) -> tuple[int, str]:
    """(multiple, unit) of a ``downsample`` rule, by the first letter of its unit."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", rule)
    if not m or m[2][0] not in LETTERS:
        raise ValueError(f"unknown calendar unit: {rule!r}")
    return int(m[1] or 1), LETTERS[m[2][0]]


_DATE = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}


def date_pattern(c_pattern: str) -> str:
    """A C date pattern as Spark's; tokens without a counterpart are an error."""
    out = []
    for token in re.findall(r"%.?|[A-Za-z']+|[^%A-Za-z']+", c_pattern, re.S):
        if token[0] == "%":
            if token[1:] not in _DATE:
                raise ValueError(f"unsupported date token in {c_pattern!r}")
            out.append(_DATE[token[1:]])
        elif token[0].isalpha() or token[0] == "'":
            out.append("'" + token.replace("'", "''") + "'")
        else:
            out.append(token)
    return "".join(out)


def regex(re2: str) -> str:
    """An RE2 pattern for Java's engine: named groups differ."""
    return re.sub(r"\(\?P<", "(?<", re2)


def replacement(re2: str) -> str:
    r"""An RE2 replacement (``\1``) for Java's engine (``$1``)."""
    return re.sub(r"\\(\d)", r"$\1", re2.replace("$", r"\$"))
