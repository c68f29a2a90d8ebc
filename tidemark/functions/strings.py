"""String functions.  Offsets are code points unless said otherwise."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.freq import regex, replacement

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[ \t\n\r\x0B\f]"


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E" if text else ""


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def ascii_swapcase(x: Column) -> Column:
    return F.translate(x, UPPER + LOWER, LOWER + UPPER)


def ascii_capitalize(x: Column) -> Column:
    return F.concat(ascii_upper(F.substring(x, 1, 1)), ascii_lower(F.substr(x, F.lit(2))))


def utf8_lower(x: Column) -> Column:
    return F.lower(x)


#: Characters whose upper case is several: the simple mapping gives one, or the character itself.
_LONG = [c for c in map(chr, range(0x80, 0x1FFFF)) if len(c.upper()) > 1]
_SHORT = pc.utf8_upper(pa.array(_LONG)).to_pylist()
#: What stands for them while the rest is mapped: the last private code points.
_ASIDE = [chr(0x10FF00 + k) for k in range(len(_LONG))]


def utf8_upper(x: Column) -> Column:
    """Upper case, one character for one."""
    return F.translate(F.upper(F.translate(x, "".join(_LONG), "".join(_ASIDE))), "".join(_ASIDE), "".join(_SHORT))


def utf8_capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def utf8_swapcase(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def _title(x: Column, lower, upper, letter: str) -> Column:
    start = F.struct(F.lit("").alias("o"), F.lit(False).alias("p"))
    step = lambda a, c: F.struct(F.concat(a["o"], F.when(a["p"], c).otherwise(upper(c))).alias("o"), F.rlike(c, F.lit(letter)).alias("p"))
    return F.aggregate(F.split(lower(x), ""), start, step, lambda a: a["o"])


def utf8_title(x: Column) -> Column:
    """Upper case after any character that isn't a letter."""
    return _title(x, F.lower, F.upper, r"^\p{L}")


def ascii_title(x: Column) -> Column:
    return _title(x, ascii_lower, ascii_upper, "^[A-Za-z]")


def reverse(x: Column) -> Column:
    return F.reverse(x)


def utf8_length(x: Column) -> Column:
    return F.char_length(x)


def binary_length(x: Column) -> Column:
    return F.octet_length(x)


def repeat(x: Column, n: int) -> Column:
    return F.repeat(x, n)


def replace_slice(x: Column, start: int, stop: int, new: str) -> Column:
    """``x[:start] + new + x[stop:]`` with Python's slices; an end before the start counts as the start."""
    n = F.char_length(x)
    place = lambda k: F.least(n, F.lit(k)) if k >= 0 else F.greatest(F.lit(0), n + k)
    first = place(start)
    return F.concat(F.substr(x, F.lit(1), first), F.lit(new), F.substr(x, F.greatest(first, place(stop)) + 1))


def replace_substring(x: Column, old: str, new: str, most: int = -1) -> Column:
    if most < 0:
        return F.replace(x, F.lit(old), F.lit(new))
    return F.array_join(F.split(x, _quote(old), most + 1), new)


def replace_regex(x: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(x, regex(pattern), replacement(new))


#: Name -> pattern that the whole string must match.
CLASSES = {
    "ascii_is_alnum": "[A-Za-z0-9]+",
    "ascii_is_alpha": "[A-Za-z]+",
    "ascii_is_decimal": "[0-9]+",
    "utf8_is_alnum": r"[\p{L}\p{N}]+",
    "utf8_is_alpha": r"\p{L}+",
    "utf8_is_decimal": r"\p{Nd}+",
    "utf8_is_digit": r"\p{N}+",
    "utf8_is_numeric": r"\p{N}+",
    "utf8_is_space": r"(?U)\s+",
    "utf8_is_printable": r"[\P{C}&&[^\p{Z}]| ]*",
}


def is_class(x: Column, name: str) -> Column:
    return F.rlike(x, F.lit(f"^{CLASSES[name]}\\z"))


def ascii_is_lower(x: Column) -> Column:
    """Some ASCII letter, and none in upper case."""
    return F.rlike(x, F.lit("[a-z]")) & ~F.rlike(x, F.lit("[A-Z]"))


def ascii_is_upper(x: Column) -> Column:
    return F.rlike(x, F.lit("[A-Z]")) & ~F.rlike(x, F.lit("[a-z]"))


def ascii_is_title(x: Column) -> Column:
    return (x == ascii_title(x)) & F.rlike(x, F.lit("[A-Za-z]"))


def utf8_is_lower(x: Column) -> Column:
    return (x == F.lower(x)) & F.rlike(x, F.lit(r"\p{L}"))


def utf8_is_upper(x: Column) -> Column:
    return (x == F.upper(x)) & F.rlike(x, F.lit(r"\p{L}"))


def utf8_is_title(x: Column) -> Column:
    return (x == utf8_title(x)) & F.rlike(x, F.lit(r"\p{L}"))


def string_is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.char_length(x)


def lpad(x: Column, width: int, pad: str = " ") -> Column:
    """Longer strings stay as they are."""
    return F.when(F.char_length(x) >= width, x).otherwise(F.lpad(x, width, pad))


def rpad(x: Column, width: int, pad: str = " ") -> Column:
    return F.when(F.char_length(x) >= width, x).otherwise(F.rpad(x, width, pad))


def center(x: Column, width: int, pad: str = " ") -> Column:
    """An odd pad goes to the right."""
    n = F.char_length(x)
    left = F.concat(F.repeat(F.lit(pad), F.floor((width - n) / 2).cast("int")), x)
    return F.when(n >= width, x).otherwise(F.rpad(left, width, pad))


def trim(x: Column, characters: str = " ", side: str = "both") -> Column:
    """Strips a set of characters."""
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side](x, F.lit(characters))


def trim_whitespace(x: Column, side: str = "both", ascii_only: bool = False) -> Column:
    blank = _BLANK if ascii_only else r"\s"
    pattern = {"both": f"^{blank}+|{blank}+\\z", "left": f"^{blank}+", "right": f"{blank}+\\z"}[side]
    return F.regexp_replace(x, pattern if ascii_only else "(?U)" + pattern, "")


def slice_codeunits(x: Column, start: int, stop: int, step: int = 1) -> Column:
    """Python's ``x[start:stop:step]`` for a positive step."""
    n = F.char_length(x)
    place = lambda k: F.least(n, F.lit(k)) if k >= 0 else F.greatest(F.lit(0), n + k)
    first = place(start)
    part = F.substr(x, first + 1, F.greatest(F.lit(0), place(stop) - first))
    if step == 1:
        return part
    return F.array_join(F.filter(F.split(part, ""), lambda c, i: i % step == 0), "")


def split_whitespace(x: Column, most: int = -1, ascii_only: bool = False) -> Column:
    pattern = f"{_BLANK}+" if ascii_only else r"(?U)\s+"
    return F.split(x, pattern, most + 1 if most >= 0 else -1)


def split_pattern(x: Column, pattern: str, most: int = -1, from_right: bool = False) -> Column:
    limit = most + 1 if most >= 0 else -1
    if not from_right:
        return F.split(x, _quote(pattern), limit)
    parts = F.split(F.reverse(x), _quote(pattern[::-1]), limit)
    return F.reverse(F.transform(parts, F.reverse))


def split_regex(x: Column, pattern: str, most: int = -1) -> Column:
    return F.split(x, regex(pattern), most + 1 if most >= 0 else -1)


def extract_regex(x: Column, pattern: str) -> Column:
    """A struct of the named groups; null without a match."""
    java = regex(pattern)
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", java)
    return F.when(F.rlike(x, F.lit(java)), F.struct(*[F.regexp_extract(x, java, k + 1).alias(n) for k, n in enumerate(names)]))


def binary_join(x: Column, separator: str) -> Column:
    """Null if an element is null."""
    return F.when(~F.exists(x, lambda c: c.isNull()), F.array_join(x, separator))


def _folded(x: Column, pattern: str, ignore_case: bool) -> tuple[Column, str]:
    return (F.lower(x), pattern.lower()) if ignore_case else (x, pattern)


def count_substring(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    x, pattern = _folded(x, pattern, ignore_case)
    return F.regexp_count(x, F.lit(_quote(pattern)))


def count_regex(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(regex(pattern)))


def starts_with(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    x, pattern = _folded(x, pattern, ignore_case)
    return F.startswith(x, F.lit(pattern))


def ends_with(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    x, pattern = _folded(x, pattern, ignore_case)
    return F.endswith(x, F.lit(pattern))


def find_substring(x: Column, pattern: str) -> Column:
    """Byte offset of the first place, or -1."""
    return F.when(F.instr(x, pattern) == 0, F.lit(-1)).otherwise(F.octet_length(F.substring_index(x, pattern, 1)))


def match_like(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    return x.ilike(pattern) if ignore_case else x.like(pattern)


def match_substring(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    x, pattern = _folded(x, pattern, ignore_case)
    return F.contains(x, F.lit(pattern))


def match_regex(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.rlike(x, F.lit(("(?i)" if ignore_case else "") + regex(pattern)))


def is_in(x: Column, values: list, skip_nulls: bool = False) -> Column:
    """Never null: a null is in a set that holds a null, unless nulls are skipped."""
    known = [v for v in values if v is not None]
    found = F.coalesce(x.isin(*known), F.lit(False)) if known else F.lit(False)
    return F.when(x.isNull(), F.lit(None in values and not skip_nulls)).otherwise(found)


def index_in(x: Column, values: list, skip_nulls: bool = False) -> Column:
    """First position in the set; null if absent."""
    places: dict = {}
    for k, v in enumerate(values):
        places.setdefault(v, k)
    out = F.lit(None).cast("int")
    for v, k in places.items():
        if v is None:
            out = out if skip_nulls else F.when(x.isNull(), F.lit(k)).otherwise(out)
        else:
            out = F.when(x == F.lit(v), F.lit(k)).otherwise(out)
    return out
