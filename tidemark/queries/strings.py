"""String functions (survey rows T1-T29, J8, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as s
from .base import scalar

c = F.col
N, TXT = "p_name", "text"
P, K = ["p_partkey"], ["conv_id", "turn"]
MIX = "CASE WHEN p_partkey % 5 = 0 THEN p_name || '-É ' || p_type WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END"


def mix():
    return F.expr(MIX)


def put(name, columns, source="conversations", keys=None):
    scalar(name, source, keys or (K if source == "conversations" else P), columns)


put("t01_ascii_case", {"l": (lambda: s.ascii_lower(c(TXT)), f"translate(text, '{s.UPPER}', '{s.LOWER}')"), "u": (lambda: s.ascii_upper(c(TXT)), f"translate(text, '{s.LOWER}', '{s.UPPER}')")})
put("t02_utf8_case", {"l": (lambda: s.utf8_lower(c(TXT)), "lower(text)"), "u": (lambda: s.utf8_upper(c(TXT)), "upper(text)")})
put("t03_capitalize", {"u": (lambda: s.utf8_capitalize(c(TXT)), "upper(substr(text, 1, 1)) || lower(substr(text, 2))"), "a": (lambda: s.ascii_capitalize(c(TXT)), f"translate(substr(text, 1, 1), '{s.LOWER}', '{s.UPPER}') || translate(substr(text, 2), '{s.UPPER}', '{s.LOWER}')")})


TITLE = "array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({x}, i - 1, 1), '^{k}') THEN lower(substr({x}, i, 1)) ELSE upper(substr({x}, i, 1)) END), '')"
put("t04_title", {"u": (lambda: s.utf8_title(mix()), TITLE.format(x=f"({MIX})", k="\\p{L}")), "a": (lambda: s.ascii_title(c("p_brand")), TITLE.format(x="p_brand", k="[A-Za-z]"))}, "part")
put("t05_swapcase", {"a": (lambda: s.ascii_swapcase(c(TXT)), f"translate(text, '{s.UPPER}{s.LOWER}', '{s.LOWER}{s.UPPER}')")})
put("t05_utf8_swapcase", {"u": (lambda: s.utf8_swapcase(mix()), f"array_to_string(list_transform(string_split({MIX}, ''), lambda k: CASE WHEN k = upper(k) THEN lower(k) ELSE upper(k) END), '')")}, "part")
put("t06_reverse", {"r": (lambda: s.reverse(c(TXT)), "reverse(text)")})
put("t07_utf8_length", {"n": (lambda: s.utf8_length(c(TXT)).cast("long"), "CAST(length(text) AS BIGINT)")})
put("t08_binary_length", {"n": (lambda: s.binary_length(c(TXT)).cast("long"), "CAST(strlen(text) AS BIGINT)")})
put("t09_repeat", {"r": (lambda: s.repeat(mix(), 3), f"repeat({MIX}, 3)")}, "part")
put("t10_replace_slice", {"a": (lambda: s.replace_slice(mix(), 1, 3, "XY"), f"substr({MIX}, 1, 1) || 'XY' || substr({MIX}, 4)"), "b": (lambda: s.replace_slice(c(N), 0, -2, ""), "substr(p_name, greatest(length(p_name) - 1, 1))")}, "part")
put("t11_replace_substring", {"all": (lambda: s.replace_substring(c(TXT), "e", "<>"), "replace(text, 'e', '<>')"), "first": (lambda: s.replace_substring(c(TXT), ".", "!", 1), "CASE WHEN strpos(text, '.') = 0 THEN text ELSE substr(text, 1, strpos(text, '.') - 1) || '!' || substr(text, strpos(text, '.') + 1) END")})
put("t12_replace_regex", {"y": (lambda: s.replace_regex(c(TXT), r"([a-z]+) ([a-z]+)", r"\2 \1"), r"regexp_replace(text, '([a-z]+) ([a-z]+)', '\2 \1', 'g')")})
put("t13_ascii_predicates", {k: (lambda k=k: s.is_class(mix(), k), f"regexp_full_match({MIX}, '{s.CLASSES[k]}')") for k in ("ascii_is_alnum", "ascii_is_alpha", "ascii_is_decimal")} | {"lower": (lambda: s.ascii_is_lower(c(N)), "regexp_matches(p_name, '[a-z]') AND NOT regexp_matches(p_name, '[A-Z]')"), "title": (lambda: s.ascii_is_title(c("p_brand")), "p_brand = " + TITLE.format(x="p_brand", k="[A-Za-z]"))}, "part")
put("t14_utf8_predicates", {"alnum": (lambda: s.is_class(mix(), "utf8_is_alnum"), f"regexp_full_match({MIX}, '[\\p{{L}}\\p{{N}}]+')"), "alpha": (lambda: s.is_class(c("p_type"), "utf8_is_alpha"), "regexp_full_match(p_type, '\\p{L}+')"), "decimal": (lambda: s.is_class(c("p_size").cast("string"), "utf8_is_decimal"), "true"), "digit": (lambda: s.is_class(mix(), "utf8_is_digit"), f"regexp_full_match({MIX}, '\\p{{N}}+')"), "numeric": (lambda: s.is_class(c("p_size").cast("string"), "utf8_is_numeric"), "true"), "space": (lambda: s.is_class(mix(), "utf8_is_space"), f"regexp_full_match({MIX}, '\\s+')"), "printable": (lambda: s.is_class(mix(), "utf8_is_printable"), f"({MIX}) = ({MIX})"), "lower": (lambda: s.utf8_is_lower(c(N)), "p_name = lower(p_name) AND regexp_matches(p_name, '\\p{L}')"), "upper": (lambda: s.utf8_is_upper(c("p_type")), "p_type = upper(p_type) AND regexp_matches(p_type, '\\p{L}')"), "title": (lambda: s.utf8_is_title(c("p_brand")), "p_brand = " + TITLE.format(x="p_brand", k="\\p{L}"))}, "part")
put("t15_is_ascii", {"y": (lambda: s.string_is_ascii(c(TXT)), "length(text) = strlen(text)")})
put("t16_pads", {"c": (lambda: s.center(mix(), 12, "*"), f"CASE WHEN length({MIX}) >= 12 THEN ({MIX}) ELSE rpad(repeat('*', (12 - length({MIX})) // 2) || ({MIX}), 12, '*') END"), "l": (lambda: s.lpad(mix(), 10, "0"), f"CASE WHEN length({MIX}) >= 10 THEN ({MIX}) ELSE lpad({MIX}, 10, '0') END"), "r": (lambda: s.rpad(mix(), 10, "0"), f"CASE WHEN length({MIX}) >= 10 THEN ({MIX}) ELSE rpad({MIX}, 10, '0') END")}, "part")
put("t17_trims", {"b": (lambda: s.trim(c(TXT), "ÉELOa."), "trim(text, 'ÉELOa.')"), "l": (lambda: s.trim(c(TXT), "ÉELOa.", "left"), "ltrim(text, 'ÉELOa.')"), "r": (lambda: s.trim(c(TXT), "nas.", "right"), "rtrim(text, 'nas.')")})
put("t18_trim_whitespace", {k: (lambda k=k, a=a, side=side: s.trim_whitespace(F.concat(F.lit(" \t"), mix(), F.lit("\n ")), side, a), f"regexp_replace(chr(32) || chr(9) || ({MIX}) || chr(10) || chr(32), '{p}', '', 'g')") for k, a, side, p in (("b", True, "both", "^\\s+|\\s+$"), ("l", True, "left", "^\\s+"), ("r", True, "right", "\\s+$"), ("ub", False, "both", "^\\s+|\\s+$"))}, "part")
put("t19_slice_codeunits", {"a": (lambda: s.slice_codeunits(c(TXT), 2, 9), "substr(text, 3, 7)"), "n": (lambda: s.slice_codeunits(c(TXT), 0, -3), "substr(text, 1, greatest(length(text) - 3, 0))"), "s": (lambda: s.slice_codeunits(c(TXT), 0, 9, 2), "array_to_string(list_transform(range(1, 10, 2), lambda i: substr(text, i, 1)), '')")})
put("t20_split_whitespace", {"n": (lambda: F.size(s.split_whitespace(c(N), ascii_only=True)).cast("long"), "CAST(len(string_split_regex(p_name, '\\s+')) AS BIGINT)"), "x": (lambda: F.element_at(s.split_whitespace(c(N)), 1), "string_split_regex(p_name, '\\s+')[1]"), "rest": (lambda: F.element_at(s.split_whitespace(c(N), 1), 2), "substr(p_name, strpos(p_name, ' ') + 1)")}, "part")
put("t21_split_pattern", {"n": (lambda: F.size(s.split_pattern(c(TXT), ". ")).cast("long"), "CAST(len(string_split(text, '. ')) AS BIGINT)"), "last": (lambda: F.element_at(s.split_pattern(c(TXT), ". ", 1, from_right=True), -1), "string_split(text, '. ')[-1]"), "rx": (lambda: F.size(s.split_regex(c(TXT), "[.,] ?")).cast("long"), "CAST(len(string_split_regex(text, '[.,] ?')) AS BIGINT)")})
put("t22_extract_regex", {"word": (lambda: s.extract_regex(c("p_brand"), r"^(?P<word>[A-Za-z]+)#(?P<num>1\d)$")["word"], "CASE WHEN regexp_matches(p_brand, '^([A-Za-z]+)#(1\\d)$') THEN regexp_extract(p_brand, '^([A-Za-z]+)#(1\\d)$', 1) END"), "num": (lambda: s.extract_regex(c("p_brand"), r"^(?P<word>[A-Za-z]+)#(?P<num>1\d)$")["num"], "CASE WHEN regexp_matches(p_brand, '^([A-Za-z]+)#(1\\d)$') THEN regexp_extract(p_brand, '^([A-Za-z]+)#(1\\d)$', 2) END")}, "part")
put("t23_binary_join", {"y": (lambda: s.binary_join(F.array(mix(), c("p_type")), "+"), f"({MIX}) || '+' || p_type")}, "part")
put("t24_count_substring", {"n": (lambda: s.count_substring(c(TXT), "le").cast("long"), "CAST((length(text) - length(replace(text, 'le', ''))) // 2 AS BIGINT)"), "i": (lambda: s.count_substring(c(TXT), "LE", True).cast("long"), "CAST((length(lower(text)) - length(replace(lower(text), 'le', ''))) // 2 AS BIGINT)"), "rx": (lambda: s.count_regex(c(TXT), "[aeiou]n").cast("long"), "CAST(len(regexp_extract_all(text, '[aeiou]n')) AS BIGINT)")})
put("t25_starts_ends_with", {"a": (lambda: s.starts_with(c(TXT), "é", True), "starts_with(lower(text), 'é')"), "b": (lambda: s.ends_with(c(TXT), "."), "ends_with(text, '.')")})
put("t26_find_substring", {"y": (lambda: s.find_substring(c(TXT), "ai").cast("long"), "CASE WHEN strpos(text, 'ai') = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(strlen(substr(text, 1, strpos(text, 'ai') - 1)) AS BIGINT) END")})
put("t27_match_like", {"a": (lambda: s.match_like(c(N), "%b_l%"), "p_name LIKE '%b_l%'"), "b": (lambda: s.match_like(c(N), "%RING", True), "p_name ILIKE '%RING'")}, "part")
put("t28_match_substring", {"a": (lambda: s.match_substring(c(TXT), "EAU", True), "contains(lower(text), 'eau')"), "b": (lambda: s.match_regex(c(TXT), "(?i)[aeiou]{3}[ .]"), "regexp_matches(text, '(?i)[aeiou]{3}[ .]')")})
SET = ["ECONOMY", None, "SMALL"]
TY = "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END"
put("t29_j08_is_in", {"a": (lambda: s.is_in(F.expr(TY), SET), f"coalesce(({TY}) IN ('ECONOMY', 'SMALL'), true)"), "b": (lambda: s.is_in(F.expr(TY), SET, True), f"coalesce(({TY}) IN ('ECONOMY', 'SMALL'), false)")}, "part")
put("t29_j09_index_in", {"a": (lambda: s.index_in(F.expr(TY), SET), f"CASE WHEN ({TY}) IS NULL THEN 1 WHEN ({TY}) = 'ECONOMY' THEN 0 WHEN ({TY}) = 'SMALL' THEN 2 END")}, "part")
