"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the code points that Python's str.strip() removes
WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PLACEHOLDER = "<STR>"
# possessive, since a greedy group recurses once per character of a literal
LITERAL = r'(?s)"(?:[^"\\]|\\.)*+\\?("?)'


def mask_literals(c: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Each double-quoted literal's content becomes the placeholder; an unterminated one runs to the end and stays open."""
    return F.regexp_replace(c, LITERAL, f'"{placeholder}$1')


def literal_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LITERAL))


def strip(c: Column) -> Column:
    """Without white space at both ends, by the Unicode rule."""
    return F.btrim(c, F.lit(WS))


def rstrip_newlines(c: Column) -> Column:
    return F.rtrim(c, F.lit("\n"))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_count(c: Column) -> Column:
    """Newlines plus one."""
    return F.size(lines(c))


def nonblank_lines(c: Column) -> Column:
    """The lines that hold more than white space, as they are."""
    return F.filter(lines(c), lambda x: ~is_blank(x))


def substring_count(c: Column, pattern: str) -> Column:
    """Occurrences from left to right that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(pattern), F.lit("")))) / F.lit(len(pattern))).cast("bigint")


def preview(c: Column, n: int = 120) -> Column:
    return F.substring(c, 1, n)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def truthy_field(record: Column, fields: tuple[str, ...]) -> Column:
    """The first truthy of a variant's fields, as a variant: "", 0, false, null, [] and {} fall through."""

    def one(name: str) -> Column:
        v = F.try_variant_get(record, f"$['{name}']", "variant")
        s = F.to_json(v)
        return F.when(v.isNotNull() & ~F.is_variant_null(v) & ~s.isin('""', "0", "0.0", "-0.0", "false", "[]", "{}"), v)

    return F.coalesce(*(one(f) for f in fields))


def usable_string(v: Column) -> Column:
    """The stripped text of a variant that is a string and not blank, else null."""
    s = strip(F.try_variant_get(v, "$", "string"))
    return F.when(F.schema_of_variant(v) == "STRING", F.when(s != "", s))
