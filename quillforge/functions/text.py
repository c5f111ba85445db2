"""Text expressions that the operators share; all are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() and split() take for white space.
SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words of three letters and more, as Python's [^\W\d_] has letters.
LETTERS = r"[\p{L}\p{Nl}\p{No}]{3,}"
#: Words in a sample of a text.
SAMPLE = 12


def java(pattern: str) -> str:
    """A pattern with the white space and line ends that Python has."""
    return pattern.replace(r"\s", SPACE).replace("(?m)", "(?dm)")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


#: The characters of SPACE.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def lines(c: Column) -> Column:
    """Like splitlines(): an end of line at the end of the text opens no further line."""
    rows = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")
    return let(rows, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def fold(c: Column) -> Column:
    """casefold() for Latin scripts."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def count_matches(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).cast("long")


def evenly_spaced(n: Column, k: int) -> Column:
    """At most k indices from 0 to n - 1, at equal distances, halves to even."""
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(spaced)


def word_sample(source: Column) -> Column:
    """Every (n // SAMPLE)-th of the source's distinct words in order, the first SAMPLE of them."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(LETTERS), F.lit(0)), fold)))
    step = lambda v: F.greatest(F.floor(F.size(v) / SAMPLE), F.lit(1)).cast("int")
    return let(found, lambda v: F.slice(F.filter(v, lambda w, i: i % step(v) == 0), 1, SAMPLE))
