"""Text, number and array scalars as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip sees it: Unicode white space and four separators; the same one by one.
SPACE = r"[\s\x{1c}-\x{1f}]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Line breaks as str.splitlines sees them.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: A run of digits with inner or trailing separators.
NUMERIC_RUN = r"(?U)\d[\d.,/]*"


def reverse_text(x: Column) -> Column:
    """By code points."""
    return F.reverse(x)


def split_lines(x: Column) -> Column:
    """Lines without their breaks; a final break adds none, an empty text has none."""
    parts = F.split(x, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def reverse_lines(x: Column) -> Column:
    return F.array_join(F.transform(split_lines(x), lambda line: F.reverse(line)), "\n")


def map_runs(x: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """``x`` with each match of ``pattern`` replaced by ``body`` of it."""
    gaps = F.split(x, pattern, -1)
    runs = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), body)
    return F.array_join(F.zip_with(gaps, runs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")


def unreverse_numbers(x: Column) -> Column:
    """Each numeric run in place, its characters in reverse."""
    return map_runs(x, NUMERIC_RUN, lambda r: F.reverse(r))


def strip_ws(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def strip_cell(x: Column) -> Column:
    """As strip_ws, for a column of texts of which most begin and end with plain characters."""
    plain = lambda c: c.between("!", "~")
    return F.when(plain(F.substring(x, 1, 1)) & plain(F.substring(x, -1, 1)), x).otherwise(strip_ws(x))


def collapse_ws(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, f"(?U){SPACE}+", " "))


def drop_ws(x: Column) -> Column:
    return F.regexp_replace(x, f"(?U){SPACE}+", "")


def normalize_text(x: Column) -> Column:
    """White space collapsed, the characters of each numeric run sorted."""
    return sorted_numbers(collapse_ws(x))


def sorted_numbers(x: Column) -> Column:
    return map_runs(x, NUMERIC_RUN, lambda r: F.array_join(F.array_sort(F.split(r, "")), ""))


def section_between(x: Column, start: str, ends: Sequence[str]) -> Column:
    """What follows the first ``start`` up to the nearest of ``ends``, or the end of the
    text, stripped; empty without ``start``."""
    quoted = lambda text: "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    stop = "|".join([*map(quoted, ends), r"\z"])
    return strip_ws(F.regexp_extract(x, rf"(?s){quoted(start)}(.*?)(?:{stop})", 1))


def first_capture(x: Column, pattern: str, group: int = 1) -> Column:
    """Stripped; empty without a match."""
    return strip_ws(F.regexp_extract(x, pattern, group))


def all_captures(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def zero_pad_code(x: Column, width: int = 6) -> Column:
    """Zeros in front up to ``width``, after a sign; longer codes stay whole."""
    sign = F.regexp_extract(x, r"\A[+-]", 0)
    missing = F.greatest(F.lit(width) - F.length(x), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), missing), F.substring(x, F.length(sign) + 1, F.length(x)))


def clean_name(x: Column) -> Column:
    """Lines reversed and stripped; those without a letter, digit or underscore dropped;
    the rest joined by spaces. Null gives an empty name."""
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda line: strip_ws(F.reverse(line)))
    return strip_ws(F.array_join(F.filter(lines, lambda line: line.rlike(r"(?U)\w")), " "))


def rejoin_final_letter(x: Column, letters: str) -> Column:
    """A letter that stands alone after a word goes back to it."""
    return F.regexp_replace(x, rf"(?U)(\S) ({letters})(?=\s|\z)", "$1$2")


def letterhead(x: Column, letters: str, n: int = 3) -> Column:
    """The first ``n`` lines with a letter, stripped, final letters re-joined."""
    # Only lines that stay are put right; as a rule they are among the first.
    own = lambda text: F.filter(F.split(text, LINE_BREAK, -1), lambda line: line.rlike(letters))
    enough = F.filter(F.array(own(F.substring_index(x, "\n", 2 * n))), lambda lines: F.size(lines) >= n)
    lines = F.slice(F.coalesce(F.get(enough, F.lit(0)), own(x)), 1, n)
    return F.transform(lines, lambda line: rejoin_final_letter(strip_ws(line), letters))


def url_slug(url: Column) -> Column:
    """The last run of digits in the file's stem, else the stem made safe, else doc."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, "([^/]+)/*$", 1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    safe = F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "_")
    return F.coalesce(F.try_element_at(F.regexp_extract_all(stem, F.lit(r"\d+"), F.lit(0)), F.lit(-1)), F.nullif(safe, F.lit("")), F.lit("doc"))


def url_cache_key(url: Column) -> Column:
    """File name of a fetched URL; null for what is not fetched."""
    return F.when(url.startswith("http://") | url.startswith("https://"), F.concat(F.sha2(url, 256), F.lit(".pdf")))


def format_thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def cap_text(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def escape_lines(x: Column) -> Column:
    """Markup characters escaped, lines joined by <br/>, a space for nothing."""
    safe = F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(safe == "", F.lit(" ")).otherwise(F.array_join(F.split(safe, "\n"), "<br/>"))


def parse_number(x: Column) -> Column:
    """A double from digits with optional sign in front, commas and decimals; else null."""
    return parse_bare(strip_ws(x))


def parse_bare(x: Column) -> Column:
    """As parse_number, of a text that is stripped."""
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), bare.try_cast("double"))


def ordered_distinct(xs: Column) -> Column:
    return F.array_distinct(xs)


def decision_links(raw: Column) -> Column:
    """Links to numbered decisions, the first of each number, in order of appearance."""
    urls = F.transform(F.regexp_extract_all(raw, F.lit(r"(?U)https?://\S+"), F.lit(0)), lambda u: F.rtrim(u, F.lit('".,)”–- ')))
    keyed = F.filter(F.transform(urls, lambda u: F.struct(u.alias("url"), F.regexp_extract(u, r"dec[_-]?(\d+)", 1).alias("key"))), lambda s: s["key"] != "")
    none = F.expr("cast(array() AS array<struct<url:string,key:string>>)")
    firsts = F.aggregate(keyed, none, lambda acc, s: F.when(F.exists(acc, lambda a: a["key"] == s["key"]), acc).otherwise(F.array_append(acc, s)))
    return F.transform(firsts, lambda s: s["url"])


def numbered_join(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def first_anchor(x: Column, anchors: Sequence[str]) -> Column:
    """The first of ``anchors``, in their order, that the text has."""
    return F.coalesce(*[F.when(x.contains(a), F.lit(a)) for a in anchors])


def has_marker(x: Column, marker: str) -> Column:
    """Whether reversed page text has the marker, white space left aside."""
    return drop_ws(F.array_join(F.transform(split_lines(F.coalesce(x, F.lit(""))), lambda line: F.reverse(line)), "")).contains("".join(marker.split()))
