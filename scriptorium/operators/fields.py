"""Summary fields of a letter by rules: text(doc_id, raw, readable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..profile import Profile


def reversed_date(x: Column, label: str) -> Column:
    """The date after the label, its characters in reverse; empty without one."""
    return F.reverse(F.regexp_extract(x, rf"(?U){label}\s*:?\s*(\d{{1,4}}[./]\d{{1,2}}[./]\d{{2,4}})", 1))


def request_numbers(x: Column, profile: Profile) -> Column:
    """Request numbers, once each and put right, then the committee's; what is missing is
    left out."""
    found = t.all_captures(x, rf"(?U){profile.request_label}\s*(\d{{3}}-\d{{2}})")
    right = lambda r: F.array_join(F.transform(F.split(r, "-"), lambda run: F.reverse(run)), "-")
    numbers = F.array_join(F.array_distinct(F.transform(found, right)), ", ")
    pattern = rf"(?U){profile.committee_pattern}\s*:?\s*([^\n]+)"
    committee = F.when(x.rlike(pattern), F.concat(F.lit(profile.committee_label + ": "), t.first_capture(x, pattern)))
    return F.concat_ws(" | ", F.nullif(numbers, F.lit("")), committee)


def breakdown_raw(x: Column, profile: Profile) -> Column:
    """The section after the first start anchor, in order of priority, that occurs."""
    return F.coalesce(*[F.when(x.contains(a), t.section_between(x, a, profile.breakdown_ends)) for a in profile.breakdown_starts], F.lit(""))


def program_codes(section: Column, profile: Profile) -> Column:
    """Codes after the program word, then those that lead a line; reversed, once each."""
    after = t.all_captures(section, rf"(?U){profile.program_word}\s*:?\s*(\d{{5,6}})")
    leading = t.all_captures(section, r"(?Um)^\s*(\d{5,6})\s*:")
    return F.array_distinct(F.transform(F.concat(after, leading), lambda c: F.reverse(c)))


def program_breakdown(section: Column, profile: Profile) -> Column:
    """The section with numbers put right and program prefixes taken out."""
    right = F.regexp_replace(t.unreverse_numbers(section), rf"(?U){profile.program_word}\s*\d{{5,6}}\s*:?\s*", "")
    return F.regexp_replace(right, r"(?Um)^\s*\d{5,6}\s*:\s*", "")


def flag_with_exclusion(x: Column, profile: Profile) -> Column:
    """No if the text denies it, yes if it says so, else no."""
    return F.when(x.rlike("(?U)" + profile.negative_pattern), profile.no).when(x.rlike("(?U)" + profile.positive_pattern), profile.yes).otherwise(profile.no)


def phrase_flag(x: Column, profile: Profile) -> Column:
    return F.when(x.rlike("(?U)" + profile.change_pattern), profile.yes).otherwise(profile.no)


def request_fields(text: DataFrame, profile: Profile) -> DataFrame:
    """doc_id and the eight fields as strings, in the profile's order under f0 to f7."""
    x = F.coalesce("readable", F.lit(""))
    rows = text.withColumn("_b", breakdown_raw(x, profile))
    values = [
        reversed_date(x, profile.date_label),
        request_numbers(x, profile),
        F.array_join(program_codes(F.col("_b"), profile), ", "),
        t.section_between(x, *profile.gist),
        program_breakdown(F.col("_b"), profile),
        t.numbered_join(t.decision_links(F.coalesce("raw", F.lit("")))),
        flag_with_exclusion(x, profile),
        phrase_flag(x, profile),
    ]
    return rows.select("doc_id", *[v.alias(f"f{k}") for k, v in enumerate(values)])


def fields_long(wide: DataFrame, profile: Profile, method: str = "parse") -> DataFrame:
    """doc_id, method, field_no, field, value: a row per field, missing ones empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("field_no"), F.lit(name).alias("field"), F.coalesce(f"f{k}", F.lit("")).alias("value")) for k, name in enumerate(profile.fields)])
    return wide.select("doc_id", F.lit(method).alias("method"), F.inline(entries))


def with_links(fields: DataFrame, text: DataFrame, profile: Profile) -> DataFrame:
    """Long fields of any method with the links taken from the raw text."""
    links = text.select("doc_id", t.numbered_join(t.decision_links(F.coalesce("raw", F.lit("")))).alias("_links"))
    is_links = F.col("field") == profile.links_field
    rows = fields.join(links, "doc_id", "left")
    return rows.withColumn("value", F.when(is_links, F.coalesce("_links", F.lit(""))).otherwise(F.col("value"))).drop("_links")
