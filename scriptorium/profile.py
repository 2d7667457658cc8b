"""Anchors and labels of a family of letters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Everything language-specific that the rules look for. Patterns are Java regular
    expressions without the leading (?U), which the rules add."""

    page_marker: str
    name_header: str
    fields: tuple[str, ...]
    links_field: str
    history_marker: str
    gist: tuple[str, tuple[str, ...]]
    breakdown_starts: tuple[str, ...]
    breakdown_ends: tuple[str, ...]
    date_label: str
    request_label: str
    committee_pattern: str
    committee_label: str
    program_word: str
    negative_pattern: str
    positive_pattern: str
    change_pattern: str
    yes: str
    no: str
    letters: str
    input_cap: int = 20_000
    code_digits: int = 6  # the most that a code has


# Fixed values of the letters' language and layout.
HEBREW = Profile(
    page_marker="האוצר - אגף התקציבים",
    name_header="שם הפרט",
    fields=("תאריך", "מס' פנייה", "מס' תוכנית", "עיקרי הפנייה", "עיקרי הפנייה בחלוקה לתוכניות", "קישורים להחלטות ממשלה", "האם יש התייחסות לכספים קואליציונים", "שינויים בכוח אדם"),
    links_field="קישורים להחלטות ממשלה",
    history_marker="היסטוריה תקציבית",
    gist=("עיקרי הפנייה:", ("מטרת השינוי", "האישור ייכנס", "בכבוד רב")),
    breakdown_starts=("עיקרי הפנייה בחלוקה", "מטרת השינוי"),
    breakdown_ends=("השפעה על", "קישורים להחלטות ממשלה", "האישור ייכנס", "בכבוד רב", "נספח"),
    date_label="תאריך הבקשה",
    request_label="בקשה מספר",
    committee_pattern=r"מספר פני\S* לועדה",
    committee_label="מספר פנייה לועדה",
    program_word="תו?כנית",
    negative_pattern=r"(אינה|לא)\s+כולל\S*\s+כספים קואליציוני",
    positive_pattern=r"הסכמ\S*\s+\S*קואליצי|תקצ\S*\s+\S*קואליצי|כתקציב\s+קואליצי|(?<!התייחסות ל)כספ\S*\s+קואליצי",
    change_pattern=r"שינוי\S* בכוח אדם",
    yes="כן",
    no="לא",
    letters="[֐-ת]",
)

#: The same rules over plain Latin text.
LATIN = Profile(
    page_marker="Budget Office - Letters",
    name_header="item name",
    fields=("date", "requests", "programs", "gist", "breakdown", "links", "coalition", "manpower"),
    links_field="links",
    history_marker="Budget history",
    gist=("Gist:", ("Purpose", "Effective", "Regards")),
    breakdown_starts=("Breakdown", "Purpose"),
    breakdown_ends=("Impact", "Links", "Effective", "Regards", "Appendix"),
    date_label="Request date",
    request_label="Request no",
    committee_pattern=r"Committee\S* no",
    committee_label="committee",
    program_word="programm?e?",
    negative_pattern=r"(excludes|without)\s+coalition",
    positive_pattern=r"agreed\S*\s+\S*coalition|(?<!mention of )funds\s+coalition",
    change_pattern=r"changes? in manpower",
    yes="yes",
    no="no",
    letters="[A-Za-z]",
)
