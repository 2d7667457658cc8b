"""Display order of right-to-left text as a column expression.

A line's characters become a line of their classes, one letter each. The rules that resolve
weak and neutral classes are replacements in it that keep its length; the letters left
are levels, and a fold over characters and levels puts runs into visual order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of right-to-left scripts: Hebrew and its kin, and Arabic and its kin.
_RIGHT = r"\u05BE\u05C0\u05C3\u05C6\u05D0-\u05F4\u07C0-\u07EA\u07FA\u0800-\u0815\u0840-\u0858\u200F\uFB1D\uFB1F-\uFB4F"
_ARABIC = r"\u0608\u060B\u060D\u061B-\u064A\u066D-\u066F\u0671-\u06D5\u06E5\u06E6\u06EE\u06EF\u06FA-\u070D\u070F\u0710\u0712-\u072F\u074D-\u07A5\u07B1\u0860-\u086A\u08A0-\u08C9\uFB50-\uFD3D\uFD50-\uFDCE\uFDF0-\uFDFC\uFE70-\uFEFC"
_DIGITS = r"\u0660-\u0669\u066B\u066C"
#: Class letters: L and R strong, A Arabic, M marks, N and D European and Arabic digits, E
#: T C signs among numbers (plus and minus; currency and the like; separators), S and W
#: white space, O the rest. Fixed values, in the order in which they are told.
CLASSES = (
    (rf"[\p{{L}}\p{{Nl}}\p{{Mc}}\u200E&&[^{_RIGHT}{_ARABIC}]]", "L"),
    (rf"[{_RIGHT}]", "R"),
    (rf"[{_ARABIC}]", "A"),
    (r"[\p{Mn}\p{Me}]", "M"),
    (r"[0-9\u00B2\u00B3\u00B9\u06F0-\u06F9]", "N"),
    (rf"[{_DIGITS}]", "D"),
    (r"[+\-\u2212]", "E"),
    (r"[#$%\u00A2-\u00A5\u00B0\u00B1\u066A\u2030-\u2034\u20A0-\u20CF]", "T"),
    (r"[,./:\u00A0\u060C\u2044\u202F]", "C"),
    (r"[\t\x0B\x1F]", "S"),
    (r"[ \f\u1680\u2000-\u200A\u2028\u205F\u3000]", "W"),
    (r"[^LRAMNDETCSW]", "O"),
)
MIRRORED = ("()[]{}<>\u00AB\u00BB\u2039\u203A\u2264\u2265", ")(][}{><\u00BB\u00AB\u203A\u2039\u2265\u2264")
#: Characters without which a line stays as it is.
HAS_RIGHT = rf"[{_RIGHT}{_ARABIC}{_DIGITS}]"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _replace(classes: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        classes = F.regexp_replace(classes, pattern, by)
    return classes


def _next(after: str, what: str, ahead: str = "") -> str:
    """``what`` right after ``after``, or after one just replaced."""
    return rf"(?:(?<={after})|\G(?!\A)){what}{ahead}"


def classes_of(line: Column) -> Column:
    """One letter of CLASSES per character. Letters are told first: what later rules look for is no letter."""
    return _replace(line, *CLASSES)


def levels(classes: Column, right: bool) -> Column:
    """A digit per character, the embedding level, for lines that run from the right (base
    level 1) or the left (0)."""
    base = "R" if right else "L"
    marks = [(_next(c, "M"), c) for c in "LRANDETCSWO"]  # a mark is as what it stands on
    weak = [
        (r"((?:A|\G(?!\A))[^LRAN]*)N", "$1D"),  # digits after Arabic letters
        ("A", "R"),
        ("(?<=N)[EC](?=N)", "N"), ("(?<=D)C(?=D)", "D"),  # one sign between two numbers
        ("T(?=T*N)", "N"), (_next("N", "T"), "N"),  # signs beside a number
        ("[ETC]", "O"),
        (r"((?:L|\G(?!\A))[^LRN]*)N" if right else r"((?:L|\G)[^LRN]*)N", "$1L"),  # digits after letters from the left
    ]
    # Neutrals between two of the other direction (numbers count as from the right) follow
    # them; the rest follow the line.
    other = (_next("L", "[OWS]", "(?=[OWS]*L)"), "L") if right else (_next("[RND]", "[OWS]", "(?=[OWS]*[RND])"), "R")
    resolved = _replace(classes, *marks, ("M", base), *weak, other, ("[OWS]", base))
    resolved = F.translate(resolved, "LRND", "2122" if right else "0122")
    ends = F.regexp_replace(classes, r"W(?=W*(?:S|\z))|S", "X")  # white space at ends has the line's level
    return F.array_join(F.zip_with(F.split(ends, ""), F.split(resolved, ""), lambda e, r: F.when(e == "X", "1" if right else "0").otherwise(r)), "")


def _arranged(line: Column, levels: Column) -> Column:
    """Runs of level 2 keep their order within runs from level 1 on, which are reversed."""
    pairs = F.zip_with(F.split(line, ""), F.split(levels, ""), lambda c, n: F.struct(F.when(n == "1", F.translate(c, *MIRRORED)).otherwise(c).alias("c"), n.alias("n")))
    state = lambda out, turned, kept: F.struct(out.alias("out"), turned.alias("turned"), kept.alias("kept"))
    none = F.lit("")

    def step(s: Column, x: Column) -> Column:
        two = state(s["out"], s["turned"], F.concat(s["kept"], x["c"]))
        one = state(s["out"], F.concat(x["c"], s["kept"], s["turned"]), none)
        zero = state(F.concat(s["out"], s["kept"], s["turned"], x["c"]), none, none)
        return F.when(x["n"] == "2", two).when(x["n"] == "1", one).otherwise(zero)

    return F.aggregate(pairs, state(none, none, none), step, lambda s: F.concat(s["out"], s["kept"], s["turned"]))


def _shown(line: Column) -> Column:
    def by_classes(c: Column) -> Column:
        from_right = F.regexp_extract(c, "[LRA]", 0).isin("R", "A")
        return _arranged(line, F.when(from_right, levels(c, True)).otherwise(levels(c, False)))

    return F.when(line.rlike(HAS_RIGHT), _let(classes_of(line), by_classes)).otherwise(line)


def display_order(text: Column) -> Column:
    """Each line of a text as it is to be drawn from left to right.

    A line runs as its first strong letter does. Brackets and the like are mirrored in
    right-to-left runs. Explicit embeddings, isolates and pairing of brackets are not
    resolved: their signs are neutral. Null stays null; lines without right-to-left letters
    stay as they are.
    """
    return F.when(text.rlike(HAS_RIGHT), F.array_join(F.transform(F.split(text, "\n", -1), _shown), "\n")).otherwise(text)
