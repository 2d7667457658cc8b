"""Personal data: fixed patterns, and a linear-chain conditional random field.

The field tags words by the shapes of themselves and their neighbours. It is trained
from a small labelled table and decoded by Viterbi over numpy batches. It adds spans to
those of the patterns and takes none away: secrets (passwords, keys and tokens given a
value), phone numbers in local form, and what the patterns found in part only.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone", "B-secret")
#: Bytes of words whose shapes are kept; words that are scored at once.
KEPT_BYTES, BLOCK = 4 << 20, 1 << 15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GIVEN = re.compile(r"[\w.-]+\s*(?:=>?|:=?(?!//))\s*")
_MAIL = re.compile(r"[^@]@[^@]+[.].")
_RUN = re.compile(r"([^\W\d_]+)|([0-9]+)")
_LINK = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
_CUE = re.compile(r"(?i)(?:tel|telephone|phone|call|fax|mobile)[.:]*")
_AGAIN = re.compile(r"(.{1,4}?)\1{2,}")


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and a domain with a dot, found from each @ (a
    search from every letter would take the square of a long word's length)."""
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            at = done = m.end()
        else:
            at = done = at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


# The labelled table


def labelled_table(rows: int = 1200, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Short word sequences with a label for each word, made by rule from a seed."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    plain = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def word() -> str:
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyzéöñ") for _ in range(r.randint(1, 14)))
        w = r.choice((w, w, w, w.capitalize(), w.upper()))
        return w + r.choice(("", "", "", "", "", "", ".", ",", ":", ";", "!!", "?"))

    octets = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    area, line = lambda: str(r.randint(200, 989)), lambda: f"{r.randint(200, 989)}-{digits(4)}"
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 16, 32, 40, 64))))

    local = lambda: r.choice((plain(), f"{plain()}.{digits(2)}", f"{plain()}_{digits(1)}", f"{plain()}.{plain()}", f"{plain()}{digits(3)}", f"{plain()}ö{plain()}"))
    domain = lambda: r.choice((plain(), plain() + digits(1), f"{plain()}.{plain()}", f"{plain()}{digits(1)}.{plain()}")) + "." + r.choice(("com", "org", "net", "de"))

    def secret() -> str:
        v = r.choice((hexes(), "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(16, 48)))))
        return r.choice((v, v, v.upper(), f"{plain()}_{v}", "-".join(v[i : i + 4] for i in range(0, len(v), 4))))

    def given() -> list[tuple[str, str]]:
        """A name and a secret value for it, in several notations."""
        name, v = r.choice((plain(), f"{plain()}_{plain()}")), secret()
        name = r.choice((name, name, name.upper()))
        if r.random() < 0.2:  # as in a list of environment variables
            name, v = name.upper(), v.upper()
        if r.random() < 0.1:
            return [(name.capitalize() + ":", "O"), (r.choice(("Bearer", "bearer", "Basic", "Token")), "O"), (v, "B-secret")]
        if r.random() < 0.45:
            return [(r.choice((f"{name}={v}", f"{name}={v}", f'{name}="{v}"', f"{name}:{v}")), "B-secret")]
        head = r.choice(([(name, "O"), (r.choice(("=", ":=", "=>")), "O")], [(name + ":", "O")], [(name + "=", "O")]))
        return [*head, (r.choice((v, f'"{v}"', f"'{v}'", f'"{v}"' + r.choice(("!!", ";", ",")))), "B-secret")]

    def link() -> list[tuple[str, str]]:
        """An address of a page, with values that are no secrets."""
        host = f"{r.choice(('http', 'https', 'https', 'ftp'))}://{r.choice((domain(), domain(), 'www.' + domain(), domain() + ':' + r.choice(('80', '8080'))))}"
        value = lambda: r.choice((hexes(), digits(r.randint(1, 16)), plain(), plain() + digits(2)))
        path = "".join(f"/{r.choice((plain(), plain() + '-' + plain(), digits(r.randint(1, 10)), hexes()))}" for _ in range(r.randint(0, 4)))
        asked = "&".join(f"{plain()}={value()}" for _ in range(r.choice((0, 1, 1, 2, 3))))
        return [(r.choice(("{}", "{}", "<{}>", '"{}"', "({})")).format(host + (path or "/") + (asked and "?" + asked)), "O")]

    def landline() -> list[tuple[str, str]]:
        """A phone number in local form: a trunk prefix of 0, or no area; the latter, which
        any two numbers may look like, only where a word before tells."""
        area = "0" + str(r.randint(1, 9)) + digits(r.randint(1, 3))
        whole = r.choice((f"{area} {digits(r.randint(5, 8))}", f"{area} {digits(3)} {digits(4)}", f"{area[:3]} {digits(4)} {digits(4)}", f"{area}/{digits(r.randint(6, 8))}", f"({area}) {digits(r.randint(6, 8))}", f"({area}) {digits(3)} {digits(4)}", f"{area}-{digits(r.randint(6, 7))}", " ".join([area[:2], *(digits(2) for _ in range(4))])))
        if r.random() < 0.3:
            return [(r.choice(("tel", "tel.", "Tel.", "Tel:", "phone:", "Phone", "call", "Call", "fax", "Fax:", "mobile")), "O"), (r.choice((f"{r.randint(200, 989)}-{digits(4)}", f"{digits(3)}-{digits(4)}")), "B-phone")]
        return tagged("phone", whole)

    def tagged(kind: str, text: str) -> list[tuple[str, str]]:
        return [(w, f"{'I' if i and kind in ('card', 'phone') else 'B'}-{kind}") for i, w in enumerate(text.split(" "))]

    held = (
        given, given, given,
        lambda: tagged("email", local() + "@" + domain()),
        lambda: tagged("email", f"<{local()}@{domain()}>"),
        lambda: tagged("email", local() + "@" + domain()),
        lambda: tagged("ip", octets()),
        lambda: tagged("ip", f"{octets()}:{r.choice(('80', '443', '8080'))}"),
        lambda: tagged("card", digits(16)),
        lambda: tagged("card", " ".join(digits(4) for _ in range(4))),
        lambda: tagged("card", "-".join(digits(4) for _ in range(4))),
        lambda: tagged("phone", f"+{r.randint(1, 99)} ({area()}) {line()}"),
        lambda: tagged("phone", f"({area()}) {line()}"),
        lambda: tagged("phone", f"{area()}-{line()}"),
        lambda: tagged("phone", f"{area()}.{line().replace('-', '.')}"),
        lambda: tagged("phone", f"+{r.randint(1, 99)} {digits(3)} {digits(7)}"),
        landline, landline,
    )
    other = (
        lambda: digits(r.randint(1, 3)), lambda: str(r.randint(1500, 2099)), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"v{digits(1)}.{digits(2)}", lambda: f"{r.randint(1900, 2099)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{r.randint(1900, 2099)}",
        lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(2)}-{digits(2)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{digits(2)} {digits(3)}", lambda: hexes(), lambda: f"@{plain()}", lambda: f"{plain()}={plain()}", lambda: f"{plain()}={digits(2)}",
        lambda: f"{digits(1)}.", lambda: f"({r.randint(1900, 2099)})", lambda: f"{plain()}{digits(2)}", lambda: r.choice("=|:-*#"), lambda: f"{digits(3)}%", lambda: digits(r.randint(5, 9)),
    )
    table = []
    for _ in range(rows):
        row: list[tuple[str, str]] = [(word(), "O")]
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                row += r.choice(held)()
                if r.random() < 0.2:
                    row[-1] = (row[-1][0] + r.choice(".,;"), row[-1][1])
            elif r.random() < 0.06:
                row += link()
            else:
                row += [(w, "O") for w in r.choice(other)().split(" ")]
                if r.random() < 0.3:  # a name that is given a value of no secret kind
                    row[-1:] = [(plain(), "O"), ("=", "O"), (r.choice((f'"{plain()}"', plain(), digits(3), f'"{plain()}{digits(2)}"')), "O")]
            row += [(word(), "O") for _ in range(r.randint(1, 3))]
        table.append(row)
    return table


# Features


def shape(word: str) -> str:
    """What the field sees of a word, as its features joined by tabs: runs of letters as x,
    runs of digits as d and their number (20 for more), other characters as they are; the
    same without numbers, and again without signs at the ends; how many digits, runs and
    changes between letters and digits; the length by powers of two; the case; whether all
    letters are hexadecimal; whether it is a link, or announces a phone number. All of the word counts at any length. A
    piece that stands three times or more in a row is written as that piece and +."""
    runs = _RUN.findall(word)
    digits, letters = sum(len(d) for _, d in runs), "".join(x for x, _ in runs)
    changes = sum(bool(a[0]) != bool(b[0]) for a, b in zip(runs, runs[1:]))
    exact = _AGAIN.sub(r"\1+", _RUN.sub(lambda m: "x" if m[1] else f"d{min(len(m[2]), 20)}", word))
    loose = _AGAIN.sub(r"\1+", _RUN.sub(lambda m: "x" if m[1] else "d", word))
    core = loose.strip("\"'.,;:!?<>")
    case = "" if not letters else "a" if letters.islower() else "A" if letters.isupper() else "Aa" if letters[0].isupper() and letters[1:].islower() else "aA"
    hexes = bool(digits and letters) and set(letters.lower()) <= set("abcdef")
    seen = (f"s={exact}", f"l={loose}", f"core={core}", f"n={min(digits, 20)}", f"r={min(len(runs), 12)}", f"ch={min(changes, 8)}", f"len={len(word).bit_length()}", f"case={case}", f"hex={hexes}", f"at={'@' in word}", f"mail={bool(_MAIL.search(word))}", f"x={bool(letters)}", f"is={'=' in word or ':' in word[1:-1]}", f"link={bool(_LINK.search(word))}", f"cue={bool(_CUE.fullmatch(word))}")
    return "\t".join(x.replace("\t", " ") for x in seen)


class Field:
    """Weights: of each feature for the word itself, the one before and the one after,
    by label; and of each pair of neighbouring labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.index, self.weights, self.moves = index, weights, moves
        #: By how much more than O another label must score to be worth its moves, at best.
        self.slack = np.array([(moves[:, y, None] + moves[y] - moves[:, 0, None] - moves[0]).max() for y in range(1, len(moves))])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.table, self.held = np.zeros((0, *self.weights.shape[1:])), 0
        self.ids(["x"])

    def ids(self, words: Sequence[str]) -> np.ndarray:
        """The rows of ``table`` for the words' shapes; row 0 is a plain word's, which is
        also what stands before and after a text."""
        fresh = []
        for w in set(words):
            if w in self.known:
                continue
            s = shape(w)
            if s not in self.shapes:
                self.shapes[s] = len(self.shapes)
                fresh.append(self.weights[[i for f in s.split("\t") if (i := self.index.get(f)) is not None]].sum(axis=0))
            self.known[w] = self.shapes[s]
            self.held += len(w)
        if fresh:
            self.table = np.concatenate([self.table, fresh])
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """(words, labels) for a sequence whose ends count as words of plain letters."""
        return self._scored(np.concatenate([[0], self.ids(words), [0]]), 1, len(words) + 1)

    def _scored(self, ids: np.ndarray, a: int, b: int) -> np.ndarray:
        return self.table[ids[a:b], 0] + self.table[ids[a - 1 : b - 1], 1] + self.table[ids[a + 1 : b + 1], 2]

    def decode(self, texts: Sequence[Sequence[str]]) -> dict[int, dict[int, str]]:
        """For each text (its words) with a label other than O: word number -> label, as
        Viterbi over the whole text finds them. A word that is O on every best path, because
        no other label scores enough to make up for O whatever its neighbours are, is set
        first; what lies between such words is decoded, runs of one length together."""
        if self.held > KEPT_BYTES:
            self.forget()
        starts, parts = [], [np.zeros(1, dtype=np.int32)]
        at = 1
        for words in texts:
            starts.append(at)
            parts += [self.ids(words), parts[0]]
            at += len(words) + 1
        ids, ends = np.concatenate(parts), {x - 1 for x in starts} | {at - 1}
        open_, rows = [np.empty(0, dtype=np.int64)], [np.empty((0, len(LABELS)))]
        for a in range(1, at - 1, BLOCK):
            s = self._scored(ids, a, min(a + BLOCK, at - 1))
            unsure = (s[:, 1:] - s[:, :1] + self.slack >= -1e-9).any(axis=1)
            unsure[[x - a for x in ends if a <= x < a + len(s)]] = False
            open_.append(np.flatnonzero(unsure) + a)
            rows.append(s[unsure])
        place, s = np.concatenate(open_), np.concatenate(rows)
        cuts = np.flatnonzero(np.diff(place) > 1) + 1
        by_length: dict[int, list[int]] = defaultdict(list)
        for a, b in zip([0, *cuts], [*cuts, len(place)]):
            by_length[b - a].append(a)
        out: dict[int, dict[int, str]] = defaultdict(dict)
        first = np.array(starts)
        for n, group in by_length.items():
            if n:
                ys = viterbi(s[np.array(group)[:, None] + np.arange(n)], self.moves)
                for i, j in zip(*np.nonzero(ys)):
                    x = int(place[group[i] + j])
                    k = int(np.searchsorted(first, x, side="right")) - 1
                    out[k][x - starts[k]] = LABELS[ys[i, j]]
        return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (n, length) for n sequences of one length (n, length, labels),
    each between words labelled O."""
    best, back = scores[:, 0] + moves[0], []
    for t in range(1, scores.shape[1]):
        through = best[:, :, None] + moves
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + scores[:, t]
    at = (best + moves[:, 0]).argmax(axis=1)
    out = [at]
    for b in reversed(back):
        at = b[np.arange(len(at)), at]
        out.append(at)
    return np.stack(out[::-1], axis=1)


@functools.lru_cache(maxsize=2)
def train(rows: int = 1000, seed: int = 11, steps: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps; forward and backward sums run over all
    sequences of a length at once."""
    by_length: dict[int, list] = defaultdict(list)
    index: dict[str, int] = {}
    for row in labelled_table(rows, seed):
        shapes = [shape(w) for w in ("x", *(w for w, _ in row), "x")]
        ids = [[index.setdefault(f, len(index)) for f in s.split("\t")] for s in shapes]
        by_length[len(row)].append((ids, [LABELS.index(y) for _, y in row]))
    k = len(LABELS)
    n_features = len(next(iter(by_length.values()))[0][0][0])
    groups = [(np.array([x for x, _ in g]), np.array([y for _, y in g])) for g in by_length.values()]
    weights, moves = np.zeros((len(index), 3, k)), np.zeros((k, k))
    sums_w, sums_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    total = sum(y.size for _, y in groups)
    for _ in range(steps):
        dw, dm = -decay * weights, -decay * moves
        for ids, ys in groups:
            n, length = ys.shape
            near = [ids[:, 1:-1], ids[:, :-2], ids[:, 2:]]
            s = sum(weights[x, j].sum(axis=2) for j, x in enumerate(near))
            f, b = np.empty_like(s), np.empty_like(s)
            f[:, 0] = s[:, 0] + moves[0]
            for t in range(1, length):
                f[:, t] = _lse(f[:, t - 1, :, None] + moves, 1) + s[:, t]
            b[:, -1] = moves[:, 0]
            for t in range(length - 2, -1, -1):
                b[:, t] = _lse(moves + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            z = _lse(f[:, -1] + moves[:, 0], 1)
            p = np.eye(k)[ys] - np.exp(f + b - z[:, None, None])
            for j, x in enumerate(near):
                np.add.at(dw[:, j], x.reshape(-1), np.repeat(p.reshape(-1, k), n_features, axis=0) / total)
            for t in range(1, length):
                q = np.exp(f[:, t - 1, :, None] + moves + (s[:, t] + b[:, t])[:, None, :] - z[:, None, None])
                np.add.at(dm, (ys[:, t - 1], ys[:, t]), 1 / total)
                dm -= q.sum(axis=0) / total
            ends = np.zeros((n, k + k))
            ends[:, :k], ends[:, k:] = p[:, 0], p[:, -1]
            dm[0] += ends[:, :k].sum(axis=0) / total
            dm[:, 0] += ends[:, k:].sum(axis=0) / total
        sums_w += dw**2
        sums_m += dm**2
        weights += rate * dw / np.sqrt(sums_w)
        moves += rate * dm / np.sqrt(sums_m)
    return Field(index, weights, moves)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# Tagging


def plausible(kind: str, text: str) -> bool:
    """The exact check that a tagged span must pass, over all of it: a card's number of
    digits and Luhn sum, an address's parts, a phone number's digits, a mail address's
    parts, a secret's 8 letters and digits or more, and that it is no link."""
    if kind == "ip":
        return any(k == "ip" for k, _, _ in base_spans(text))
    if kind == "email":
        return bool(_MAIL.search(text))
    if kind == "secret":
        return sum(map(str.isalnum, text)) >= 8 and not _LINK.match(text)
    digits = re.sub("[^0-9]", "", text)
    return 7 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def field_spans(texts: Sequence[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of each text that the field finds. Punctuation at a span's ends is left out,
    and of a secret the name that it is given to."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, tags in field.decode([_WORD.findall(t) for t in texts]).items():
        text, spans = texts[k], [m.span() for m in _WORD.finditer(texts[k])]
        for i in sorted(tags):
            kind = tags[i][2:]
            if tags[i][0] == "I" and tags.get(i - 1, "O")[2:] == kind:
                continue
            j = i
            while tags.get(j + 1) == "I-" + kind:
                j += 1
            start, end = spans[i][0], spans[j][1]
            if kind == "secret" and (m := _GIVEN.match(text, start, end)):
                start = m.end()
            whole = text[start:end]
            start += len(whole) - len(whole.lstrip("\"'<[{,;:.#$%&*|!"))
            end -= len(whole) - len(whole.rstrip("\"'>]},;:.#$%&*|!?"))
            if start < end and plausible(kind, text[start:end]):
                out[k].append((kind, start, end))
    return out


def added_spans(base: Sequence[tuple[str, int, int]], more: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the field's spans those that overlap none of the base, or else only such of their
    own kind, all of which they contain and exceed."""
    taken = sorted((a, b, k) for k, a, b in base)
    starts, reach = [a for a, _, _ in taken], np.maximum.accumulate([b for _, b, _ in taken] or [0])
    out = []
    for kind, a, b in more:
        i, j = int(np.searchsorted(reach, a, side="right")), bisect_left(starts, b)
        over = [x for x in taken[i:j] if x[1] > a]
        if all(k == kind and a <= c and d <= b and (c, d) != (a, b) for c, d, k in over):
            out.append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _tag(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, most=1 << 19):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        rows: dict[str, list] = {k: [] for k in ("base", "spans", *(f"n_{k}" for k in BASE_KINDS), "n_secret", "n_spans")}
        for text, more in zip(texts, field_spans(texts, field), strict=True):
            base = base_spans(text)
            every = base + added_spans(base, more)
            rows["base"].append(joined(base))
            rows["spans"].append(joined(every))
            for k in BASE_KINDS:
                rows[f"n_{k}"].append(sum(x[0] == k for x in base))
            rows["n_secret"].append(sum(x[0] == "secret" for x in every))
            rows["n_spans"].append(len(every))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if k in ("base", "spans") else pa.int64()) for k, v in rows.items())], names=["doc_id", *rows])


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base, spans (both "kind:start:end" joined by commas), n_email, n_ip,
    n_card, n_phone (of the base), n_secret and n_spans (of all), one row per row of
    ``docs``.

    The field's spans are added where they overlap no span of the patterns, or contain
    such of their own kind and more. A null text counts as empty and has no spans. doc_id
    may be null or repeat; other columns are ignored; no rows in, no rows out.
    """
    ship(docs.sparkSession)
    field = field or train()
    field.forget()
    schema = "doc_id long, base string, spans string, " + ", ".join(f"n_{k} long" for k in (*BASE_KINDS, "secret", "spans"))
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _tag(b, field), schema), "personal-data")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
