"""Personal data in whole texts, with spans in source characters.

Base detectors run on the text as it is. Then a chain of transducers rewrites disguises:

* look-alike letters and digits to ASCII, zero-width characters to nothing;
* letters that stand for digits inside numbers (4l11, 1O) to those digits;
* runs of digits spelled in English, Spanish, French or German, also "double four", digits among them and "dot"
  between them, to plain numbers, "plus" before them to +;
* signs for @ and full stops, wrapped (at), spoken " dot " or joined _at_, each alone or beside the plain sign:
  an automaton walks the chain of signs and the words between them, and where a chain reads as an address (or as
  four numbers) its signs are rewritten.

Each rewritten character carries the source characters it came from, stages compose, and the same detectors
run on the result; a hit that holds a rewritten character is mapped back and added unless a base span of its
kind already covers it. Base spans always stay. A spoken address needs a known ending, and a plain word that often
stands before "at" (visit us at ...) is no name.

Every detector is linear in the text's length, also on long runs of digits or letters.

Nulls: a null text is empty. Other columns do not matter, repeated rows each come out, an empty table gives
no rows.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones, and dots and at signs in other forms.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "օ": "o",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
# Digits as they are spelled in four languages, zero first; words before a digit that is said
# more than once; words for +, @ and the full stop.
SPELLINGS = {
    "en": "zero one two three four five six seven eight nine",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
}
DIGIT_WORDS = {w: str(i) for words in SPELLINGS.values() for i, w in enumerate(words.split())} | {"oh": "0", "nought": "0", "ein": "1", "zwo": "2", "fuenf": "5"}
TIMES = {"double": 2, "doble": 2, "doppel": 2, "triple": 3}
PLUS = ("plus", "más", "mas")
AT = ("at", "arroba", "arobase", "ät", "klammeraffe")
DOT = ("dot", "punto", "point", "punkt")
# Letters that are written for digits.
LETTER_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
# Endings that a spoken address must have, since "at the dot on" is ordinary prose.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz name io ai app dev me tv cc co us uk eu de fr es it nl be ch at pt pl se no dk fi ie ca au nz in jp cn kr br mx ar cl pe ru gr cz hu ro tr za il sg hk tw "
    "cloud online site store shop tech xyz blog email agency digital studio media design systems solutions services group team website club pro mobi academy center company consulting education network software support international example test".split()
)
# Words before "at" that are no names.
NO_NAMES = frozenset(
    "a an and are available back based be been being bought buy call check click contact details email everyone find follow found go he her here him home hosted i information is it join learn live located look looked looking looks mail me meet met more not now online only open or order out page people posted published read register see seen send she shop sign site sold start started stay stop support that them there these they this those today together up us visit was we were website work worked working works write you".split()
)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can match only where the run's own start does, hence the look-behinds.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

def any_of(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


_word = rf"(?:(?:{any_of(TIMES)})[ \t-])?(?:{any_of(DIGIT_WORDS)})(?![^\W_])"
_gap = rf"(?:[ \t]+(?:{any_of(DOT)})[ \t]+|[ \t,.()/-]{{1,3}})"
#: Spelled digits and digits in a row, with spelled ones in it.
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{any_of(PLUS)})[ \t]+)?(?:[0-9]+{_gap})*{_word}(?:{_gap}(?:{_word}|[0-9]+(?![^\W_])))+", re.I)
SPELLED_PART = re.compile(rf"(?P<plus>{any_of(PLUS)})[ \t]+|(?:(?P<times>{any_of(TIMES)})[ \t-])?(?P<word>{any_of(DIGIT_WORDS)})(?![^\W_])|(?P<digits>[0-9]+)|[ \t]+(?P<dot>{any_of(DOT)})[ \t]+|(?P<gap>[ \t,.()/-]{{1,3}})", re.I)
MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OoIlSB]*[0-9])[0-9]*[OoIlSB][0-9OoIlSB]*(?![A-Za-z0-9])")

_at, _dot = any_of(AT), any_of(DOT)
#: Signs: wrapped, spoken, joined by _ or -, and plain.
SIGN = re.compile(
    rf"[ \t]*[(\[{{<][ \t]*(?:(?P<wrapped_at>{_at}|@)|(?:{_dot}|\.))[ \t]*[)\]}}>][ \t]*|[ \t]+(?:(?P<soft_at>{_at})|(?P<soft_dot>{_dot}))[ \t]+"
    rf"|(?<=[A-Za-z0-9])[_-](?:(?P<joined_at>{_at})|(?P<joined_dot>{_dot}))[_-](?=[A-Za-z0-9])|(?P<plain_at>@)|(?<=[A-Za-z0-9_%+-])(?P<plain_dot>\.)(?=[A-Za-z0-9])",
    re.I,
)
ATOM = re.compile(r"[A-Za-z0-9_%+-]+")
LABEL = re.compile(r"[A-Za-z0-9-]+")
STRANGE = re.compile("[^\x00-\x7fÀ-İĲ-ſ]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def find_emails(text: str):
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", end)


def find_ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def find_cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def find_phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield m.span()


DETECTORS = dict(zip(KINDS, (find_emails, find_ips, find_cards, find_phones)))


class Mapped:
    """A rewritten text with the source span of each character."""

    def __init__(self, text: str, start: list, end: list):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, changes) -> Mapped:
        """changes: (start, end, replacement) in order, in this text's characters."""
        parts, start, end, at = [], [], [], 0
        for a, b, to in changes:
            parts += [self.text[at:a], to]
            start += self.start[at:a] + [self.start[a]] * len(to)
            end += self.end[at:a] + [self.end[b - 1]] * len(to)
            at = b
        if not parts:
            return self
        return Mapped("".join(parts) + self.text[at:], start + self.start[at:], end + self.end[at:])


def plain_char(c: str) -> str:
    """ASCII for a look-alike: by the table, by digit value, or by compatibility form; else the character."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
    if digit is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() and len(form) == 1 and form != " " else c


def homoglyphs(text: Mapped) -> Mapped:
    return text.rewrite((m.start(), m.end(), to) for m in STRANGE.finditer(text.text) if (to := plain_char(m[0])) != m[0])


def mixed_digits(text: Mapped) -> Mapped:
    def changes():
        for m in MIXED.finditer(text.text):
            if 2 * sum(map(str.isdigit, m[0])) >= len(m[0]):
                for i, c in enumerate(m[0], m.start()):
                    if c in LETTER_DIGITS:
                        yield i, i + 1, LETTER_DIGITS[c]

    return text.rewrite(changes())


def spelled_digits(text: Mapped) -> Mapped:
    """State: what came before the place in a run. Between two spelled digits a gap without a full stop vanishes."""

    def changes():
        for run in SPELLED.finditer(text.text):
            held, before = None, ""  # a gap whose end is not known yet, and the kind of part before it
            for m in SPELLED_PART.finditer(text.text, run.start(), run.end()):
                kind = m.lastgroup
                if kind == "gap":
                    held = m
                    continue
                if kind == "word":
                    if held and before == "word" and "." not in held[0]:
                        yield held.start(), held.end(), ""
                    yield m.start(), m.end(), DIGIT_WORDS[m["word"].lower()] * TIMES.get((m["times"] or "").lower(), 1)
                elif kind in ("plus", "dot"):
                    yield m.start(), m.end(), "+" if kind == "plus" else "."
                held, before = None, kind

    return text.rewrite(changes())


class Sign:
    """A sign in the text: kind @ or full stop; how: plain, soft (spoken or joined), wrapped."""

    def __init__(self, m: re.Match):
        how = m.lastgroup or "wrapped_dot"
        self.start, self.end, self.kind = m.start(), m.end(), "@" if how.endswith("_at") else "."
        self.plain, self.soft = how.startswith("plain"), how.startswith(("soft", "joined"))


def chains(text: str):
    """Signs that follow each other with one atom between them, as (atom before, sign, ..., sign, atom after)."""
    chain: list = []
    for m in SIGN.finditer(text):
        sign = Sign(m)
        atom = ATOM.fullmatch(text, chain[-1].end, sign.start) if chain else None
        if chain and not atom:
            yield chain
            chain = []
        chain.append(sign)
    if chain:
        yield chain


def address(text: str, atoms: list, chain: list, at: int) -> tuple[int, int] | None:
    """The first and last sign of the address around an @ sign of the chain."""
    lo = hi = at
    while lo and chain[lo - 1].kind == "." and atoms[lo - 1]:
        lo -= 1
    while hi + 1 < len(chain) and chain[hi + 1].kind == "." and LABEL.fullmatch(atoms[hi + 1]):
        hi += 1
    if not atoms[lo]:
        return None
    for last in range(hi, at, -1):
        ending = LABEL.match(atoms[last + 1])
        soft = any(x.soft for x in chain[at : last + 1])
        if ending and (not soft or ending[0].lower() in ENDINGS):
            name = chain[at].soft and lo == at and atoms[at].lower() in NO_NAMES
            return None if name or all(x.plain for x in chain[lo : last + 1]) else (lo, last)
    return None


def rewritten_signs(text: str):
    """(start, end, sign) of the disguised signs that belong to an address or to four numbers."""
    for chain in chains(text):
        if all(x.plain for x in chain):
            continue
        first = chain[0].start
        while first and ATOM.match(text[first - 1]):
            first -= 1
        after = ATOM.match(text, chain[-1].end)
        atoms = [text[first : chain[0].start], *(text[a.end : b.start] for a, b in zip(chain, chain[1:])), after[0] if after else ""]
        used: set = set()
        for i, sign in enumerate(chain):
            if sign.kind == "@" and (found := address(text, atoms, chain, i)):
                used.update(range(found[0], found[1] + 1))
            if i + 2 < len(chain) and all(x.kind == "." for x in chain[i : i + 3]) and all(a.isascii() and a.isdigit() for a in atoms[i : i + 4]):
                used.update(range(i, i + 3))
        yield from ((chain[i].start, chain[i].end, chain[i].kind) for i in sorted(used) if not chain[i].plain)


def at_and_dot(text: Mapped) -> Mapped:
    return text.rewrite(rewritten_signs(text.text))


#: Cheap signs that a transducer may have work to do: an @ sign and a full stop around one label, one of them disguised.
TRIGGER = re.compile(
    rf"[(\[{{<][ \t]*(?:{_at}|{_dot}|@|\.)[ \t]*[)\]}}>]|[ \t_-](?:{_at})[ \t_-]+[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|[ \t_-]+(?:{_dot})[ \t_-])|@[A-Za-z0-9.-]+[ \t_-]+(?:{_dot})[ \t_-]|[0-9][ \t_-]+(?:{_dot})[ \t_-]+[0-9]", re.I
)


#: Two parts of a spelled number, in lower case; quick, since every branch begins with a letter.
SPELLED_PAIR = re.compile(rf"(?:{any_of(DIGIT_WORDS)}){_gap}(?:{any_of([*DIGIT_WORDS, *TIMES])}|[0-9])")


def spelled_pair(text: str) -> bool:
    lower = text.lower()
    return any(not m.start() or not lower[m.start() - 1].isalnum() for m in SPELLED_PAIR.finditer(lower))


def disguised(text: str) -> bool:
    return (not text.isascii() and STRANGE.search(text) is not None) or TRIGGER.search(text) is not None or MIXED.search(text) is not None or spelled_pair(text)


def spans(text: str) -> tuple[list, list]:
    """(base, added): each a list of (start, kind number, end) in order."""
    base = [(a, k, b) for k, kind in enumerate(KINDS) for a, b in DETECTORS[kind](text)]
    added = []
    if disguised(text):
        clean = at_and_dot(spelled_digits(mixed_digits(homoglyphs(Mapped.of(text)))))
        for k, kind in enumerate(KINDS):
            taken = sorted((a, b) for a, j, b in base if j == k)
            for a, b in DETECTORS[kind](clean.text):
                lo, hi = clean.start[a], clean.end[b - 1]
                if text[lo:hi] != clean.text[a:b] and not any(x <= lo and hi <= y for x, y in taken):
                    added.append((lo, k, hi))
    return sorted(base), sorted(added)


def told(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive."""
    span = "array<struct<kind:string,start:int,end:int>>"
    kind_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in pieces(batches):
            base, added = [], []
            for t in b.column("text"):
                x, y = spans(t.as_py() or "")
                base.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in x])
                added.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in y])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, kind_t), pa.array(added, kind_t)], ["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {span}, added {span}")


def digest(found: DataFrame) -> DataFrame:
    """The counts of base spans, their digest, and all spans as text."""

    def text(c):
        rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
        ordered = F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))
