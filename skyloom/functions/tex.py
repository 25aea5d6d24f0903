"""TeX markup in titles, abstracts and names, bibliography sources, and how names are shortened: plain Python over strings.

A text is read once from left to right. A control sequence is looked at where it begins: an accent takes its letter, in
braces or not, a known word stands for its letter, and anything else stays as it was written.
"""

from __future__ import annotations

import io
import re
import string
import tarfile
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

# What TeX commands stand for.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "θ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "varpi": "π", "rho": "ρ", "varrho": "ρ", "sigma": "σ",
    "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ",
    "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
SPECIAL = {
    "ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "i": "i", "j": "j",
    "deg": "°", "degree": "°", "textdegree": "°",
}
MARKS = {
    "`": "̀", "'": "́", "^": "̂", "~": "̃", '"': "̈", "=": "̄", ".": "̇", "c": "̧", "v": "̌",
    "u": "̆", "r": "̊", "H": "̋", "k": "̨", "b": "̱", "d": "̣",
}
_WORDS = GREEK | SPECIAL
_PLACED = str.maketrans("", "", "{}\\")
#: Capitalised words that belong to a surname all the same; words in lower case always do.
_CAPITAL_PARTICLES = {"Van", "Von", "De", "Der", "St."}


class _Reader:
    """A place in a text."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, what: str) -> bool:
        found = self.text.startswith(what, self.at) and bool(what)
        self.at += len(what) * found
        return found

    def letters(self) -> str:
        start = self.at
        while self.peek().isascii() and self.peek().isalpha():
            self.at += 1
        return self.text[start : self.at]

    def letter_of_accent(self) -> str | None:
        """The one letter under an accent: ``x``, ``{x}``, ``\\i`` or ``{\\i}``."""
        while self.take(" "):
            pass
        group = self.take("{")
        named = self.take("\\")
        start = self.at
        word = self.letters()
        if named or group:
            return word if len(word) == 1 and (not group or self.take("}")) else None
        self.at = start + 1
        return word[:1] or None

    def command(self, show, group: bool) -> str | None:
        """What the control sequence here stands for, in braces of its own or not; ``show`` combines a letter and its mark."""
        if not self.take("\\"):
            return None
        name = self.letters()
        if not name:
            name = self.peek()
            self.at += len(name)
        if name in MARKS and (letter := self.letter_of_accent()):
            return show(letter, MARKS[name])
        found = _WORDS.get(name) if show is _composed else None
        if found and not group:
            self.take(" ")  # a blank ends a command's name
        return found


def _composed(letter: str, mark: str) -> str:
    return unicodedata.normalize("NFC", letter + mark)


def _bare(letter: str, mark: str) -> str:
    return letter


def _read(text: str, show) -> str:
    out, here = [], _Reader(text)
    while here.at < len(text):
        try_ = _Reader(text, here.at)
        group = try_.take("{")
        found = try_.command(show, group)
        if found is None or (group and not try_.take("}")):
            out.append(here.peek())
            here.at += 1
        else:
            out.append(found)
            here = try_
    return "".join(out)


def to_unicode(text: str | None) -> str:
    """Accents, Greek letters and special letters as Unicode; unknown commands stay."""
    return _read(text, _composed) if text and "\\" in text else text or ""


def plain_name(name: str | None) -> str:
    """A name without markup: accented letters lose their accent, commands keep their name."""
    return " ".join(_read(name or "", _bare).translate(_PLACED).split())


def short_name(name: str | None) -> str:
    """Initials for the given names, then the surname; ``Last, First`` is turned round."""
    last, comma, given = plain_name(name).partition(",")
    words = [*given.replace(",", " ").split(), last.strip()] if comma else last.split()
    surname = len(words) - 1
    while not comma and surname > 0 and (words[surname - 1][0].islower() or words[surname - 1] in _CAPITAL_PARTICLES):
        surname -= 1
    first = ("-".join(f"{part[0].upper()}." for part in word.split("-") if part) for word in words[: max(surname, 0)])
    return " ".join(w for w in (*first, *words[max(surname, 0) :]) if w)


# bibliographies

_TYPED = re.compile(r"@[A-Za-z_]\w*\s*\{")
#: Blanks, braces, quotes and commas end an identifier in running text.
_BETWEEN = re.compile(r"([\s{}<>,\"']+)")
#: What may stand right before a new-style number, which is else just a number; the first also with a blank between.
_LEADS = ("arxiv:", "abs/", "/pdf/")
_LOWER = string.ascii_lowercase + "-"
RAW = 2000


def works(source: str | None) -> list[str]:
    """One chunk for each cited work: what follows a ``\\bibitem``, else each typed entry, else the whole text."""
    text = source or ""
    marker = "\\bibitem"
    if marker in text:
        chunks = text.split(marker)[1:]
    else:
        starts = [m.start() for m in _TYPED.finditer(text)]
        chunks = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)] or [text]
    return [c for c in chunks if c.strip()]


def fields(chunk: str, name: str) -> Iterator[str]:
    """The non-empty values of all fields of a name, in balanced braces or in quotes."""
    for m in re.finditer(rf"(?i)(?<![a-z]){name}\s*=\s*([{{\"])", chunk):
        depth, quoted = 0, m[1] == '"'
        for at in range(m.end(), len(chunk)):
            c = chunk[at]
            if depth == 0 and c == ('"' if quoted else "}"):
                if value := " ".join(chunk[m.end() : at].split()):
                    yield value
                break
            depth += (c == "{") - (c == "}")


def field(chunk: str, name: str) -> str | None:
    """The first value of a field; none if it has none."""
    return next(fields(chunk, name), None)


def _digits(text: str, at: int, most: int) -> str:
    """The digits at a place, up to ``most`` of them."""
    end = at
    while end < len(text) and end - at < most and text[end] in string.digits:
        end += 1
    return text[at:end]


def _joined(char: str) -> bool:
    """Whether an identifier can't begin behind, or end before, this character."""
    return char.isalnum() or char == "_"


def _doi(word: str) -> str | None:
    """The DOI in a word: directory 10, a registrant's number, a slash, and all that follows but closing punctuation."""
    for at in (m.start() for m in re.finditer(r"10\.", word)):
        registrant = _digits(word, at + 3, 10)
        slash = at + 3 + len(registrant)
        suffix = word[slash + 1 :].rstrip(".;)]")
        if 4 <= len(registrant) <= 9 and word[slash : slash + 1] == "/" and suffix and not _joined(word[at - 1 : at]):
            return (word[at : slash + 1] + suffix).lower()
    return None


def _old_id(word: str) -> str | None:
    """The archive's id of before 2007 in a word: a name, maybe a subject class in capitals, a slash and seven digits."""
    for at in (m.start() for m in re.finditer("/", word)):
        number, name, subject = _digits(word, at + 1, 8), word[:at], ""
        if len(number) != 7 or _joined(word[at + 8 : at + 9]):
            continue
        if name[-3:-2] == "." and len(name) > 3 and all(c in string.ascii_uppercase for c in name[-2:]):
            name, subject = name[:-3], name[-3:]
        archive = name[len(name.rstrip(_LOWER)) :].lstrip("-")
        if len(archive) > 1 and not _joined(name[: len(name) - len(archive)][-1:]):
            return f"{archive}{subject}/{number}"
    return None


def _new_id(word: str, before: str) -> str | None:
    """The archive's number YYMM.NNNN or YYMM.NNNNN in a word, behind a lead in it or in the word ``before`` a blank."""
    low = word.lower()
    places = [m.end() for lead in _LEADS for m in re.finditer(re.escape(lead), low)] + [0] * before.lower().endswith(("arxiv", *_LEADS))
    for at in sorted(places):
        month, number = _digits(word, at, 5), _digits(word, at + 5, 6)
        if len(month) == 4 and word[at + 4 : at + 5] == "." and len(number) in (4, 5):
            return f"{month}.{number}"
    return None


def work(chunk: str) -> dict[str, str | None]:
    """``raw, ref_doi, ref_arxiv, ref_title`` of a chunk; none where nothing is found. A new-style id goes before an old one."""
    parts = _BETWEEN.split(chunk)
    doi = new = old = None
    for k in range(0, len(parts), 2):
        word = parts[k]
        before = parts[k - 2] if k and not parts[k - 1].strip() else ""
        doi, new, old = doi or _doi(word), new or _new_id(word, before), old or _old_id(word)
    return {"raw": chunk.strip()[:RAW], "ref_doi": doi, "ref_arxiv": new or old, "ref_title": field(chunk, "title")}


def cited_dois(source: str | None) -> list[str]:
    """The DOI fields of a bibliography's entries, as written; a value without a directory and a slash is none."""
    return [v for chunk in works(source) for v in fields(chunk, "doi") if "10." in v and "/" in v]


#: Files of a submission that hold its bibliography, best first.
_SOURCES = (".bbl", ".bib", ".tex")


def source_of(archive: bytes | None) -> str:
    """Bibliography text of a submission: the best kind of file of a tar, or a plain file; none for a PDF or broken bytes."""
    data = archive or b""
    if data[:2] == b"\x1f\x8b":
        try:
            data = zlib.decompress(data, wbits=31)
        except zlib.error:
            return ""
    kinds: dict[str, list[bytes]] = {}
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for member in filter(tarfile.TarInfo.isfile, tar):
                kinds.setdefault(PurePosixPath(member.name.lower()).suffix, []).append(tar.extractfile(member).read())
    except tarfile.TarError:
        kinds = {} if data[:5] == b"%PDF-" else {_SOURCES[0]: [data]}
    best = next((kinds[k] for k in _SOURCES if k in kinds), [])
    return "\n".join(b.decode("utf-8", "ignore") for b in best)
