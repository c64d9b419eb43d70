"""Text, number and date functions as Columns. All are JVM-side built-ins.

Regular expressions here and in the extractors carry their flags inline: ``i`` and ``u`` for case-insensitive Unicode, ``s`` for dot-all, ``m``
for line anchors, and ``d`` so that only \\n ends a line.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, from the rule that decomposition leaves an ASCII letter first.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFKD", c)) != c and d[0].isascii() and d[0].isalpha() and len(d.encode("ascii", "ignore")) == 1]
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)
_MARKED = "".join(_MARKED)

# Month names.
MONTHS_SHORT = ("JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ")
MONTHS_LONG = ("JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "MAIO", "JUNHO", "JULHO", "AGOSTO", "SETEMBRO", "OUTUBRO", "NOVEMBRO", "DEZEMBRO")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """Null, NaN or white space only; never null itself."""
    s = c.cast("string")
    return s.isNull() | (F.trim(F.regexp_replace(s, r"\s+", " ")) == "") | (s == "NaN")


def strip_accents(c: Column) -> Column:
    """Latin letters lose their marks; combining marks go."""
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{Mn}+", "")


def name_key(c: Column) -> Column:
    """Lower-case letters and digits only, without accents."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "")


def text_key(c: Column) -> Column:
    """Upper case, no accents, single spaces, trimmed."""
    return F.upper(F.trim(F.regexp_replace(strip_accents(c), r"\s+", " ")))


def tight_key(c: Column) -> Column:
    """Upper case, no accents, no spaces."""
    return F.upper(F.regexp_replace(strip_accents(c), r"\s+", ""))


def py_name_key(name: str) -> str:
    """``name_key`` of a column name, on the driver."""
    return re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode().lower())


def py_column_key(name: str) -> str:
    """Key under which rules find sheets and columns: no accents, spaces or underscores, upper case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", str(name)) if not unicodedata.combining(c))
    return re.sub(r"[\s_]+", "", plain).upper()


#: Letters that Java takes as part of a number (exponents, suffixes, names, hexadecimals); here they make the text no number.
_NUMBER_LETTERS = "dDfFiInNaAeExXpP"


def py_text_key(text: str) -> str:
    """``text_key`` of a literal."""
    bare = "".join(c for c in text.translate(str.maketrans(_MARKED, _PLAIN)) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", bare, flags=re.ASCII).strip(" ").upper()


def py_loose_number(text: str) -> float | None:
    """``loose_number`` of a literal."""
    s = re.sub(r"\s+", "", text, flags=re.ASCII)
    if re.fullmatch(r"[+-]?\d+([.,]\d+)?", s, re.ASCII):
        return float(s.replace(",", "."))
    return float(s) if re.fullmatch(r"[+-]?\d+(\.\d+)?[eE][+-]?\d+", s, re.ASCII) else None


def br_number(c: Column) -> Column:
    """Brazilian number text to double: points go, the comma becomes the point, trailing % goes; anything else is null. One pass over the text, no regular expression."""
    plain = F.translate(F.rtrim(F.trim(c), F.lit("%")), f",{_NUMBER_LETTERS}.", "." + "?" * len(_NUMBER_LETTERS))
    return plain.try_cast("double")


def format_br(c: Column, decimals: int = 2) -> Column:
    """A number as Brazilian text, 1.234,56; the inverse of ``br_number``."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def br_date(c: Column) -> Column:
    """dd/mm/yyyy to yyyy-mm-dd by place, without a calendar check; other shapes stay; blank is null."""
    return let(c, lambda x: F.when(x != "", F.regexp_replace(x, "^([^/]*)/([^/]*)/([^/]*)$", "$3-$2-$1")))


def loose_number(c: Column) -> Column:
    """Number of a cell: spaces go; sign, digits and one fraction after . or , ; anything else is null."""
    s = F.regexp_replace(c.cast("string"), r"\s+", "")
    whole = F.when(s.rlike(r"^[+-]?\d+(?:[.,]\d+)?$"), F.replace(s, F.lit(","), F.lit(".")).cast("double"))
    return F.coalesce(whole, F.when(s.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$"), s.cast("double")))


def without_format(c: Column) -> Column:
    return F.regexp_replace(c, r"[.\-]", "")


def month_number(c: Column) -> Column:
    """Two digits of a Portuguese month name, short or long, in any case, with or without cedilla."""
    pairs = [x for names in (MONTHS_SHORT, MONTHS_LONG) for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(f"{i:02d}"))]
    return F.try_element_at(F.create_map(*pairs), F.upper(strip_accents(c)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def month_from_name(path: Column) -> Column:
    """yyyy-mm from a file name that has a month's long name and a year."""
    pattern = r"(?iu)\b(JANEIRO|FEVEREIRO|MAR[ÇC]O|ABRIL|MAIO|JUNHO|JULHO|AGOSTO|SETEMBRO|OUTUBRO|NOVEMBRO|DEZEMBRO)\.?\s*(\d{4})\b"
    name = file_name(path)
    return F.concat(first(name, pattern, 2), F.lit("-"), month_number(first(name, pattern)))


@dataclass(frozen=True)
class Scanned:
    """A text and what ``folded`` makes of it: most patterns are ruled out by a literal that is not in there, without a pass of the regular expression."""

    text: Column
    folded: Column


#: What Java's case-insensitive patterns take for an ASCII letter, beside the letter in both cases.
_ALIKE = (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k"))


def folded(text: Column) -> Column:
    """Lower case; it holds the ``required`` literals of every pattern that matches the text, whatever its flags."""
    return F.lower(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), _ALIKE, text))


def _best(clauses: list[tuple[str, ...]]) -> tuple[str, ...]:
    return max(clauses, key=lambda c: min(map(len, c)), default=())


def _branches(pattern: str, at: int) -> tuple[list[tuple[str, ...]], int]:
    """(clauses of the alternation that starts here, where it ends). Every match holds one literal of each clause."""
    every, clauses, run = [], [], ""
    while True:
        c = pattern[at : at + 1]
        if c in ("", "|", ")"):
            every.append(clauses + [(run,)] * bool(run))
            clauses, run = [], ""
            if c != "|":
                either = tuple(x for b in every for x in _best(b))
                return (every[0] if len(every) == 1 else [either] * all(every)), at + 1
            at += 1
            continue
        literal, inner = "", []
        if c == "(":
            kind = re.compile(r"\((\?[a-z]*\)|\?<?[=!]|\?:|(?!\?))").match(pattern, at)
            if not kind:
                raise ValueError(f"group of {pattern} at {at}")
            if kind[1].endswith(")"):
                at = kind.end()
                continue
            inner, at = _branches(pattern, kind.end())
            inner = [] if kind[1] not in ("", "?:") else inner
        elif c == "[":
            at = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]").match(pattern, at).end()
        elif c == "\\":
            literal, at = "" if pattern[at + 1].isalnum() else pattern[at + 1], at + 2
        else:
            literal, at = "" if c in ".^$" else c, at + 1
        literal = literal.lower() if literal.isascii() else ""
        times = re.compile(r"([?*+]|\{(\d+)[^}]*\})[?+]?").match(pattern, at)
        if times:
            at = times.end()
            if times[1] in "?*" or times[2] == "0":
                literal, inner = "", []
        run += literal
        if times or not literal:
            clauses, run = clauses + [(run,)] * bool(run) + inner, ""


@lru_cache(None)
def required(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Literals of three letters or more, in lower case: every match of the pattern holds one of each tuple, in any case. Short tuples come first, long ones are left out."""
    least = lambda c: tuple(x for x in dict.fromkeys(c) if not any(y in x and y != x for y in c))
    found = dict.fromkeys(c for c in map(least, _branches(pattern, 0)[0]) if min(map(len, c)) >= 3 and len(c) <= 8)
    return tuple(sorted(found, key=lambda c: (len(c), -min(map(len, c)))))


def _may(text: Scanned, pattern: str) -> Column | None:
    """False if the text can't match; None if nothing tells."""
    each = [reduce(Column.__or__, (F.contains(text.folded, F.lit(x)) for x in c)) for c in required(pattern)]
    return reduce(Column.__and__, each) if each else None


def may(text: Column | Scanned, pattern: str) -> Column:
    """False only if the pattern can't match: the literals that it needs are not there."""
    found = _may(text, pattern) if isinstance(text, Scanned) else None
    return F.lit(True) if found is None else found


def any_may(text: Column | Scanned, patterns: list[str]) -> Column:
    """False only if none of the patterns can match. A literal that several need is looked for once."""
    if not isinstance(text, Scanned) or not all(map(required, patterns)):
        return F.lit(True)
    need = dict.fromkeys(x for p in patterns for x in max(required(p), key=lambda c: sum(c in required(q) for q in patterns)))
    return reduce(Column.__or__, (F.contains(text.folded, F.lit(x)) for x in need))


def has(text: Column | Scanned, pattern: str) -> Column:
    """Does the pattern match anywhere?"""
    if not isinstance(text, Scanned):
        return text.rlike(pattern)
    held = _may(text, pattern)
    if held is None:
        return text.text.rlike(pattern)
    whole = re.fullmatch(r"\(\?[a-z]*i[a-z]*u[a-z]*\)([A-Za-z ]+)", pattern)
    return held if whole and required(pattern) == ((whole[1].lower(),),) else held & text.text.rlike(pattern)


def _where(text: Column | Scanned, pattern: str, body):
    """body(the text), null where the pattern can't match."""
    if not isinstance(text, Scanned):
        return body(text)
    held = _may(text, pattern)
    return body(text.text) if held is None else F.when(held, body(text.text))


def first(text: Column | Scanned, pattern: str, group: int = 1) -> Column:
    """Group of the first match, trimmed; null without a match."""
    bare = lambda c: F.trim(c, F.lit(" \t\n\x0b\f\r"))
    if isinstance(text, Scanned) and required(pattern):  # most texts that may match do: an empty group alone asks again
        return _where(text, pattern, lambda t: let(F.regexp_extract(t, pattern, group), lambda x: F.when((x != "") | t.rlike(pattern), bare(x))))
    return _where(text, pattern, lambda t: F.when(t.rlike(pattern), bare(F.regexp_extract(t, pattern, group))))


def cut_right(line: Column, patterns: tuple[str, ...]) -> Column:
    """The line without what the patterns match, one after the other. Most lines match none: one pattern made of all of them tells, after one space if all begin with some."""
    bare = [re.sub(r"^\(\?[a-z]*\)", "", p).removesuffix(".*$") for p in patterns]
    spaced = all(b.startswith(r"\s+") for b in bare)
    any_of = rf"\s(?:{'|'.join(b.removeprefix(r'\s+') for b in bare)})" if spaced else "|".join(bare)
    any_of = any_of.replace(r"[\d.,]+\s", r"[\d.,]++\s")  # no number gives back a part of itself to a space
    return F.when(line.rlike(f"(?iud){any_of}"), reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, line)).otherwise(line)


def last(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last match, trimmed; null without a match."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once and named, so that an expression that uses it often stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shapes(text: Column | Scanned, *kinds) -> Column:
    """The row of the first pattern that matches. kinds: (pattern, number of groups, body from the groups to a row that is not null)."""
    one = lambda p, n, body: let(groups(text, p, n), lambda g: F.when(g.isNotNull(), body(g)))
    return F.coalesce(*(one(*k) for k in kinds))


def _whole_line(pattern: str) -> bool:
    """Does the pattern match a line as a whole or not at all?"""
    flags, rest = re.fullmatch(r"(?:\(\?([a-z]*)\))?(.*)", pattern, re.S).groups()
    return rest.startswith("^") and rest.endswith("$") and not rest.endswith("\\$") and "m" not in (flags or "")


def groups(text: Column | Scanned, pattern: str, n: int) -> Column:
    """All n groups of the first match at once, null without a match; groups that took no part are empty. The pattern matches no empty text.

    A pattern of whole lines runs once: the line becomes its groups, or stays in one piece."""
    row = "\x01".join(f"${i}" for i in range(1, n + 1))
    if n > 1 and _whole_line(pattern):
        return _where(text, pattern, lambda t: let(F.split(F.regexp_replace(t, pattern, row), "\x01", -1), lambda g: F.when(F.size(g) == n, g)))
    whole = lambda t: F.regexp_extract(t, pattern, 0)
    return _where(text, pattern, lambda t: F.when(whole(t) != "", F.split(F.regexp_replace(whole(t), pattern, row), "\x01", -1)))


def all_groups(text: Column | Scanned, pattern: str, n: int) -> Column:
    """The groups of every match: array<array<string>>."""
    row = "\x01".join(f"${i}" for i in range(1, n + 1))
    found = _where(text, pattern, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    if isinstance(text, Scanned) and required(pattern):
        found = F.when(text.text.isNotNull(), F.coalesce(found, F.array().cast("array<string>")))
    return F.transform(found, lambda m: F.split(F.regexp_replace(m, pattern, row), "\x01", -1))


def url_quote(c: Column) -> Column:
    """Percent-encoding that keeps / and ~ and encodes the space as %20."""
    q = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def file_link(file: Column, mode: str, template: str | None = None) -> Column:
    """Link of a file: ``search`` (a drive search for the stem), ``template`` ({stem} and {file}), else null; blank file is null."""
    name = blank_to_null(file.cast("string"))
    stem = file_stem(name)
    if mode == "search":
        return F.concat(F.lit("https://drive.google.com/drive/search?q="), url_quote(stem))
    if mode == "template" and template:
        text = F.replace(F.replace(F.lit(template), F.lit("{arquivo_sem_ext}"), stem), F.lit("{arquivo}"), name)
        return F.when(name.isNotNull(), text)
    return F.lit(None).cast("string")


def sorted_letters(c: Column) -> Column:
    """Key of an anagram: all characters but spaces, sorted."""
    return F.array_join(F.array_sort(F.split(F.replace(c, F.lit(" "), F.lit("")), "")), "")


def date_days(a: Column, b: Column) -> Column:
    """Days between two dd/mm/yyyy texts; null if one is no date."""
    day = lambda c: F.try_to_timestamp(c, F.lit("dd/MM/yyyy"))
    return F.datediff(day(b), day(a))
