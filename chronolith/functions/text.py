"""Text as column expressions: slugs, names, Markdown, phrases, screen names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import UI_CHROME

#: Letters with marks of the Latin languages and their plain forms, character for character; fixed values.
MARKED = "ÁÀÂÄÃÅáàâäãåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÖÕóòôöõÚÙÛÜúùûüÑñÇçÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCcYyy"
#: Letters that have a capital of one letter besides the usual one of several, and that one.
WIDE = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 == len(c.title()))
CAPITAL = "ẞ" + "".join(c.title() for c in WIDE[1:])

#: Suffixes that tell versions of one thing apart.
_VERSION = r"(?:[-_\s]*(?:v\d+|version\s*\d+|final[-_\s]*\d+|final|copy|copia|rev\d*))+[-_ ]*$"
_LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
_UPPER = "A-ZÁÉÍÓÚÑ"
# What names of screens don't have, words that are none, lines that are noise, and the signs cut off words.
SCREEN_NOISE = r"(?iu)ctrl?\s*\+|\(ctr|@|\.(com|cl|net)\b|^\s*(esta|este|esto|updated?|new|nuevo|nueva|session|home|men[uú])\s*$"
SCREEN_FILLERS = r"(?i)^(updated?|al|the|de|del|la|el|los|las|un|una|y|o|en)$"
LINE_NOISE = r"(?iu)^(archivo|inicio|insertar|ayuda|buscar|file|home|edit|view|\d{1,2}:\d{2}|[^\p{L}\p{N}_]+)$"
WORD_EDGES = r"^[.&/\-]+|[.&/\-]+$"


def plain(text: Column) -> Column:
    """Letters without their marks, and nothing that isn't ASCII."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"[^\x00-\x7F]", "")


def slug(text: Column, default: str = "") -> Column:
    """ASCII letters and figures by hyphens; ``default`` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(plain(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(out == "", F.lit(default)).otherwise(out)


def stem(name: Column) -> Column:
    """A file name without its folders and its last extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def family(name: Column) -> Column:
    """What versions of a file have in common: its stem without version suffixes, as a lower-case slug."""
    low = plain(F.lower(stem(F.coalesce(name, F.lit("")))))
    base = F.regexp_replace(F.regexp_replace(low, r"^[-_ ]+|[-_ ]+$", ""), _VERSION, "")
    return F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def _without_noise(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for word in ("grabación", "grabacion", "demo"):
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def tokens(text: Column) -> Column:
    """Distinct ASCII words of a name, without those that say nothing."""
    return F.array_distinct(F.filter(F.split(_without_noise(text), r"[^a-z0-9]+"), lambda x: x != ""))


def compact(text: Column) -> Column:
    return F.regexp_replace(_without_noise(text), r"[^a-z0-9]+", "")


def clean_markdown(text: Column) -> Column:
    """Text without links, marks of Markdown, and double or outer spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[por validar\]", "")
    out = F.regexp_replace(out, r"\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"[`*_>#|]", " ")
    out = F.regexp_replace(out, r"\s+([,.;:])", "$1")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(out, r"^[ ·\-—:;,.]+|[ ·\-—:;,.]+\z", "")


def _last(text: Column, sub: str) -> Column:
    """Place from 0 of the last occurrence; -1 without one."""
    at = F.locate(sub[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at + 1 - len(sub)).otherwise(F.lit(-1))


def capital(letter: Column) -> Column:
    """The capital of a letter, itself one letter; letters whose capital is several stay where they have no other."""
    upper = F.upper(letter)
    return F.when(F.length(upper) > 1, F.translate(letter, WIDE, CAPITAL)).otherwise(upper)


def phrase(text: Column, most: int = 165, least: int = 60, first: Callable[[Column], Column] = F.upper) -> Column:
    """A clean phrase: cut at the last sentence or comma past ``least``, or else at the last space; ends with a stop.

    ``first`` makes the first letter a capital; by default it may become several (SS of ß).
    """
    whole = clean_markdown(text)
    cut = F.substring(whole, 1, most)
    stop = F.greatest(_last(cut, ". "), _last(cut, ", "))
    space = _last(cut, " ")
    head = lambda n: cut.substr(F.lit(1), n.cast("int"))
    short = F.when(stop > least, head(stop)).when(space >= 0, head(space)).otherwise(cut)
    kept = F.when(F.length(whole) > most, F.regexp_replace(short, r"^[ ,;:]+|[ ,;:]+\z", "")).otherwise(whole)
    ended = F.when(kept.rlike(r"[.!?]\z"), kept).otherwise(F.concat(kept, F.lit(".")))
    return F.when(kept == "", F.lit("")).otherwise(F.concat(first(F.substring(ended, 1, 1)), ended.substr(F.lit(2), F.length(ended))))


def section(markdown: Column, number: int) -> Column:
    """The body of the section ``## number. ...``, up to the next one."""
    return F.regexp_extract(F.coalesce(markdown, F.lit("")), rf"(?ms)^##\s*{number}\.\s[^\n]*?$(.*?)(?=^##\s|\z)", 1)


def enumerated(block: Column) -> Column:
    """Phrases of a text's facts (1), (2) ...; none with fewer than two marks."""
    parts = F.filter(F.split(F.coalesce(block, F.lit("")), r"(?=\(\d\))"), lambda x: x.rlike(r"^\(\d\)"))

    def fact(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, r"^\(\d\)\s*", ""))
        x = F.trim(F.regexp_replace(x, r"^\s*(y|e)\s+", ""))
        return phrase(F.regexp_replace(x, r"[;,]\s*(?:y|e)?\s*$", ""))

    return F.when(F.size(parts) >= 2, F.filter(F.transform(parts, fact), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def cut_off(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis if there were more."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def is_chrome(text: Column, chrome=tuple(UI_CHROME)) -> Column:
    """Whether all words are parts of any program's window; true without words."""
    known = F.array(*map(F.lit, chrome))
    return F.forall(words(text), lambda w: F.array_contains(known, F.lower(F.regexp_replace(w, WORD_EDGES, ""))))


def is_screen_name(text: Column) -> Column:
    """Whether a line can be the name of a screen: a short label of capitalised words or acronyms, without noise."""
    s = F.coalesce(text, F.lit(""))
    bad = s.rlike(SCREEN_NOISE)
    signs = s.rlike(rf"^[{_LETTERS}0-9][{_LETTERS}0-9 .&\-]*$")
    each = words(s)

    def good(word: Column) -> Column:
        w = F.regexp_replace(word, WORD_EDGES, "")
        upper = w.rlike(r"\p{Lu}") & (w == F.upper(w))
        pieces = F.regexp_extract_all(w, F.lit(rf"([{_UPPER}][a-záéíóúñ]+)"), F.lit(1))
        lower = F.transform(pieces, lambda p: F.lower(p))
        twice = (F.size(pieces) >= 2) & (F.size(F.array_distinct(lower)) < F.size(pieces))
        return (
            (w != "")
            & ~w.rlike(SCREEN_FILLERS)
            & (w.rlike(r"^\p{Lu}") | w.rlike(r"^\d+$"))
            & ((F.length(w) >= 3) | upper)
            & (F.size(pieces) < 3)
            & ~twice
            & (~upper | w.rlike(rf"^[{_UPPER}]{{2,6}}[0-9]{{0,2}}$"))
        )

    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    size = F.length(s).between(4, 34) & F.size(each).between(1, 4)
    return size & ~bad & ~is_chrome(s) & signs & F.forall(each, good) & (letters >= 4)


def screen_title(text: Column, most: int = 40) -> Column:
    """The first line of a text that can be the name of a screen, or ''."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.array_join(words(x), " "))
    fits = lambda s: F.length(s).between(3, most) & ~s.rlike(LINE_NOISE) & s.rlike(r"[A-Za-zÁÉÍÓÚáéíóúÑñ]{3}") & is_screen_name(s)
    return F.coalesce(F.get(F.filter(lines, fits), F.lit(0)), F.lit(""))


def ocr_text(lines: Column, least: float = 0.35) -> Column:
    """Text of recognised lines (array of structs x, y, score, text) in reading order: rows of 12, then from the left."""
    good = F.filter(lines, lambda x: x["score"] >= least)
    keyed = F.transform(good, lambda x: F.struct(F.bround(x["y"] / 12).alias("row"), x["x"].alias("x"), x["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["text"]), "\n")
