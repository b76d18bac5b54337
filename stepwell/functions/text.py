"""Keys, spoken forms, slugs and other text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no goal of their own, and how shorthand is said.
ROLES = "jdm jdn jds etw sich".split()
ARTICLES = "der die das den dem des ein eine einer einem einen".split()
PREPOSITIONS = (
    "an auf in zu für gegen als über unter mit von nach bei um vor aus durch gegenüber ohne "
    "wegen zwischen seit trotz statt während bis dank"
).split()
SPOKEN = {"jdm": "jemandem", "jdn": "jemanden", "jds": "jemandes", "jd": "jemand", "etw": "etwas"}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
SLUG_LIMIT = 48


def heads(key: Column) -> Column:
    """The words a goal key names: for each comma part the only word left without roles, frames, articles and, beside
    other words, prepositions; parts that name two name none."""

    def of(part: Column) -> Column:
        written = F.regexp_replace(F.regexp_replace(part, r"\p{L}+\.?\s*\((?:Akk|Dat|Gen|Nom)\)", " "), r"\([^)]*\)", " ")
        found = F.filter(F.regexp_extract_all(written, F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*ROLES, *ARTICLES))
        # the first of words that differ in case only
        lows = F.transform(found, F.lower)
        once = F.filter(found, lambda w, i: F.array_position(lows, F.lower(w)) == i + 1)
        rest = F.when(F.size(once) > 1, F.filter(once, lambda w: ~F.lower(w).isin(*PREPOSITIONS))).otherwise(once)
        return F.when(F.size(rest) == 1, F.element_at(rest, 1))

    return F.array_distinct(F.filter(F.transform(F.split(key, ","), of), lambda w: w.isNotNull()))


def _expand(part: Column) -> Column:
    text = F.regexp_replace(part, r"(?U)(?<![\w.])([\w.]+)(?:/[\w.]+)+", "$1")
    text = F.replace(F.regexp_replace(text, r"\([^)]*\)", " "), F.lit("+"), F.lit(" "))
    names = F.create_map(*[F.lit(x) for kv in SPOKEN.items() for x in kv])
    ws = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    ws = F.transform(ws, lambda w: F.coalesce(F.element_at(names, F.lower(F.regexp_replace(w, r"\.+$", ""))), w))
    at = F.array_position(ws, F.lit("sich")).cast("int")
    moved = F.concat(F.array(F.lit("sich")), F.slice(ws, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(ws, at + 1, F.size(ws)))
    return F.array_join(F.when(at > 1, moved).otherwise(ws), " ")


def spoken(key: Column) -> Column:
    """A key as it is said: shorthand written out, first alternatives, sich in front; of two frames the first, with
    the word both share."""
    first = F.trim(F.element_at(F.split(key, ","), 1))
    branches = F.transform(F.split(first, " / "), lambda b: F.trim(b))
    frame = _expand(F.element_at(branches, 1))
    joined = F.trim(F.concat_ws(" ", frame, F.element_at(heads(first), 1)))
    both = F.when((F.size(heads(first)) == 1) & (frame != ""), joined).otherwise(_expand(F.element_at(branches, -1)))
    return F.when(F.contains(first, F.lit(" / ")), both).otherwise(_expand(first))


def _bare() -> tuple[str, str]:
    """Letters whose compatibility form is one ASCII letter and marks, and those letters."""
    found = {}
    for c in map(chr, range(0xA0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalpha():
            found[c] = base
    return "".join(found), "".join(found.values())


def slug(text: Column) -> Column:
    """Text as part of a file name: umlauts written out, accents dropped, the rest hyphens, 48 characters."""
    for a, b in UMLAUTS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(F.translate(text, *_bare()), r"\p{M}+", "")
    text = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(text, 1, SLUG_LIMIT), "-+$", "")


def search_term(key: Column) -> Column:
    """What to search for: each comma part's last word without brackets, shorthand and articles; the first such."""
    parts = F.transform(F.split(key, ","), lambda p: F.element_at(F.filter(F.split(F.regexp_replace(p, r"\([^)]*\)", " "), r"\s+"), lambda w: (w != "") & ~F.regexp_replace(F.lower(w), r"\.+$", "").isin(*ROLES, *ARTICLES)), -1))
    return F.element_at(F.filter(parts, lambda w: w.isNotNull()), 1)


def says(text: Column, terms: Column) -> Column:
    """Whether lower-case text has the start of any term: all but two letters, four at least."""
    return F.exists(terms, lambda t: F.contains(F.lower(text), F.substr(F.lower(t), F.lit(1), F.greatest(F.lit(4), F.length(t) - 2))))


def mentions(text: Column, word: str) -> Column:
    """Whether text has word as a whole word."""
    import re

    return text.rlike(rf"(?U)(?<!\w){re.escape(word)}(?!\w)")


def cloze(text: Column, surface: Column) -> Column:
    return F.when(F.contains(text, surface), F.replace(text, surface, F.lit("_____"))).otherwise(text)


def video_id(url: Column) -> Column:
    """The id in a video's address, or the text itself if it is one."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|/shorts/|/embed/|^)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit(""))


def channel_handle(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:/channel/(UC[A-Za-z0-9_-]{22})|(@[A-Za-z0-9._-]+))", 0), F.lit(""))


def language(line: Column) -> Column:
    """de, en or ? by which language's function words are more."""
    # fixed values: the marker words counted
    de = r"(?iU)\b(ich|und|das|nicht|ist|die|der|wir|auch|sehr|aber|mit|für|sich|noch|schon|wenn|dass|man)\b"
    en = r"(?iU)\b(the|and|is|you|that|with|for|have|this|are|was|were|they|there|about|would)\b"
    n, m = (F.regexp_count(line, F.lit(p)) for p in (de, en))
    return F.when(n > m, "de").when(m > n, "en").otherwise("?")
