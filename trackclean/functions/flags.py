"""Defect flags of a (title, artist) pair, in the order of the detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import DEFAULT, Options
from .text import GENERIC, SPACES, WS, blank, is_symbolic, lstrip, rstrip, text, ustrip

#: Patterns of the defects that are told by one.
NUMBERED = rf"^{WS}*[0-9]{{1,3}}{WS}*[-._)\]{SPACES}]"
TEMPO_MARK = rf"(?i)[{SPACES}\-(\[]+[0-9]{{2,3}}{WS}*bpm\b"
DASHES = rf"{WS}-{WS}[^\n]*{WS}-{WS}"
ORIGINAL_MIX = rf"(?i)\boriginal{WS}*mix\b"


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_generic(s: Column) -> Column:
    return text(s).rlike(GENERIC)


def is_unreadable(s: Column) -> Column:
    """Not symbolic, and shorter than two characters or less than three letters in ten."""
    t = ustrip(text(s))
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    return ~is_symbolic(s) & ((F.length(t) < 2) | (letters / F.greatest(F.length(t), F.lit(1)) < 0.3))


def is_badly_cased(s: Column) -> Column:
    t = ustrip(s)
    return (((t == F.lower(t)) & (t != F.upper(t))) | ((t == F.upper(t)) & (F.length(t) > 3))) & s.rlike(r"\p{L}") & ~is_symbolic(s)


def detect_issues(title: Column, artist: Column, o: Options = DEFAULT) -> Column:
    t, a = text(title), text(artist)
    dash = F.contains(t, F.lit(" - "))
    dashes = F.size(F.split(t, " - ")) - 1
    low = F.lower(t)
    weird = F.contains(t, F.lit("_")) | F.contains(t, F.lit("  ")) | any_of(F.contains(t, F.lit(x)) for x in o.replace_with_dash) | F.contains(t, F.lit("-")) & t.rlike(DASHES)
    found = {
        "artist_missing": blank(a),
        "embedded_track_number": t.rlike(NUMBERED),
        "embedded_artist": dash & (dashes <= 3),
        "junk_prefix": any_of(F.startswith(F.lower(lstrip(t)), F.lit(p.lower())) for p in o.junk_prefixes),
        "junk_suffix": any_of(F.endswith(F.lower(rstrip(t)), F.lit(p.lower())) for p in o.junk_suffixes),
        "original_mix_redundant": F.contains(low, F.lit("original")) & t.rlike(ORIGINAL_MIX),
        "bpm_suffix": F.contains(low, F.lit("bpm")) & t.rlike(TEMPO_MARK),
        "weird_separators": weird,
        "bad_capitalization": is_badly_cased(t),
        "generic_track_name": is_generic(t),
        "unreadable_title": blank(t) | is_unreadable(t),
        "duplicate_artist_title": (a != "") & (t != "") & (F.lower(ustrip(a)) == F.lower(ustrip(t))),
        "scene_junk": any_of(F.contains(low, F.lit(m.lower())) for m in o.scene_markers),
        "missing_artist_but_present_in_title": blank(a) & dash,
    }
    return those([(c, F.lit(name)) for name, c in found.items()])


def those(found: list[tuple[Column, Column]]) -> Column:
    """The values whose condition holds, in order; without a function of an array's items, which would not be compiled, nor
    all that its array is made of."""
    return F.concat(*[F.when(c, F.array(value)).otherwise(F.array().cast("array<string>")) for c, value in found])


def has_any(flags: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, names)))
