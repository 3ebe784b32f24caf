"""String rules as column expressions. White space is Unicode's, spelled out, as Java's classes are ASCII only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import ARTIST_SEPARATORS, DEFAULT, PREFIX_SEPARATORS, STOP_WORDS, UPPER_NAMES, Options

SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACES}]"
#: The same characters one by one, for trimming.
BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The characters trimmed at edges, and the patterns of names that say nothing, numbers, tempo marks, mixes and
#: file names. They accept what the rules are defined to accept; white space is spelled out as Java needs it.
EDGE = " -_:"
GENERIC = rf"(?i)^{WS}*(?:track{WS}*[0-9]+|untitled(?:{WS}*[0-9]+)?|audio{WS}*track{WS}*[0-9]+|t[0-9]+|[0-9]{{1,3}}){WS}*$"
NUMBER = rf"^(?:{WS}*[0-9]{{1,3}}{WS}*[-._)\]]{WS}*|{WS}*[0-9]{{1,3}}{WS}+)"
RANGE = rf"[0-9]{{2,3}}(?:{WS}*[-–—]{WS}*[0-9]{{2,3}})?{WS}*"
TEMPO = (rf"(?i){WS}*[(\[]{WS}*{RANGE}(?:bpm)?{WS}*[)\]]{WS}*$", rf"(?i)[{SPACES}\-]+{RANGE}bpm{WS}*$")
MIX = (rf"(?i){WS}*[(\[]{WS}*original{WS}*mix{WS}*[)\]]{WS}*$", rf"(?i){WS}*-{WS}*original{WS}*mix{WS}*$", rf"(?i){WS}+original{WS}*mix{WS}*$")
#: Of names that clean_name gives, in which one space is all white space there is.
FILENAMES = (
    (r"^(.+?) - [0-9]{1,3} - (.+)$", True),
    (r"^[0-9]{1,3} - (.+?) - (.+)$", True),
    (r"^(?:[0-9]{1,3})? ?[.\-_)\]]+ ?(.+?) - (.+)$", True),
    (r"^[0-9]{1,3} - (.+)$", False),
)
TWO_PARTS = (r"^(.+?) - (.+)$", True)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _plain(c: Column) -> Column:
    """The text begins with an ASCII character that is no white space: told by two comparisons, where trimming looks
    each end up among all kinds of white space."""
    return (c >= "!") & (c < "\x7f")


def ustrip(c: Column) -> Column:
    return F.when(_plain(c) & _plain(F.substring(c, -1, 1)), c).otherwise(F.btrim(c, F.lit(BLANKS)))


def lstrip(c: Column) -> Column:
    return F.when(_plain(c), c).otherwise(F.ltrim(c, F.lit(BLANKS)))


def rstrip(c: Column) -> Column:
    return F.when(_plain(F.substring(c, -1, 1)), c).otherwise(F.rtrim(c, F.lit(BLANKS)))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank(c: Column) -> Column:
    return F.when(_plain(c), False).otherwise(F.btrim(text(c), F.lit(BLANKS)) == "")


def squeeze(c: Column) -> Column:
    """The replacement is left out where all white space is single spaces: it looks each character up."""
    return F.trim(F.when(F.contains(c, F.lit("  ")) | c.rlike("[^ -~]"), F.regexp_replace(c, f"{WS}+", " ")).otherwise(c))


def strip_track_number(s: Column) -> Column:
    """Without a leading track number, unless fewer than two characters would be left."""
    rest = lstrip(F.regexp_replace(s, NUMBER, ""))
    return F.when(s.rlike(NUMBER) & (F.length(rest) >= 2), rest).otherwise(s)


def normalize_separators(s: Column, o: Options = DEFAULT) -> Column:
    """(value, noted): dash tokens to " - ", collapse tokens and white space to one space."""
    out, hit = s, F.lit(False)
    for token, put in [(t, " - ") for t in o.replace_with_dash] + [(t, " ") for t in o.collapse]:
        hit = hit | F.contains(out, F.lit(token))
        out = F.replace(out, F.lit(token), F.lit(put))
    return F.struct(squeeze(out).alias("value"), hit.alias("noted"))


def after(s: Column, n: Column) -> Column:
    return F.ltrim(F.substring(s, n + 1, F.length(s)), F.lit(EDGE))


def strip_literal_prefix(s: Column, prefix: Column) -> Column:
    """Without the prefix in any case and what separates it; as it is if nothing would be left."""
    rest = after(s, F.length(prefix))
    hit = (F.length(prefix) > 0) & F.startswith(F.lower(s), F.lower(prefix)) & ~blank(rest)
    return F.when(F.coalesce(hit, F.lit(False)), rest).otherwise(s)


def strip_artist_prefix(s: Column, artist: Column, album_artist: Column) -> Column:
    """Without "<artist><separator>" (then: album artist) in front; the first that fits, once."""
    found = []
    for name in (ustrip(text(artist)), ustrip(text(album_artist))):
        of_name = []
        for sep in ARTIST_SEPARATORS:
            full = F.concat(name, F.lit(sep))
            rest = after(s, F.length(full))
            of_name.append(F.when(F.startswith(F.lower(s), F.lower(full)) & ~blank(rest), rest))
        found.append(F.when((name != "") & F.startswith(F.lower(s), F.lower(name)), F.coalesce(*of_name)))
    return F.coalesce(*found, s)


def strip_junk_prefix(s: Column, o: Options = DEFAULT) -> Column:
    lead = F.length(s) - F.length(lstrip(s))
    low = F.lower(lstrip(s))
    hit = [F.startswith(low, F.lit(p.lower())) for p in o.junk_prefixes]
    return F.when(reduce(lambda a, b: a | b, hit, F.lit(False)), F.coalesce(*[F.when(h, after(s, lead + len(p))) for h, p in zip(hit, o.junk_prefixes, strict=True)], s)).otherwise(s)


def strip_junk_suffix(s: Column, o: Options = DEFAULT) -> Column:
    low, size = F.lower(rstrip(s)), F.length(rstrip(s))
    hit = [F.endswith(low, F.lit(p.lower())) for p in o.junk_suffixes]
    without = lambda p: F.rtrim(F.substring(s, F.lit(1), F.greatest(size - len(p), F.lit(0))), F.lit(EDGE))
    return F.when(reduce(lambda a, b: a | b, hit, F.lit(False)), F.coalesce(*[F.when(h, without(p)) for h, p in zip(hit, o.junk_suffixes, strict=True)], s)).otherwise(s)


def strip_tempo(s: Column) -> Column:
    """Without tempo marks at the end, however many; a text that is all tempo keeps the last."""

    def without(v: Column, pattern: str) -> Column:
        rest = F.rtrim(F.regexp_replace(v, pattern, ""), F.lit(" -_[(),"))
        return let(rest, lambda r: F.when(v.rlike(pattern) & ~blank(r), r).otherwise(v))

    def once(v: Column) -> Column:
        return let(without(v, TEMPO[0]), lambda x: without(x, TEMPO[1]))

    # every pass that changes something takes a number away
    passes = F.sequence(F.lit(1), F.regexp_count(s, F.lit("[0-9]+")))
    return F.when(s.rlike("[0-9]{2}") & (s.rlike(TEMPO[0]) | s.rlike(TEMPO[1])), F.aggregate(passes, s, lambda v, _: once(v))).otherwise(s)


def strip_original_mix(s: Column) -> Column:
    return F.when(F.contains(F.lower(s), F.lit("original")), F.coalesce(*[F.when(s.rlike(p), rstrip(F.regexp_replace(s, p, ""))) for p in MIX], s)).otherwise(s)


def split_artist_title(s: Column) -> Column:
    """(artist, title) of "Artist - Title" with two characters on both sides and one dash only, else null."""
    left = ustrip(F.substring_index(s, " - ", 1))
    right = ustrip(F.substring(s, F.locate(" - ", s) + 3, F.length(s)))
    fit = F.contains(s, F.lit(" - ")) & (F.length(left) >= 2) & (F.length(right) >= 2) & ~F.contains(right, F.lit(" - "))
    return F.when(fit, F.struct(left.alias("artist"), right.alias("title")))


def is_symbolic(s: Column) -> Column:
    """Up to six letters that are all one letter, or all of i, v, x."""
    t = F.lower(ustrip(text(s)))
    one = F.replace(t, F.substring(t, 1, 1), F.lit("")) == ""
    return (F.length(t) <= 6) & t.rlike(r"^\p{L}{1,6}$") & (one | t.rlike("^[ivx]+$"))


def needs_title_case(s: Column) -> Column:
    return ((s == F.lower(s)) | ((s == F.upper(s)) & (F.length(s) > 3))) & s.rlike(r"\p{L}") & ~is_symbolic(s)


def needs_artist_case(s: Column) -> Column:
    t = ustrip(s)
    return (t == F.lower(t)) & (t != F.upper(t)) & s.rlike(r"\p{L}") & ~s.rlike("[0-9]")


def smart_title_case(s: Column) -> Column:
    """Words capitalised but for small words inside; names that are always upper-case stay so."""
    word = lambda t: ~t.rlike(f"^(?:{WS}+|[-/])$")

    def cased(tokens: Column) -> Column:
        n = F.size(F.filter(tokens, word))

        def one(t: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(tokens, F.lit(1), i), word))
            small = F.lower(t).isin(*STOP_WORDS) & (nth > 0) & (nth < n - 1)
            return (F.when(~word(t), t).when(F.upper(t).isin(*UPPER_NAMES), F.upper(t)).when(small, F.lower(t))
                    .otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))))

        return F.array_join(F.transform(tokens, one), "")

    return let(F.regexp_extract_all(s, F.lit(f"({WS}+|[-/]|[^-/{SPACES}]+)"), F.lit(1)), cased)


def stem(filename: Column) -> Column:
    """Without the last dot and what follows it, unless nothing would be left."""
    left = F.length(filename) - F.length(F.substring_index(filename, ".", -1)) - 1
    return F.when(left > 0, F.substring(filename, F.lit(1), left)).otherwise(filename)


def clean_name(filename: Column) -> Column:
    """A file name as parse_name reads it: without its ending, with single spaces for underscores and white space."""
    return squeeze(F.replace(stem(filename), F.lit("_"), F.lit(" ")))


def parse_filename(filename: Column, two_parts: Column) -> Column:
    """(artist, title) read off a file name, artist null if it has a title only, null if nothing fits."""
    return let(clean_name(filename), lambda v: parse_name(v, two_parts))


def parse_name(v: Column, two_parts: Column) -> Column:
    """parse_filename of a clean_name, which is best a column of its own, as it is named often."""

    def by(pattern: str, both: bool, allowed: Column | None = None) -> Column:
        title = F.trim(F.regexp_extract(v, pattern, 2 if both else 1))
        artist = F.trim(F.regexp_extract(v, pattern, 1)) if both else F.lit(None).cast("string")
        fit = v.rlike(pattern) & (F.length(title) >= 2) & ((F.length(artist) >= 2) if both else F.lit(True))
        return F.when(fit if allowed is None else fit & allowed, F.struct(artist.alias("artist"), title.alias("title")))

    return F.when(F.contains(v, F.lit(" - ")), F.coalesce(*[by(p, b) for p, b in FILENAMES], by(*TWO_PARTS, two_parts)))


def leftmost_segment(prefix: Column) -> Column:
    """The text before the first kind of separator that the prefix has; null if shorter than two characters."""
    first = reduce(lambda rest, sep: F.when(F.contains(prefix, F.lit(sep)), ustrip(F.substring_index(prefix, sep, 1))).otherwise(rest), reversed(PREFIX_SEPARATORS), F.lit(None).cast("string"))
    return F.when(F.length(first) >= 2, first)


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(text(s)), rf"[{SPACES}\-_/]+"), lambda t: F.length(t) > 1)


def no_shared_tokens(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def int_ish(s: Column) -> Column:
    """The number before a slash, or that of the first four characters ("3/12": 3, "2021-05-03": 2021), else null."""
    head = F.split_part(s, F.lit("/"), F.lit(1))
    return F.coalesce(ustrip(head).try_cast("int"), F.substring(head, 1, 4).try_cast("int"))
