"""Options of the cleaning rules; lists become literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    remove_original_mix: bool = True
    remove_bpm_suffix: bool = True
    junk_prefixes: tuple[str, ...] = ("va -", "[free]")
    junk_suffixes: tuple[str, ...] = ("(original mix)", "- original mix", "(free download)")
    scene_markers: tuple[str, ...] = ("webrip", "promo")
    collapse: tuple[str, ...] = ("_", "  ")
    replace_with_dash: tuple[str, ...] = (" -- ", " – ", " — ")
    sample_positions: tuple[str, ...] = ("first", "second", "middle", "last")
    clean_threshold: float = 0.9
    deterministic_threshold: float = 0.6
    low_confidence_flag: float = 0.6
    max_tracks_per_call: int = 40


DEFAULT = Options()

#: Words that stay lower-case inside a title, and names that are always upper-case.
STOP_WORDS = ("a", "an", "and", "as", "at", "but", "by", "in", "of", "on", "or", "the", "to")
UPPER_NAMES = ("VA", "EP", "LP", "DJ", "MC", "VIP", "UK", "USA", "II", "III", "IV")
#: Separators, as they are tried.
ARTIST_SEPARATORS = (" - ", " – ", " — ", " -- ", "_-_")
PREFIX_SEPARATORS = (" - ", " – ", " — ", " -- ")
#: Flags that need a reviewer, that cost a sample much, and that cost it little.
BLOCKING = ("generic_track_name", "unreadable_title", "suspicious_swap_artist_title", "embedded_album_name")
HARD = BLOCKING
SOFT = ("weird_separators", "bad_capitalization", "original_mix_redundant", "junk_prefix", "junk_suffix", "bpm_suffix", "embedded_track_number")
FLAGS = (
    "artist_missing", "embedded_track_number", "embedded_artist", "junk_prefix", "junk_suffix", "original_mix_redundant",
    "bpm_suffix", "weird_separators", "bad_capitalization", "generic_track_name", "unreadable_title",
    "duplicate_artist_title", "scene_junk", "missing_artist_but_present_in_title", "embedded_album_name",
    "suspicious_swap_artist_title",
)
PENDING = ("propose_fix", "unreadable_needs_manual_review")
MANUAL = "unreadable_needs_manual_review"
AUTO_NOTE = "auto-approved"
WRITABLE = (".flac", ".mp3", ".m4a", ".mp4", ".ogg", ".opus")
