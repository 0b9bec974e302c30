"""Words in Brahmic scripts as Latin letters, by SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST, BLOCK = 0x0900, 0x0D7F, 0x80
# Sounds of the letters by their place in a block (all blocks follow the layout of Devanagari).
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh",
    0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r",
    0x31: "r", 0x32: "l", 0x33: "l", 0x34: "zh", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r",
    0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
# Sounds of vowels, vowel signs, nasal marks and chillu letters.
VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au"}
SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x57: "au", 0x62: "l", 0x63: "l"}
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
CHILLU = {0x0D7A: "n", 0x0D7B: "n", 0x0D7C: "r", 0x0D7D: "l", 0x0D7E: "l", 0x0D7F: "k"}
VIRAMA = 0x4D

_SOUNDS = {chr(FIRST + k): v for t in (CONSONANTS, VOWELS, SIGNS, NASALS) for k, v in t.items()} | {chr(k): v for k, v in CHILLU.items()}
_PLACES = sorted(ord(c) - FIRST for c in _SOUNDS if ord(c) < FIRST + BLOCK) + [VIRAMA]
_OTHERS = [(chr(b + p), chr(FIRST + p)) for b in range(FIRST + BLOCK, LAST, BLOCK) for p in _PLACES]
_JOINERS = "‌‍"
_INDIC = f"[{chr(FIRST)}-{chr(LAST)}]"


def _set(*tables: dict) -> str:
    return "".join(chr(k if k >= FIRST else FIRST + k) for t in tables for k in t)


def literal_map(words: dict[str, str]) -> Column:
    """A dictionary as one constant of the plan; it is broadcast with the code, so keep it to some thousand entries."""
    return F.create_map(*(F.lit(x) for kv in words.items() for x in kv)) if words else F.create_map().cast("map<string,string>")


def romanized(c: Column) -> Column:
    """One word: letters of all blocks are read as Devanagari; a consonant takes an 'a' where another letter than a
    vowel sign or virama follows, none at the end of the word. Other characters vanish; null stays null."""
    s = F.translate(c, "".join(a for a, _ in _OTHERS), "".join(b for _, b in _OTHERS))
    s = F.regexp_replace(s, f"[^{''.join(_SOUNDS)}{chr(FIRST + VIRAMA)}]", "")
    s = F.regexp_replace(s, f"([{_set(CONSONANTS)}])(?=[{_set(CONSONANTS, VOWELS, NASALS, CHILLU)}])", "$1a")
    s = F.replace(s, F.lit(chr(FIRST + VIRAMA)), F.lit(""))
    sounds = literal_map(_SOUNDS)
    return F.array_join(F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(sounds, x), x)), "")


def transliterated(c: Column, learned: dict[str, str] | None = None) -> Column:
    """A text whose Indic words are replaced: by the learned dictionary, else letter by letter. Other texts stay as they are."""
    known = literal_map(learned or {})
    runs = F.regexp_extract_all(c, F.lit(f"[{chr(FIRST)}-{chr(LAST)}{_JOINERS}]+|[^{chr(FIRST)}-{chr(LAST)}{_JOINERS}]+"), F.lit(0))

    def latin(run: Column) -> Column:
        bare = F.regexp_replace(run, f"[{_JOINERS}]", "")
        word = F.coalesce(F.try_element_at(known, bare), F.try_element_at(known, run), romanized(bare)) if learned else romanized(bare)
        return F.when(run.rlike(f"[{chr(FIRST)}-{chr(LAST)}{_JOINERS}]"), word).otherwise(run)

    return F.when(c.rlike(_INDIC), F.array_join(F.transform(runs, latin), "")).otherwise(c)
