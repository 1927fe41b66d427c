"""Text expressions. All run inside the JVM; none needs a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that a CSV reader takes as a missing value.
NA_VALUES = (
    "", "NA", "N/A", "nan", "NaN", "null", "NULL", "None", "n/a", "<NA>", "#N/A",
    "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A", "#NA",
)

# Unicode white space as (first, last) code points.
WHITE_SPACE = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)

# The Unicode property Emoji=Yes beyond ASCII as (first, last) code points. Digits,
# '#' and '*' are emoji only as keycaps, regional indicators only in pairs: see EMOJI.
EMOJI_RANGES = (
    (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122),
    (0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328),
    (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB),
    (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x2604), (0x260E, 0x260E),
    (0x2611, 0x2611), (0x2614, 0x2615), (0x2618, 0x2618), (0x261D, 0x261D), (0x2620, 0x2620),
    (0x2622, 0x2623), (0x2626, 0x2626), (0x262A, 0x262A), (0x262E, 0x262F), (0x2638, 0x263A),
    (0x2640, 0x2640), (0x2642, 0x2642), (0x2648, 0x2653), (0x265F, 0x2660), (0x2663, 0x2663),
    (0x2665, 0x2666), (0x2668, 0x2668), (0x267B, 0x267B), (0x267E, 0x267F), (0x2692, 0x2697),
    (0x2699, 0x2699), (0x269B, 0x269C), (0x26A0, 0x26A1), (0x26A7, 0x26A7), (0x26AA, 0x26AB),
    (0x26B0, 0x26B1), (0x26BD, 0x26BE), (0x26C4, 0x26C5), (0x26C8, 0x26C8), (0x26CE, 0x26CF),
    (0x26D1, 0x26D1), (0x26D3, 0x26D4), (0x26E9, 0x26EA), (0x26F0, 0x26F5), (0x26F7, 0x26FA),
    (0x26FD, 0x26FD), (0x2702, 0x2702), (0x2705, 0x2705), (0x2708, 0x270D), (0x270F, 0x270F),
    (0x2712, 0x2712), (0x2714, 0x2714), (0x2716, 0x2716), (0x271D, 0x271D), (0x2721, 0x2721),
    (0x2728, 0x2728), (0x2733, 0x2734), (0x2744, 0x2744), (0x2747, 0x2747), (0x274C, 0x274C),
    (0x274E, 0x274E), (0x2753, 0x2755), (0x2757, 0x2757), (0x2763, 0x2764), (0x2795, 0x2797),
    (0x27A1, 0x27A1), (0x27B0, 0x27B0), (0x27BF, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B07),
    (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D),
    (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF),
    (0x1F170, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A),
    (0x1F201, 0x1F202), (0x1F21A, 0x1F21A), (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A),
    (0x1F250, 0x1F251), (0x1F300, 0x1F321), (0x1F324, 0x1F393), (0x1F396, 0x1F397),
    (0x1F399, 0x1F39B), (0x1F39E, 0x1F3F0), (0x1F3F3, 0x1F3F5), (0x1F3F7, 0x1F4FD),
    (0x1F4FF, 0x1F53D), (0x1F549, 0x1F54E), (0x1F550, 0x1F567), (0x1F56F, 0x1F570),
    (0x1F573, 0x1F57A), (0x1F587, 0x1F587), (0x1F58A, 0x1F58D), (0x1F590, 0x1F590),
    (0x1F595, 0x1F596), (0x1F5A4, 0x1F5A5), (0x1F5A8, 0x1F5A8), (0x1F5B1, 0x1F5B2),
    (0x1F5BC, 0x1F5BC), (0x1F5C2, 0x1F5C4), (0x1F5D1, 0x1F5D3), (0x1F5DC, 0x1F5DE),
    (0x1F5E1, 0x1F5E1), (0x1F5E3, 0x1F5E3), (0x1F5E8, 0x1F5E8), (0x1F5EF, 0x1F5EF),
    (0x1F5F3, 0x1F5F3), (0x1F5FA, 0x1F64F), (0x1F680, 0x1F6C5), (0x1F6CB, 0x1F6D2),
    (0x1F6D5, 0x1F6D9), (0x1F6DC, 0x1F6E5), (0x1F6E9, 0x1F6E9), (0x1F6EB, 0x1F6EC),
    (0x1F6F0, 0x1F6F0), (0x1F6F3, 0x1F6FC), (0x1F7E0, 0x1F7EB), (0x1F7F0, 0x1F7F0),
    (0x1F90C, 0x1F93A), (0x1F93C, 0x1F945), (0x1F947, 0x1F9FF), (0x1FA70, 0x1FA7C),
    (0x1FA80, 0x1FAC6), (0x1FAC8, 0x1FAC8), (0x1FACC, 0x1FADD), (0x1FADF, 0x1FAEB),
    (0x1FAEF, 0x1FAFA),
)


def regex_class(ranges: Sequence[tuple[int, int]]) -> str:
    """Inside of a regular-expression character class, in the ``\\x{...}`` notation."""
    return "".join(
        f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges
    )


_SPACE_CHARS = "".join(chr(c) for a, b in WHITE_SPACE for c in range(a, b + 1))
_NOT_SPACE = f"[^{regex_class(WHITE_SPACE)}]"

# One emoji: a keycap, a flag pair, or a pictograph with optional flag tags; then the variation
# selector and joiner that bind it to the next one. A lone variation selector is removed anywhere,
# a joiner only after an emoji, because it carries meaning in Persian and Indic scripts.
# The look-ahead rejects nearly every letter in one step, before the alternatives are tried.
EMOJI = (
    "(?=[0-9#*\\x{A9}\\x{AE}\\x{203C}-\\x{1FAFF}])"
    "(?:(?:[0-9#*]\\x{FE0F}?\\x{20E3}"
    "|[\\x{1F1E6}-\\x{1F1FF}]{2}"
    f"|[{regex_class(EMOJI_RANGES)}](?:[\\x{{E0020}}-\\x{{E007E}}]+\\x{{E007F}})?)"
    "(?:[\\x{FE0E}\\x{FE0F}]?\\x{200D})?"
    "|[\\x{FE0E}\\x{FE0F}])"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends. Plain ``trim`` removes blanks only."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def not_blank(text: Column) -> Column:
    """True when the text holds any character that is no white space; false when missing.

    Stops at the first such character, so nothing is copied as ``strip(text) != ''`` would.
    """
    return F.coalesce(text.rlike(_NOT_SPACE), F.lit(False))


def missing_to_null(value: Column, na_values: Sequence[str] = NA_VALUES) -> Column:
    """Null for every spelling of a missing value."""
    return F.when(~value.isin(*na_values), value)


def fill_text(text: Column, null_text: str = "") -> Column:
    """Text as a string, with ``null_text`` for a missing one.

    ``null_text=""`` makes a missing text blank, to be dropped by the blank filter.
    ``null_text="nan"`` keeps it as that word.
    """
    return F.coalesce(text.cast("string"), F.lit(null_text))


def remove_emoji(text: Column) -> Column:
    """Text without emoji; white space around them stays."""
    return F.regexp_replace(text, F.lit(EMOJI), F.lit(""))


def tokens(text: Column, fold: bool = True) -> Column:
    """Array of letter runs, lower-cased unless ``fold`` is false. A missing text has none."""
    source = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(
        F.lower(source) if fold else source, F.lit("[\\p{L}]+"), F.lit(0)
    )


def first_tokens(text: Column, n: int, fold: bool = True) -> Column:
    """The first ``n`` of ``tokens``, without looking for tokens in the rest of the text."""
    source = F.coalesce(text, F.lit(""))
    # At most n + 1 separators are looked for. The first piece is empty when the text starts with
    # one, and the last of n + 2 pieces is the uncut rest.
    pieces = F.split(F.lower(source) if fold else source, "\\P{L}+", n + 2)
    return F.slice(F.array_remove(F.slice(pieces, 1, n + 1), ""), 1, n)
