"""Text expressions: trimming, tokens, full text, file names, clock display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is trimmed and split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]"
SPACES = rf"[{SPACE_CLASS}]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def non_empty(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """Lower-cased tokens; punctuation is deleted, so ``a-b`` gives ``ab``."""
    words = F.regexp_replace(F.lower(c), NOT_WORD, "")
    return F.array_remove(F.split(F.coalesce(words, F.lit("")), SPACES), "")


def full_text(asr_text: Column, ocr_texts: Column, action_labels: Column, audio_events: Column) -> Column:
    """Non-empty parts in the order transcript, screen text, actions, sounds, joined by one space."""

    def joined(c: Column) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, " "))

    return F.concat_ws(" ", non_empty(asr_text), joined(ocr_texts), joined(action_labels), joined(audio_events))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def clock(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on; negative times show as zero."""
    whole = F.floor(seconds).cast("bigint")
    hours, minutes, secs = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    return (
        F.when(seconds < 0, F.lit("00:00"))
        .when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, secs))
        .otherwise(F.format_string("%02d:%02d", minutes, secs))
    )
