"""Caption and name text as columns: camera-motion removal, cleaning, names, escapes."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.functions import dims

# The wording of camera motion in captions, and the repairs after its removal. The order of steps matters.
_VERBS = (
    r"(?:advances?|moves?|pans?|tilts?|glides?|shifts?|adjusts?|continues?|transitions?|progresses|follows?|maintains?"
    r"|approaches|turns?|swings?|tracks?|sweeps?|zooms?|pulls?|pushes?|ascends?|descends?|retreats?|emerges?"
    r"|navigates?|crosses?|provides?|offers?|reveals?|captures?|remains?)"
)
_ADVERBS = r"(?:smoothly |steadily |gently |briefly |subtly |occasionally |then |slowly |further )?"
_PRONOUN_MOVES = r"(?:it|he|she|they)\s+" + _VERBS + r"[^.]*\."
_OPENING = (
    r"(?i)^(?:(?:The (?:video|footage|clip) (?:begins|starts|opens) with )|(?:The first-person perspective (?:begins|starts) with )"
    r"|(?:The camera " + _VERBS + r"\s+))?(?:a |the )?(?:first-person |FPV |steady |smooth )?(?:perspective |view |forward movement |movement |motion )?"
    r"(?:(?:of someone\s+)?(?:moving|walking|advancing|progressing|traveling|gliding)\s+)?(?:steadily |smoothly |slowly |forward )?"
    r"(?:along|through|across|over|down|into|past|forward along|ahead along)?\s+([^.]*?)\.\s*"
)
_STEPS = [
    (r"(?i)^(?:The (?:video|footage|clip) (?:begins|starts|opens) with )?(?:a |the )?(?:first-person |FPV |steady |smooth )?(?:perspective|view|forward movement|movement|motion)"
     r"(?:\s+(?:of someone\s+)?(?:moving|walking|advancing|progressing|traveling|gliding))[^.]*\.\s*", ""),
    (r"(?i)(?<=[.!?])\s*(?:(?:The (?:camera|viewer|movement|journey|walk|ascent|descent|advance|progression))"
     r"|(?:As the (?:viewer|person|camera|walk|journey|movement)\s+(?:progresses|continues|advances|moves|proceeds))"
     r"|(?:The (?:entire )?(?:sequence|journey|video|walk)\s+(?:maintains|unfolds|continues|captures))"
     r"|(?:Throughout the (?:entire )?(?:sequence|journey|video|walk|clip))|(?:(?:The )?[Cc]ontinuing (?:onward|forward|straight)))[^.!?]*[.!?]", ""),
    (r"(?i),?\s*(?:the camera|the viewer(?:'s gaze)?|the perspective)\s+" + _ADVERBS + _VERBS + r"[^,.\n]*", ""),
    (r"(?i),\s*(?:moving|advancing|walking|progressing|traveling|gliding|proceeding)(?:\s+(?:steadily |smoothly |slowly |forward |ahead )?"
     r"(?:forward|ahead|along|through|across|onward|deeper|further|into))[^,.\n]*", ""),
    (r"(?i)\s*with a (?:first-person|FPV|steady)\s+(?:perspective|view)\s+(?:of someone\s+)?(?:moving|walking|advancing|progressing)[^,.]*", ""),
    (r"\s*,\s*,", ","),
    (r"\.\s*\.", "."),
    (r"(?i)(?<=\.)\s*(?:As|And|But|While)\s*,", "."),
    (r"\bAs\s*,\s*", ""),
    (r"(?<=\.)\s*,\s*", ". "),
    (r"(?i)\.\s+" + _PRONOUN_MOVES, ""),
    (r"(?i)^\s*" + _PRONOUN_MOVES + r"\s*", ""),
    (r"^\s*[,;.]\s*", ""),
    (r"^\s*capturing\b", "Capturing"),
    (r"\.\s*\.", "."),
    (r"\s{2,}", " "),
]
#: A location shorter than this is not rescued; a part of one shorter than that does not show that it is still there.
LOCATION_CHARS, PART_CHARS, SEEN_CHARS, LEAST_CHARS = 15, 8, 150, 20


#: Any white space, as a class that Java, RE2 and Python read alike.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def stripped(text: Column) -> Column:
    """Without white space at the ends, line ends and wide blanks included."""
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def strip_camera_motion(caption: Column) -> Column:
    """A caption without the descriptions of camera movement.

    A location named in the opening is put in front if it got lost with the opening. A result below LEAST_CHARS characters
    is not used: the caption stays as it was. Null stays null.
    """
    text = caption
    for pattern, by in _STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    text = stripped(text)
    location = stripped(F.regexp_extract(caption, _OPENING, 1))
    named = F.regexp_replace(location, r"[,. ]+$", "")
    parts = F.filter(F.transform(F.split(named, ","), stripped), lambda p: F.length(p) > PART_CHARS)
    seen = F.exists(parts, lambda p: F.lower(F.substring(text, 1, SEEN_CHARS)).contains(F.lower(p)))
    text = F.when((F.length(location) > LOCATION_CHARS) & ~seen, F.concat(named, F.lit(". "), text)).otherwise(text)
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    return F.when(F.length(text) < LEAST_CHARS, caption).otherwise(text)


# How the bytes 80 to 9f read in Windows-1252, curly quotes, ligatures.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_PLAIN = str.maketrans({**dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "\u2028": "\n", "\u2029": "\n", "\x85": "\n"})
_BYTE_OF = {c: 0x80 + i for i, c in enumerate(_C1)} | {chr(b): b for b in range(0x80, 0x100)}
#: A first byte of two to four and the bytes that follow it, each read as a character.
_MISREAD = re.compile(rf"[\xc2-\xdf][\x80-\xbf{_C1}]|[\xe0-\xef][\x80-\xbf{_C1}]{{2}}|[\xf0-\xf4][\x80-\xbf{_C1}]{{3}}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff\ufff9-\ufffb]")


def _reread(m: re.Match) -> str:
    try:
        return bytes(_BYTE_OF[c] for c in m.group()).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repaired_text(text: str) -> str:
    """A text whose UTF-8 bytes were read as Windows-1252, once or several times, read rightly; plain quotes, letters instead
    of ligatures and full-width forms, one kind of line end, no control characters, composed letters."""
    while (again := _MISREAD.sub(_reread, text)) != text:
        text = again
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_PLAIN)
    text = "".join(unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uffee" else c for c in text) if any("\uff01" <= c <= "\uffee" for c in text) else text
    return unicodedata.normalize("NFC", _CONTROL.sub("", text))


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else repaired_text(t), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescaped_html(text: pd.Series) -> pd.Series:
    """Entities resolved twice, as captions come escaped twice."""
    return text.map(lambda t: t if t is None else html.unescape(html.unescape(t)), na_action="ignore")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))


def cleaned(text: Column) -> Column:
    """Broken encodings repaired, entities resolved, white space collapsed."""
    return collapsed(unescaped_html(repaired(text)))


def escaped(text: Column) -> Column:
    """For use inside HTML; the ampersand first."""
    for raw, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(by))
    return text


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def canonical_metric(name: Column) -> Column:
    """The metric that a result file's name for it means; other names stay."""
    known = F.create_map(*(F.lit(x) for kv in dims.ALIASES.items() for x in kv))
    return F.coalesce(known[name], name)


def renamed_prefix(key: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose prefix fits replaces it."""
    out = None
    for old, new in rules:
        fits, value = key.startswith(old), F.concat(F.lit(new), F.substring(key, len(old) + 1, 1 << 30))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return key if out is None else out.otherwise(key)


def filled(template: str, name: str, value: Column) -> Column:
    """A template with ##NAME## replaced."""
    return F.replace(F.lit(template), F.lit(f"##{name}##"), value.cast("string"))
