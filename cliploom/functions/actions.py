"""Actions: key and mouse tokens from directory names, action texts, JSON and captions, and their spread over chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.functions.dims import IDLE
from cliploom.functions.shapes import padded

ACTION = "struct<keys:string,mouse:string>"

# How directories spell mouse directions. Other arrows than the idle one are not spelled as themselves.
MOUSE_NAMES = {
    "Up": "↑", "Down": "↓", "Left": "←", "Right": "→", "Up_Left": "↑←", "Up_Right": "↑→", "Down_Left": "↓←", "Down_Right": "↓→", "·": "·",
}


def action(keys: Column | str, mouse: Column | str) -> Column:
    keys, mouse = (F.lit(x) if isinstance(x, str) else x for x in (keys, mouse))
    return F.struct(keys.alias("keys"), mouse.alias("mouse"))


def action_of_directory(name: Column, names: dict[str, str] = MOUSE_NAMES) -> Column:
    """Action of Keys_<keys>_Mouse_<mouse>; "_" in keys means "+", an unknown mouse word no movement; other names are idle."""
    keys = F.replace(F.regexp_extract(name, r"^Keys_(.+)_Mouse_(.+)$", 1), F.lit("_"), F.lit("+"))
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    mouse = F.coalesce(known[F.regexp_extract(name, r"^Keys_(.+)_Mouse_(.+)$", 2)], F.lit(IDLE[1]))
    return F.when(name.rlike(r"^Keys_(.+)_Mouse_(.+)$"), action(keys, mouse)).when(name.isNotNull(), action(*IDLE))


def action_of_line(line: Column) -> Column:
    """Action of a line of an action text: its first two tokens in parentheses, idle ones where they are missing."""
    tokens = F.regexp_extract_all(line, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return action(F.coalesce(F.get(tokens, F.lit(0)), F.lit(IDLE[0])), F.coalesce(F.get(tokens, F.lit(1)), F.lit(IDLE[1])))


def actions_of_json(text: Column) -> Column:
    """Actions of a JSON list of objects or of pairs; missing parts are idle, broken JSON and other values give null."""
    objects = F.from_json(text, "array<struct<keys:string,mouse:string>>")
    pairs = F.from_json(text, "array<array<string>>")
    from_objects = F.transform(objects, lambda a: action(F.coalesce(a["keys"], F.lit(IDLE[0])), F.coalesce(a["mouse"], F.lit(IDLE[1]))))
    from_pairs = F.transform(pairs, lambda a: action(F.coalesce(F.get(a, F.lit(0)), F.lit(IDLE[0])), F.coalesce(F.get(a, F.lit(1)), F.lit(IDLE[1]))))
    is_list, of_objects = F.trim(text).rlike(r"^\[[\s\S]*\]$"), F.trim(text).rlike(r"^\[\s*(\{|\])")
    return F.when(is_list & of_objects, from_objects).when(is_list, from_pairs)


def actions_to_json(actions: Column) -> Column:
    """[[keys, mouse], ...]"""
    return F.to_json(F.transform(actions, lambda a: F.array(a["keys"], a["mouse"])))


def spread(segments: Column, chunks: int | Column) -> Column:
    """Segments in turn over ``chunks`` places as evenly as can be, the first ones longer; with more segments than places
    only the first have one."""
    n = F.lit(chunks) if isinstance(chunks, int) else chunks
    many = F.size(segments)
    base, more = F.floor(n / many).cast("int"), n % many
    return F.when(many > 0, F.flatten(F.transform(segments, lambda s, i: F.array_repeat(s, base + (i < more).cast("int")))))


def chunk_action(actions: Column, chunk: Column) -> Column:
    """The action of a chunk; the last one for chunks beyond the list."""
    return F.get(actions, F.least(chunk, F.size(actions) - 1))


# The wording of camera clauses, in order of precedence.
_MOVE = r"moves|advances|progresses|glides|proceeds|pushes|follows|tracks|navigates"
_TURN = r"pans|shifts|turns|sweeps|rotates|tilts|angles"
_ADV = r"(?:\s+(?:steadily|smoothly|slightly|gently|gradually|subtly|then|occasionally|slowly|briefly|further|continuously|rapidly|quickly))*"
_PREP = r"(?:\s+(?:to the|toward the|towards the))?"
_DIR = r"forward|backward|upward|downward|left|right|up|down"
_WHO = r",?\s*the (?:camera|viewer(?:'s (?:perspective|gaze|view))?|drone)(?:\s+angle)?" + _ADV + r"\s+"
_CONTINUED = (
    r"(?:(?:to\s+)?(?:move|pan|tilt|advance|progress|glide|shift|push|turn|track|navigate)"
    r"|moving|panning|tilting|advancing|progressing|gliding|shifting|pushing|turning)"
)
_CLAUSES = [
    ("plain", _WHO + rf"(?P<verb>{_MOVE}|{_TURN})" + _ADV + _PREP + r"\s+" + rf"(?P<dir>{_DIR})"),
    ("moves", _WHO + r"continues" + _ADV + r"\s+" + _CONTINUED + _ADV + _PREP + r"\s+" + rf"(?P<dir>{_DIR})"),
    ("moves", _WHO + r"continues\s+(?:its|the)\s+(?:steady\s+|smooth\s+)?" + rf"(?P<dir>{_DIR})"),
    ("pans", _WHO + rf"(?:{_MOVE}|{_TURN})" + _ADV + r"\s+from\s+(?:the\s+)?" + rf"(?:{_DIR})" + r"\s+to\s+(?:the\s+)?" + rf"(?P<dir>{_DIR})"),
    ("plain", _WHO + r"(?P<verb>moving|panning|tilting|advancing|progressing|gliding|shifting|pushing|turning)" + _ADV + _PREP + r"\s+" + rf"(?P<dir>{_DIR})"),
]
_PATTERNS = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in _CLAUSES]
_TURNING = {"pans", "shifts", "turns", "sweeps", "rotates", "tilts", "angles", "panning", "shifting", "turning", "tilting"}
_KEY_OF = {"forward": "W", "backward": "S", "left": "A", "right": "D"}
_MOUSE_OF = {"left": "←", "right": "→", "up": "↑", "down": "↓", "upward": "↑", "downward": "↓"}
#: Text between clauses from this length on is a stretch without camera movement.
IDLE_CHARS = 20


def camera_clauses(prompt: str) -> list[tuple[int, int, str, str]]:
    """(start, end, verb, direction) of the camera clauses of a caption, by place. A pattern's match is left out where it
    begins inside a match found before."""
    found: list[tuple[int, int, str, str]] = []
    for rank, (kind, pattern) in enumerate(_PATTERNS):
        for m in pattern.finditer(prompt):
            if rank and any(a <= m.start() < b for a, b, _, _ in found):
                continue
            verb = m["verb"].lower() if kind == "plain" else kind
            found.append((m.start(), m.end(), verb, m["dir"].lower()))
    return sorted(found, key=lambda f: f[0])


def camera_segments(prompt: str | None) -> list[tuple[str, str]]:
    """The actions a caption tells, in order. Movement and turn next to each other are one action, a longer text without
    camera movement an idle one. A caption without clauses gives one idle action."""
    clauses = camera_clauses(prompt) if prompt else []
    out: list[tuple[str, str]] = []
    open_kind, last = None, 0
    for start, end, verb, direction in clauses:
        gap = len(prompt[last:start].strip(", ")) >= IDLE_CHARS
        turning = verb in _TURNING
        if gap:
            out.append(IDLE)
        if open_kind is not None and open_kind != turning and not gap:
            keys, mouse = out[-1]
            out[-1] = (keys, _MOUSE_OF.get(direction, IDLE[1])) if turning else (_KEY_OF.get(direction, IDLE[0]), mouse)
            open_kind = None
        else:
            out.append((IDLE[0], _MOUSE_OF.get(direction, IDLE[1])) if turning else (_KEY_OF.get(direction, IDLE[0]), IDLE[1]))
            open_kind = turning
        last = end
    if clauses and len(prompt[last:].strip(", .")) >= IDLE_CHARS:
        out.append(IDLE)
    return out or [IDLE]


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("keys", T.StringType()), T.StructField("mouse", T.StringType())]))


@F.pandas_udf(_SEGMENTS)
def segments_of_caption(prompt: pd.Series) -> pd.Series:
    """``camera_segments`` of each caption; needs the places of matches, which no built-in function gives."""
    return prompt.map(lambda p: [{"keys": k, "mouse": m} for k, m in camera_segments(p if isinstance(p, str) else None)])


def with_actions(df: DataFrame, chunks: int, text_actions: Column | None = None, null_is_text: bool = False) -> DataFrame:
    """Adds actions and action_source: the actions of a row by precedence: its chunk_actions_json, a shared action text,
    its action_keys and action_mouse, its prompt_original, its refined_prompt or prompt.

    Blank values and broken JSON pass on to the next tier. So does a null key or mouse, unless ``null_is_text``, which
    reads it as the word "nan". Captions are parsed only for rows that no earlier tier settles.
    """
    own = actions_of_json(F.nullif(F.trim("chunk_actions_json"), F.lit("")))
    own = F.when(F.size(own) > 0, padded(own, chunks))
    shared = padded(text_actions, chunks) if text_actions is not None else F.lit(None).cast(f"array<{ACTION}>")
    keys, mouse = F.col("action_keys"), F.col("action_mouse")
    if null_is_text:
        pair = F.array_repeat(action(F.coalesce(keys, F.lit("nan")), F.coalesce(mouse, F.lit("nan"))), chunks)
    else:
        pair = F.when(keys.isNotNull() & mouse.isNotNull(), F.array_repeat(action(keys, mouse), chunks))
    out = df.withColumns({"_a0": own, "_a1": shared, "_a2": pair})
    settled = F.coalesce("_a0", "_a1", "_a2").isNotNull()
    original = F.when(~settled & (F.trim("prompt_original") != ""), F.col("prompt_original"))
    plain = F.when(~settled & original.isNull(), F.coalesce("refined_prompt", "prompt"))
    out = out.withColumns({"_o": original, "_s": segments_of_caption(F.coalesce(original, plain))})
    out = out.withColumn("_a3", F.when(F.col("_o").isNotNull(), spread(F.col("_s"), chunks))).withColumn("_a4", spread(F.col("_s"), chunks))
    names = ("chunk_actions_json", "action_text", "columns", "prompt_original", "prompt")
    source = F.coalesce(*(F.when(F.col(f"_a{i}").isNotNull(), F.lit(n)) for i, n in enumerate(names)))
    return out.withColumn("actions", F.coalesce(*(f"_a{i}" for i in range(5)))).withColumn("action_source", source).drop("_o", "_s", *(f"_a{i}" for i in range(5)))
