"""The sentences of a page of wiki markup, in reading order."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_EMPTY_REF = re.compile(r"<ref\b[^<>]*/>", re.I)
_BLOCK = re.compile(r"<(ref|gallery|math|code|pre|nowiki|syntaxhighlight|timeline|score|table|sup|sub)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_BREAK = re.compile(r"<(?:br|hr|p)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_LINK = re.compile(r"\[\[([^\[\]|:]*)\]\]|\[\[[^\[\]|:]*\|([^\[\]|]*)\]\]")
_SPACED_LINK = re.compile(r"\[\[[^\[\]]*\]\]")
_WEB_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]*\s*([^\]]*)\]|https?://\S+")
_MAGIC = re.compile(r"__[^\W_]+__")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
#: A line that begins so is a table, a heading, a redirect, a rest of a template or a file of a gallery.
_NO_PROSE = ("{", "|", "!", "}", "=", "[[", "----", "#")
_FILE_LINE = re.compile(r"[^\W\d_]{2,}:[^\s:]*\.[A-Za-z]{3,4}\b")
_END = re.compile(r"""(?<=[.!?…])["'”»“’)\]]*\s+|(?<=[。！？])["'”»“’)）」』]*\s*|(?<=[.!?])(?=[\u3400-\u9fff])""")
#: A quotation or an aside in a sentence, which may be in another language.
_QUOTED = re.compile(r"""[(（][^()（）]+[)）]|„[^„“”]+[“”]|“[^“”]+”|«[^«»]+»|(?<!\w)"(?=\S)[^"]+"|「[^「」]+」|''[^']{2,}''""")
#: A piece that is only an initial, a short abbreviation or a number belongs to what follows.
_ABBREVIATED = re.compile(r"""[^\w\u3400-\u9fff]*(?:\d+|[^\W\d_\u3400-\u9fff]{1,3})\.\Z""")
_LETTER = re.compile(r"[^\W\d_]")
_TERMINATED = re.compile(r"""[.!?…。！？]["'”»“’)\]）」』]*$""")


def _link_text(m: re.Match) -> str:
    return m.group(1) or m.group(2) or ""


def paragraphs(text: str) -> list[str]:
    """Lines of running text; bold and italic marks are left in."""
    if "<" in text:
        text = _COMMENT.sub(" ", text)
        if "<" in text:
            text = _TAG.sub(" ", _BREAK.sub("\n", _BLOCK.sub("", _EMPTY_REF.sub("", text))))
    if "{{" in text:
        if "{{{" in text:
            text = _PARAMETER.sub("", text)
        while True:
            text, n = _TEMPLATE.subn("", text)
            if not n:
                break
    if "[" in text:
        text = _LINK.sub(_link_text, text)
        while "[[" in text:
            text, n = _SPACED_LINK.subn("", text)
            if not n:
                break
        if "//" in text:
            text = _WEB_LINK.sub(r"\1", text)
    if "__" in text:
        text = _MAGIC.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    out = []
    for line in _LINE.split(text):
        line = line.strip(" \t\u00a0\u200b\ufeff\u3000")
        if not line or line.startswith(_NO_PROSE) or line.endswith("=="):
            continue
        if line[0] in "*:;":
            line = line.lstrip("*:; \t")
        if ":" in line and _FILE_LINE.match(line):
            continue
        out.append(line)
    return out


def sentences(text: str) -> list[str]:
    """Sentences with an end mark, without quotations and asides; other lines are no sentences."""
    out = []
    for line in paragraphs(text):
        line = line.replace("'''", "")
        if "(" in line or '"' in line or "''" in line or "„" in line or "«" in line or "“" in line or "（" in line:
            # An emphasised word stays, an emphasised phrase is a title or a quotation.
            line = re.sub(r"''([^'\s]+)''", r"\1", line)
            line = _QUOTED.sub("", line).replace("''", "")
        before = ""
        for s in _END.split(line):
            if _ABBREVIATED.match(s):
                before += s + " "
                continue
            s, before = before + s, ""
            if _TERMINATED.search(s) and _LETTER.search(s):
                out.append(s)
    return out
