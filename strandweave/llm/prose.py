"""Running text out of wiki markup, and its sentences."""

from __future__ import annotations

import re

PAIRED = re.compile(r"<(/?)(ref|math|nowiki|table|sup|sub|gallery|noinclude|includeonly|code|pre)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z!][^<>\n]*>")
INNER = re.compile(r"\{\{\{?[^{}]*\}?\}\}")
SPACED = re.compile(r"\[\[[^\[\]|]*:[^\[\]]*\]\]")
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
OUTER = re.compile(r"\[(?:https?:)?//[^\]\n]*\]|https?://\S+")
TITLE = re.compile(r"^\s*'''[^\n]*?'''\s*[–—-]\s+")
END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+")
WORD = re.compile(r"[^\W\d_]+")


def untagged(text: str) -> str:
    """The text without comments and without what stands between paired tags; one pass, however many tags stay open."""
    if "<!--" in text:
        first, *rest = text.split("<!--")
        text = first + "".join(" " + r.split("-->", 1)[1] if "-->" in r else "<!--" + r for r in rest)
    tags = list(PAIRED.finditer(text))
    ends: dict[str, list] = {}
    for t in tags:
        if t[1]:
            ends.setdefault(t[2].lower(), []).append(t)
    out, at = [], 0
    nexts = {name: iter(own) for name, own in ends.items()}
    close = {name: next(own) for name, own in nexts.items()}
    for t in tags:
        if t[1] or t.start() < at:
            continue
        name = t[2].lower()
        if name == "ref" and t[0].endswith("/>"):
            end = t.end()
        else:
            c = close.get(name)
            while c is not None and c.start() < t.end():
                c = close[name] = next(nexts[name], None)
            if c is None:
                continue
            end = c.end()
        out += [text[at : t.start()], " "]
        at = end
    return TAG.sub(" ", "".join(out) + text[at:])


def sentences(text: str) -> list[str]:
    """The sentences of the prose: no templates, tables, references, headings, categories, redirects or title."""
    if "<" in text:
        text = untagged(text)
    while "{{" in text:
        shorter = INNER.sub(" ", text)
        if shorter == text:
            break
        text = shorter
    if "[" in text:
        if "://" in text:
            text = OUTER.sub(" ", text)
        text = LINK.sub(r"\1", SPACED.sub(" ", text))
    if "'''" in text:
        text = TITLE.sub("", text)
    if "''" in text:
        text = text.replace("'''", "").replace("''", "")
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "|!#={" and (line[0] != "#" or line[1:2].isalpha()):
            continue
        out += END.split(line.lstrip("*#:; "))
    return out
