"""Prose of technical posts: sentences without code, links, mark-up and quoting signs, with their places."""

from __future__ import annotations

import html
import re

#: What is no prose, replaced by a sentence break (blocks) or a blank (inside a line).
_BLOCKS = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)"
    r"|<pre\b.*?(?:</pre\s*>|\Z)|\[code\].*?(?:\[/code\]|\Z)|<script\b.*?(?:</script\s*>|\Z)"
    r"|^(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+",
    re.S | re.M | re.I,
)
#: Pieces inside lines, each with the strings without which it can't occur.
_INLINE = [
    (("<c", "<C", "<t", "<T", "`"), re.compile(r"<code\b.*?(?:</code\s*>|$)|<tt\b.*?</tt\s*>|``[^`\n]+``|`[^`\n]*`", re.M | re.I)),
    (("<a", "<A", "](", "]:", "[u", "[U"), re.compile(r"<a\b[^>]*>.*?(?:</a\s*>|$)|!?\[[^\]\n]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)|\[url[^\]]*\].*?\[/url\]|\[[^\]\n]*\]:\s*\S+", re.M | re.I)),
    (("://", "www.", "WWW."), re.compile(r"<?\b(?:https?|ftp|ssh|git|file)://[^\s<>\"]+>?|\bwww\.[^\s<>\"]+", re.I)),
    (("@",), re.compile(r"\S+@\S+\.\w+")),
    (("<",), re.compile(r"</?[A-Za-z][^<>\n]*>")),
    (("/",), re.compile(r"(?<!\w)(?:\.{0,2}|~)/[\w.\-]+(?:/[\w.\-]+)*")),
    (("(",), re.compile(r"\b\w+\([^)\n]*\)")),
    (("_",), re.compile(r"\b\w*[a-z]_\w+\b", re.I)),
    (("::", "->", "."), re.compile(r"\b\w+(?:::|->|\.)\w+\(?\)?")),
]
#: What the last of them needs between two words.
_DOTTED = re.compile(r"(?<=\w)(?:::|->|\.)(?=\w)")
_QUOTE = re.compile(r"^[ ]{0,3}(?:>+ ?)+|^[ ]{0,3}(?:[-*+•]|\d+[.)])[ ]+|^#+[ ]+", re.M)
_BREAK = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|(?<=[。！？])|\n\s*\n|\n")
#: Code inside a sentence: assignments with both sides, and the signs of comparisons and arrows.
_CODE_SPAN = re.compile(r"[\w.\[\]]+\s*(?<![=!<>])(?:[-+*/|&%:]?=)(?![=>])\s*[^\s,;]+|[=!<>]=+|[=-]>|[{}]")
#: What a line of code begins or ends with.
_CODE_SHAPE = re.compile(r"[{};=]\s*$|\s:\s*$|^\s*(?:\$|>>>|#!|//|/\*|at \w+\.)|^\s*\w+:\s*\S*\s*$|^ERROR \d|^exit status")
_WORD = re.compile(r"[^\W\d_]{2,}")
#: A line that looks like code is prose if it has so many words; what is left of a sentence besides code, if it has so many.
PROSE_WORDS, LEFT_WORDS = 5, 3
#: Sentences of so few letters tell a language only if one stands out.
FEW_LETTERS = 5
#: A sentence of a post is scored in parts of this many characters if it is longer.
LONGEST = 4000


_CODE_MARKS = frozenset("{}=<>$#/*!:")


def _may_be_code(part: str) -> bool:
    """Whether the search for code can find any: it needs one of these."""
    return part[-1] == ";" or not _CODE_MARKS.isdisjoint(part) or part.startswith(("at ", "ERROR ", "exit status"))


def _without_code(part: str) -> str:
    """The sentence without the code in it; nothing if it is a line of code."""
    left = " ".join(_CODE_SPAN.sub(" ", part).split())
    n = len(_WORD.findall(left))
    wide = n < PROSE_WORDS and _wide_letters(left) >= 2  # scripts without blanks have few words
    if wide or n >= PROSE_WORDS or (n >= LEFT_WORDS or left == part) and not _CODE_SHAPE.search(part):
        return left
    return ""


def _wide_letters(part: str) -> int:
    return sum(c.isalpha() and c > "\u3000" for c in part)


def _worded(part: str) -> bool:
    """Whether there are letters of words."""
    letters = 0
    for c in part:
        if c.isalpha():
            letters += 1
            if letters > 1:
                return True
    return False


def is_short(sentence: str) -> bool:
    """Whether a sentence has too few letters to tell a language by itself, unless one stands out."""
    return len(sentence) < 40 and sum(c.isalpha() for c in sentence) <= FEW_LETTERS and _wide_letters(sentence) < 2


def sentences(text: str | None) -> list[str]:
    """The sentences of a text's prose. A null, empty or wordless text has none."""
    if not text:
        return []
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    if any(m in plain for m in ("```", "~~~", "<", "[", "    ", "\t")):
        plain = _BLOCKS.sub("\n\n", plain)
    dotted = _DOTTED.search(plain)
    for marks, pattern in _INLINE if dotted else _INLINE[:-1]:
        if any(m in plain for m in marks):
            plain = pattern.sub(" ", plain)
    if "&" in plain:
        plain = html.unescape(plain)
    plain = _QUOTE.sub("", plain)
    found = []
    for part in _BREAK.split(plain):
        if not part:
            continue
        part = " ".join(part.split())
        if part and _may_be_code(part):
            part = _without_code(part)
        if not _worded(part):
            continue
        found += [part[i : i + LONGEST] for i in range(0, len(part), LONGEST)]
    return found
