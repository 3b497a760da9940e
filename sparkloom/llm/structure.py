"""Where a text stops: a pushdown parser over fences, brackets, quotations, lists and markup."""

from __future__ import annotations

import re

#: Characters that show nothing: white space, format and filler characters.
INVISIBLE = "\\s­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ\x00-\x1f"
_EDGES = "".join(filter(re.compile(f"[{INVISIBLE}]").match, map(chr, range(0x10000))))
_CUT_MARK = re.compile(
    r"(?:\.{3,}|…|‥|⋯|[\[(<{*]*\s*(?:truncated|cut(?: off| short)?|continued|continues|cont|snip(?:ped)?|incomplete|output limit|max(?:imum)? (?:tokens|length)|length limit|end of stream|eos|\.\.\.|…)[^\w\[(<{]*[\])>}*])$",
    re.I,
)
#: Characters that a text with a cut mark may end with.
_MARK_ENDS = ("...", "…", "‥", "⋯", "]", ")", ">", "}", "*")
_OPENERS = re.compile(r"[(\[{“„«»「『（\"<`]|^[> \t]*~~~", re.M)
#: A line of nothing but a heading, which the text after it would have to follow.
_BARE_HEADING = re.compile(r"^\s*#{1,6}\s+\S[^.!?]*$")
_END = re.compile(r"[.!?。！？‽؟।][\"'’”»«)\]}」』*_~`]*$")
_FENCE = re.compile(r"^\s*(?:>\s*)*(`{3,}|~{3,})")
_ITEM = re.compile(r"^\s*(?:>\s*)*(?:[-*+•‣–]|\(?(?:\d{1,3}|[a-zA-Z])[.)])(?:\s+|$)")
_STUB = re.compile(r"(?:^|\s)[a-z0-9]+(?:_[a-z0-9]+)+\.$|\b[A-Za-z0-9]+\.[a-z]{1,3}\.$|(?<!\w)(?:e\.g|i\.e|z\.B|p\. ?ex|etc)\.?$")
_CODE = re.compile(r"^\s*(?:>\s*)*(?:[A-Za-z]{3}(?:\.[lwbLWB])?(?:\s+[#$(\[\w.][^\s]*(?:,\s*\w+\)?)?)?|\.?[A-Za-z_]\w*:|\.[a-z_]\w*)\s*(?:;.*)?$")
_MNEMONIC = re.compile(r"^[A-Z]{3}$|^[a-z]{3}$")
# Instructions after which control does not fall through to the next line.
_LEAVES = {"rts", "rtl", "rti", "jmp", "jml", "bra", "brl", "stp"}
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）"}
_CLOSERS = {")", "]", "}", "”", "»", "」", "』", "）"}
_MARKS = re.compile("[" + re.escape("".join({*_PAIRS, *_CLOSERS, '"'})) + "]")
# What stands in brackets or quotation marks without opening one: code spans, single quoted marks, half-open intervals.
_SPAN = re.compile(r"`[^`\n]*`|(['\"])[()\[\]{}<>'\"“”„«»]\1")
_INTERVAL = re.compile(r"\[[^\[\](),\n]{1,40},[^\[\](),\n]{1,40}\)|\([^\[\](),\n]{1,40},[^\[\](),\n]{1,40}\]")
# Elements that end where the next one of their kind begins.
_IMPLIED = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link", "blank", "none", "empty", "wbr", "source", "col"}
# Words that no answer ends with.
_DANGLING = set(
    "a an the of to in on at by for with from into and or but nor that which who when where while because if as than is are was were be been has have had its their this these it then so not "
    "der die das den dem des ein eine einen einem einer und oder aber von vom zu zum zur mit nach bei im in auf für weil wenn dass ob ist sind war wird als nicht noch "
    "le la les un une des du de et ou mais que qui quand dans sur pour par avec sans est sont au aux en "
    "el los las una unos unas y o pero cuando del al con para por sin es son se lo su "
    "os as um uma e ou mas quando do da dos das no na nos nas ao com para por sem é são".split()
)


def visible(text: str | None) -> str:
    """The text without white space and invisible characters at either end."""
    return text.strip(_EDGES) if text else ""


def open_at_end(text: str) -> list[str]:
    """What is still open where the text stops, outermost first.

    The stack holds ``fence`` for a code block, the opening character for a bracket or quotation and
    ``<name>`` for markup. Inside a fence nothing else is read. Brackets and quotations end with their
    paragraph, so one that is never closed does not hide what follows.
    """
    stack: list[str] = []
    if not _OPENERS.search(text):
        return stack
    lines = text.split("\n")
    for at, line in enumerate(lines):
        if line.count("```") % 2 or line.lstrip("> \t").startswith("~~~"):
            if stack and stack[-1] == "fence":
                stack.pop()
            else:
                stack = [s for s in stack if s[0] == "<"] + ["fence"]
            continue
        if stack and stack[-1] == "fence":
            continue
        if not line.strip():
            stack = [s for s in stack if s[0] == "<"]
            continue
        before = list(stack)
        if "`" in line or "'" in line or '"' in line:
            line = _SPAN.sub(" ", line)
        marks = line
        if "," in line and ("[" in line or "]" in line):
            marks = _INTERVAL.sub(" ", line)
        quoted = '"' in stack
        for mark in _MARKS.finditer(marks):
            ch = mark.group()
            # A mark that may also close opens only before a word; a quotation can end in a later paragraph.
            opens = marks[mark.end() : mark.end() + 1].strip(" \t.,;:!?)]") != ""
            if ch == '"':  # after a digit it is a measure, unless it closes a quotation
                if quoted or opens and not marks[max(0, mark.start() - 1) : mark.start()].isdigit():
                    quoted = not quoted
            elif stack and ch in _closers(stack[-1]):
                stack.pop()
            elif ch in "“»" and not ("«" in stack and ch == "»"):
                stack.extend(ch if opens else "")
            elif ch in _PAIRS:
                stack.append(ch)
            elif ch in _CLOSERS and any(ch in _closers(s) for s in stack):
                while stack and ch not in _closers(stack.pop()):
                    pass
        if quoted != ('"' in stack):
            stack.append('"') if quoted else stack.remove('"')
        if "<" in line:
            for close, name, single in _TAG.findall(line):
                tag = f"<{name.lower()}>"
                if close and tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
                elif not close and not single and name.lower() not in _VOID and f"</{name}" in text and not (stack[-1:] == [tag] and name.lower() in _IMPLIED):
                    stack.append(tag)
        if len(stack) > len(before) and at + 1 < len(lines) and is_code(line):
            stack = before  # an instruction ends with its line
    return stack


def _closers(opener: str) -> str:
    """The marks that close an opening one; low quotation marks have two, guillemets may point inwards."""
    return "“”" if opener == "„" else "«" if opener == "»" else _PAIRS.get(opener, "")


def is_code(line: str) -> bool:
    """Whether a line reads as one instruction or label of an assembly listing."""
    return bool(_CODE.match(line))


def stops_inside(text: str | None, strict: bool = False, ends=None) -> str | None:
    """What a text stops inside: code_block, word, list_item, sentence, mark, or None if it is complete.

    With ``strict`` the length speaks for a cut; see :func:`endings`.
    """
    return endings(text, ends)[strict]


def endings(text: str | None, ends=None) -> tuple[str | None, str | None]:
    """What a text surely stops inside, and what it stops inside if its length speaks for a cut.

    A text with nothing visible is complete here (it is empty, not cut). One that ends with a cut mark or
    leaves a code block, bracket, quotation or markup open is cut. So is one that ends without a mark, but
    for whole sentences by the classifier ``ends`` (see :class:`.endings.EndModel`), which like a jump's
    operand or a full stop after half a file name are cut only at a length that speaks for it. Without
    ``ends`` every ending without a mark is a cut. Headings at the end that nothing follows are left out.
    """
    text = visible(text)
    if text.endswith(_MARK_ENDS):
        line = text.rfind("\n") + 1
        mark = _CUT_MARK.search(text, line)
        if mark:
            rest = visible(text[: mark.start()])
            return ("mark",) * 2 if any(c.isalnum() for c in rest) else (None, None)
    if not any(c.isalnum() for c in text):
        return None, None
    stack = open_at_end(text)
    if stack and stack[-1] == "fence":
        return ("code_block",) * 2
    lines = [x for x in text.split("\n") if x.strip()]
    while len(lines) > 1 and _BARE_HEADING.match(lines[-1]):
        lines.pop()
    last = lines[-1].strip()
    item = _ITEM.match(last)
    if stack:
        return ("list_item" if item else "code_block" if len(lines) > 1 and is_code(last) else "sentence",) * 2
    if last.endswith(("```", "~~~")):
        return None, None
    body = last[item.end() :] if item else last
    if item and not body.strip():
        return ("list_item",) * 2
    if _END.search(body):
        return None, "word" if _STUB.search(body) else None
    if is_code(last) and len(lines) > 1 and not item:
        head = re.sub(r"^[>\s]+", "", last).split()[0].lower()
        if is_code(lines[-2]) or head in _LEAVES:
            returns = head in ("rts", "rtl", "rti", "stp")
            return None if returns or head in _LEAVES and len(last.split()) > 1 else "code_block", None if returns else "code_block"
    tokens = body.split()
    inside = "list_item" if item else "sentence" if body[-1] in ",;:" or len(tokens) > 1 else "word"
    if not item and len(lines) == 1 and len(tokens) <= 5 and len(body) <= 32:
        word = tokens[-1]
        if body[-1] not in ",;:-/([{" and word.lower() not in _DANGLING:
            return None, None  # short answers repeat, so their lengths are frequent without any cut
    if ends and body[-1] not in ",;:-/" and ends.ends(body):
        return None, inside
    return inside, inside
