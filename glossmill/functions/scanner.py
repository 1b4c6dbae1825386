"""Locate functions and methods in one source text.

The only parser-like Python of the package, called on Arrow batches. Strings,
comments, templates and patterns are blanked first; declarations are then found with
searches over the blanked text and a table of matching brackets. It knows no
grammar beyond that. Brackets that do not match are left out of the table, and
so are declarations that need them; the others are found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

# Words after which a value starts: "/" opens a pattern there, "function" an expression.
_BEFORE_VALUE = (
    "return|typeof|case|in|of|delete|void|throw|new|do|instanceof|yield|await|extends|default"
)
_OPAQUE = re.compile(
    r"//[^\n]*|/\*.*?\*/"
    r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
    r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
    r"|`"
    rf"|(?:[=(,:;!&|?{{\[+\-*%~^<>]|(?P<behind>\))|\b(?:{_BEFORE_VALUE})\b)\s*"
    r"(?P<pattern>/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*)",
    re.S,
)
_MARK = re.compile(r"""["'`/]""")
_STRING = re.compile(r""""[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'""", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_PATTERN = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*", re.S)
_VALUE_MARKS = frozenset("=(,:;!&|?{[+-*%~^<>")
_VALUE_WORDS = frozenset(_BEFORE_VALUE.split("|"))
_IN_TEMPLATE = re.compile(rf"{_OPAQUE.pattern}|[{{}}]", re.S)
_TEMPLATE_TEXT = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*", re.S)
_NOT_BREAK = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()\[\]{}]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: By code point: opening brackets are positive, their partners the same negative number.
_KINDS = np.zeros(128, np.int8)
for _kind, (_opening, _closing) in enumerate(("()", "[]", "{}"), 1):
    _KINDS[ord(_opening)], _KINDS[ord(_closing)] = _kind, -_kind
#: Levels of brackets that are told apart as arrays.
_DEEPEST = 64

# Possessive quantifiers: blanked comments are long runs of blanks.
_FUNCTION = re.compile(
    r"(?<![.\w$])function\b\s*+\*?\s*+(?P<name>[\w$]*+)\s*+(?=[<(])"
)
_BEFORE_FUNCTION = frozenset("export default async declare".split())
_METHOD_HEAD = (
    r"[^\S\n]*+(?P<first>(?:(?:public|private|protected|static|async|abstract|readonly"
    r"|override|declare)\s++(?=[\w$#\"*]))*+)\*?[^\S\n]*+(?:(?P<name>#?[\w$]++|\"++)\s*+[?!]?\s*+(?=[<(])(?!\(\)[;.,)])|(?P<computed>\[))"
)
_METHOD = re.compile(rf"(?<=[{{}};,\n]){_METHOD_HEAD}")
_DECORATED = re.compile(r"@[\w$.]++")
_BEHIND_DECORATOR = re.compile(_METHOD_HEAD)
# Words that may stand before "(...) {" outside a class or an object.
_STATEMENTS = frozenset(
    "if for while switch catch with function return typeof new await super "
    "do else throw delete void in of instanceof yield case import".split()
)
_CONDITIONS = frozenset(("if", "while", "for", "with"))
_CLASS = re.compile(r"(?<![.\w$])class\b(?=[\s{])")
_LABEL = re.compile(r"\s*(?:case\b|default\s*:$|[\w$]+\s*:$)")
_ENDS_CALL = frozenset((";", ".", ",", ")"))
_TYPE_TOKEN = re.compile(r"=>|[{}()\[\];,=<>|&:]|[\w$.]+")
_EXPECTS_TYPE = frozenset(("|", "&", "<", "=>", "is", "keyof", "typeof", ":"))
_ANGLE = re.compile(r"=>|[<>({\[]")
_PARAMETER_MARK = re.compile(r"=>|[<>,({\[]")
_PARAMETER = re.compile(
    r"\s*(?:@\w+\s*)?(?:(?:public|private|protected|readonly|override)\s+(?=[\w$\[{]))*(?:\.\.\.)?\s*(?P<name>[\w$]+|[\[{])?"
)
_VALUE_EXPECTED = re.compile(rf"(?:[=(,:?&|!+\-*/%<>\[~^.]|\b(?:{_BEFORE_VALUE}))$")
_EMPTY_BODY = re.compile(r"\{(?:\s++|/\*.*?\*/|//[^\n]*)*+\}", re.S)
_LINE_BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029]")


class Unbalanced(ValueError):
    """Brackets or templates do not close."""


def _template_end(src: str, pos: int) -> int:
    """Offset behind the template literal that opens at ``pos``, nested to any depth."""
    depths: list[int] = []  # of braces, for each expression that is open
    pos = _TEMPLATE_TEXT.match(src, pos + 1).end()
    while True:
        if src.startswith("${", pos):
            depths.append(1)
            pos += 2
        elif src.startswith("`", pos):
            pos += 1
            if not depths:
                return pos
        else:
            raise Unbalanced("template")
        while depths[-1]:
            m = _IN_TEMPLATE.search(src, pos)
            if m is None:
                raise Unbalanced("template")
            if m.group() == "`":
                pos = m.start() + 1
                break
            depths[-1] += {"{": 1, "}": -1}.get(m.group(), 0)
            pos = m.end()
        else:
            depths.pop()
        pos = _TEMPLATE_TEXT.match(src, pos).end()


def _word_before_group(text: str) -> str | None:
    """The word in front of the brackets that end ``text``; None if ``text`` starts inside."""
    depth = 0
    for at in range(len(text) - 1, -1, -1):
        depth += {")": 1, "(": -1}.get(text[at], 0)
        if depth == 0:
            end = _end_before(text, at)
            start = _word_start(text, end)
            if text[start:end] == "await":
                end = _end_before(text, start)
                start = _word_start(text, end)
            return text[start:end] if start else None
    return None


def _closes_condition(pieces: list[str]) -> bool:
    """True if the ``)`` that ends the pieces closes the condition of a statement."""
    text = ""
    for piece in reversed(pieces):
        text = piece + text
        if (word := _word_before_group(text)) is not None:
            return word in _CONDITIONS
    return (_word_before_group(" " + text) or "") in _CONDITIONS


def _before_slash(src: str, slash: int, low: int) -> tuple[str, int]:
    """What stands before a slash, not below ``low``: a value is due there ("value"), a
    bracket closes (")") or neither (""); and the offset behind it."""
    end = slash
    while end > low and src[end - 1].isspace():
        end -= 1
    if end == low:
        return "", end
    last = src[end - 1]
    if last in _VALUE_MARKS:
        return "value", end
    if last == ")":
        return ")", end
    start = end
    while start > low and (src[start - 1].isalnum() or src[start - 1] == "_"):
        start -= 1
    whole = not start or not (src[start - 1].isalnum() or src[start - 1] == "_")
    return "value" if whole and src[start:end] in _VALUE_WORDS else "", end


def _blanked(src: str) -> str:
    """``src`` with comments as blanks and other opaque text as quotes, same offsets.

    Only quotes and slashes can open opaque text, so only these are looked for.
    """
    out, pos, at = [], 0, 0
    while (m := _MARK.search(src, at)) is not None:
        start, mark = m.start(), m.group()
        at = start + 1
        if mark == "`":
            try:
                end = _template_end(src, start)
            except Unbalanced:
                end = at  # a stray mark opens nothing
        elif mark != "/":
            if (found := _STRING.match(src, start)) is None:
                continue
            end = found.end()
        elif (found := _COMMENT.match(src, start)) is not None:
            end = found.end()
            comment = found.group()
            out.append(src[pos:start])
            out.append(_NOT_BREAK.sub(" ", comment) if "\n" in comment else " " * len(comment))
            pos = at = end
            continue
        else:
            before, behind = _before_slash(src, start, pos)
            if not before or (found := _PATTERN.match(src, start)) is None:
                continue
            end = found.end()
            if before == ")":
                # a slash behind a bracket divides, unless a statement begins there
                out.append(src[pos:behind])
                pos = behind
                if not _closes_condition(out):
                    continue
        out.append(src[pos:start])
        out.append('"' * (end - start))
        pos = at = end
    out.append(src[pos:])
    return "".join(out)


def _nested(text: str) -> tuple[dict[int, int], dict[int, int]] | None:
    """``_partners`` of a text whose brackets all match, by their depth; None for others."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[np.minimum(codes, 127)]
    at = np.flatnonzero(kind)
    kind = kind[at]
    depth = np.cumsum(np.sign(kind))
    opens = kind > 0
    level = depth - opens  # of an opening bracket and its partner: the brackets around them
    if not len(at) or depth.min() < 0 or depth[-1] or depth.max() > _DEEPEST:
        return None
    order = np.argsort(level, kind="stable")
    first, second = order[0::2], order[1::2]
    if (kind[first] + kind[second]).any():
        return None
    a, b = at[first].tolist(), at[second].tolist()
    partner = dict(zip(a, b, strict=True))
    partner.update(zip(b, a, strict=True))
    places, levels = at[opens], level[opens]
    outer = np.full(len(places), -1)
    by_level = [places[levels == d] for d in range(int(levels.max()) + 1)]
    for d in range(1, len(by_level)):
        outer[levels == d] = by_level[d - 1][np.searchsorted(by_level[d - 1], by_level[d]) - 1]
    return partner, dict(zip(places.tolist(), outer.tolist(), strict=True))


def _partners(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """Offset of the matching bracket for every bracket, and the bracket around each.

    A closing bracket that fits an opened one drops what was opened since; one that
    fits none is dropped itself. An opened brace of a declaration outlives a single
    bracket too many, so the text behind it is still read.
    """
    if (found := _nested(text)) is not None:
        return found
    partner: dict[int, int] = {}
    around: dict[int, int] = {}
    opened: list[int] = []
    waiting = {"(": 0, "[": 0, "{": 0}
    for m in _BRACKET.finditer(text):
        at = m.start()
        mark = text[at]
        if mark in "([{":
            around[at] = opened[-1] if opened else -1
            opened.append(at)
            waiting[mark] += 1
            continue
        wanted = _PAIRS[mark]
        if not waiting[wanted]:
            continue
        while True:
            other = opened.pop()
            waiting[text[other]] -= 1
            if text[other] == wanted:
                break
        partner[other] = at
        partner[at] = other
    return partner, around


def _word_start(text: str, end: int) -> int:
    """Offset of the first character of the word that ends at ``end``."""
    while end and (text[end - 1].isalnum() or text[end - 1] in "_$"):
        end -= 1
    return end


def _skip_blanks(text: str, pos: int) -> int:
    while pos < len(text) and text[pos].isspace():
        pos += 1
    return pos


def _end_before(text: str, pos: int) -> int:
    """Offset behind the last visible character before ``pos``."""
    size = 256
    while True:
        low = max(0, pos - size)
        seen = len(text[low:pos].rstrip())
        if seen or low == 0:
            return low + seen
        size *= 4


def _behind_generics(text: str, pos: int, partner: dict[int, int]) -> int:
    """Offset behind ``<...>`` at ``pos`` and the blanks after it."""
    if not text.startswith("<", pos):
        return pos
    depth = 0
    while (m := _ANGLE.search(text, pos)) is not None:
        pos = partner.get(m.start(), m.start()) + 1 if m.group() in "({[" else m.end()
        depth += {"<": 1, ">": -1}.get(m.group(), 0)
        if depth == 0:
            break
    return _skip_blanks(text, pos)


def _body(text: str, pos: int, partner: dict[int, int]) -> int:
    """Offset of the brace that opens the body behind a parameter list, or -1.

    A result type may stand between; braces that belong to it are skipped.
    """
    pos = _skip_blanks(text, pos)
    if text.startswith("{", pos):
        return pos
    if not text.startswith(":", pos):
        return -1
    expects_type, pos = True, pos + 1
    while (m := _TYPE_TOKEN.search(text, pos)) is not None:
        token = m.group()
        if token == "{" and not expects_type:
            return m.start()
        if token in (";", "}", ")", "]", "=", ","):
            return -1
        pos = partner.get(m.start(), m.start()) + 1 if token in ("{", "(", "[") else m.end()
        expects_type = token in _EXPECTS_TYPE
    return -1


def _parameters(src: str, text: str, opening: int, partner: dict[int, int]) -> list[str]:
    """Names of the parameters; a destructured one is its source text."""
    closing, names, depth = partner[opening], [], 0
    start = pos = opening + 1
    while True:
        m = _PARAMETER_MARK.search(text, pos, closing)
        at = m.start() if m else closing
        if m is None or (m.group() == "," and depth <= 0):
            if text[start:at].strip():
                names.append(_parameter(src, text, start, partner))
            start = at + 1
        if m is None:
            return names
        pos = partner.get(at, at) + 1 if m.group() in "({[" else m.end()
        depth += {"<": 1, ">": -1}.get(m.group(), 0)


def _parameter(src: str, text: str, start: int, partner: dict[int, int]) -> str:
    m = _PARAMETER.match(text, start)
    if m.group("name") is None:
        behind = text.find("(", m.end())
        if behind == m.end() and behind in partner:  # the decorator has arguments
            return _parameter(src, text, partner[behind] + 1, partner)
        return src[start : m.end()].strip()
    at = m.start("name")
    return src[at : partner.get(at, at) + 1] if m.group("name") in "[{" else m.group("name")


def _with_decorators(text: str, first: int, partner: dict[int, int]) -> int:
    """Offset of the first decorator in front of ``first``."""
    while True:
        end = _end_before(text, first)
        if end and text[end - 1] == ")":
            end = partner.get(end - 1, 0)
        start = end
        while start and (text[start - 1].isalnum() or text[start - 1] in "_$."):
            start -= 1
        if start == end or not start or text[start - 1] != "@":
            return first
        first = start - 1


def _value_expected(text: str, end: int) -> bool:
    """True if an expression, not a statement, goes on behind ``end``."""
    return _VALUE_EXPECTED.search(text[min(_word_start(text, end), max(end - 2, 0)) : end]) is not None


def _declares(text: str, first: int) -> bool:
    """True if a function declaration, not an expression, may start at ``first``."""
    end = _end_before(text, first)
    if end == 0 or text[end - 1] in ";{})":
        return True
    if text[_word_start(text, end) : end] == "else" or "\n" in text[end:first]:
        return not _value_expected(text, end)
    return False


def _class_bodies(text: str, partner: dict[int, int]) -> set[int]:
    """Offsets of the braces that open class bodies."""
    found = set()
    for m in _beginning(_CLASS, "class", text):
        pos, depth = m.end(), 0
        while (mark := _ANGLE.search(text, pos)) is not None:
            if mark.group() == "{" and depth <= 0:
                found.add(mark.start())
                break
            if mark.group() in "({[":
                if mark.start() not in partner:
                    break
                pos = partner[mark.start()] + 1
            else:
                pos = mark.end()
            depth += {"<": 1, ">": -1}.get(mark.group(), 0)
    return found


def _is_object(text: str, brace: int) -> bool:
    """True if the brace opens an object: where a value is expected, no block begins."""
    end = _end_before(text, brace)
    if end == 0 or text.endswith("=>", 0, end) or text[end - 1] in ";{})":
        return False
    if text[end - 1] == ":":
        start = max(text.rfind(c, 0, end) for c in ";{}\n") + 1
        if _LABEL.match(text, start, end) and text[start:end].lstrip().startswith(("case", "default")):
            return False
    return text[end - 1] in "=(,:?&|![" or text[_word_start(text, end) : end] in ("return", "default")


def _beginning(pattern: re.Pattern[str], word: str, text: str) -> Iterator[re.Match[str]]:
    """The matches of a pattern that begins with ``word``, which is looked for."""
    at = text.find(word)
    while at >= 0:
        m = pattern.match(text, at)
        if m is not None:
            yield m
        at = text.find(word, at + 1 if m is None else m.end())


def _candidates(text: str, partner: dict[int, int], around: dict[int, int]):
    """``(first, kind, name start, name end, parameter list)`` of possible declarations."""
    for m in _beginning(_FUNCTION, "function", text):
        opening = _behind_generics(text, m.end(), partner)
        first, default = m.start(), False
        while True:
            end = _end_before(text, first)
            start = _word_start(text, end)
            if text[start:end] not in _BEFORE_FUNCTION:
                break
            first, default = start, default or text[start:end] == "default"
        if (m.group("name") or default) and _declares(text, first):
            yield first, "function", *m.span("name"), opening
    classes, brackets, kinds = _class_bodies(text, partner), sorted(around), {}

    def holds_members(at: int) -> bool:
        """True if the bracket around an offset is that of a class or an object."""
        k = bisect_right(brackets, at - 1) - 1
        brace = brackets[k] if k >= 0 else -1
        while brace >= 0 and partner.get(brace, -1) < at:
            brace = around[brace]
        if brace < 0 or text[brace] != "{":
            return False
        if brace not in kinds:
            kinds[brace] = brace in classes or _is_object(text, brace)
        return kinds[brace]

    heads = {}
    for m in _METHOD.finditer(text):
        at = m.end()
        if text[at - 1] == "[" or text[partner.get(at, -2) + 1 : partner.get(at, -2) + 2] not in _ENDS_CALL:
            heads[m.start("first")] = m  # most matches are calls
    for m in _DECORATED.finditer(text):
        pos = _end_of_decorator(text, m.end(), partner)
        if (head := _BEHIND_DECORATOR.match(text, pos)) is not None:
            heads.setdefault(head.start("first"), head)
    for m in heads.values():
        if m.group("computed"):
            bracket = m.start("computed")
            if bracket not in partner or not holds_members(bracket):
                continue
            start, stop = bracket, partner[bracket] + 1
            opening = _skip_blanks(text, stop)
            if opening >= len(text) or text[opening] not in "<(":
                continue
        else:
            (start, stop), opening = m.span("name"), m.end()
        if text[opening] == "<":
            opening = _behind_generics(text, opening, partner)
        elif text[partner.get(opening, -2) + 1 : partner.get(opening, -2) + 2] in _ENDS_CALL:
            continue  # most matches are calls
        name = text[start:stop]
        if name == "constructor" or (name in _STATEMENTS and not holds_members(start)):
            continue
        yield m.start("first"), "method", start, stop, opening


def _end_of_decorator(text: str, pos: int, partner: dict[int, int]) -> int:
    """Offset behind a decorator's arguments, if it has any."""
    return partner.get(pos, pos - 1) + 1 if text.startswith("(", pos) else pos


def has_block(body: str) -> bool:
    """True for a body with more than white space and comments between its braces."""
    return _EMPTY_BODY.fullmatch(body) is None


def find_functions(src: str | None) -> list[dict]:
    """Functions and methods whose body has a statement, in text order."""
    if not src:
        return []
    text = _blanked(src)
    partner, around = _partners(text)
    found = []
    for first, kind, name_start, name_end, opening in _candidates(text, partner, around):
        if not text.startswith("(", opening) or opening not in partner:
            continue
        body = _body(text, partner[opening] + 1, partner)
        if body in partner and has_block(src[body : partner[body] + 1]):
            found.append((first, kind, src[name_start:name_end], opening, body))
    if not found:
        return []
    line_starts = [0] + [m.end() for m in _LINE_BREAK.finditer(src)]
    rows = []
    for first, kind, name, opening, body in sorted(found):
        # generators and modifiers may leave blanks in front of the declaration
        start = _with_decorators(text, _skip_blanks(text, first), partner)
        end = partner[body] + 1
        line = bisect_right(line_starts, start) - 1
        rows.append(
            {
                "line": line,
                "character": len(src[line_starts[line] : start].encode("utf-16-le")) // 2,
                "comments": src[_end_before(text, start) : start].strip(),
                "text": src[start:end],
                "kind": kind,
                "name": name,
                "params": _parameters(src, text, opening, partner),
                "body": src[body:end],
                "start_off": start,
                "end_off": end,
            }
        )
    return rows
