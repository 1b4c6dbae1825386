"""Structure strings: space-separated, bracketed tokens for markup and code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.rows import text_rows

# Elements without content, per the HTML standard.
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "source", "track", "wbr",
)
MARKUP_TOKEN = r"(<!--(?s:.*?)-->|</?[A-Za-z][A-Za-z0-9]*[^<>]*>)"
TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9]*)"

# The reserved and contextual words that have their own token class.
KEYWORDS = (
    "async", "await", "break", "case", "catch", "class", "const", "continue", "debugger",
    "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally",
    "for", "function", "if", "import", "in", "instanceof", "let", "new", "null", "of",
    "return", "static", "super", "switch", "this", "throw", "true", "try", "typeof",
    "var", "void", "while", "with", "yield",
)
# Class names of words whose inner capital no rule gives.
KEYWORD_CLASSES = {"instanceof": "InstanceOfKeyword", "typeof": "TypeOfKeyword"}
# Class names of punctuation.
PUNCTUATION_CLASSES = {
    "(": "OpenParenToken",
    ")": "CloseParenToken",
    "[": "OpenBracketToken",
    "]": "CloseBracketToken",
    ";": "SemicolonToken",
    ",": "CommaToken",
    ".": "DotToken",
    "...": "DotDotDotToken",
    ":": "ColonToken",
    "?": "QuestionToken",
    "=>": "EqualsGreaterThanToken",
    "=": "EqualsToken",
    "==": "EqualsEqualsToken",
    "===": "EqualsEqualsEqualsToken",
    "!=": "ExclamationEqualsToken",
    "!==": "ExclamationEqualsEqualsToken",
    "!": "ExclamationToken",
    "<": "LessThanToken",
    ">": "GreaterThanToken",
    "<=": "LessThanEqualsToken",
    ">=": "GreaterThanEqualsToken",
    "+": "PlusToken",
    "++": "PlusPlusToken",
    "+=": "PlusEqualsToken",
    "-": "MinusToken",
    "--": "MinusMinusToken",
    "-=": "MinusEqualsToken",
    "*": "AsteriskToken",
    "**": "AsteriskAsteriskToken",
    "/": "SlashToken",
    "%": "PercentToken",
    "&": "AmpersandToken",
    "&&": "AmpersandAmpersandToken",
    "|": "BarToken",
    "||": "BarBarToken",
    "^": "CaretToken",
    "~": "TildeToken",
    "@": "AtToken",
}
#: Numbers, words, common marks, comments, strings, templates without nested code,
#: other marks. The frequent alternatives come first.
CODE_TOKEN = (
    r"([0-9][\w.]*|[\w$]+|[(){};,]"
    r"|/\*(?s:.*?)\*/|//[^\n]*"
    r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
    r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
    r"|`[^`\\]*(?:\\.[^`\\]*)*`"
    r"|\.\.\.|===|!==|=>|==|!=|<=|>=|\+\+|--|\+=|-=|\*\*|&&|\|\||[^\s\w$])"
)
_TOKEN, _KEYWORDS = re.compile(CODE_TOKEN, re.ASCII), frozenset(KEYWORDS)
#: What may hold white space, or begin it; between them, white space parts pieces of whole
#: tokens. A backslash escapes no line end.
_MARKS = (b'"', b"'", b"`", b"//", b"/*")
_ESCAPE = rb"\\(?!\r|\xc2\x85|\xe2\x80[\xa8\xa9])[^\n]"
_OPAQUE = re.compile(
    rb"/\*(?s:.*?)\*/|//[^\n]*"
    rb'|"[^"\\\n]*(?:' + _ESCAPE + rb'[^"\\\n]*)*"'
    rb"|'[^'\\\n]*(?:" + _ESCAPE + rb"[^'\\\n]*)*'"
    rb"|`[^`\\]*(?:" + _ESCAPE + rb"[^`\\]*)*`"
    rb"|[\"'`/]"
)
#: The ``[name]`` part of a structure string.
IDENTIFIER = r" \[[^\]]*\]"
_NAMES = re.compile(IDENTIFIER.encode())


def markup_structure(html: Column) -> Column:
    """Nested tag names of a page: ``ul ( li ( a ( ) ) )``; text is left out."""
    tokens = F.filter(
        F.regexp_extract_all(html, F.lit(MARKUP_TOKEN), F.lit(1)),
        lambda t: ~t.startswith("<!--"),
    )

    def emit(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, TAG_NAME, 1))
        return (
            F.when(t.startswith("</"), F.lit(")"))
            .when(t.endswith("/>") | name.isin(*VOID_ELEMENTS), name)
            .otherwise(F.concat(name, F.lit(" (")))
        )

    return F.array_join(F.transform(tokens, emit), " ")


def token_class(token: str) -> str:
    """Class of one code token; names keep their text, braces open and close a block.

    Comments have no class ('').
    """
    first = token[0]
    if "a" <= first <= "z" or "A" <= first <= "Z" or first in "_$":
        if token in _KEYWORDS:
            return KEYWORD_CLASSES.get(token, token.capitalize() + "Keyword")
        return f"Identifier [{token}]"
    if token in ("{", "}"):
        return "Block ( OpenBraceToken SyntaxList (" if token == "{" else ") CloseBraceToken )"
    if "0" <= first <= "9":
        return "NumericLiteral"
    if first in "\"'":
        return "StringLiteral"
    if first == "`":
        return "TemplateLiteral"
    if token.startswith(("//", "/*")):
        return ""
    return PUNCTUATION_CLASSES.get(token, "UnknownToken")


class _Classes(dict):
    """Classes of the tokens of a piece of code; so many short pieces are remembered."""

    MAX_PIECES, MAX_BYTES = 1 << 18, 64

    def __missing__(self, piece: bytes) -> bytes:
        if piece[:1] in b"\"'`" or piece[:2] in (b"//", b"/*"):
            return token_class(piece[:2].decode("latin-1")).encode()
        found = _TOKEN.findall(piece.decode(errors="surrogateescape"))
        out = " ".join(map(token_class, found)).encode(errors="surrogateescape")
        if len(piece) <= self.MAX_BYTES:
            if len(self) >= self.MAX_PIECES:
                self.clear()
            self[piece] = out
        return out


_CLASSES = _Classes()


def _pieces(body: bytes) -> list[bytes]:
    """Comments, strings, templates and the pieces of code between them."""
    out, pos = [], 0
    for m in _OPAQUE.finditer(body):
        out += body[pos : m.start()].split()
        out.append(m[0])
        pos = m.end()
    return out + body[pos:].split()


def _block(body: bytes) -> bytes:
    """Token classes of a body, bracketed by its braces; an empty list has no brackets.

    Only comments, strings and templates hold white space, and no other token holds a
    quote or the slash of a comment. So white space parts a body without these marks into
    pieces of whole tokens, most of which were seen before.
    """
    if any(mark in body for mark in _MARKS):
        joined = b" ".join(filter(None, map(_CLASSES.__getitem__, _pieces(body))))
    else:
        joined = b" ".join(map(_CLASSES.__getitem__, body.split()))
    return joined.replace(b"SyntaxList ( )", b"SyntaxList")


def _structure(
    kind: bytes | None, name: bytes | None, params: list[bytes | None] | None, body: bytes | None
) -> bytes | None:
    """The structure of one function; null without parameters or body."""
    if params is None or body is None:
        return None
    listed = b"SyntaxList"
    if params:
        parts = (b"Parameter ( Identifier [" + p + b"] )" for p in params if p is not None)
        listed = b"SyntaxList ( " + b" CommaToken ".join(parts) + b" )"
    lead = b"FunctionDeclaration ( FunctionKeyword" if kind == b"function" else b"MethodDeclaration ("
    named = b" Identifier [" + name + b"]" if name else b""
    return lead + named + b" OpenParenToken " + listed + b" CloseParenToken " + _block(body)


def _plain_structure(*parts) -> bytes | None:
    ast = _structure(*parts)
    return None if ast is None else without_identifiers(ast)


@F.arrow_udf(T.StringType())
def _whole(
    batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]],
) -> Iterator[pa.Array]:
    return text_rows(batches, _structure)


@F.arrow_udf(T.StringType())
def _plain(
    batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]],
) -> Iterator[pa.Array]:
    return text_rows(batches, _plain_structure)


def function_structure(
    kind: Column, name: Column, params: Column, body: Column, identifiers: bool = True
) -> Column:
    """Structure of a function or method from its parts.

    The header (kind, name, parameters) is exact; the body is a sequence of token
    classes nested by braces. The closing bracket of the outermost node is left off,
    which is how the datasets spell a structure. Bodies cross to Python as Arrow batches,
    where the classes of a piece of code are looked up and not worked out for every token.
    Without ``identifiers`` a structure is stripped of them before it leaves the task, as
    ``strip_identifiers`` does to a stored one.
    """
    return (_whole if identifiers else _plain)(kind, name, params, body)


def without_identifiers(ast: bytes) -> bytes:
    """One structure string without its ``[name]`` parts."""
    return _NAMES.sub(b"", ast)


def strip_identifiers(ast: Column) -> Column:
    """Remove the ``[name]`` parts of a structure string."""
    return F.regexp_replace(ast, IDENTIFIER, "")


def strip_root(ast: Column) -> Column:
    """Remove the wrapper of a whole-file structure.

    The head and the last closing bracket go independently of each other, as both
    alternatives of the pattern match on their own.
    """
    return F.regexp_replace(ast, r"^SourceFile \( SyntaxList | \)$", "")


def nesting_depth(ast: Column) -> Column:
    """Deepest bracket nesting of a structure string."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc: Column, t: Column) -> Column:
        depth = (
            F.when(t == "(", acc["depth"] + 1).when(t == ")", acc["depth"] - 1).otherwise(acc["depth"])
        )
        return F.struct(
            depth.alias("depth"), F.greatest(acc["deepest"], depth).alias("deepest")
        )

    return F.aggregate(F.split(ast, " "), zero, step, lambda acc: acc["deepest"])
