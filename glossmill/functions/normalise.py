"""Normalisation and tokenisation of comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tokens of the normalised form.
URL = r"(?:https?)?://[A-Za-z0-9_./?=&%]*[A-Za-z0-9_]"
URL_TOKEN = "URL"
CODE_CHARACTERS = r"([.,()<>\[\]{}\"'`\-$=_;%|&#~^\\])"
SLASH_PIECES = r"(/{3,}|/{1,2}|[^/]+)"
NEW_LINE = r"\r\n|\r|\n"
START, END, EOL = "<start>", "<end>", "<eol>"
PROTECTED = (START, EOL, END, "/**", "/*", "*/", "//")
TOKEN = r"(<start>|<eol>|<end>|/\*\*|/\*|\*/|//|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}\p{Z}_\s])"


def mask_urls(text: Column) -> Column:
    """Replace addresses (scheme optional) by one token."""
    return F.regexp_replace(text, URL, URL_TOKEN)


def space_code_characters(text: Column) -> Column:
    """Surround characters with a meaning in code by blanks."""
    return F.regexp_replace(text, CODE_CHARACTERS, " $1 ")


def split_slashes(text: Column) -> Column:
    """Three or more slashes in a row become single ones separated by blanks."""
    pieces = F.regexp_extract_all(text, F.lit(SLASH_PIECES), F.lit(1))
    spaced = F.transform(
        pieces,
        lambda t: F.when(
            t.startswith("///"), F.rtrim(F.replace(t, F.lit("/"), F.lit("/ ")))
        ).otherwise(t),
    )
    return F.array_join(spaced, "")


def mark_lines(text: Column) -> Column:
    """Delete tab stops and turn line ends into a token."""
    return F.regexp_replace(F.regexp_replace(text, "\t", ""), NEW_LINE, f" {EOL} ")


def clean_text(text: Column) -> Column:
    """Lower-case, mask addresses, space code characters and slashes, mark lines."""
    return mark_lines(split_slashes(space_code_characters(mask_urls(F.lower(text)))))


def tokenise(text: Column) -> Column:
    """Words and single marks; the protected tokens are never split."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def drop_empty(tokens: Column) -> Column:
    """Remove empty tokens."""
    return F.filter(tokens, lambda t: t != "")


def wrap(text: Column) -> Column:
    """Add the start and end token and collapse runs of blanks."""
    return F.regexp_replace(
        F.concat(F.lit(f"{START} "), text, F.lit(f" {END}")), " {2,}", " "
    )


def normalise_comment(text: Column) -> Column:
    """The whole chain: clean, tokenise, join by blanks, wrap."""
    return wrap(F.array_join(drop_empty(tokenise(clean_text(text))), " "))
