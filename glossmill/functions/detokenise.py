"""Generated tokens back to comment text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.placeholders import word_runs

# Tokens that end a line, and the mark of glued characters.
LINE_TOKENS = ("<eol>", "<eos>")
GLUE = ">"


def rechunk(tokens: Column) -> Column:
    """Regroup a stream of characters or words into runs of word/non-word characters."""
    return word_runs(F.array_join(tokens, ""))


def spaced_pieces(tokens: Column) -> Column:
    """Each token as it appears in the text, with its leading blank if it needs one.

    What precedes a token only depends on the token before it, so the pieces are
    computed independently of each other and joined once.
    """

    def piece(t: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        at_start = (i == 0) | F.coalesce(before.isin(*LINE_TOKENS), F.lit(False))
        after_glued = F.coalesce(before.startswith(GLUE), F.lit(False))
        return (
            F.when(t.isin(*LINE_TOKENS), F.lit("\n"))
            .when(
                t.startswith(GLUE),
                F.concat(
                    F.when(at_start | after_glued, "").otherwise(" "), F.substring(t, 2, 1)
                ),
            )
            .otherwise(F.concat(F.when(at_start, "").otherwise(" "), t))
        )

    return F.transform(tokens, piece)


def detokenise(tokens: Column) -> Column:
    """Text of a token list: line tokens, glued characters, blanks between words."""
    return F.array_join(spaced_pieces(tokens), "")
