"""Text column functions: cleaning, composing and fixed-length token windows."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: literal patterns removed by the corpus cleaners, longest first
LITERAL_BACKSLASH_N = "\\n"          # the two characters backslash and n
BR_DOUBLE = "<br /><br />"
BR_BACKSLASH_N = "<br />\\n"        # "<br />" followed by a literal backslash-n
PAD_TOKEN = "[PAD]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_literal(col, pattern: str) -> Column:
    return F.replace(_c(col), F.lit(pattern), F.lit(""))


def clean_text(col) -> Column:
    """Remove the HTML line breaks and literal backslash-n, longest pattern first."""
    c = remove_literal(col, BR_DOUBLE)
    c = remove_literal(c, BR_BACKSLASH_N)
    return remove_literal(c, LITERAL_BACKSLASH_N)


def newline_to_space(col) -> Column:
    return F.translate(_c(col), "\n", " ")


def compose_text(title, description) -> Column:
    """``title + ' ' + description``; falls back to description, then title.

    A missing column is passed as ``None`` and acts as a null column.
    """
    t = F.lit(None).cast("string") if title is None else _c(title)
    d = F.lit(None).cast("string") if description is None else _c(description)
    return F.coalesce(F.concat(t, F.lit(" "), d), d, t)


def compose_text_strict(title, description) -> Column:
    """``title + ' ' + description``; a null part is an error."""
    both = F.concat(_c(title), F.lit(" "), _c(description))
    return F.when(both.isNull(), F.raise_error(F.lit("title and description must not be null"))).otherwise(both)


def compose_text_nan(title, description) -> Column:
    """Stringify-then-concat: a null part is written as ``nan``."""
    return F.concat(F.coalesce(_c(title), F.lit("nan")), F.lit(" "),
                    F.coalesce(_c(description), F.lit("nan")))


def tokens(col) -> Column:
    """Whitespace tokens of the whole text (empty text gives no token)."""
    t = F.trim(_c(col))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def token_window(col, length: int) -> tuple[Column, Column, Column]:
    """Truncate to ``length`` tokens, pad to ``length``; also the 0/1 mask and token count.

    Returns (ids-as-strings array, mask array, number of real tokens in the window).
    """
    toks = tokens(col)
    head = F.slice(toks, 1, length)
    n_real = F.size(head)
    pad = F.array_repeat(F.lit(PAD_TOKEN), F.lit(length) - n_real)
    window = F.concat(head, pad)
    # no lambda here: a lambda would re-evaluate the split for every position
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(length) - n_real))
    return window, mask, n_real
