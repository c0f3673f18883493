r"""Text clean-up, tokens and spans as Column expressions.

Everything here runs inside the JVM except canonical normalisation, which has no
Spark builtin: that step sends Python only the rows holding a character the
normal form could change, so plain rows cross as nulls.

White space is always the class ``WS`` (what ``str.strip`` removes), because
``\s`` and ``trim`` in the JVM are narrower.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ``str.strip`` removes, as regex class bodies.  They need
# the (?U) flag in front of the pattern; listing the characters instead is ten times slower.
WS = r"\s\x{1c}-\x{1f}"
INLINE = r"\s\x{1c}-\x{1f}&&[^\n]"

# The same characters as a string: a trim looks at the ends of a text only, a pattern at every place.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Counts the tokens of every string of an array: array<string> -> array<int>.
TokenCounter = Callable[[Column], Column]


# Ranges no character of which NFKC can change, alone or next to others: most of
# Latin, Cyrillic and the Han scripts.  Others merely send their row to Python.
STABLE = r"\x{0}-\x{9f}\x{bf}-\x{131}\x{400}-\x{482}\x{3400}-\x{a66e}"


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str]:
    """Lower-case letters that decompose into one base plus marks, and their bases."""
    source, base = [], []
    for p in range(0x80, 0x10000):
        if 0xD800 <= p <= 0xDFFF:
            continue
        c = chr(p)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            source.append(c)
            base.append(plain)
    return "".join(source), "".join(base)


def strip(text: Column) -> Column:
    """Remove white space at both ends, as ``str.strip`` does."""
    return F.btrim(text, F.lit(BLANKS))


def leading_blanks(text: Column) -> Column:
    """Number of white-space characters before the first visible one."""
    return F.length(F.regexp_extract(text, f"(?U)^[{WS}]*", 0))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?U)[^{WS}]")


def nfkc(text: Column) -> Column:
    """Compatibility normal form; only rows that could change visit Python."""

    @F.pandas_udf("string")
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))

    unstable = text.rlike("[^\\x00-\\x7f]") & text.rlike(f"[^{STABLE}]")
    return F.coalesce(compose(F.when(unstable, text)), text)


def join_hyphens(text: Column) -> Column:
    """Undo a line-break hyphen between a letter and a lower-case letter."""
    return F.regexp_replace(text, f"(?U)([A-Za-z])-\\n[{WS}]*([a-z])", "$1$2")


def tidy(text: Column, keep_hyphens: Column | bool = False) -> Column:
    """Clean-up after the normal form: controls, line ends, hyphens, blanks."""
    out = F.translate(text, "\x00\u00ad", "")
    out = F.regexp_replace(out, "\\r\\n?", "\n")
    if keep_hyphens is False:
        out = join_hyphens(out)
    elif keep_hyphens is not True:
        out = F.when(keep_hyphens, out).otherwise(join_hyphens(out))
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, f"(?U)(?<![^\\n])[{INLINE}]+|[{INLINE}]++(?![^\\n])", "")
    out = F.regexp_replace(out, "\\n{3,}", "\n\n")
    return strip(out)


def normalize_text(text: Column, code: Column | bool = False) -> Column:
    """Full clean-up of a text; ``code`` keeps line-break hyphens."""
    return tidy(nfkc(text), code)


def fold(text: Column) -> Column:
    """Lower case without diacritics, the form in which terms are indexed."""
    low = F.lower(text)
    source, base = _accent_tables()
    plain = F.regexp_replace(F.translate(low, source, base), "\\p{M}+", "")
    return F.when(low.rlike("[^\\x00-\\x7f]"), plain).otherwise(low)


def index_terms(text: Column) -> Column:
    """Indexed terms in order, repeats included."""
    return F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), 0)


def query_words(text: Column) -> Column:
    """Words of a query; an underscore keeps its neighbours together."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+"), 0)


def whitespace_tokens(texts: Column) -> Column:
    """Default token counter: runs of visible characters in each string."""
    return F.transform(texts, lambda t: F.regexp_count(t, F.lit(f"(?U)[^{WS}]+")))


def count_one(text: Column, count: TokenCounter) -> Column:
    return F.element_at(count(F.array(text)), 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``, even within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def embed_text(heading: Column, body: Column) -> Column:
    """What is indexed for a passage: its heading line, then its body."""
    return F.when(heading != "", F.concat(heading, F.lit("\n"), body)).otherwise(body)


def heading_path(names: Column) -> Column:
    return F.array_join(names, " > ")


# Patterns that cut a text into consecutive pieces; joined, the pieces are the text.
# Each piece is a unit followed by the white space that ends it.
LINES = "[^\\n]*\\n+|[^\\n]+"
PARAGRAPHS = "(?s).*?\\n\\n|.+"
SENTENCES = f"(?Us).*?(?:(?<=[.!?])[{WS}]+|\\n+)|.+"
WORDS = "[^ ]+ *| +"


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)
