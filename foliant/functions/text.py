"""Words, sentences, token counts and white space, as Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the lexical index takes for a word, and what a query's words may hold besides.
TERM = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{300}-\x{36F}]*"
TERM_HYPHEN = r"[\p{L}\p{N}\p{Co}-][\p{L}\p{N}\p{Co}\x{300}-\x{36F}-]*"
PHRASE = r"[\p{L}\p{N}_]+"
PHRASE_HYPHEN = r"[\p{L}\p{N}_-]+"
SENTENCE_END = r"(?<=[.!?])(?U)\s+"


def _folds() -> tuple[str, str]:
    """Letters with one mark and the letters below them; combining marks come last and fall away."""
    marked, plain = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.combining(chr(int(parts[1], 16))):
            base = chr(int(parts[0], 16))
            if base.isascii():
                marked.append(chr(cp))
                plain.append(base.lower())
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


MARKED, PLAIN = _folds()


def fold(text: Column) -> Column:
    """Lower case without diacritics of single code points; ligatures and sharp s stay."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: Column, hyphen: bool = False) -> Column:
    """Folded words of a text in order; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM_HYPHEN if hyphen else TERM), F.lit(0))


def phrases(query: Column, hyphen: bool = False) -> Column:
    """A query's words, each as the array of terms that the index cuts it into; words without a term are dropped."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(PHRASE_HYPHEN if hyphen else PHRASE), F.lit(0))
    return F.filter(F.transform(found, lambda w: terms(w, hyphen)), lambda t: F.size(t) > 0)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_space(text: Column) -> Column:
    """White space as single spaces and ``<`` escaped; null as empty."""
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), F.lit("<"), F.lit("\\<"))


def sentences(text: Column) -> Column:
    """Pieces that end in ``.``, ``!`` or ``?`` before white space."""
    return F.filter(F.split(strip(F.coalesce(text, F.lit(""))), SENTENCE_END), lambda s: s != "")


def tokens(text: Column) -> Column:
    """White-space words: the default tokenizer."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda s: s != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def fixed_windows(text: Column, budget: int) -> Column:
    """Consecutive windows of ``budget`` tokens, each joined by single spaces."""
    own = tokens(text)
    return F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / budget).cast("int")), lambda i: F.array_join(F.slice(own, i * budget + 1, budget), " "))).otherwise(F.array().cast("array<string>"))


def unwrap(text: Column, prefix: str, suffix: str) -> Column:
    """Without the prefix and the suffix, each where it is there."""
    out = F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    return F.when(F.endswith(out, F.lit(suffix)), F.left(out, F.length(out) - len(suffix))).otherwise(out)


def neutralised(text: Column, tag: str = "tool_result") -> Column:
    """The tag's closing form made harmless by a zero-width space, then the text wrapped in the tag."""
    safe = F.regexp_replace(text, rf"(?i)</\s*{tag}\s*>", f"<​/{tag}>")
    return F.concat(F.lit(f"<{tag}>\n"), safe, F.lit(f"\n</{tag}>"))
