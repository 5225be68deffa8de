"""Row-wise text functions as Catalyst expressions (``Column -> Column``).

All of these run JVM-side (higher-order functions are interpreted there, not
compiled): regular expressions,
higher-order array functions (``transform``/``filter``/``aggregate``) and
maps. None needs Python at run time, so each one is as cheap on a 1000-node
cluster as a projection, and each one also runs unchanged on a streaming
DataFrame.

Regex dialect notes: Python's ``\\w``/``\\s`` are Unicode-aware while Java's
are ASCII unless ``(?U)`` is set, and even then differ on marks. Where the
reference relies on Python semantics we spell classes with explicit Unicode
properties (``\\p{L}``, ``\\p{N}``).
"""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Python's whitespace (str.isspace), spelled out so Java and RE2 agree.
PY_SPACE = (r"\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Python's \w (str.isalnum() or '_'), spelled out.
PY_WORD = r"\p{L}\p{N}_"
# Strict punctuation: the eight characters ! ? . , : ; ' "
STRICT_PUNCTUATION = "[!?.,:;'\"]"
# Noisy punctuation: Python's [^\w\d\s].
NOISY_PUNCTUATION = f"[^{PY_WORD}{PY_SPACE}]"
# Emoji: maximal runs over the four blocks U+1F600-1F64F (emoticons),
# U+1F300-1F5FF (symbols & pictographs), U+1F680-1F6FF (transport & map),
# U+1F1E0-1F1FF (flags).
EMOJI_RUN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
# URL: optional scheme (http|ftp|https)://, host of dotted word parts, optional
# rest. Any word.word counts as a URL.
URL_PATTERN = (f"(?:(http|ftp|https)://)?([{PY_WORD}-]+(?:(?:\\.[{PY_WORD}-]+)+))"
               f"([{PY_WORD}.,@?^=%&:/~+#-]*[{PY_WORD}@?^=%&/~+#-])?")
# Word filter applied to tokens: ^[\w\d]+$.
WORD_TOKEN = f"^[{PY_WORD}]+$"
# ---------------------------------------------------------------------------


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst does not eliminate common subexpressions inside lambda
    functions, so an array expression referenced from within ``transform`` /
    ``filter`` would be recomputed for every element (quadratic). Binding it
    through a one-element ``transform`` evaluates it once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- T1 / T2 -----------------------------------------------------------------
def punctuation(text: Column, strict: bool = True) -> Column:
    """Every punctuation character of ``text`` in order (ARRAY<STRING>)."""
    pattern = STRICT_PUNCTUATION if strict else NOISY_PUNCTUATION
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# --- T3 ----------------------------------------------------------------------
def emoji(text: Column) -> Column:
    """Maximal runs of emoji; a run is one token (ARRAY<STRING>)."""
    return F.regexp_extract_all(text, F.lit(EMOJI_RUN), F.lit(0))


# --- T4 ----------------------------------------------------------------------
def capitalization(text: Column, fraction: bool = True) -> Column:
    """Count of A-Z, or A-Z / max(A-Z + a-z, 1) (ASCII only), as DOUBLE."""
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    if not fraction:
        return upper.cast("double")
    lower = F.regexp_count(text, F.lit("[a-z]"))
    return (upper / F.greatest(upper + lower, F.lit(1))).cast("double")


# --- T8 / T9 -----------------------------------------------------------------
def urls(text: Column, short_url: bool = False) -> Column:
    """URLs found in ``text``. ``short_url`` keeps the host only, otherwise
    ``scheme://host+rest`` (a missing scheme gives ``://host...``). One regex
    pass over the text; each (short) match is then split into its groups."""
    anchored = f"^{URL_PATTERN}$"
    matches = F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))
    if short_url:
        return F.transform(matches, lambda m: F.regexp_extract(m, anchored, 2))
    return F.transform(matches, lambda m: F.concat(
        F.regexp_extract(m, anchored, 1), F.lit("://"), F.regexp_extract(m, anchored, 2),
        F.regexp_extract(m, anchored, 3)))


def strip_urls(text: Column) -> Column:
    """Replace every URL by one space."""
    return F.regexp_replace(text, F.lit(URL_PATTERN), F.lit(" "))


# --- T11 ---------------------------------------------------------------------
def whitespace_tokens(text: Column) -> Column:
    """``str.split()``: split on (Unicode) whitespace, no empty tokens."""
    return F.filter(F.split(text, f"[{PY_SPACE}]+"), lambda t: t != F.lit(""))


# --- T15 ---------------------------------------------------------------------
def token_counts(tokens: Column, key_type: str = "string") -> Column:
    """token -> count map in O(n log n) without a shuffle: sort the array and
    measure the runs. Keys come out in sorted order. ``key_type`` is the
    element type (e.g. 'int' for hashed buckets, which sort faster)."""
    def body(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                          lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, i - 1)))
        return let(starts, lambda st: F.when(n > 0, F.map_from_arrays(
            F.transform(st, lambda i: F.element_at(s, i)),
            F.zip_with(st, F.concat(F.slice(st, 2, F.greatest(n, F.lit(1))), F.array(n + 1)),
                       lambda a, b: (b - a).cast("bigint")))).otherwise(
            F.create_map().cast(f"map<{key_type},bigint>")))
    return let(F.array_sort(tokens), body)


def as_output(tokens: Column, output_type: str = "list") -> Column:
    """Output shape of a token list: ``list`` (array), ``str`` (space joined)
    or ``dict`` (token -> count map)."""
    if output_type == "list":
        return tokens
    if output_type == "str":
        return F.concat_ws(" ", tokens)
    if output_type == "dict":
        return token_counts(tokens)
    raise ValueError(f"Not a valid output type: {output_type!r}")


# --- T16 / T17 ---------------------------------------------------------------
def json_text(doc: Column, path: str) -> Column:
    """``doc::jsonb->>'key'`` for a JSON string column."""
    return F.get_json_object(doc, f"$.{path}")


def lines(text: Column) -> Column:
    """Split on newline and strip every line (ARRAY<STRING>)."""
    return F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(
        s, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", ""))


# --- T18 ---------------------------------------------------------------------
# Named entities that are unescaped (&amp; is handled last).
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"),
                 ("&middot;", "\u00b7"), ("&hellip;", "\u2026"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"),
                 ("&laquo;", "\u00ab"), ("&raquo;", "\u00bb"), ("&euro;", "\u20ac")]


def _code_point(n: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes ('' if there is none)."""
    def octets(*parts) -> Column:
        return F.decode(F.unhex(F.concat(*[F.lpad(F.hex(p), 2, "0") for p in parts])), "UTF-8")
    tail = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    lead = lambda shift, mark: F.shiftright(n, shift).bitwiseOR(F.lit(mark))
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return (F.when(bad, F.lit("")).when(n < 0x80, octets(n)).when(n < 0x800, octets(lead(6, 0xC0), tail(0)))
            .when(n < 0x10000, octets(lead(12, 0xE0), tail(6), tail(0)))
            .otherwise(octets(lead(18, 0xF0), tail(12), tail(6), tail(0))))


def html_unescape(text: Column) -> Column:
    """Numeric references (decimal and hexadecimal), then the named entities above, ``&amp;`` last."""
    pattern = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"

    def decoded(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        return _code_point(F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int"))

    def rebuilt(refs: Column) -> Column:
        between = F.split(text, pattern)
        return F.when(F.size(refs) == 0, text).otherwise(F.concat(F.element_at(between, 1), F.array_join(
            F.transform(refs, lambda ref, i: F.concat(decoded(ref), F.element_at(between, i + 2))), "")))

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rebuilt)
    for ent, ch in [*HTML_ENTITIES, ("&amp;", "&")]:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


# --- T19 ---------------------------------------------------------------------
def trim80(text: Column) -> Column:
    """Trim to 80 columns: ``s[:77] + '...'`` when longer than 80."""
    return F.when(F.char_length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))) \
        .otherwise(text)


# --- T20 ---------------------------------------------------------------------
# Fixed pattern of a line that introduces or holds a quotation.
QUOTE_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"


def strip_header(text: Column) -> Column:
    """What follows the first blank line; nothing when there is none."""
    at = F.instr(text, "\n\n")
    return F.when(at > 0, text.substr(at + 2, F.char_length(text))).otherwise(F.lit(""))


def strip_footer(text: Column) -> Column:
    """The trimmed text up to the last line that is blank or only dashes (after
    trimming); a text without such a line after its first stays as it is."""
    trim = lambda s: F.regexp_replace(s, f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")

    def cut(lines: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(lines, lambda s, i: F.when(trim(s).rlike("^-*$"), i))), F.lit(0))
        return F.when(last > 0, F.array_join(F.slice(lines, F.lit(1), F.greatest(last, F.lit(1))), "\n")).otherwise(text)

    return let(F.split(trim(text), "\n"), cut)


def strip_quotes(text: Column) -> Column:
    """Without the lines that match ``QUOTE_LINE``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(QUOTE_LINE)), "\n")


# --- T21 ---------------------------------------------------------------------
#: Code points are looked up in pages of this many.
_PAGE = 128
_SEP = "\x01"


def strip_accents(text: Column) -> Column:
    """``strip_accents='unicode'``: NFKD-decompose, then drop the code points with
    a combining class. Null stays null.

    Spark has no normaliser, so the decompositions of all code points are two
    constant arrays made from Python's ``unicodedata`` (a page list and the pages
    that hold a change); Hangul syllables go by their rule. ASCII runs pass whole;
    every other code point is two array accesses."""
    pages, flat = _fold_pages()
    # Literals that the optimizer folds into arrays once.
    page_of = F.split(F.lit(pages), _SEP).cast("array<int>")
    folded = F.split(F.lit(flat), _SEP)
    lead, vowel, tail = (F.split(F.lit(_SEP.join(chr(first + i) for i in range(n))), _SEP) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))

    def fold(run: Column) -> Column:
        cp = F.ascii(run)       # the code point of the first character
        s = cp - 0xAC00
        last = F.pmod(s, F.lit(28))
        syllable = F.concat(F.get(lead, F.floor(s / 588).cast("int")), F.get(vowel, F.floor(F.pmod(s, F.lit(588)) / 28).cast("int")),
                            F.when(last > 0, F.get(tail, last)).otherwise(""))
        other = F.coalesce(F.get(folded, F.get(page_of, F.shiftright(cp, _PAGE.bit_length() - 1)) * _PAGE + cp.bitwiseAND(_PAGE - 1)), run)
        return F.when(cp < 128, run).when(cp.between(0xAC00, 0xD7A3), syllable).otherwise(other)

    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(runs, fold), "")).otherwise(text)


@cache
def _fold_pages() -> tuple[str, str]:
    """(page number of each block of code points, -1 if nothing changes there; the
    folded code points of all pages), both joined by ``_SEP``."""
    import unicodedata

    def fold(cp: int) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))

    pages, flat = [], []
    for start in range(0, sys.maxunicode + 1, _PAGE):
        cps = range(start, start + _PAGE)
        block = [chr(cp) if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp <= 0xD7A3 else fold(cp) for cp in cps]
        changed = block != [chr(cp) for cp in cps]
        pages.append(len(flat) // _PAGE if changed else -1)
        flat += block if changed else []
    while pages[-1] < 0:
        pages.pop()
    return _SEP.join(map(str, pages)), _SEP.join(flat)


# --- T22 ---------------------------------------------------------------------
def _gram_at(tokens: Column, n: int):
    # One-argument lambda (PySpark reads a 2-argument lambda as (element, index)).
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def word_ngrams(tokens: Column, n_min: int = 1, n_max: int = 1) -> Column:
    """All word n-grams for n in [n_min, n_max], space-joined, in sklearn order
    (all unigrams, then all bigrams, ...). Short arrays give no n-grams for
    that n (guarded: ``sequence`` would count down)."""
    def body(tk):
        size = F.size(tk)
        parts = []
        for n in range(n_min, n_max + 1):
            if n == 1:
                parts.append(tk)
                continue
            grams = F.transform(F.sequence(F.lit(1), size - n + 1), _gram_at(tk, n))
            parts.append(F.when(size >= n, grams).otherwise(F.array().cast("array<string>")))
        return parts[0] if len(parts) == 1 else F.concat(*parts)
    return let(tokens, body)


# --- T23 ---------------------------------------------------------------------
def char_windows(text: Column, length: int = 25, step: int = 3) -> Column:
    """Semi-redundant windows: ARRAY<STRUCT<window, next_char>> of ``length``
    characters every ``step`` characters, the following character as label.
    One linear regex pass (zero-width match at every position); indexing a
    UTF-8 string by character position would make this quadratic."""
    pat = F.lit(f"(?s)(?=(.{{{length}}})(.))")
    wins = F.regexp_extract_all(text, pat, F.lit(1))
    nxt = F.regexp_extract_all(text, pat, F.lit(2))
    pairs = F.arrays_zip(wins.alias("window"), nxt.alias("next_char"))
    return F.filter(pairs, lambda x, i: F.pmod(i, F.lit(step)) == 0)


# --- T25 ---------------------------------------------------------------------
def position_xy(pos: Column, width: int = 128) -> tuple[Column, Column]:
    """Fingerprint position -> (x, y) on the width x width grid."""
    return (F.pmod(pos, F.lit(width)).cast("int"), F.floor(pos / width).cast("int"))


# --- T26 ---------------------------------------------------------------------
def multi_hot(labels: Column, classes: list[str]) -> Column:
    """Multi-label binariser: 0/1 array aligned with ``classes``."""
    cls = F.array(*[F.lit(c) for c in classes])
    return F.transform(cls, lambda c: F.array_contains(labels, c).cast("int"))


def multi_hot_inverse(bits: Column, classes: list[str]) -> Column:
    cls = F.array(*[F.lit(c) for c in classes])
    return F.filter(cls, lambda c, i: F.element_at(bits, i + 1) == 1)
