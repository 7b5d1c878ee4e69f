"""Text and identifier expressions.

Every function takes and returns Columns and stays on the JVM.  Tokenisers work
on the whole string with a few regex passes instead of a lambda per word.
"""

from pyspark.sql import functions as F

# The characters that count as white space, as literal characters
# (for trimming) and as the inside of a regex class.
SPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_POINTS))
SPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CLASS = r"\p{L}\p{N}_"

# Placeholder for a string literal, project default, C headers.
LITERAL_PLACEHOLDER = "strlitplaceholder"
UNKNOWN_PROJECT = "unknown_project"
C_HEADERS = "#include <stdint.h>\n#include <stddef.h>\n\n"

# Possessive quantifiers keep long literals off the regex engine's stack.
_LITERAL = r"""'(?:[^\\']++|\\.)*+'|"(?:[^\\"]++|\\.)*+\""""
# The marks that begin a match are looked for first: most characters are none.
_COMMENT_OR_LITERAL = r"(?smd)(?=[/'\"])(?://.*?$|/\*.*?\*/|(" + _LITERAL + "))"


def _column(value):
    return F.col(value) if isinstance(value, str) else value


def strip(value):
    """Trim white space of every kind from both ends."""
    return F.trim(_column(value), F.lit(SPACE_CHARS))


def collapse_spaces(value):
    """White-space runs to one blank, trimmed."""
    return strip(F.regexp_replace(_column(value), f"[{SPACE_CLASS}]+", " "))


def fill_missing(value):
    return F.coalesce(_column(value), F.lit(""))


def minimal_clean_text(value):
    """Line ends to ``\\n``, trimmed, null to empty."""
    unix = F.replace(fill_missing(value), F.lit("\r\n"), F.lit("\n"))
    return strip(F.replace(unix, F.lit("\r"), F.lit("\n")))


def remove_comments(value):
    """Each ``//`` or ``/* */`` comment becomes one blank; literals stay as they are.

    The text between comments and literals alternates with these, so each match
    is put back, or its blank, after the stretch before it.
    """
    text = _column(value)
    between = F.split(text, _COMMENT_OR_LITERAL, -1)
    matches = F.regexp_extract_all(text, F.lit(_COMMENT_OR_LITERAL), F.lit(0))
    kept = F.transform(matches, lambda m: F.when(F.startswith(m, F.lit("/")), F.lit(" ")).otherwise(m))
    return F.array_join(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def replace_string_literals(value, greedy=False):
    """Double-quoted strings on one line to a placeholder word."""
    if greedy:
        return F.regexp_replace(_column(value), '(?d)".*"', LITERAL_PLACEHOLDER)
    return F.regexp_replace(_column(value), '(?d)".*?"', f" {LITERAL_PLACEHOLDER} ")


# One camel piece: an upper-case letter, further ones that do not start a word, then
# lower-case letters and digits.
_UPPER_PIECE = "[A-Z](?:[A-Z](?![a-z]))*+[a-z0-9]*+"
# A piece that starts in lower case starts a run of letters and digits, and the run
# is not made of digits alone.
# Its first character is taken before looking around: most places fail there at once.
_LOWER_PIECE = "[a-z0-9](?<![A-Za-z0-9]{2})(?!(?<=[0-9])[0-9]*+(?![A-Za-z0-9]))[a-z0-9]*+"


def _camel_gaps(value):
    """A blank before every upper-case run and before its last letter if a word starts there."""
    return F.regexp_replace(value, "([A-Z](?:[A-Z](?![a-z]))*+)", " $1")


def _words(value):
    return F.array_remove(F.split(value, " "), "")


def _lower_all(values):
    return _words(F.lower(F.array_join(values, " ")))


def split_identifier(value):
    """Snake and camel parts in lower case, without digit-only snake parts.

    Works on a single identifier as on a whole text, since anything that is not
    a letter or digit separates.
    """
    pieces = F.regexp_extract_all(_column(value), F.lit(f"{_UPPER_PIECE}|{_LOWER_PIECE}"), F.lit(0))
    return _lower_all(pieces)


def code_tokens(value):
    """Ordered tokens of source text: no comments, placeholders for strings, split identifiers."""
    bare = F.regexp_replace(fill_missing(value), _COMMENT_OR_LITERAL, "$1 ")
    return split_identifier(replace_string_literals(bare))


def preprocess_code(value):
    return F.array_join(code_tokens(value), " ")


def letters_tokens_legacy(value):
    """Ordered letter-only tokens; digits inside a word vanish, every other character separates."""
    letters = F.regexp_replace(_column(value), "[0-9]++", "")
    pieces = F.regexp_extract_all(letters, F.lit("[A-Z](?:[A-Z](?![a-z]))*+[a-z]*+|[a-z]++"), F.lit(0))
    return _lower_all(pieces)


def code_tokens_legacy(value):
    bare = replace_string_literals(remove_comments(fill_missing(value)), greedy=True)
    return letters_tokens_legacy(bare)


def identifier_tokens_legacy(value):
    """Token set of one identifier; digits are stripped after splitting, which may leave ''."""
    parts = F.filter(
        F.split(_column(value), r"[, \-!?:_~]+"),
        lambda part: (part != "") & ~part.rlike(r"^\p{Nd}+$"),
    )
    pieces = F.flatten(
        F.transform(parts, lambda part: F.split(strip(_camel_gaps(part)), f"[{SPACE_CLASS}]+"))
    )
    whole = F.filter(pieces, lambda piece: piece != "")
    return F.array_distinct(F.transform(whole, lambda p: F.regexp_replace(F.lower(p), "[^a-zA-Z]+", "")))


def call_tokens_legacy(value):
    """Last segment of a call path, without underscores; nothing if it holds a blank."""
    last = F.element_at(F.split(_column(value), r"[.>:\-<]"), -1)
    return F.when(F.contains(last, F.lit(" ")), F.array().cast("array<string>")).otherwise(
        F.array(F.lower(F.replace(last, F.lit("_"), F.lit(""))))
    )


def raw_tokens_legacy(value):
    """Token set of raw code, split at a set of punctuation marks."""
    text = F.replace(F.replace(_column(value), F.lit("\\t"), F.lit("")), F.lit("\\n"), F.lit(""))
    gaps = _camel_gaps(F.regexp_replace(text, r'[.>:\-<()"=\]\[+, ]', " "))
    return F.array_distinct(_words(F.regexp_replace(F.lower(gaps), f"[{SPACE_CLASS}]+", " ")))


def control_tokens_legacy(value):
    """As ``raw_tokens_legacy`` once escapes and the marks ``& ! |`` are gone."""
    text = F.replace(F.replace(_column(value), F.lit("\\t"), F.lit("")), F.lit("\\n"), F.lit(""))
    return raw_tokens_legacy(F.translate(text, "&!|", ""))


def ngrams(tokens, n):
    """Runs of ``n`` neighbouring tokens joined by a blank, in order."""
    tokens = _column(tokens)
    if n == 1:
        return tokens
    if n == 2:
        left = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
        right = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
        return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens, low=1, high=2):
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])


def word_tokens(text):
    """Lower-case words of at least two word characters, as text vectorisers split by default."""
    return F.regexp_extract_all(F.lower(_column(text)), F.lit(f"[{WORD_CLASS}]{{2,}}"), F.lit(0))


def safe_project_name(value):
    """Characters outside ``[A-Za-z0-9_.-]`` to ``_``, trimmed of ``_``, never empty."""
    named = F.coalesce(F.nullif(_column(value), F.lit("")), F.lit(UNKNOWN_PROJECT))
    safe = F.trim(F.regexp_replace(named, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(UNKNOWN_PROJECT))


def ensure_c_source(value):
    """Source body with headers and a final line end."""
    body = fill_missing(value)
    return (
        F.when(~F.contains(body, F.lit("#include")), F.concat(F.lit(C_HEADERS), body, F.lit("\n")))
        .when(~F.endswith(body, F.lit("\n")), F.concat(body, F.lit("\n")))
        .otherwise(body)
    )


def dotted_extension(extension):
    value = _column(extension)
    return F.when(F.startswith(value, F.lit(".")), value).otherwise(F.concat(F.lit("."), value))


def source_key(path):
    """Last two segments of a path."""
    return F.substring_index(_column(path), "/", -2)
