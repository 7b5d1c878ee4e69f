"""Code elements: identifiers, calls and control words, from text or from node cells."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CELL_TERMINATOR
from .text import (
    SPACE_CLASS,
    WORD_CLASS,
    _UPPER_PIECE,
    _column,
    _lower_all,
    call_tokens_legacy,
    control_tokens_legacy,
    fill_missing,
    identifier_tokens_legacy,
    split_identifier,
)

# Words that are not calls, and the control words in their order.
NOT_CALLS = ("if", "for", "while", "switch", "return", "sizeof")
CONTROL_WORDS = ("if", "for", "while", "switch", "case", "return")

# Node kinds of a dump.
NODE_KINDS = ("IDENTIFIER", "CALL", "CONTROL_STRUCTURE")

NODE_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("_label", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("code", T.StringType()),
        ]
    )
)

# Cheap tests come first: most characters fail them.
_CALL = rf"(?<![A-Za-z0-9_])(?<![{WORD_CLASS}])([A-Za-z_][A-Za-z0-9_]*+)[{SPACE_CLASS}]*+\("
_CONTROL = rf"(?=[{''.join(sorted({w[0] for w in CONTROL_WORDS}))}])(?<![{WORD_CLASS}])({'|'.join(CONTROL_WORDS)})(?![{WORD_CLASS}])"


# A sub-token starts an identifier (after digits that do not belong to it), starts a
# snake part that is not digits alone, or starts with an upper-case letter.
_IDENTIFIER_PIECE = (
    "(?=[A-Za-z0-9])(?:(?<![A-Za-z0-9_])[0-9]*+(?=[a-z])|(?<=_)(?![0-9]++(?![A-Za-z0-9]))(?=[a-z0-9])|(?=[A-Z]))"
    f"({_UPPER_PIECE}|[a-z0-9]++)"
)


def _literals(values):
    return F.array(*[F.lit(v) for v in values])


def identifiers(text):
    """Distinct sub-tokens of all identifiers; digits before an identifier do not belong to it."""
    return F.array_distinct(
        _lower_all(F.regexp_extract_all(fill_missing(text), F.lit(_IDENTIFIER_PIECE), F.lit(1)))
    )


def call_names(text):
    """Names followed by an opening bracket, in order, with repeats."""
    return F.regexp_extract_all(fill_missing(text), F.lit(_CALL), F.lit(1))


def calls(text):
    """Distinct sub-tokens of called names, keywords left out before splitting."""
    names = F.array_except(call_names(text), _literals(NOT_CALLS))
    return F.array_distinct(split_identifier(F.array_join(names, " ")))


def controls(text):
    """Control words that occur, in fixed order."""
    found = F.regexp_extract_all(fill_missing(text), F.lit(_CONTROL), F.lit(1))
    return F.array_intersect(_literals(CONTROL_WORDS), found)


def pseudo_cell(text):
    """Node cell from text alone: identifiers, calls, then controls.

    Names are plain identifiers, so the JSON is joined without escaping.
    """
    names = F.regexp_extract_all(fill_missing(text), F.lit("[A-Za-z_][A-Za-z0-9_]*+"), F.lit(0))

    def nodes(values, kind, key):
        return F.transform(
            values, lambda v: F.concat(F.lit(f'{{"_label": "{kind}", "{key}": "'), v, F.lit('"}'))
        )

    parts = F.concat(
        nodes(names, "IDENTIFIER", "name"),
        nodes(call_names(text), "CALL", "name"),
        nodes(controls(text), "CONTROL_STRUCTURE", "code"),
    )
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]" + CELL_TERMINATOR))


def _quoted(value):
    """A JSON string; only values with marks to escape go through the JSON writer."""
    value = F.coalesce(value, F.lit(""))
    wrapped = F.to_json(F.array(value))
    escaped = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    return F.when(value.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def node_json(kind, name, code):
    """One dump node as a JSON object; kinds are plain words."""
    return F.concat(
        F.lit('{"_label": "'), kind,
        F.lit('", "name": '), _quoted(name),
        F.lit(', "code": '), _quoted(code), F.lit("}"),
    )


def node_cell(node_jsons):
    return F.concat(F.lit("["), F.array_join(node_jsons, ", "), F.lit("]" + CELL_TERMINATOR))


def parse_cell(cell, min_chars=100):
    """Nodes of a cell; cells of at most ``min_chars`` characters have none."""
    cell = fill_missing(cell)
    body = F.substring_index(cell, CELL_TERMINATOR, 1)
    nodes = F.from_json(F.when(F.length(cell) > min_chars, body), NODE_SCHEMA)
    return F.coalesce(nodes, F.array().cast(NODE_SCHEMA))


def _node_values(nodes, kind, key):
    own = F.filter(_column(nodes), lambda node: node["_label"] == kind)
    return F.transform(own, lambda node: F.coalesce(node[key], F.lit("")))


def node_tokens(nodes, legacy=False):
    """Token sets (ids, calls, controls) of a node array."""
    values = (
        _node_values(nodes, "IDENTIFIER", "name"),
        _node_values(nodes, "CALL", "name"),
        _node_values(nodes, "CONTROL_STRUCTURE", "code"),
    )
    if legacy:
        split = (identifier_tokens_legacy, call_tokens_legacy, control_tokens_legacy)
        return tuple(
            F.array_distinct(F.flatten(F.transform(value, fn))) for value, fn in zip(values, split)
        )
    return tuple(F.array_distinct(split_identifier(F.array_join(value, " "))) for value in values)


def one_node_tokens(kind, name, code, legacy=False):
    """Tokens of a single dump node: of its name, or of its code for a control structure."""
    named = [identifier_tokens_legacy, call_tokens_legacy, control_tokens_legacy] if legacy else [split_identifier] * 3
    values = (name, name, code)
    choice = None
    for label, fn, value in zip(NODE_KINDS, named, values):
        choice = (F.when if choice is None else choice.when)(kind == label, fn(value))
    return choice
