"""Boolean trigram queries derived from regular expressions."""

from re import _constants as ops
from re import _parser as parser

EVERYTHING = frozenset([frozenset()])  # an OR of ANDs; the empty AND holds for any text
MOST_STRINGS = 64
MOST_CHARACTERS = 8


def _lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def _simplify(ors):
    """Drop each AND that another one implies."""
    return frozenset(a for a in ors if not any(b < a for b in ors))


def _and(left, right):
    return _simplify({a | b for a in left for b in right})


def _of_strings(strings):
    """A text with one of ``strings`` has all ASCII trigrams of one of them."""
    return _simplify({frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()) for s in strings})


def _characters(items):
    found = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(_lower(chr(value)))
        elif op is ops.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            found.update(_lower(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= MOST_CHARACTERS else None


def _item(op, value):
    """(all strings the item can match or None, a query that holds wherever it matches)."""
    if op is ops.LITERAL:
        return {_lower(chr(value))}, EVERYTHING
    if op is ops.AT:
        return {""}, EVERYTHING
    if op is ops.IN:
        return _characters(value), EVERYTHING
    if op is ops.SUBPATTERN:
        return _sequence(value[-1])
    if op is ops.BRANCH:
        ways = [_sequence(way) for way in value[1]]
        if all(strings is not None for strings, _ in ways):
            return set().union(*(strings for strings, _ in ways)), EVERYTHING
        return None, _simplify(frozenset().union(*(query if strings is None else _of_strings(strings) for strings, query in ways)))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if most == 1 and strings is not None:
            return strings | ({""} if least == 0 else set()), EVERYTHING
        if least == 0:
            return None, EVERYTHING
        return None, query if strings is None else _of_strings(strings)
    return None, EVERYTHING


def _sequence(items):
    known, query, exact = {""}, EVERYTHING, True
    for op, value in items:
        strings, inside = _item(op, value)
        joined = {a + b for a in known for b in strings} if strings is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            known = joined
            continue
        query, exact = _and(query, _and(_of_strings(known), inside)), False
        known = strings or {""}
    if exact:
        return known, EVERYTHING
    return None, _and(query, _of_strings(known))


def trigram_query(pattern, flags=0):
    """An OR of ANDs of trigrams that every text with a match of ``pattern`` meets.

    Trigrams are in ASCII lower case, so the query holds for either case.
    ``EVERYTHING`` means that no trigram is mandatory and the texts have to be
    scanned.
    """
    strings, query = _sequence(parser.parse(pattern, flags))
    return _of_strings(strings) if strings is not None else query
