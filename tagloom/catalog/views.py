"""SQL views (as WITH clauses) that mirror ``sources.views`` and shared intermediates."""

from ..constants import LABELS, LEGACY_RULE_LABELS
from ..functions.labels import ALIASES
from ..functions.text import SPACE_CLASS, SPACE_POINTS
from ..operators.rules import NOTEBOOK_CAPS
from ..sources.views import CATEGORIES

SPACES = "||".join(f"chr({p})" for p in SPACE_POINTS)
WS = f"[{SPACE_CLASS}]"
LABEL_LIST = ", ".join(LABELS)


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x):
    return f"trim({x}, {SPACES})"


def clean(x):
    return strip(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")


COMMENT = r"""(?sm)//.*?$|/\*.*?\*/|(''(?:[^\\'']|\\.)*''|"(?:[^\\"]|\\.)*")"""


def remove_comments(x):
    """Literals are told from comments by their first character, match by match."""
    between, matches = f"string_split_regex({x}, '{COMMENT}')", f"regexp_extract_all({x}, '{COMMENT}')"
    kept = f"list_transform({matches}, lambda m: CASE WHEN starts_with(m, '/') THEN ' ' ELSE m END)"
    return f"array_to_string(list_transform(list_zip({between}, list_append({kept}, '')), lambda z: z[1] || z[2]), '')"


def literals(x, greedy=False):
    if greedy:
        return f"""regexp_replace({x}, '".*"', 'strlitplaceholder', 'g')"""
    return f"""regexp_replace({x}, '".*?"', ' strlitplaceholder ', 'g')"""


def camel(p):
    return f"regexp_replace(regexp_replace({p}, '([A-Z]+)', ' \\1', 'g'), '([A-Z][a-z]+)', ' \\1', 'g')"


def split_identifier(x):
    parts = (
        f"list_filter(string_split_regex(regexp_replace({x}, '[^a-zA-Z0-9_]', ' ', 'g'), '[ _]+'), "
        "lambda p: p <> '' AND NOT regexp_full_match(p, '[0-9]+'))"
    )
    pieces = f"list_transform({parts}, lambda p: string_split_regex(trim(lower({camel('p')})), ' +'))"
    return f"list_filter(flatten({pieces}), lambda t: t <> '')"


def code_tokens(x):
    return split_identifier(literals(f"regexp_replace({x}, '{COMMENT}', '\\1 ', 'g')"))


def letters_legacy(x):
    units = f"string_split(regexp_replace({x}, '[^a-zA-Z0-9]', ' ', 'g'), ' ')"
    letters = "regexp_replace(u, '[^a-zA-Z]+', '', 'g')"
    pieces = f"list_transform({units}, lambda u: string_split_regex(trim(lower({camel(letters)})), ' +'))"
    return f"list_filter(flatten({pieces}), lambda t: t <> '')"


def names(x):
    return f"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*')"


def ids(x):
    return "list_distinct(" + split_identifier(f"array_to_string({names(x)}, ' ')") + ")"


def call_names(x):
    words = f"regexp_extract_all({x}, '([\\p{{L}}\\p{{N}}_]+){WS}*\\(', 1)"
    return f"list_filter({words}, lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*'))"


def calls(x):
    kept = f"list_filter({call_names(x)}, lambda w: w NOT IN ('if','for','while','switch','return','sizeof'))"
    return "list_distinct(" + split_identifier(f"array_to_string({kept}, ' ')") + ")"


def controls(x):
    words = ", ".join(
        f"CASE WHEN regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}' END"
        for k in ("if", "for", "while", "switch", "case", "return")
    )
    return f"list_filter([{words}], lambda k: k IS NOT NULL)"


def _label_chain():
    flat = [(label, a.lower()) for label, aliases in ALIASES for a in aliases]
    steps = [
        f"lc0 AS (SELECT *, lower(trim(regexp_replace(raw_classification, '\\s+', ' ', 'g'))) AS r0 FROM raw_samples)"
    ]
    for i, (_, alias) in enumerate(flat, 1):
        steps.append(
            f"lc{i} AS (SELECT *, replace(r{i-1}, '{alias}', ' ') AS r{i}, contains(r{i-1}, '{alias}') AS c{i} FROM lc{i-1})"
        )
    last = len(flat)
    none = "r0 IN ('', 'nan', 'none', 'null', 'n/a')"
    columns = []
    for label in LABELS:
        if label == "other":
            hit = (
                f"len(list_filter(string_split(regexp_replace(r{last}, '[+/.,;:_-]', ' ', 'g'), ' '), "
                "lambda w: w NOT IN ('', 'nan', 'none', 'null'))) > 0"
            )
        else:
            hit = " OR ".join(f"c{i}" for i, (l, _) in enumerate(flat, 1) if l == label)
        columns.append(f"CASE WHEN {none} THEN 0 WHEN {hit} THEN 1 ELSE 0 END AS {label}")
    return ",\n".join(steps) + (
        f",\nlabelled AS MATERIALIZED (SELECT sample_id, text, raw_classification, project, "
        + ", ".join(columns) + f" FROM lc{last})"
    )


def split_of(x, seed=42):
    bucket = f"(('0x' || substr(sha1('{seed}:' || {x}), 1, 8))::BIGINT % 10)"
    return f"CASE WHEN {bucket} < 8 THEN 'train' WHEN {bucket} = 8 THEN 'val' ELSE 'test' END"


ANY_LABEL = f"greatest({LABEL_LIST}) = 1"

_RAW = f"""raw_samples AS (
  SELECT doc_id AS sample_id,
    concat('int ', source, '_Handle', upper(substr(lang, 1, 1)), substr(lang, 2), '(char *p) {{ /* ', lang,
      ' */ if (p) return check', doc_id % 7, '(p); log("', source, '"); }}', chr(10), text) AS text,
    CASE doc_id % {len(CATEGORIES)} {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))} END AS raw_classification,
    source AS project
  FROM documents)"""

_SAMPLES = f"""samples AS MATERIALIZED (
  SELECT sample_id, {split_of('sample_id')} AS split, {clean('text')} AS text,
    {strip('raw_classification')} AS raw_classification, project, {LABEL_LIST}
  FROM labelled WHERE {ANY_LABEL} AND {clean('text')} <> '')"""


def score(k):
    return f"(((sample_id * 37 + {k * 101}) % 100) / 100.0::DOUBLE)"


_SCORED = (
    "scored AS MATERIALIZED (SELECT sample_id, split, raw_classification, "
    + ", ".join(f"{score(k)} AS score_{l}, {l} AS true_{l}" for k, l in enumerate(LABELS))
    + " FROM samples)"
)
_CELLS = "cells AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT sample_id, split, {k} AS k, '{l}' AS label, score_{l} AS score, true_{l} AS y, "
    f"(score_{l} >= 0.5)::INT AS p FROM scored"
    for k, l in enumerate(LABELS)
) + ")"

VIEWS = {
    "raw_samples": ((), _RAW),
    "labelled": (("raw_samples",), _label_chain()),
    "samples": (("labelled",), _SAMPLES),
    "scored": (("samples",), _SCORED),
    "cells": (("scored",), _CELLS),
    "tokens": (
        ("samples",),
        f"tokens AS MATERIALIZED (SELECT sample_id, split, {LABEL_LIST}, {code_tokens('text')} AS tokens FROM samples)",
    ),
    "uni": (
        ("tokens",),
        "uni AS MATERIALIZED (SELECT sample_id, split, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM tokens)",
    ),
    "terms": (
        ("uni",),
        """terms AS MATERIALIZED (SELECT sample_id, split, term FROM uni UNION ALL
  SELECT sample_id, split, term || ' ' || nxt FROM (
    SELECT *, lead(term) OVER (PARTITION BY sample_id ORDER BY pos) AS nxt FROM uni) WHERE nxt IS NOT NULL)""",
    ),
    "long_labels": (
        ("samples",),
        "long_labels AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT sample_id, split, '{l}' AS label, {l} AS y FROM samples" for l in LABELS) + ")",
    ),
    "doc_labels": (
        (),
        f"doc_labels AS MATERIALIZED (SELECT doc_id AS sample_id, {split_of('doc_id')} AS split, text, quality, toxic "
        "FROM documents JOIN labels USING (doc_id))",
    ),
    "element_sets": (
        ("samples",),
        f"element_sets AS MATERIALIZED (SELECT sample_id, split, {LABEL_LIST}, {ids('text')} AS ids, "
        f"{calls('text')} AS calls, {controls('text')} AS controls FROM samples)",
    ),
    "element_tokens": (
        ("element_sets",),
        "element_tokens AS MATERIALIZED ("
        + " UNION ALL ".join(f"SELECT sample_id, split, {LABEL_LIST}, '{f}' AS field, unnest({f}) AS token FROM element_sets" for f in ("ids", "calls", "controls"))
        + ")",
    ),
}


def prevalence_views(labels, prefix, by_universe):
    """Frequencies of train tokens per label in long form: <prefix>_freq(label, field, token, freq)."""
    counts = " UNION ALL ".join(
        f"SELECT '{l}' AS label, field, token, sum({l}) AS n FROM element_tokens WHERE split = 'train' GROUP BY field, token"
        for l in labels
    )
    if by_universe:
        sizes = f"{prefix}_d AS MATERIALIZED (SELECT field, greatest(count(DISTINCT token), 1) AS d FROM {prefix}_n GROUP BY field)"
        joined = f"{prefix}_n c JOIN {prefix}_d USING (field)"
    else:
        sizes = f"{prefix}_d AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT '{l}' AS label, greatest(coalesce(sum({l}), 0), 1) AS d FROM samples WHERE split = 'train'" for l in labels
        ) + ")"
        joined = f"{prefix}_n c JOIN {prefix}_d USING (label)"
    return (
        f"{prefix}_n AS MATERIALIZED ({counts}),\n{sizes},\n"
        f"{prefix}_freq AS MATERIALIZED (SELECT label, field, token, (n * 100.0::DOUBLE) / d AS freq FROM {joined}),\n"
        f"{prefix}_other AS MATERIALIZED (SELECT a.label, a.field, a.token, a.freq AS freq, "
        f"max(b.freq) AS max_other, min(b.freq) AS min_other FROM {prefix}_freq a JOIN {prefix}_freq b "
        f"ON a.field = b.field AND a.token = b.token AND a.label <> b.label GROUP BY ALL)"
    )


def rules_view(prefix, legacy, threshold=1.5, caps=None, name=None):
    """Rules of <prefix>_other as <name>_rules; ``caps`` by field replace the one cap of the lowest other frequency."""
    if legacy:
        pos = "CASE WHEN max_other <> 0 THEN freq / max_other WHEN freq <> 0 THEN 1000.0 ELSE 0.0 END"
        cap = "10000.0" if caps is None else "CASE field " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in caps.items()) + " END"
        low = f"least({cap}, min_other)"
        neg = f"CASE WHEN {low} <> 0 AND freq <> 0 THEN {low} / freq WHEN {low} <> 0 THEN 1000.0 ELSE 0.0 END"
        keep_pos, keep_neg = f"({pos}) > {threshold}", f"({neg}) > {threshold}"
    else:
        pos = "CASE WHEN max_other > 0 THEN freq / max_other END"
        neg = "CASE WHEN freq > 0 THEN min_other / freq END"
        keep_pos = f"CASE WHEN max_other > 0 THEN freq / max_other > {threshold} ELSE freq > 0 END"
        keep_neg = f"CASE WHEN freq > 0 THEN min_other / freq > {threshold} ELSE min_other > 0 END"
    return (
        f"{name or prefix}_rules AS MATERIALIZED (SELECT label, field, 'pos' AS polarity, token, {pos} AS ratio FROM {prefix}_other WHERE {keep_pos} "
        f"UNION ALL SELECT label, field, 'neg', token, {neg} FROM {prefix}_other WHERE {keep_neg})"
    )


VIEWS["lib"] = (("element_tokens",), prevalence_views(LABELS, "lib", False) + ",\n" + rules_view("lib", False))
VIEWS["leg"] = (("element_tokens",), prevalence_views(LEGACY_RULE_LABELS, "leg", True) + ",\n" + rules_view("leg", True))
VIEWS["notebook"] = (("leg",), rules_view("leg", True, caps=NOTEBOOK_CAPS, name="notebook"))


def with_views(select, *names):
    """``select`` behind a WITH clause of the named views and what they need."""
    ordered = []

    def add(name):
        if name in ordered:
            return
        for needed in VIEWS[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return select
    return "WITH " + ",\n".join(VIEWS[n][1] for n in ordered) + "\n" + select
