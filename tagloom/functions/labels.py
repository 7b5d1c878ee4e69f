"""Label expressions: free-form category strings to fixed labels, and splits."""

from pyspark.sql import functions as F

from ..constants import LABELS
from .text import _column, collapse_spaces, fill_missing

# Category spellings per label, searched in this order.
ALIASES = (
    ("exec", ("Exec Code", "Code Exec", "Execution Code")),
    ("overflow", ("Overflow",)),
    ("mem", ("Mem. Corr.", "Mem Corr", "Memory Corruption")),
    ("dos", ("DoS", "Denial of Service")),
    ("bypass", ("Bypass",)),
    ("priv", ("+Priv", "Privilege Gain", "Priv Gain")),
    ("info", ("+Info", "Information Gain", "Info Gain")),
)

# Strings that mean "no label".
NO_LABEL = ("", "nan", "none", "null", "n/a")

# letters that match i or s when case is ignored
_FOLD_FROM, _FOLD_TO = "\u017f\u0131\u0130", "sii"

_LEFTOVER_WORD = " (?!(?:nan|none|null) )[^ ]"


def _bit(label):
    return 1 << LABELS.index(label)


def label_mask(raw):
    """The labels of a raw category string as one integer, bit k for label k.

    Aliases are literals, so the search is a fold of plain string replaces over a
    constant array; the generated code does not grow with the alias count.
    """
    text = F.lower(F.translate(collapse_spaces(fill_missing(raw)), _FOLD_FROM, _FOLD_TO))
    steps = F.expr(
        "array(" + ", ".join(
            f"named_struct('alias', '{alias.lower()}', 'bit', {_bit(label)})" for label, aliases in ALIASES for alias in aliases
        ) + ")"
    )

    def take(state, step):
        found = F.contains(state["rest"], step["alias"])
        return F.struct(
            F.replace(state["rest"], step["alias"], F.lit(" ")).alias("rest"),
            state["mask"].bitwiseOR(F.when(found, step["bit"]).otherwise(F.lit(0))).alias("mask"),
        )

    def close(state):
        rest = F.concat(F.lit(" "), F.translate(state["rest"], "+/.,;:_-", " " * 8), F.lit(" "))
        other = F.when(rest.rlike(_LEFTOVER_WORD), F.lit(_bit("other"))).otherwise(F.lit(0))
        return state["mask"].bitwiseOR(other)

    start = F.struct(text.alias("rest"), F.lit(0).alias("mask"))
    return F.when(text.isin(*NO_LABEL), F.lit(0)).otherwise(F.aggregate(steps, start, take, close))


def label_columns(mask, labels=LABELS):
    """0/1 columns of a mask column, given by name."""
    return [F.expr(f"shiftright({mask}, {i}) & 1 AS {label}") for i, label in enumerate(labels)]


def labels_to_list(labels=LABELS, prefix=""):
    """Names of the active labels in fixed order."""
    named = ", ".join(f"if({prefix}{label} = 1, '{label}', NULL)" for label in labels)
    return F.expr(f"array_compact(array({named}))")


def assign_split(sample_id, seed=42):
    """train, val or test from a hash of seed and id: 8, 1 and 1 tenths."""
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), _column(sample_id).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10
    return F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test")
