"""Views that give the given tables the shape the operators work on.

``raw_samples`` labels every document with a free-form category string and wraps
its text in a small C-like function, since the prose alone has no identifiers,
calls or comments.  All rows and whole texts are used.
"""

from pyspark.sql import functions as F

from ..constants import LABELS
from ..operators.prep import prepare
from ..staging import spread

# Category strings, given to documents in turn by their id.
CATEGORIES = (
    "DoS Overflow", "+Info", "Dir. Trav.", "DoS Exec Code Overflow Mem. Corr.", "Bypass +Info", "",
    "Exec Code", "DoS", "NaN", "Overflow +Priv", "XSS", "dos   bypass",
)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def code_text():
    lang = F.col("lang")
    return F.concat(
        F.lit("int "), F.col("source"), F.lit("_Handle"),
        F.upper(F.substring(lang, 1, 1)), F.substring(lang, 2, 1 << 20),
        F.lit("(char *p) { /* "), lang, F.lit(" */ if (p) return check"),
        (F.col("doc_id") % 7).cast("string"), F.lit('(p); log("'), F.col("source"), F.lit('"); }\n'),
        F.col("text"),
    )


def raw_from_documents(documents):
    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    category = F.expr(f"element_at(array({names}), cast(doc_id % {len(CATEGORIES)} + 1 AS int))")
    return documents.select(
        F.col("doc_id").alias("sample_id"),
        code_text().alias("text"),
        category.alias("raw_classification"),
        F.lit("").alias("cve_id"),
        F.lit("").alias("cwe_id"),
        F.col("source").alias("project"),
        F.lit("").alias("commit_id"),
        F.lit(1).alias("vul"),
    )


def raw_samples(spark, sf_dir):
    return raw_from_documents(documents(spark, sf_dir))


def samples(spark, sf_dir, seed=42):
    return prepare(raw_samples(spark, sf_dir), seed)


DOC_LABELS = ("quality", "toxic")


def doc_labels(spark, sf_dir, seed=42):
    """Labelled documents with their two natural labels."""
    from ..functions.labels import assign_split

    texts = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return texts.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), assign_split("doc_id", seed).alias("split"), "text",
        *DOC_LABELS,
    )


def with_scores(rows, labels=LABELS):
    """A deterministic score per label in [0, 1), from the id."""
    scores = [f"((sample_id * 37 + {k * 101}) % 100) / 100.0D AS score_{label}" for k, label in enumerate(labels)]
    return rows.selectExpr("*", *scores)


def predictions(spark, sf_dir, threshold=0.5, labels=LABELS):
    """Scores, thresholded predictions and true labels of every sample."""
    scored = with_scores(samples(spark, sf_dir), labels)
    return scored.selectExpr(
        "sample_id", "split", "raw_classification",
        *[f"score_{l}" for l in labels],
        *[f"cast(score_{l} >= {float(threshold)}D AS int) AS pred_{l}" for l in labels],
        *[f"{l} AS true_{l}" for l in labels],
    )


def page_code(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select(F.col("page_id").alias("sample_id"), F.col("html").alias("text"))
