"""Joining node dumps, manifests, scores and labels by key."""

from pyspark.sql import functions as F

from ..constants import CELL_TERMINATOR, FIELDS, LABELS
from ..functions.elements import NODE_KINDS, node_cell, node_json, one_node_tokens
from ..functions.text import source_key
from ..sources.writers import source_bodies
from ..staging import number_rows, stage

EMPTY_CELL = "[]--====--"


def dump_nodes(samples, extension=".cpp"):
    """Dump rows of every sample: identifiers, calls, then control words, in text order."""
    from ..functions.elements import call_names, controls
    from ..functions.text import safe_project_name

    names = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z_][A-Za-z0-9_]*+"), F.lit(0))
    sets = F.array(
        F.struct(F.lit(0).alias("kind"), names.alias("values")),
        F.struct(F.lit(1).alias("kind"), call_names(F.col("text")).alias("values")),
        F.struct(F.lit(2).alias("kind"), controls(F.col("text")).alias("values")),
    )
    filename = F.concat(safe_project_name("project"), F.lit("/"), F.col("sample_id").cast("string"), F.lit(extension))
    kinds = F.array(*[F.lit(k) for k in NODE_KINDS])
    return (
        samples.select(filename.alias("filename"), F.explode(sets).alias("s"))
        .select("filename", "s.kind", F.posexplode("s.values").alias("pos", "value"))
        .select(
            "filename",
            F.shiftleft(F.col("kind").cast("long"), 40).bitwiseOR(F.col("pos").cast("long")).alias("line_no"),
            F.element_at(kinds, F.col("kind") + 1).alias("label"),
            F.when(F.col("kind") == 2, F.lit("")).otherwise(F.col("value")).alias("value"),
            F.col("value").alias("code"),
        )
    )


def aggregate_nodes_by_file(nodes):
    """One node cell per file, nodes in line order: the form in which cells are exported.

    A cell is one value, so a file has to fit into a row.  Rules do not need the
    cells; ``file_elements`` takes the token sets from the node rows.
    """
    packed = F.struct("line_no", node_json(F.col("label"), F.col("value"), F.col("code")).alias("json"))
    cells = nodes.select("filename", packed.alias("_node")).groupBy("filename").agg(
        F.array_sort(F.collect_list("_node")).alias("_nodes")
    )
    return cells.select("filename", F.size("_nodes").cast("long").alias("n_nodes"), node_cell(F.col("_nodes.json")).alias("cpg"))


def count_nodes(nodes):
    """(filename, label, value, code, n) of the different nodes of the three kinds.

    The kind goes as a number, negative where the code is not the value: most
    codes are, and are then not held and shuffled a second time.
    """
    kinds = F.array(*[F.lit(k) for k in NODE_KINDS])
    kind, differs = F.array_position(kinds, F.col("label")).cast("int"), ~F.col("code").eqNullSafe(F.col("value"))
    keys = "filename", F.when(differs, -kind).otherwise(kind).alias("_kind"), "value", F.when(differs, F.col("code")).alias("_code")
    counts = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("_kind") < 0, F.col("_code")).otherwise(F.col("value"))
    return counts.select("filename", F.element_at(kinds, F.abs("_kind")).alias("label"), "value", code.alias("code"), "n")


def file_elements(nodes, min_chars=100, legacy=False):
    """(filename, ids, calls, controls): the token sets of a file's cell, without making the cell.

    Repeats of a token go before the shuffle.  A cell of at most ``min_chars``
    characters has no tokens; its length follows from the lengths of its nodes.
    """
    kinds = dict(zip(NODE_KINDS, FIELDS))
    json = node_json(F.col("label"), F.col("value"), F.col("code"))
    field = F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.col("label"))
    marked = nodes.select(
        "filename", field.alias("field"), F.length(json).cast("long").alias("_chars"),
        one_node_tokens(F.col("label"), F.coalesce("value", F.lit("")), F.coalesce("code", F.lit("")), legacy).alias("_tokens"),
    )
    long = marked.select("filename", "field", "_chars", F.posexplode_outer("_tokens").alias("_pos", "_token"))
    once = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    sets = long.groupBy("filename").agg(
        F.sum(F.when(once, F.col("_chars") + len(", "))).alias("_chars"),
        *[F.collect_set(F.when(F.col("field") == f, F.col("_token"))).alias(f) for f in FIELDS],
    )
    whole = F.col("_chars") - len(", ") + len("[]" + CELL_TERMINATOR) > min_chars
    none = F.array().cast("array<string>")
    return sets.select("filename", *[F.when(whole, F.col(f)).otherwise(none).alias(f) for f in FIELDS])


def with_file_elements(rows, elements, root="sources"):
    """Rows with the token sets of their source file; files without nodes have none."""
    keyed = source_bodies(rows, root).select("sample_id", source_key("source_path").alias("filename"))
    none = F.array().cast("array<string>")
    sets = keyed.join(elements, "filename", "left").select("sample_id", *[F.coalesce(f, none).alias(f) for f in FIELDS])
    return rows.join(sets, "sample_id")


def join_manifest_nodes(manifest, cells):
    """Every manifest row with its cell; files without nodes get an empty one."""
    keyed = manifest.withColumn("filename", source_key("source_path"))
    return keyed.join(cells, "filename", "left").withColumns(
        {"cpg": F.coalesce("cpg", F.lit(EMPTY_CELL)), "n_nodes": F.coalesce("n_nodes", F.lit(0))}
    )


def join_source_cells(source, manifest):
    """Source rows with path and cell, matched on the id as a string."""
    left = source.withColumn("sample_id", F.col("sample_id").cast("string"))
    right = manifest.select(F.col("sample_id").cast("string").alias("sample_id"), "source_path", "filename", "cpg")
    return left.join(right, "sample_id", "left")


def with_positions(table, order, name="position"):
    """0-based positions over an explicit order, for tables that come without a key."""
    return number_rows(table, order, name, start=0)


def align_predictions(scores, truth, elements=None, key="sample_id", labels=LABELS):
    """Scores, true labels and elements of a sample on one row."""
    true_columns = [F.col(l).alias(f"true_{l}") for l in labels]
    joined = scores.join(truth.select(key, *true_columns), key)
    return joined if elements is None else joined.join(elements, key)


def _bucket_sums(rows, labels, buckets):
    """Per bucket of the key, the rows and two checksums that do not depend on their order."""
    known = [F.coalesce(l, F.lit(0)) for l in labels] + [F.col(l).isNull() for l in labels] + [F.col("_key").isNull()]
    checks = [F.sum(F.xxhash64(F.lit(seed), "_key", *known).cast("decimal(20,0)")).alias(f"_c{seed}") for seed in (1, 2)]
    return rows.groupBy(_bucket(buckets)).agg(F.count(F.lit(1)).alias("_n"), *checks)


def _bucket(buckets):
    return F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_bucket")


def validate_alignment(test, labels_table, key="sample_id", labels=LABELS, buckets=1 << 16):
    """Row counts of both tables, repeated and differing keys, and whether every label agrees, as one row.

    Order-free checksums of 128 bits per bucket of the key are compared first;
    only rows of buckets that differ are joined.  In the others both tables hold
    the same rows, so repeated keys are counted on one side, without labels.
    Each side is counted by key before a join, so a repeated key neither
    multiplies rows nor evens out a difference in length.
    """
    kind = test.schema[key].dataType
    sides = [t.select(F.col(key).cast(kind).alias("_key"), *[F.col(l).cast("int").alias(l) for l in labels]) for t in (test, labels_table)]
    left, right = (_bucket_sums(rows, labels, buckets).select("_bucket", F.struct("_n", "_c1", "_c2").alias(n)) for rows, n in zip(sides, "lr"))
    sums = stage(left.join(right, "_bucket", "full"), "bucket-sums")
    # at most one row per bucket
    differing = F.broadcast(sums.where(~F.col("l").eqNullSafe(F.col("r"))).select("_bucket"))

    def side(rows, name):
        met = rows.withColumn("_bucket", _bucket(buckets)).join(differing, "_bucket", "left_semi")
        values = F.max(F.struct(*labels)).alias(f"_v{name}")
        return met.groupBy(F.struct("_key").alias("_key")).agg(F.count(F.lit(1)).alias(f"_n{name}"), values)

    both = side(sides[0], "l").join(side(sides[1], "r"), "_key", "full")  # keys in a struct: a null key meets a null key
    same = F.col("_nl").isNotNull() & F.col("_nr").isNotNull() & F.col("_vl").eqNullSafe(F.col("_vr"))
    repeated = (F.coalesce("_nl", F.lit(0)) > 1) | (F.coalesce("_nr", F.lit(0)) > 1)
    none = F.lit(0).cast("long")
    rows_of = [F.coalesce(F.sum(f"{n}._n"), none).alias(a) for n, a in (("l", "test_rows"), ("r", "label_rows"))]
    keys = sides[0].select("_key").withColumn("_bucket", _bucket(buckets)).join(differing, "_bucket", "left_anti").groupBy("_key").count()
    parts = [
        sums.agg(*rows_of).select("test_rows", "label_rows", none.alias("repeated_keys"), none.alias("mismatched_rows"), none.alias("_wrong")),
        both.agg(F.count_if(repeated), F.count_if(~same), F.count_if(~same | repeated)).select(none, none, "*"),
        keys.agg(F.count_if(F.col("count") > 1).alias("n")).select(none, none, "n", none, "n"),
    ]
    total = parts[0].union(parts[1]).union(parts[2])
    found = total.agg(*[F.sum(c).alias(c) for c in parts[0].columns])
    return found.select(*parts[0].columns[:4], (F.col("_wrong") == 0).cast("int").alias("labels_match"))


def split_prediction_table(predictions, labels=LABELS, key="sample_id", pred="pred_", true="true_"):
    """``pred_*`` and ``true_*`` columns as two tables named by label."""
    scores = predictions.select(key, *[F.col(f"{pred}{l}").alias(l) for l in labels])
    truth = predictions.select(key, *[F.col(f"{true}{l}").alias(l) for l in labels])
    return scores, truth
