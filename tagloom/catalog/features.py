"""Vocabularies, TF-IDF, selection, sequences, histograms, word vectors."""

from pyspark.sql import functions as F

from ..constants import P_VALUE_GRID
from ..functions.text import code_tokens_legacy, word_tokens
from ..operators import cooccurrence, tfidf, vectors
from ..plans.baseline import BaselineConfig, fit_features, tokenised
from ..sources import views
from ..staging import discard, stage, stage_sized
from .registry import query
from .views import letters_legacy, literals, remove_comments, with_views

MAX_FEATURES = 20_000


def _tokens(spark, sf_dir):
    return stage(tfidf.with_tokens(views.samples(spark, sf_dir)).select("sample_id", "split", "tokens"), "tokens")


def _terms(spark, sf_dir):
    return tfidf.with_terms(_tokens(spark, sf_dir))


def _vocab_ctes(labels, source="terms", k=MAX_FEATURES):
    """tf, vocab(term, cf, df, idf) of train, and unit-length weights w of all splits."""
    return f"""tf AS MATERIALIZED (SELECT sample_id, split, term, count(*) AS tf FROM {source} GROUP BY ALL),
vocab AS MATERIALIZED (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df,
  ln((1.0::DOUBLE + (SELECT count(*) FROM {labels} WHERE split = 'train')) / (1.0::DOUBLE + count(*))) + 1.0 AS idf
  FROM tf WHERE split = 'train' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {k}),
w AS MATERIALIZED (SELECT sample_id, split, term, x / sqrt(sum(x * x) OVER (PARTITION BY sample_id)) AS w
  FROM (SELECT sample_id, split, term, tf * idf AS x FROM tf JOIN vocab USING (term)))"""


def with_weights(select, *needs, labels="samples", source="terms", extra="", k=MAX_FEATURES):
    base = with_views("", *(needs or ("samples", "terms"))).rstrip()
    middle = f",\n{extra}" if extra else ""
    return f"{base}{middle},\n{_vocab_ctes(labels, source, k)}\n{select}"


@query("a9_term_counts", with_views("SELECT term, count(*) AS cf, count(DISTINCT sample_id) AS df FROM terms GROUP BY term", "terms"))
def term_counts(spark, sf_dir):
    return tfidf.term_statistics(_terms(spark, sf_dir))


_TOP = with_views(f"SELECT term, count(*) AS cf FROM terms WHERE split = 'train' GROUP BY term ORDER BY count(*) DESC, term LIMIT {MAX_FEATURES}", "terms")


@query("w1_vocab_topk", _TOP)
def vocab_topk(spark, sf_dir):
    return tfidf.frequent_terms(_terms(spark, sf_dir).where("split = 'train'"), MAX_FEATURES)


@query("w1_vocab_topk_pruned", _TOP)
def vocab_topk_pruned(spark, sf_dir):
    """The way for large tables: no shuffle of all terms."""
    return tfidf.top_terms(_terms(spark, sf_dir).where("split = 'train'"), MAX_FEATURES)


_INDEX = (
    "vocab_ids AS MATERIALIZED (SELECT term AS token, row_number() OVER (ORDER BY count(*) DESC, min(sample_id * 10000000 + pos)) AS token_id, "
    "count(*) AS cf FROM uni WHERE split = 'train' GROUP BY term)"
)


def with_index(select):
    return with_views("", "uni").rstrip() + ",\n" + _INDEX + "\n" + select


@query("w7_vocab_index", with_index("SELECT token, token_id, cf FROM vocab_ids"))
def vocab_index(spark, sf_dir):
    return tfidf.vocab_index(_tokens(spark, sf_dir).where("split = 'train'"))


@query("w7_vocab_index_unknown", with_index("SELECT token, token_id + 1 AS token_id, cf FROM vocab_ids"))
def vocab_index_unknown(spark, sf_dir):
    return tfidf.vocab_index(_tokens(spark, sf_dir).where("split = 'train'"), first_id=2)


def _index(rows, first_id=1):
    return stage_sized(tfidf.vocab_index(rows.where("split = 'train'"), first_id=first_id).select("token", "token_id"), "index")


@query(
    "j5_vocab_lookup",
    with_index("SELECT sample_id, (pos - 1)::INTEGER AS pos, token_id::INTEGER AS token_id FROM uni JOIN vocab_ids ON term = token"),
)
def vocab_lookup(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    return tfidf.vocab_lookup(rows, _index(rows))


_SEQUENCES = (
    "SELECT t.sample_id, array_to_string(list_resize(list_slice(coalesce(s.ids, []), 1, {n}), {n}, 0), ',') AS sequence FROM tokens t "
    "LEFT JOIN (SELECT sample_id, list(token_id ORDER BY pos) AS ids FROM uni JOIN vocab_ids ON term = token GROUP BY sample_id) s USING (sample_id)"
)


@query("f6_count_sequence", with_index(_SEQUENCES.format(n=256)))
def count_sequence(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    out = tfidf.count_sequence(rows, _index(rows), 256)
    return out.select("sample_id", F.array_join("sequence", ",").alias("sequence"))


@query(
    "f6_count_sequence_unknown",
    with_index(
        "SELECT sample_id, array_to_string(list_resize(list_slice(list(coalesce(token_id + 1, 1) ORDER BY pos), 1, 512), 512, 0), ',') AS sequence "
        "FROM uni LEFT JOIN vocab_ids ON term = token GROUP BY sample_id"
    ),
)
def count_sequence_unknown(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    out = tfidf.count_sequence(rows, _index(rows, 2), 512, unknown_id=1)
    return out.select("sample_id", F.array_join("sequence", ",").alias("sequence"))


@query(
    "a12_token_length_histogram",
    with_views("SELECT (floor(least(len(tokens), 512) / 16) * 16)::BIGINT AS bin, count(*) AS n FROM tokens GROUP BY 1", "tokens"),
)
def length_histogram(spark, sf_dir):
    return tfidf.token_length_histogram(tfidf.with_tokens(views.samples(spark, sf_dir)))


@query(
    "a13_padding_density",
    with_views(
        "SELECT p AS position, round(avg((len(tokens) <= p)::INT), 6) AS padded_share FROM tokens, range(512) r(p) GROUP BY p",
        "tokens",
    ),
)
def padding_density(spark, sf_dir):
    out = tfidf.padding_density(tfidf.with_tokens(views.samples(spark, sf_dir)))
    return out.select("position", F.round("padded_share", 6).alias("padded_share"))


@query("f1_tfidf_fit", with_weights("SELECT term, cf, df, round(idf, 6) AS idf FROM vocab"))
def tfidf_fit(spark, sf_dir):
    rows = _terms(spark, sf_dir).where("split = 'train'")
    fitted = tfidf.tfidf_fit(rows, MAX_FEATURES).table.df
    return fitted.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


def _named(entries, vocabulary):
    return entries.join(vocabulary.table.df.select("term_id", "term"), "term_id")


@query("f2_tfidf_transform", with_weights("SELECT sample_id, term, round(w, 6) AS w FROM w"))
def tfidf_transform(spark, sf_dir):
    rows = _terms(spark, sf_dir)
    vocabulary = tfidf.tfidf_fit(rows.where("split = 'train'"), MAX_FEATURES)
    entries = _named(tfidf.tfidf_entries(rows, vocabulary), vocabulary)
    return entries.select("sample_id", "term", F.round("w", 6).alias("w"))


_LEGACY_TERMS = (
    "ltok AS MATERIALIZED (SELECT sample_id, split, list_filter("
    + letters_legacy(literals(remove_comments("text"), True))
    + ", lambda t: length(t) >= 2) AS tokens FROM samples),\n"
    "luni AS MATERIALIZED (SELECT sample_id, split, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM ltok),\n"
    "lterms AS MATERIALIZED (SELECT sample_id, split, term FROM luni UNION ALL SELECT sample_id, split, term || ' ' || nxt FROM "
    "(SELECT *, lead(term) OVER (PARTITION BY sample_id ORDER BY pos) AS nxt FROM luni) WHERE nxt IS NOT NULL)"
)


@query(
    "f3_tfidf_legacy",
    with_weights(
        "SELECT sample_id, term, round(w, 6) AS w FROM w",
        "samples", source="lterms", extra=_LEGACY_TERMS,
    ),
)
def tfidf_legacy(spark, sf_dir):
    text = views.samples(spark, sf_dir).withColumn("text", F.array_join(code_tokens_legacy("text"), " "))
    rows = tfidf.with_tokens(text, tokenizer=word_tokens).select("sample_id", "split", "tokens")
    rows = tfidf.with_terms(stage(rows, "tokens"))
    vocabulary = tfidf.tfidf_fit(rows.where("split = 'train'"), MAX_FEATURES)
    entries = _named(tfidf.tfidf_entries(rows, vocabulary), vocabulary)
    return entries.select("sample_id", "term", F.round("w", 6).alias("w"))


def chi2_ctes():
    """Chi-square of every (term, label) of train from long weights and labels."""
    return """train_y AS MATERIALIZED (SELECT sample_id, label, y FROM long_labels WHERE split = 'train'),
share AS MATERIALIZED (SELECT label, avg(y)::DOUBLE AS p1 FROM train_y GROUP BY label),
obs AS MATERIALIZED (SELECT term, label, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS o1, sum(w) AS s FROM w JOIN train_y USING (sample_id) GROUP BY ALL),
chi AS MATERIALIZED (SELECT term, label, CASE WHEN p1 > 0 AND p1 < 1 THEN (o1 - s * p1) * (o1 - s * p1) / (s * p1)
  + ((s - o1) - s * (1 - p1)) * ((s - o1) - s * (1 - p1)) / (s * (1 - p1)) END AS chi2 FROM obs JOIN share USING (label))"""


def with_chi2(select):
    return with_weights("", "samples", "terms", "long_labels").rstrip() + ",\n" + chi2_ctes() + "\n" + select


def _fitted(spark, sf_dir):
    config = BaselineConfig(max_features=MAX_FEATURES)
    rows = tokenised(views.samples(spark, sf_dir), config)
    return rows, *fit_features(rows, config)


@query("f4_chi2_scores", with_chi2("SELECT term, label, round(chi2, 6) AS chi2 FROM chi"))
def chi2_scores(spark, sf_dir):
    _, vocabulary, _, moments = _fitted(spark, sf_dir)
    scores = _named(tfidf.chi2_scores(moments), vocabulary)
    return scores.select("term", "label", F.round("chi2", 6).alias("chi2"))


_CRITICAL = "(VALUES " + ", ".join(f"({p}::DOUBLE, {tfidf.critical_value(p)!r}::DOUBLE)" for p in P_VALUE_GRID) + ") g(p_value, critical)"
_BEST = "(SELECT term, max(coalesce(chi2, 0)) AS m FROM chi GROUP BY term)"
_SELECTED = (
    f"SELECT g.p_value, term FROM {_BEST}, {_CRITICAL} WHERE m >= g.critical UNION ALL "
    f"SELECT g.p_value, (SELECT term FROM {_BEST} ORDER BY round(m, 9) DESC, term LIMIT 1) FROM {_CRITICAL} WHERE (SELECT max(m) FROM {_BEST}) < g.critical"
)


@query("f5_min_p_select", with_chi2(_SELECTED))
def min_p_select(spark, sf_dir):
    _, vocabulary, _, moments = _fitted(spark, sf_dir)
    return _named(tfidf.select_by_p(moments), vocabulary).select("p_value", "term")


@query(
    "j9_select_features",
    with_chi2(
        "SELECT sample_id, term, round(w, 6) AS w FROM w WHERE term IN (SELECT term FROM ("
        + _SELECTED + ") WHERE p_value = 0.5)"
    ),
)
def select_features(spark, sf_dir):
    _, vocabulary, entries, moments = _fitted(spark, sf_dir)
    selected = stage_sized(tfidf.select_by_p(moments, (0.5,)).select("term_id"), "selected")
    kept = tfidf.select_features(entries, selected)
    return _named(kept, vocabulary).select("sample_id", "term", F.round("w", 6).alias("w"))


def _given_vectors(spark, sf_dir, index):
    """The given vectors as vectors of the most frequent words: word id - 1 = vec_id."""
    given = views.table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("token_id"), F.col("embedding").alias("vector"))
    return index.df.join(given, "token_id").select(F.col("token").alias("word"), "vector")


def _dims(rows, keys, column):
    return rows.select(*keys, F.posexplode(column).alias("d", "v")).select(
        *keys, (F.col("d") + 1).cast("long").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value")
    )


def _array_sum(column):
    return F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)


_VECTOR = "(SELECT vec_id + 1 AS token_id, embedding FROM embeddings)"


@query(
    "j6_embedding_lookup",
    with_index(
        f"SELECT v.token_id, token, round(coalesce(list_sum(embedding::DOUBLE[]), 0), 6) AS total, coalesce(len(embedding), 64)::INTEGER AS size "
        f"FROM vocab_ids v LEFT JOIN {_VECTOR} e ON v.token_id = e.token_id"
    ),
)
def embedding_lookup(spark, sf_dir):
    index = _index(_tokens(spark, sf_dir))
    found = vectors.embedding_lookup(index.df, _given_vectors(spark, sf_dir, index), 64)
    return found.select("token_id", "token", F.round(_array_sum("vector"), 6).alias("total"), F.size("vector").alias("size"))


@query(
    "f8_embedding_matrix",
    with_index(
        "SELECT i.token_id, round(coalesce(list_sum(embedding::DOUBLE[]), 0), 6) AS total, round(coalesce(embedding[64], 0)::DOUBLE, 6) AS last "
        f"FROM (SELECT token_id FROM vocab_ids UNION ALL SELECT 0) i LEFT JOIN {_VECTOR} e ON i.token_id = e.token_id"
    ),
)
def embedding_matrix(spark, sf_dir):
    index = _index(_tokens(spark, sf_dir))
    matrix = vectors.embedding_matrix(index.df, _given_vectors(spark, sf_dir, index), 64)
    return matrix.select(
        "token_id", F.round(_array_sum("vector"), 6).alias("total"),
        F.round(F.element_at("vector", 64).cast("double"), 6).alias("last"),
    )


@query(
    "f10_doc_vector",
    with_index(
        "SELECT sample_id, dim, round(avg(x), 6) AS value FROM (SELECT sample_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT AS dim "
        f"FROM uni JOIN vocab_ids v ON term = token JOIN {_VECTOR} e ON v.token_id = e.token_id) GROUP BY ALL"
    ),
)
def doc_vector(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    given = _given_vectors(spark, sf_dir, _index(rows)).withColumnRenamed("word", "token")
    means = vectors.doc_vector(rows, stage_sized(given, "vectors"))
    return _dims(means.select("sample_id", vectors.vector_to_array("doc_vector").alias("v")), ["sample_id"], "v")


def _word_vectors(spark, sf_dir, **settings):
    rows = _tokens(spark, sf_dir).where("split = 'train'")
    return vectors.word_vectors(vectors.word2vec_fit(rows, **settings))


@query("f7_word2vec_fit")
def word2vec_fit(spark, sf_dir):
    return _word_vectors(spark, sf_dir)


@query(
    "f7_word2vec_whole_vocabulary",
    with_views("SELECT term AS word, 100 AS dims FROM uni WHERE split = 'train' GROUP BY term", "uni"),
)
def word2vec_whole_vocabulary(spark, sf_dir):
    """The same of the fit at the operator's defaults."""
    return word2vec_fit(spark, sf_dir).select("word", F.size("vector").alias("dims"))


_MEETINGS = """near_ AS MATERIALIZED (SELECT x.term AS a, y.term AS b, count(*) AS n FROM uni x JOIN uni y USING (sample_id)
  WHERE x.split = 'train' AND y.pos > x.pos AND y.pos <= x.pos + 25 GROUP BY ALL),
met AS MATERIALIZED (SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT * FROM near_ UNION ALL SELECT b, a, n FROM near_) GROUP BY ALL)"""


def _with_meetings(select):
    return with_views("", "uni").rstrip() + ",\n" + _MEETINGS + "\n" + select


@query(
    "f7_cooccurrence_counts",
    _with_meetings(
        "SELECT a AS word, count(*) AS partners, sum(n)::BIGINT AS meetings, max(n) AS most, sum(n * length(b))::BIGINT AS letters FROM met GROUP BY a"
    ),
)
def cooccurrence_counts(spark, sf_dir):
    """All pairs, as a few sums for each word."""
    counts = cooccurrence.cooccurrence_counts(_tokens(spark, sf_dir).where("split = 'train'"))
    return counts.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("partners"), F.sum("n").alias("meetings"), F.max("n").alias("most"), F.sum(F.col("n") * F.length("b")).alias("letters")
    )


@query(
    "f7_positive_pmi",
    _with_meetings(
        "SELECT a AS word, count(*) AS partners, round(sum(pmi), 4) AS pmi, round(max(pmi), 6) AS most FROM (SELECT a, b, ln(n::DOUBLE * (SELECT sum(n) FROM met) / (x.s::DOUBLE * y.s)) AS pmi FROM met "
        "JOIN (SELECT a, sum(n) AS s FROM met GROUP BY a) x USING (a) JOIN (SELECT a AS b, sum(n) AS s FROM met GROUP BY a) y USING (b)) WHERE pmi > 0 GROUP BY a"
    ),
)
def positive_pmi(spark, sf_dir):
    cells = cooccurrence.packed_counts(_tokens(spark, sf_dir).where("split = 'train'"))
    counts = cooccurrence.Cells(stage(cells.df, "cooccurrences"), cells.classes)
    pairs = cooccurrence.positive_pmi(counts)
    discard(counts.df)
    mutual = pairs.groupBy(F.col("a").alias("word"))
    return mutual.agg(F.count(F.lit(1)).alias("partners"), F.round(F.sum("pmi"), 4).alias("pmi"), F.round(F.max("pmi"), 6).alias("most"))


@query("f7_pmi_vectors")
def pmi_vectors(spark, sf_dir):
    return cooccurrence.pmi_vectors(_tokens(spark, sf_dir).where("split = 'train'"))


_PHRASES = """w1 AS MATERIALIZED (SELECT term, count(*) AS n FROM uni WHERE split = 'train' GROUP BY term),
nb AS MATERIALIZED (SELECT sample_id, split, pos, term AS a, lead(term) OVER (PARTITION BY sample_id ORDER BY pos) AS b FROM uni),
w2 AS MATERIALIZED (SELECT a, b, count(*) AS n_ab FROM nb WHERE split = 'train' AND b IS NOT NULL GROUP BY ALL),
ph AS MATERIALIZED (SELECT w2.a, w2.b, n_ab, (n_ab - 5) / x.n / y.n * ((SELECT count(*) FROM w1) + (SELECT count(*) FROM w2)) AS score
  FROM w2 JOIN w1 x ON x.term = w2.a JOIN w1 y ON y.term = w2.b WHERE n_ab > 5)"""


def _with_phrases(select, extra=""):
    return with_views("", "uni").rstrip() + ",\n" + _PHRASES + (",\n" + extra if extra else "") + "\n" + select


@query("f9_phrase_scores", _with_phrases("SELECT a, b, n_ab, round(score, 6) AS score FROM ph"))
def phrase_scores(spark, sf_dir):
    scores = vectors.phrase_scores(_tokens(spark, sf_dir).where("split = 'train'"))
    return scores.select("a", "b", "n_ab", F.round("score", 6).alias("score"))


_MERGED = """hit AS MATERIALIZED (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS run
  FROM nb JOIN (SELECT a, b FROM ph WHERE score > 10) USING (a, b) WHERE split <> 'train'),
lead_ AS MATERIALIZED (SELECT sample_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, run ORDER BY pos) AS nth FROM hit) WHERE nth % 2 = 1),
out_ AS MATERIALIZED (SELECT n.sample_id, n.pos, CASE WHEN l.pos IS NOT NULL THEN a || ' ' || b ELSE a END AS word
  FROM nb n LEFT JOIN lead_ l ON l.sample_id = n.sample_id AND l.pos = n.pos LEFT JOIN lead_ p ON p.sample_id = n.sample_id AND p.pos = n.pos - 1
  WHERE p.pos IS NULL AND n.split <> 'train')"""


@query(
    "f9_phrase_merge",
    _with_phrases("SELECT sample_id, string_agg(word, '|' ORDER BY pos) AS phrases FROM out_ GROUP BY sample_id", _MERGED),
)
def phrase_merge(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    scores = vectors.phrase_scores(rows.where("split = 'train'"))
    phrases = stage_sized(vectors.detect_phrases(scores), "phrases")
    merged = vectors.merge_phrases(rows.where("split <> 'train'"), phrases)
    return merged.select("sample_id", F.array_join("phrases", "|").alias("phrases"))


