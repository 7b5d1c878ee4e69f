"""The corpus operators as registered queries, each over its whole table."""

from pyspark.sql import functions as F

from tagloom.llm import chat, collocations, debruijn, imatch, langid, metric, mixing, negatives, pieces, quality, secrets, simhash, templates
from tagloom.llm.common import table

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select(
        F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )


@query
def op4_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op9_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, pieces.load(), lossless_col="lossless")
    return encoded.select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).alias("n_pieces"), "lossless")


@query
def op8_chat_formatting(spark, sf_dir):
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(rows)
    back = chats.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


ORACLES["op8_chat_formatting"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, length('<turn >') + length('</turn>') + 1 + length(role) + length(text)
        + length(role || text) - length(translate(role || text, '\<>', '')) AS chars,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars,
    bool_and((before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
        OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))
        AND bool_and(after IS NOT NULL OR role IN ('user', 'assistant')) AS valid
FROM marked GROUP BY conv_id
"""


@query
def op10_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in secrets.BASE_RULES)))
    return found.select(
        "doc_id", *(F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE_RULES),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op5_imatch_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.against_next(docs, imatch.lexicon(docs)).withColumnRenamed("id", "doc_id")


@query
def op7_embedding_near_dedup(spark, sf_dir):
    found = metric.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


@query
def op6_substring_dedup(spark, sf_dir):
    kept = debruijn.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", "text")


ORACLES["op3_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, number, string_split(text, chr(10))[number] AS line,
        list_filter(string_split_regex(string_split(text, chr(10))[number], '[\x09-\x0D\x20]+'), lambda t: t <> '') AS tokens
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS number FROM documents)
), masked AS MATERIALIZED (
    SELECT *, len(tokens) AS n, list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS mask,
        array_to_string(tokens, ' ') AS whole
    FROM lines
), leaves AS MATERIALIZED (
    SELECT n, mask[1:2] AS lead FROM masked WHERE n >= 3 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5
), placed AS MATERIALIZED (
    SELECT doc_id, number, n, lead, unnest(mask) AS token, generate_subscripts(mask, 1) AS place
    FROM (SELECT *, mask[1:2] AS lead FROM masked) JOIN leaves USING (n, lead)
), constants AS MATERIALIZED (
    SELECT n, lead, place, token, true AS constant FROM placed WHERE place > 2 AND token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5
), kept AS (
    SELECT doc_id, number, n, place, CASE WHEN place <= 2 OR constant THEN token ELSE '<*>' END AS token
    FROM placed LEFT JOIN constants USING (n, lead, place, token)
), formed AS (
    SELECT doc_id, number, array_to_string(list(token ORDER BY place), ' ') AS form FROM kept GROUP BY doc_id, number, n
    HAVING 2 * count(*) FILTER (token <> '<*>' AND regexp_matches(token, '[A-Za-z]|[^\x00-\x7F]')) > n AND count(*) FILTER (token = '<*>') > 0
), keyed AS MATERIALIZED (
    SELECT doc_id, number, '= ' || whole AS key FROM masked WHERE n > 0 UNION ALL SELECT doc_id, number, '~ ' || form FROM formed
), recurring AS (
    SELECT key, min(doc_id) AS first FROM keyed GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), dropped AS (
    SELECT DISTINCT doc_id, number FROM keyed JOIN recurring USING (key) WHERE first < doc_id
), remaining AS (
    SELECT lines.doc_id, lines.number, line, dropped.number IS NOT NULL AS gone
    FROM lines LEFT JOIN dropped ON lines.doc_id = dropped.doc_id AND lines.number = dropped.number
)
SELECT d.doc_id, count(k.number) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY k.number), '') END AS text
FROM documents d LEFT JOIN remaining k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text
"""


# The domains of the corpus, from its labels, and the shares of tokens that a mix should have.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN 'clean' END"
MIX = {"clean": 0.94, "low": 0.04, "toxic": 0.02}


def labelled_domains(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.expr(DOMAIN).alias("domain"))


@query
def op2_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = mixing.fit(docs, labelled_domains(spark, sf_dir))
    members = mixing.memberships(docs, classifier)
    rates = mixing.fit_rates(members, classifier.domains, MIX)
    posteriors = [F.col(f"p_{k}").alias(f"p_{d}") for k, d in sorted(enumerate(classifier.domains), key=lambda x: x[1])]
    return rates.select(F.col("id").alias("doc_id"), "tokens", *posteriors, "rate", mixing.take(F.col("rate"), "id", "mark").alias("copies"))


@query
def op11_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.where(~langid.held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return quality.rated(docs, model).select(
        F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op12_phrase_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLES["op12_phrase_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
    FROM documents
), totals AS (
    SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces
), counted AS MATERIALIZED (
    SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, count(*) AS a
    FROM starts, range(1, 5) AS sizes(size) WHERE pos + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30
), candidates AS MATERIALIZED (
    SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE size > 1
), halves AS MATERIALIZED (
    SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS rest
    FROM candidates, range(1, 4) AS ks(k) WHERE k < size
), cuts AS MATERIALIZED (
    SELECT h.lang, h.phrase, h.a, k, x.a AS l, y.a AS r, CAST(2000000 * h.a::HUGEINT // (x.a + y.a) AS BIGINT) AS score
    FROM halves h JOIN counted x ON x.lang = h.lang AND x.phrase = h.head JOIN counted y ON y.lang = h.lang AND y.phrase = h.rest
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT DISTINCT c.lang, array_to_string(c.words[pos:pos + part - 1], ' ') AS phrase, c.a AS longer
    FROM candidates c, range(2, 4) AS parts(part), range(1, 4) AS places(pos) WHERE part < c.size AND pos + part - 1 <= c.size
), dropped AS (
    SELECT DISTINCT w.lang, w.phrase FROM weakest w JOIN inside i ON w.lang = i.lang AND w.phrase = i.phrase
    WHERE 100 * i.longer::HUGEINT >= 80 * w.a::HUGEINT
), ranked AS (
    SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
    FROM weakest ANTI JOIN dropped USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = r"""
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vectors
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, any_value(a.label) = any_value(b.label) AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
    FROM parts a JOIN parts b ON a.dim = b.dim WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
