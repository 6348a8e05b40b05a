"""Queries over texts, sections, splits and classic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import annotate, enrich, features, models, perturb, sections, termblocks
from ..operators.scratch import stored
from . import fixtures as fx
from .fixtures import with_views

#: Fixed values of the fixtures: a mapping with one blank and one missing language.
SECTION_MAP = [("en", "english"), ("fr", "european"), ("de", "european"), ("src0", "wire"), ("src5", "")]
RULES = [("[0-9]{2,}", "NUMBER"), ("[A-Z][a-z]{9,}", "NAME")]
LEMMAS = {"thes": "the", "ofs": "of", "ins": "in"}


def clean_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def strip_dateline(spark, sf):
    d = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("NEW YORK, N.Y.—"), "text")).otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", text.strip_dateline(d).alias("body"))


def mask_entities(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.mask_patterns(F.col("text"), RULES).alias("masked"))


def mask_spans(spark, sf):
    first = F.array(F.struct(F.lit(0).alias("start"), F.coalesce(F.char_length(F.substring_index("text", " ", 1)), F.lit(0)).alias("end"), F.lit("PERSON").alias("label")))
    return fx.table(spark, sf, "documents").select("doc_id", text.mask_spans(F.col("text"), first, ["PERSON"]).alias("masked"))


def annotated(spark, sf):
    """Numbers that an annotator finds, as texts."""

    def load():
        import re

        number = re.compile("[0-9]{2,}")
        return lambda texts: [[(m.start(), m.end(), "NUMBER") for m in number.finditer(t)] for t in texts]

    d = annotate.annotate(fx.table(spark, sf, "documents").select("doc_id", "text"), load, "text")
    found = annotate.span_texts(F.col("text"), F.col("spans"), "NUMBER")
    return d.select("doc_id", F.size("spans").alias("found"), F.array_join(found, "|").alias("numbers"))


def section_parse(spark, sf):
    return fx.articles(spark, sf).select("doc_id", F.array_join(text.parse_sections(F.col("section_raw")), "|").alias("sections"))


def section_standardise(spark, sf):
    mapping = spark.createDataFrame(SECTION_MAP, "raw string, standard string")
    return sections.standardise(fx.articles(spark, sf), text.parse_sections(F.col("section_raw")), mapping, "doc_id")


def keywords_normalise(spark, sf):
    k = F.concat_ws(", ", F.lit(" News"), "lang", F.upper("lang"), F.lit(""), "source")
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords(k), "|").alias("keywords"))


def bow_clean(spark, sf):
    lemmas = F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv])
    return fx.table(spark, sf, "documents").select("doc_id", text.bag_of_words(F.col("text"), lemmas=lemmas).alias("bow"))


def piece_text(spark, sf):
    """Words as a tokenizer's pieces, cleaned of its marks."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    pieces = F.transform(words, lambda x, i: F.concat(F.when(i % 2 == 0, F.lit("Ġ")).otherwise(F.lit("##")), x))
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(pieces, text.piece_text), " ").alias("pieces"))


def safe_casts(spark, sf):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(".5 "))).when(F.col("doc_id") % 3 == 1, F.lit(" TRUE")).otherwise(F.col("lang"))
    return fx.table(spark, sf, "documents").select("doc_id", numeric.to_bool(said).alias("flag"), numeric.to_float(said).alias("number"), numeric.cell(F.concat("lang", F.lit("|"), "source")).alias("cell"))


def compose_text(spark, sf):
    return fx.articles(spark, sf).select("doc_id", text.compose([F.col("headline"), F.col("section_raw"), F.col("description")], "</s>").alias("composed"))


def sample_projection(spark, sf):
    a = fx.articles(spark, sf)
    section = sections.fallback(a, ["preprocessed_article_section", "preprocessed_section", "section", "section_raw"])
    return enrich.require_columns(a, ["headline", "label"]).select(F.col("doc_id").alias("sample_id"), "headline", section.alias("section"), "description", F.col("label"))


def category_counts(spark, sf):
    return sections.category_counts(fx.articles(spark, sf), text.parse_sections(F.col("section_raw")), F.col("family"), ["a"])


def section_totals(spark, sf):
    return sections.source_totals(fx.articles(spark, sf), text.parse_sections(F.col("section_raw")), F.col("family"))


def _pool(spark, sf):
    a = fx.articles(spark, sf)
    combos = a.groupBy(F.when(F.col("section_raw") == "", sections.MISSING).otherwise(F.array_join(text.parse_sections(F.col("section_raw")), ", ")).alias("section")).agg(F.count("*").alias("total_count"))
    return sections.label_pool(combos)


def label_pool(spark, sf):
    return _pool(spark, sf)


def section_replace(spark, sf):
    out = perturb.replace_labels(fx.articles(spark, sf), "doc_id", text.parse_sections(F.col("section_raw")), _pool(spark, sf))
    return out.select("doc_id", F.array_join("own", "|").alias("own"), F.array_join("replaced", "|").alias("replaced"))


def section_draws(spark, sf):
    """The same by draws from running sums, one label of all documents' words a section."""
    words = fx.table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("label")).groupBy("label").agg(F.count("*").alias("weight"))
    words = stored(words)
    draw = perturb.draw_labels if perturb.pool_bytes(words) <= perturb.POOL_BYTES else perturb.draw_labels_apart
    out = draw(fx.articles(spark, sf), "doc_id", text.parse_sections(F.col("section_raw")), words)
    return out.select("doc_id", F.array_join("own", "|").alias("own"), F.array_join("replaced", "|").alias("replaced"))


def binned_shuffle(spark, sf):
    return perturb.binned_shuffle(fx.articles(spark, sf), "doc_id", "description")


def seeded_split(spark, sf):
    return perturb.seeded_split(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")


def exact_split(spark, sf):
    return perturb.exact_split(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")


def seeded_sample(spark, sf):
    return perturb.seeded_sample(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50)


def _texts(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "text")


def vocabulary(spark, sf):
    v = termblocks.vocabulary(_texts(spark, sf))
    return v.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf(spark, sf):
    return termblocks.tfidf(_texts(spark, sf)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _labels(spark, sf):
    return fx.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))


def nb_model(spark, sf):
    m = features.nb_long(termblocks.nb_model(_texts(spark, sf), _labels(spark, sf)))
    return m.select("label", "term", F.round("log_prior", 6).alias("log_prior"), F.round("log_prob", 5).alias("log_prob"))


def nb_predict(spark, sf):
    return termblocks.nb_predict(_texts(spark, sf), _labels(spark, sf)).select("doc_id", "predicted", F.round("score", 4).alias("score"))


def _split_labels(spark, sf):
    return stored(perturb.seeded_split(_labels(spark, sf), "doc_id"))


def lr_predict(spark, sf):
    """Fit on the split's training rows, predict every labelled document."""
    return models.lr_fit_predict(_texts(spark, sf), _split_labels(spark, sf))


def tune_trials(spark, sf):
    """Twelve drawn trials; the winner has the highest F1 on the validation rows."""
    return models.tune_terms(_texts(spark, sf), _split_labels(spark, sf).filter("split IN ('train', 'validation')"), {"c": (0.01, 100.0), "max_iter": [100, 500, 2000]}, 12)


def batch_score(spark, sf):
    """A fixed linear model over embeddings, scored in batches."""

    def load():
        import numpy as np

        w = np.linspace(-1, 1, 64)
        return lambda x: 1 / (1 + np.exp(-(x @ w)))

    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return models.batch_score(e, load, ["embedding"], 256, [[64]]).select("vec_id", "label", F.round("prob1", 9).alias("prob1"), "predicted_label", F.round("confidence", 9).alias("confidence"))


QUERIES = {f.__name__: f for f in (clean_text, strip_dateline, mask_entities, mask_spans, section_parse, section_standardise, keywords_normalise, bow_clean, piece_text, safe_casts, compose_text, sample_projection, category_counts, label_pool, section_replace, section_draws, binned_shuffle, seeded_split, seeded_sample, vocabulary, tfidf, nb_model, nb_predict, lr_predict, tune_trials, batch_score, annotated, section_totals, exact_split)}

_PARSED = """parsed AS (SELECT *, CASE WHEN section_raw LIKE '[%' THEN from_json(section_raw, '["VARCHAR"]') WHEN section_raw = '' THEN [] ELSE [section_raw] END AS sections FROM articles)
"""
_POOL = _PARSED + """, combos AS (SELECT sections, count(*) AS n FROM parsed GROUP BY 1), pool AS (SELECT label, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT unnest(sections) AS label, n FROM combos) GROUP BY 1)
"""
_u = lambda seed, *k: f"CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {', '.join(k)})), 1, 8)) AS BIGINT)"
_TF = """tok AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}') AS t FROM documents),
terms AS (SELECT doc_id, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, df, ln((1 + n.n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM counts GROUP BY 1) CROSS JOIN n WHERE df >= 2 AND df <= 0.98 * n.n),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM counts JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
"""
_NB = _TF + """, lab AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY 1),
prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM lab)::DOUBLE) AS log_prior FROM lab GROUP BY 1),
mass AS (SELECT label, term, sum(weight) AS w FROM weights JOIN lab USING (doc_id) GROUP BY ALL),
total AS (SELECT label, sum(w) AS total FROM mass GROUP BY 1),
model AS (SELECT p.label, v.term, p.log_prior, ln((coalesce(m.w, 0) + 1) / (t.total + (SELECT count(*) FROM vocab))) AS log_prob
  FROM prior p CROSS JOIN vocab v LEFT JOIN mass m ON m.label = p.label AND m.term = v.term LEFT JOIN total t ON t.label = p.label)
"""
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(description, ''), '\\s+'), lambda x: x <> ''))"
_DROP = ", ".join(f"'{w}'" for w in text.STOP_WORDS if w not in text.NEGATIONS)
_MAP = ", ".join(f"('{a}', '{b}')" for a, b in SECTION_MAP)
ORACLE = {
    "clean_text": "SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS cleaned FROM documents",
    "strip_dateline": "SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'NEW YORK, N.Y.—' || text ELSE text END, '^[A-Z\\s,.]+—', '')) AS body FROM documents",
    "mask_entities": ("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '^[A-Z\\s,.]+—', '')), '[0-9]{2,}', '[NUMBER]', 'g'), '[A-Z][a-z]{9,}', '[NAME]', 'g'), '\\s+', ' ', 'g')) AS masked FROM documents"),
    "mask_spans": "SELECT doc_id, trim(regexp_replace('[PERSON]' || substr(text, length(split_part(text, ' ', 1)) + 1), '\\s+', ' ', 'g')) AS masked FROM documents",
    "section_parse": with_views(_PARSED + "SELECT doc_id, array_to_string(sections, '|') AS sections FROM parsed", "articles"),
    "section_standardise": with_views(_PARSED + f""", m(raw, standard) AS (VALUES {_MAP}), e AS (SELECT doc_id, unnest(sections) AS label FROM parsed),
s AS (SELECT DISTINCT doc_id, coalesce(standard, 'other') AS s FROM e LEFT JOIN m ON lower(label) = raw), j AS (SELECT doc_id, string_agg(s, ', ' ORDER BY s) AS section FROM s WHERE s <> '' GROUP BY 1)
SELECT p.doc_id, coalesce(j.section, '') AS section FROM parsed p LEFT JOIN j ON j.doc_id = p.doc_id""", "articles"),
    "keywords_normalise": "SELECT doc_id, concat_ws('|', 'News', lang, source) AS keywords FROM documents",
    "bow_clean": (f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(w, lambda x: CASE x WHEN 'thes' THEN 'the' WHEN 'ofs' THEN 'of' WHEN 'ins' THEN 'in' ELSE x END), lambda x: x NOT IN ({_DROP})), ' ') AS bow FROM t"""),
    "piece_text": "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x, i: lower(regexp_replace(CASE WHEN i % 2 = 1 THEN 'Ġ' ELSE '##' END || x, 'Ġ|##', '', 'g'))), ' ') AS pieces FROM documents",
    "safe_casts": "WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' ' || n_chars || '.5 ' WHEN 1 THEN ' TRUE' ELSE lang END AS said, lang, source FROM documents) SELECT doc_id, lower(trim(said)) = 'true' AS flag, try_cast(trim(said) AS DOUBLE) AS number, replace(lang || '|' || source, '|', '\\|') AS cell FROM s",
    "batch_score": """WITH e AS (SELECT vec_id, label, 1 / (1 + exp(-list_sum(list_transform(range(len(embedding)), lambda i: embedding[i + 1]::DOUBLE * (-1 + i * 2 / 63.0::DOUBLE))))) AS p FROM embeddings)
SELECT vec_id, label, round(p, 9) AS prob1, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted_label, round(greatest(p, 1 - p), 9) AS confidence FROM e""",
    "compose_text": with_views("SELECT doc_id, headline || '</s>' || section_raw || '</s>' || description AS composed FROM articles", "articles"),
    "sample_projection": with_views("SELECT doc_id AS sample_id, headline, section_raw AS section, description, label FROM articles", "articles"),
    "category_counts": with_views(_PARSED + ", e AS (SELECT family, unnest(CASE WHEN len(sections) = 0 THEN ['<missing>'] ELSE sections END) AS section FROM parsed) SELECT section, count(*) AS total_count, count(*) FILTER (family = 'a') AS a_count, count(*) FILTER (family <> 'a') AS other_count FROM e GROUP BY 1", "articles"),
    "label_pool": with_views(_POOL + "SELECT * FROM pool", "articles"),
    "section_replace": with_views(_POOL + f""", f AS (SELECT p.doc_id, p.sections, pool.label, pool.weight, list_contains(p.sections, pool.label) AS own FROM parsed p CROSS JOIN pool),
g AS (SELECT *, count(*) FILTER (NOT own) OVER (PARTITION BY doc_id) >= len(sections) AS enough FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -ln(({_u(42, 'doc_id', 'label')} + 1) / 4294967297.0::DOUBLE) / weight) AS rn FROM g WHERE NOT (enough AND own)),
c AS (SELECT doc_id, string_agg(label, '|' ORDER BY label) AS replaced FROM r WHERE rn <= len(sections) GROUP BY 1)
SELECT p.doc_id, array_to_string(sections, '|') AS own, coalesce(replaced, '') AS replaced FROM parsed p LEFT JOIN c ON c.doc_id = p.doc_id""", "articles"),
    "binned_shuffle": with_views(f"""d AS (SELECT doc_id, description, {_WORDS} // 5 AS bin FROM articles),
a AS (SELECT doc_id, bin, row_number() OVER (PARTITION BY bin ORDER BY doc_id) AS rn FROM d), b AS (SELECT description AS shuffled, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM d)
SELECT a.doc_id, a.bin, b.shuffled FROM a JOIN b ON a.bin = b.bin AND a.rn = b.rn""", "articles"),
    "seeded_split": f"SELECT doc_id, CASE WHEN {_u(42, 'doc_id')} / 4294967296.0::DOUBLE < 0.2 THEN 'test' WHEN {_u(43, 'doc_id')} / 4294967296.0::DOUBLE < 0.25 THEN 'validation' ELSE 'train' END AS split FROM documents",
    "exact_split": """WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents), n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS t FROM documents)
SELECT doc_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + ceil((n - t) * 0.25) THEN 'validation' ELSE 'train' END AS split FROM k CROSS JOIN n""",
    "annotated": "WITH a AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[0-9]{2,}'), []) AS v FROM documents) SELECT doc_id, len(v) AS found, array_to_string(v, '|') AS numbers FROM a",
    "section_totals": with_views(_PARSED + "SELECT coalesce(family, '<all>') AS source, count(*) AS rows, count(*) FILTER (len(sections) = 0) AS without_label, CAST(sum(len(sections)) AS BIGINT) AS labels FROM parsed GROUP BY ROLLUP (family)", "articles"),
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "vocabulary": "WITH " + _TF + "SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf": "WITH " + _TF + "SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
    "nb_model": "WITH " + _NB + "SELECT label, term, round(log_prior, 6) AS log_prior, round(log_prob, 5) AS log_prob FROM model",
    "nb_predict": "WITH " + _NB + ", s AS (SELECT doc_id, label, sum(weight * log_prob) AS score FROM weights JOIN model USING (term) GROUP BY ALL), f AS (SELECT d.doc_id, p.label, coalesce(s.score, 0) + p.log_prior AS score FROM documents d CROSS JOIN prior p LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = p.label) SELECT doc_id, arg_max(label, struct_pack(a := score, b := -label)) AS predicted, round(max(score), 4) AS score FROM f GROUP BY 1",
}
