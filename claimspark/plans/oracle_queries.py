"""Oracle SQL (DuckDB) per registered query key."""

from __future__ import annotations

from claimspark.plans import oracle as O
from claimspark.plans.queries import DATA_KEYWORDS, GRIDS, MODEL_VERSION, QUERY_FOLDS, VOCAB_SIZE
from claimspark.schema import CATEGORICAL_COLUMNS, CREDIT_COLUMNS, PROCESSED_COLUMNS, RAW_COLUMNS

_PROCESSED_SELECT = ", ".join(PROCESSED_COLUMNS + ["split"])
_RAW_SELECT = ", ".join(RAW_COLUMNS + ["split"])
_TOTAL = " + ".join(CREDIT_COLUMNS)

SQL: dict[str, str] = {}

SQL["feature_table"] = O.with_ctes(O.PROCESSED_CTE, f"SELECT {_PROCESSED_SELECT} FROM processed")
SQL["processed_read"] = SQL["feature_table"]
SQL["split_union"] = O.with_ctes(O.RAW_CTE, f"SELECT {_RAW_SELECT} FROM raw")

SQL["class_balance"] = O.with_ctes(O.PROCESSED_CTE, """
, counts AS (
  SELECT split, 'label' AS level, label AS value, count(*) AS n_rows FROM processed GROUP BY split, label
  UNION ALL
  SELECT split, 'label_binary', CAST(label_binary AS VARCHAR), count(*) FROM processed GROUP BY split, label_binary
)
SELECT split, level, value, n_rows,
       CAST(row_number() OVER (PARTITION BY split, level ORDER BY n_rows DESC, value ASC) AS INTEGER) AS rank
FROM counts""")

SQL["clean_text"] = O.with_ctes(O.RAW_CTE, f"SELECT id, {O.clean_text('statement')} AS statement_clean FROM raw")

SQL["clean_categorical"] = O.with_ctes(
    O.RAW_CTE, "SELECT id, " + ", ".join(f"{O.clean_categorical(c)} AS {c}" for c in CATEGORICAL_COLUMNS)
    + " FROM raw")

SQL["label_map"] = O.with_ctes(O.RAW_CTE, f"""
SELECT id, label, {O.label_case(O.BINARY_LABELS)} AS label_binary,
       {O.label_case(O.ORDINAL_LABELS)} AS label_ordinal
FROM raw WHERE label IN {O.sql_list(O.BINARY_LABELS)}""")
SQL["label_map_join"] = SQL["label_map"]

SQL["coerce_counts"] = O.with_ctes(
    O.RAW_CTE, "SELECT id, " + ", ".join(f"{O.coerce_count(c)} AS {c}" for c in CREDIT_COLUMNS) + " FROM raw")

SQL["text_features"] = O.with_ctes(O.RAW_CTE, f"""
SELECT id, {O.clean_text('statement')} AS statement_clean,
       {O.word_count(O.clean_text('statement'))} AS statement_len,
       CAST(length({O.clean_text('statement')}) AS INTEGER) AS statement_char_len,
       {O.count_char('statement', '!')} AS exclamation_count,
       {O.count_char('statement', '?')} AS question_count,
       {O.cap_ratio('statement')} AS capitalized_word_ratio
FROM raw WHERE statement IS NOT NULL""")

SQL["credit_features"] = O.with_ctes(O.RAW_CTE, f"""
, c AS (SELECT id, speaker, {", ".join(f"{O.coerce_count(c)} AS {c}" for c in CREDIT_COLUMNS)} FROM raw)
SELECT id, speaker, {", ".join(CREDIT_COLUMNS)},
       CASE WHEN ({_TOTAL}) = 0 THEN 0.0
            ELSE CAST(false_counts + pants_on_fire_counts AS DOUBLE) / ({_TOTAL}) END AS speaker_lie_rate,
       CAST({_TOTAL} AS BIGINT) AS speaker_total_statements
FROM c""")

SQL["keyword_flag"] = O.with_ctes(O.RAW_CTE, f"""
, c AS (SELECT id, {O.clean_categorical('context')} AS context FROM raw)
SELECT id, context, {O.political('context')} AS is_political_context,
       {O.political('context', DATA_KEYWORDS)} AS is_keyword_context
FROM c""")

SQL["missing_audit"] = O.with_ctes(O.RAW_CTE, f"""
SELECT split, count(*) AS rows_in,
       count(*) FILTER (WHERE statement IS NULL) AS rows_dropped,
       count(*) FILTER (WHERE statement IS NOT NULL) AS rows_out,
       {", ".join(
           f"count(*) FILTER (WHERE statement IS NOT NULL AND NOT coalesce(regexp_full_match({c}, '{O.NUMBER}') "
           f"AND abs(TRY_CAST(trim({c}) AS DOUBLE)) < 9223372036854775807, false)) AS {c}_filled" for c in CREDIT_COLUMNS)}
FROM raw GROUP BY split""")

SQL["unknown_label_audit"] = O.with_ctes(O.RAW_CTE, f"""
SELECT split, label, count(*) AS n_rows FROM raw
WHERE statement IS NOT NULL AND NOT coalesce(label IN {O.sql_list(O.BINARY_LABELS)}, false)
GROUP BY split, label""")

SQL["model_input"] = O.with_ctes(O.PROCESSED_CTE, f"""
SELECT id, statement_clean, label_binary, split FROM processed
WHERE split IN ('train', 'valid') AND statement_clean IS NOT NULL AND label_binary IS NOT NULL
  AND statement_clean NOT IN {O.NA_LIST_SQL}""")

# -- scoring and evaluation -------------------------------------------------

SQL["metrics"] = O.with_ctes(O.SCORED_CTE, "SELECT model, split, accuracy, f1, precision, recall, n_rows FROM macro")

SQL["classification_report"] = O.with_ctes(O.SCORED_CTE, """
SELECT model, split, CASE class_id WHEN 0 THEN 'Fake' WHEN 1 THEN 'Real' ELSE CAST(class_id AS VARCHAR) END AS row_label,
       precision, recall, f1, support FROM pcm
UNION ALL
SELECT model, split, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), accuracy, n_rows FROM macro
UNION ALL
SELECT model, split, 'macro avg', precision, recall, f1, n_rows FROM macro
UNION ALL
SELECT model, split, 'weighted avg',
       CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(precision * support) / sum(support) END,
       CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(recall * support) / sum(support) END,
       CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END,
       CAST(sum(support) AS BIGINT)
FROM pcm GROUP BY model, split""")

SQL["confusion_matrix"] = O.with_ctes(O.SCORED_CTE, """
, classes AS (SELECT model, split, true_label AS c FROM cm UNION SELECT model, split, predicted_label FROM cm),
grid AS (SELECT a.model, a.split, a.c AS true_label, b.c AS predicted_label
         FROM classes a JOIN classes b ON a.model = b.model AND a.split = b.split),
cells AS (SELECT g.model, g.split, g.true_label, g.predicted_label, CAST(coalesce(cm.n, 0) AS BIGINT) AS n
          FROM grid g LEFT JOIN cm ON g.model = cm.model AND g.split = cm.split
               AND g.true_label = cm.true_label AND g.predicted_label = cm.predicted_label)
SELECT *, CASE WHEN sum(n) OVER w = 0 THEN NULL ELSE n / sum(n) OVER w END AS row_share
FROM cells WINDOW w AS (PARTITION BY model, split, true_label)""")

SQL["error_table"] = O.with_ctes(O.SCORED_CTE, """
, errs AS (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY id_num) AS rn
           FROM pred WHERE y_true <> y_pred)
SELECT model, split, statement, CAST(y_true AS INTEGER) AS true_label, CAST(y_pred AS INTEGER) AS predicted_label,
       label, statement_len, speaker_lie_rate, party, speaker, context
FROM errs WHERE rn <= 20""")

SQL["error_type_counts"] = O.with_ctes(O.SCORED_CTE, """
SELECT model, split, count(*) AS n_rows, count(*) FILTER (WHERE y_true <> y_pred) AS n_errors,
       100.0 * avg(CAST(y_true <> y_pred AS DOUBLE)) AS error_pct,
       count(*) FILTER (WHERE y_true <> y_pred AND y_pred = 1) AS n_false_positive,
       count(*) FILTER (WHERE y_true <> y_pred AND y_pred = 0) AS n_false_negative
FROM pred GROUP BY model, split""")

_ERRS = """
, errs AS (SELECT *, CASE WHEN y_pred = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_type
           FROM pred WHERE y_true <> y_pred)"""

SQL["error_party_topk"] = O.with_ctes(O.SCORED_CTE, _ERRS + """
, c AS (SELECT model, split, error_type, party, count(*) AS n_errors FROM errs GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model, split, error_type
                                        ORDER BY n_errors DESC, party ASC) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 8""")

SQL["error_samples"] = O.with_ctes(O.SCORED_CTE, _ERRS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY model, split, error_type ORDER BY id_num) AS rn FROM errs)
SELECT model, split, error_type, statement, label, party, speaker_lie_rate FROM r WHERE rn <= 5""")

SQL["error_length_hist"] = O.with_ctes(O.SCORED_CTE, """
, h AS (SELECT model, split, CAST(y_true <> y_pred AS INTEGER) AS is_error,
               CAST(statement_len AS DOUBLE) AS x FROM pred),
st AS (SELECT model, split, is_error, count(x) AS n,
              CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
       FROM h GROUP BY ALL),
b AS (SELECT h.model, h.split, h.is_error,
             least(CAST(floor((h.x - st.lo) * 30 / (st.hi - st.lo)) AS INTEGER), 29) AS bin
      FROM h JOIN st ON h.model = st.model AND h.split = st.split AND h.is_error = st.is_error),
c AS (SELECT model, split, is_error, bin, count(*) AS cnt FROM b GROUP BY ALL),
g AS (SELECT st.*, CAST(unnest(range(30)) AS INTEGER) AS bin FROM st)
SELECT g.model, g.split, g.is_error, g.bin,
       g.lo + g.bin * ((g.hi - g.lo) / 30) AS bin_lo,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / 30) AS bin_hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
       coalesce(c.cnt, 0) / (g.n * ((g.hi - g.lo) / 30)) AS density
FROM g LEFT JOIN c ON g.model = c.model AND g.split = c.split AND g.is_error = c.is_error AND g.bin = c.bin""")

SQL["model_comparison"] = O.with_ctes(O.SCORED_CTE.replace(
    "FROM scored1\n)", "FROM scored1 WHERE split = 'test'\n)"), """
, mm AS (SELECT model, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1, avg(precision) AS precision,
                avg(recall) AS recall FROM pcm GROUP BY model)
SELECT model, printf('%.4f', accuracy) AS accuracy, printf('%.4f', f1) AS f1_macro,
       printf('%.4f', precision) AS precision_macro, printf('%.4f', recall) AS recall_macro FROM mm""")

SQL["prediction_shape"] = O.with_ctes(O.SCORED_CTE, """
SELECT model, id, pred_label, pred_label_id, pred_confidence, prob_fake, prob_real FROM pred""")

_BATCH_TEXT = "coalesce(statement, '')"
SQL["batch_score_rule"] = O.with_ctes(O.RAW_CTE, f"""
, s AS (SELECT id, {O.text_logit(O.cap_ratio(_BATCH_TEXT), O.word_count(O.clean_text(_BATCH_TEXT)))} AS z FROM raw),
s1 AS (SELECT id, {O._shape('z')} FROM s)
SELECT id, {O._flat()}, 'claimspark_rule_v1' AS version FROM s1""")
SQL["prediction_nested"] = O.with_ctes(O.RAW_CTE, f"""
, s AS (SELECT id, {O.text_logit(O.cap_ratio(_BATCH_TEXT), O.word_count(O.clean_text(_BATCH_TEXT)))} AS z FROM raw),
s1 AS (SELECT id, {O._shape('z')} FROM s),
s2 AS (SELECT id, {O._flat()} FROM s1)
SELECT id, pred_label AS label, pred_label_id AS label_id, pred_confidence AS confidence, prob_fake, prob_real,
       'claimspark_rule_v1' AS version FROM s2""")

# What SQL knows of a trained model's output: its rows, and what must hold of each.
SQL["batch_score_model"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {O.q(MODEL_VERSION)} AS version, true AS same_class, true AS same_probabilities,
       true AS shape_holds FROM documents"""
SQL["stream_score_model"] = f"SELECT doc_id, {O.q(MODEL_VERSION)} AS version, true AS equals_batch FROM documents"

# -- text features and folds --------------------------------------------------

SQL["tokens"] = O.with_ctes(O.DOCS_CTE, f"""
, t AS (SELECT id, {O.tokens('text')} AS t FROM docs)
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM t""")

SQL["ngrams"] = O.with_ctes(O.DOCS_CTE, f"""
, t AS (SELECT id, {O.tokens('text')} AS t FROM docs),
g AS (SELECT id, {O.ngrams2('t')} AS g FROM t)
SELECT id, CAST(len(g) AS INTEGER) AS n_ngrams, array_to_string(g, '|') AS ngrams FROM g""")

SQL["tfidf"] = O.with_ctes(O.DOCS_CTE + O.tf_ctes(1), f"""
SELECT tf.id, tf.term, tf.tf, dfq.df, round({O.idf_sql('dfq.df')}, 6) AS idf,
       round((1 + ln(tf.tf)) * {O.idf_sql('dfq.df')}, 6) AS weight
FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN nd""")

SQL["tfidf_normalized"] = O.with_ctes(O.DOCS_CTE + O.tf_ctes(2) + O.vocab_cte(VOCAB_SIZE), f"""
, w AS (SELECT tf.id, tf.term, v.idx, (1 + ln(tf.tf)) * {O.idf_sql('v.df')} AS w
        FROM tf JOIN vocab v ON tf.term = v.term CROSS JOIN nd)
SELECT id, term, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")

SQL["vocabulary_topk"] = O.with_ctes(O.DOCS_CTE + O.tf_ctes(2) + O.vocab_cte(VOCAB_SIZE), f"""
SELECT v.term, v.idx, v.df, v.corpus_tf, round({O.idf_sql('v.df')}, 6) AS idf FROM vocab v CROSS JOIN nd""")

SQL["stratified_folds"] = O.with_ctes(O.PROCESSED_CTE, f"""
, mi AS (SELECT id, label_binary, CAST(id AS BIGINT) AS id_num FROM processed
         WHERE split IN ('train', 'valid') AND statement_clean NOT IN {O.NA_LIST_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY label_binary ORDER BY id_num) - 1 AS r FROM mi),
sz AS (SELECT label_binary, count(*) AS nc FROM mi GROUP BY ALL),
st AS (SELECT label_binary, nc, coalesce(sum(nc) OVER (ORDER BY label_binary
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sz)
SELECT r.id, r.label_binary, {O.fold_sql(5)} AS fold FROM r JOIN st ON r.label_binary = st.label_binary""")

# -- models -------------------------------------------------------------------

_MODEL_ROWS = f"""processed WHERE statement_clean IS NOT NULL AND label_binary IS NOT NULL
  AND statement_clean NOT IN {O.NA_LIST_SQL}"""
SQL["lr_predict"] = O.with_ctes(O.PROCESSED_CTE, f"""
SELECT id, split, label_binary, true AS class_known, true AS score_agrees, true AS settled FROM {_MODEL_ROWS}""")
SQL["svm_predict"] = SQL["lr_predict"]
SQL["epoch_training"] = O.with_ctes(O.PROCESSED_CTE, f"""
SELECT id, split, label_binary, true AS class_known, true AS score_agrees, true AS restored FROM {_MODEL_ROWS} AND split = 'valid'""")

_GRID = ", ".join(f"({O.q(p.kind)}, {p.ngram_max}, {p.max_features}, {str(p.sublinear).lower()}, "
                  f"CAST({p.C} AS DOUBLE), {p.max_iter})" for p in GRIDS["lr"])
SQL["cv_results"] = O.with_ctes(O.PROCESSED_CTE, f"""
, mi AS (SELECT label_binary, CAST(id AS BIGINT) AS id_num FROM {_MODEL_ROWS} AND split IN ('train', 'valid')),
r AS (SELECT *, row_number() OVER (PARTITION BY label_binary ORDER BY id_num) - 1 AS r FROM mi),
sz AS (SELECT label_binary, count(*) AS nc FROM mi GROUP BY ALL),
st AS (SELECT label_binary, nc, coalesce(sum(nc) OVER (ORDER BY label_binary
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sz),
f AS (SELECT {O.fold_sql(QUERY_FOLDS)} AS fold, count(*) AS n FROM r JOIN st ON r.label_binary = st.label_binary GROUP BY ALL),
t AS (SELECT count(*) AS folds, sum(n) AS n, min(n) AS lo, max(n) AS hi FROM f),
g AS (SELECT * FROM (VALUES {_GRID}) AS v(model, ngram_max, max_features, sublinear, C, max_iter))
SELECT g.model, CAST(g.ngram_max AS INTEGER) AS ngram_max, CAST(g.max_features AS INTEGER) AS max_features, g.sublinear, g.C,
       CAST(g.max_iter AS INTEGER) AS max_iter, CAST(t.folds AS INTEGER) AS folds, CAST(t.n - t.hi AS BIGINT) AS n_train_min,
       CAST(t.n - t.lo AS BIGINT) AS n_train_max, CAST(t.n AS BIGINT) AS n_valid, true AS settled, true AS scores_valid,
       true AS rank_valid
FROM g CROSS JOIN t""")

SQL["experiment_summary"] = O.with_ctes(O.PROCESSED_CTE, f"""
, n AS (SELECT count(*) FILTER (WHERE split IN ('train', 'valid')) AS n_train, count(*) FILTER (WHERE split = 'test') AS n_rows
        FROM {_MODEL_ROWS})
SELECT m.model, CAST(m.c AS INTEGER) AS n_candidates, n.n_train, n.n_rows, true AS metrics_valid
FROM (VALUES ('TF-IDF + LR', {len(GRIDS["lr"])}), ('TF-IDF + SVM', {len(GRIDS["svm"])})) AS m(model, c) CROSS JOIN n""")

# -- evidence and fact-check batch -------------------------------------------

SQL["evidence_top1"] = O.with_ctes(O.EVIDENCE_CTE, "SELECT * FROM ev")

_STM = "coalesce(text, '')"
_FACT_CTES = O.EVIDENCE_CTE + f""",
s AS (SELECT item_id, text, {O.text_logit(O.cap_ratio(_STM), O.word_count(O.clean_text(_STM)))} AS z FROM benchmark),
s1 AS (SELECT item_id, text, {O._shape('z')} FROM s),
s2 AS (SELECT item_id, text, {O._flat()} FROM s1),
c AS (SELECT *, printf('Writing style: %s (confidence %.2f%%).', pred_label, pred_confidence * 100)
         AS classifier_evidence FROM s2)"""

SQL["evidence_prompt"] = O.with_ctes(_FACT_CTES, f"""
SELECT c.item_id, c.classifier_evidence, ev.evidence AS search_evidence,
       printf({O.q(__import__('claimspark.operators.evidence', fromlist=['x']).PROMPT_TEMPLATE)},
              c.text, c.classifier_evidence, ev.evidence) AS prompt
FROM c JOIN ev ON c.item_id = ev.item_id""")

SQL["fact_check"] = O.with_ctes(_FACT_CTES, f"""
, turns AS (SELECT conv_id, arg_min(text, turn) AS response FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.item_id, c.text AS statement, c.pred_label AS label, c.pred_confidence AS confidence, c.prob_real,
       ev.evidence AS search_evidence,
       printf({O.q(__import__('claimspark.operators.evidence', fromlist=['x']).PROMPT_TEMPLATE)},
              c.text, c.classifier_evidence, ev.evidence) AS prompt,
       turns.response,
       coalesce(nullif(upper(regexp_extract(coalesce(response, ''), '(?i)FINAL VERDICT:\\s*\\[?(TRUE|FALSE|UNVERIFIED)', 1)), ''),
                'UNVERIFIED') AS agent_decision
FROM c JOIN ev ON c.item_id = ev.item_id LEFT JOIN turns ON turns.conv_id = c.item_id""")

SQL["verdict_parse"] = f"""
SELECT conv_id, turn,
       CASE WHEN regexp_extract(coalesce(text, ''), '(?i)FINAL VERDICT:\\s*\\[?(TRUE|FALSE|UNVERIFIED)', 1) = ''
            THEN 'UNVERIFIED'
            ELSE upper(regexp_extract(coalesce(text, ''), '(?i)FINAL VERDICT:\\s*\\[?(TRUE|FALSE|UNVERIFIED)', 1))
       END AS verdict
FROM conversations WHERE role = 'assistant'"""

# -- learned sentence ends -----------------------------------------------------

_QUOTES = "'\"''()[]{}'"
_SENTENCES = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(w) AS word, unnest(list_concat(w[2:], [NULL])) AS nxt FROM t WHERE len(w) > 0),
b AS (SELECT *, trim(word, {_QUOTES}) AS bare,
             rtrim(translate(trim(word, {_QUOTES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ',;:!?') AS base FROM p),
c AS (SELECT *, rtrim(base, '.') AS type, ends_with(base, '.') AS period,
             coalesce(regexp_matches(trim(nxt, {_QUOTES}), '^\\p{{Ll}}'), false) AS lower FROM b),
n AS (SELECT type, count(*) FILTER (period) AS n_period, count(*) FILTER (NOT period) AS n_plain,
             count(*) FILTER (period AND lower) AS n_lower FROM c WHERE type <> '' GROUP BY type),
s AS (SELECT least(greatest(sum(n_period) / greatest(sum(n_period) + sum(n_plain), 1), 1e-9), 1 - 1e-9) AS share FROM n),
m AS (SELECT n.*, length(type) - length(replace(type, '.', '')) AS dots,
             2 * (n_period * (ln(0.99) - ln(share)) + n_plain * (ln(1 - 0.99::DOUBLE) - ln(1 - share))) AS ratio FROM n CROSS JOIN s),
l AS (SELECT *, CASE WHEN n_period = 0 OR length(type) = dots THEN 0.0
                     ELSE ratio * exp(-(length(type) - dots)::DOUBLE) * (dots + 1) * exp(-n_plain * ln(greatest(length(type) - dots, 1))) END AS score FROM m),
a AS (SELECT type, n_period, n_plain, n_lower, round(score, 4) + 0.0 AS score,  -- no negative zero
             score >= 0.3 OR (n_lower >= 5 AND 2 * n_lower > n_period) AS abbreviation FROM l)"""
SQL["sentence_abbreviations"] = _SENTENCES + " SELECT * FROM a WHERE n_period > 0"
SQL["sentence_counts"] = _SENTENCES + """,
e AS (SELECT doc_id, nxt, coalesce(right(bare, 1) IN ('!', '?') OR (right(bare, 1) = '.' AND NOT coalesce(a.abbreviation, false)
                          AND NOT regexp_matches(c.type, '^\\p{L}$')), false) AS ends
      FROM c LEFT JOIN a ON c.type = a.type),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (ends OR nxt IS NULL) AS n_sentences FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""

# -- sequences and streaming ----------------------------------------------------

SQL["sequence_encode"] = O.with_ctes(O.DOCS_CTE + O.tf_ctes(1) + O.vocab_cte(VOCAB_SIZE), f"""
, t AS (SELECT id, {O.tokens('text')} AS t FROM docs),
p AS (SELECT id, unnest(t[1:126]) AS term, generate_subscripts(t[1:126], 1) AS pos FROM t),
ids AS (SELECT p.id, list(CAST(coalesce(v.idx + 4, 3) AS INTEGER) ORDER BY p.pos) AS ids
        FROM p LEFT JOIN vocab v ON p.term = v.term GROUP BY p.id),
b AS (SELECT t.id, len(t.t) AS n_tokens, list_concat([0], coalesce(ids.ids, []), [2]) AS body
      FROM t LEFT JOIN ids ON t.id = ids.id)
SELECT id,
       array_to_string(list_concat(body, list_transform(range(128 - len(body)), lambda i: 1)), ' ') AS input_ids,
       array_to_string(list_concat(list_transform(range(len(body)), lambda i: 1),
                                   list_transform(range(128 - len(body)), lambda i: 0)), '') AS attention_mask,
       CAST(n_tokens AS INTEGER) AS n_tokens
FROM b""")

SQL["stream_score"] = f"""
WITH s AS (SELECT doc_id, {O.text_logit(O.cap_ratio(_BATCH_TEXT.replace('statement', 'text')),
                                        O.word_count(O.clean_text(_BATCH_TEXT.replace('statement', 'text'))))} AS z
           FROM documents),
s1 AS (SELECT doc_id, {O._shape('z')} FROM s)
SELECT doc_id, {O._flat()}, 'claimspark_rule_v1' AS version FROM s1"""
