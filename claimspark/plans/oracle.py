"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each query is a chain of CTEs over the driver tables. The fragments below are
written independently in SQL; they are checked against the Spark queries at
sf0.01 by the driver and by scripts/oracle_check.py.
"""

from __future__ import annotations

from claimspark.schema import (
    BINARY_LABELS,
    CREDIT_COLUMNS,
    NA_STRINGS,
    ORDINAL_LABELS,
    POLITICAL_KEYWORDS,
    WS_CLASS_RE2,
)
from claimspark.sources.adapter import COUNT_LABEL, FAKE_LABELS_BY_MOD, REAL_LABELS_BY_MOD

W = WS_CLASS_RE2
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def clean_text(x: str) -> str:
    trimmed = f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"
    collapsed = f"regexp_replace({trimmed}, '{W}+', ' ', 'g')"
    ascii_only = f"regexp_replace({collapsed}, '[^\\x00-\\x7F]+', ' ', 'g')"
    return f"coalesce(lower({ascii_only}), '')"


def clean_categorical(x: str, fill: str = "unknown") -> str:
    s = f"lower(regexp_replace(coalesce({x}, {q(fill)}), '^{W}+|{W}+$', '', 'g'))"
    return f"(CASE WHEN {s} = '' THEN {q(fill)} ELSE {s} END)"


def coerce_count(x: str) -> str:
    d = f"TRY_CAST(trim({x}) AS DOUBLE)"
    parsed = f"(CASE WHEN regexp_full_match({x}, '{NUMBER}') AND abs({d}) < 9223372036854775807 THEN {d} END)"
    return f"CAST(trunc(coalesce({parsed}, 0.0)) AS BIGINT)"


def word_count(x: str) -> str:
    return f"CAST(len(list_filter(string_split({x}, ' '), lambda w: w <> '')) AS INTEGER)"


def count_char(x: str, ch: str) -> str:
    return f"CAST(strlen({x}) - strlen(replace({x}, {q(ch)}, '')) AS INTEGER)"


def cap_ratio(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({x}, '{W}+'), lambda w: w <> '')"
    upper = (f"len(list_filter({words}, lambda w: regexp_matches(w, '\\p{{Lu}}') "
             f"AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]') AND length(w) > 1))")
    return f"(CASE WHEN coalesce(len({words}), 0) = 0 THEN 0.0 ELSE {upper} / len({words}) END)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '\\b\\w\\w+\\b')"


def label_case(mapping: dict, x: str = "label") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in mapping.items())
    return f"CAST(CASE {x} {whens} END AS INTEGER)"


def political(x: str = "context", keywords=POLITICAL_KEYWORDS) -> str:
    ors = " OR ".join(f"contains({x}, {q(k)})" for k in keywords)
    return f"CAST(CASE WHEN {ors} THEN 1 ELSE 0 END AS INTEGER)"


# -- adapter: raw claims ----------------------------------------------------

def _arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


RAW_CTE = f"""
base AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
         CASE l.quality WHEN 0 THEN {_arr(FAKE_LABELS_BY_MOD)}[d.doc_id % 3 + 1]
                        WHEN 1 THEN {_arr(REAL_LABELS_BY_MOD)}[d.doc_id % 3 + 1] END AS label,
         CASE WHEN ((d.doc_id // 20) + d.doc_id) % 10 <= 7 THEN 'train'
              WHEN ((d.doc_id // 20) + d.doc_id) % 10 = 8 THEN 'valid' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
hist AS (
  SELECT source, {", ".join(f"count(*) FILTER (WHERE label = {q(lab)}) AS {c}" for c, lab in COUNT_LABEL.items())}
  FROM base GROUP BY source
),
raw AS (
  SELECT CAST(b.doc_id AS VARCHAR) AS id, b.label, b.text AS statement,
         ' ' || upper(b.lang) || ' ' AS subject, b.source AS speaker,
         CAST(NULL AS VARCHAR) AS speaker_job, CAST(NULL AS VARCHAR) AS state_info,
         b.lang AS party,
         {", ".join(f"CAST(coalesce(h.{c}, 0) AS VARCHAR) AS {c}" for c in COUNT_LABEL)},
         b.lang || ' ' || b.source AS context, b.split
  FROM base b LEFT JOIN hist h ON b.source = h.source
)"""

_CATS = ["subject", "speaker", "speaker_job", "state_info", "party"]
_TOTAL = " + ".join(CREDIT_COLUMNS)

PROCESSED_CTE = RAW_CTE + f""",
prepared AS (
  SELECT id, label, statement,
         {", ".join(f"{clean_categorical(c)} AS {c}" for c in _CATS)},
         {", ".join(f"{coerce_count(c)} AS {c}" for c in CREDIT_COLUMNS)},
         {clean_categorical("context")} AS context, split
  FROM raw
  WHERE statement IS NOT NULL AND label IN {sql_list(BINARY_LABELS)}
),
processed AS (
  SELECT *,
         {label_case(BINARY_LABELS)} AS label_binary,
         {label_case(ORDINAL_LABELS)} AS label_ordinal,
         {clean_text("statement")} AS statement_clean,
         {word_count(clean_text("statement"))} AS statement_len,
         CAST(length({clean_text("statement")}) AS INTEGER) AS statement_char_len,
         {count_char("statement", "!")} AS exclamation_count,
         {count_char("statement", "?")} AS question_count,
         {cap_ratio("statement")} AS capitalized_word_ratio,
         CASE WHEN ({_TOTAL}) = 0 THEN 0.0
              ELSE CAST(false_counts + pants_on_fire_counts AS DOUBLE) / ({_TOTAL}) END AS speaker_lie_rate,
         CAST({_TOTAL} AS BIGINT) AS speaker_total_statements,
         {political()} AS is_political_context
  FROM prepared
)"""

NA_LIST_SQL = sql_list(NA_STRINGS)


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# -- scoring and evaluation -------------------------------------------------

def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _shape(logit: str) -> str:
    """Columns p0, p1 of the two-class softmax with FAKE logit 0."""
    m = f"greatest(CAST(0 AS DOUBLE), {logit})"
    e0, e1 = f"exp(CAST(0 AS DOUBLE) - {m})", f"exp({logit} - {m})"
    return f"{e0} / ({e0} + {e1}) AS p0, {e1} / ({e0} + {e1}) AS p1"


def _flat() -> str:
    return ("CASE WHEN p1 > p0 THEN 'REAL' ELSE 'FAKE' END AS pred_label, "
            "CAST(CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS INTEGER) AS pred_label_id, "
            "round(greatest(p0, p1), 4) AS pred_confidence, round(p0, 4) AS prob_fake, "
            "round(p1, 4) AS prob_real")


def text_logit(cap: str, length: str) -> str:
    from claimspark.operators.scoring import TEXT_RULE as R
    return (f"{dbl(R['bias'])} + {dbl(R['capitalized_word_ratio'])} * {cap} "
            f"+ {dbl(R['statement_len'])} * {length}")


def credit_logit(rate: str) -> str:
    from claimspark.operators.scoring import CREDIT_RULE as R
    return f"{dbl(R['bias'])} + {dbl(R['speaker_lie_rate'])} * {rate}"


SCORED_CTE = PROCESSED_CTE + f""",
scored0 AS (
  SELECT *, 'rule_text' AS model, {text_logit('capitalized_word_ratio', 'statement_len')} AS logit_real
  FROM processed
  UNION ALL
  SELECT *, 'rule_credit' AS model, {credit_logit('speaker_lie_rate')} AS logit_real FROM processed
),
scored1 AS (SELECT *, {_shape('logit_real')} FROM scored0),
pred AS (
  SELECT *, {_flat()}, label_binary AS y_true, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS y_pred,
         CAST(id AS BIGINT) AS id_num
  FROM scored1
),
cm AS (SELECT model, split, CAST(y_true AS INTEGER) AS true_label, CAST(y_pred AS INTEGER) AS predicted_label,
              count(*) AS n FROM pred GROUP BY ALL),
sides AS (
  SELECT model, split, true_label AS class_id, n AS support, 0 AS predicted,
         CASE WHEN true_label = predicted_label THEN n ELSE 0 END AS tp FROM cm
  UNION ALL
  SELECT model, split, predicted_label, 0, n, 0 FROM cm
),
pc AS (
  SELECT model, split, class_id, CAST(sum(support) AS BIGINT) AS support,
         CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp
  FROM sides GROUP BY ALL
),
pcm AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
         CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1
  FROM pc
),
macro AS (
  SELECT model, split, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1, avg(precision) AS precision,
         avg(recall) AS recall, CAST(sum(support) AS BIGINT) AS n_rows
  FROM pcm GROUP BY ALL
)"""


# -- text features -----------------------------------------------------------

DOCS_CTE = RAW_CTE + f""",
docs AS (SELECT id, {clean_text('statement')} AS text FROM raw)"""


def ngrams2(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def tf_ctes(ngram_max: int) -> str:
    terms = tokens("text") if ngram_max == 1 else ngrams2("t")
    src = "docs" if ngram_max == 1 else f"(SELECT id, {tokens('text')} AS t FROM docs)"
    return f""",
toks AS (SELECT id, unnest({terms}) AS term FROM {src}),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf FROM tf GROUP BY term),
nd AS (SELECT count(*) AS n FROM docs)"""


def idf_sql(df: str) -> str:
    return f"(ln((1 + nd.n) / (1 + {df})) + 1)"


def vocab_cte(k: int) -> str:
    return f""",
vocab AS (
  SELECT term, df, corpus_tf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx
  FROM (SELECT * FROM dfq ORDER BY corpus_tf DESC, term ASC LIMIT {k})
)"""


def fold_sql(k: int, r: str = "r", start: str = "s", n: str = "nc") -> str:
    def upto(x, i):
        return f"greatest(0, floor(({x} - 1 - {i}) / {k}) + 1)"
    cums, terms = [], []
    for i in range(k):
        terms.append(f"({upto(f'({start} + {n})', i)} - {upto(start, i)})")
        cums.append(" + ".join(terms))
    return "CAST(" + " + ".join(f"(CASE WHEN {c} <= {r} THEN 1 ELSE 0 END)" for c in cums) + " AS INTEGER)"


# -- evidence ----------------------------------------------------------------

def first_sentences(x: str, n: int = 3) -> str:
    # a mark (chr 1) after every end mark that white space follows, then a split at the marks
    marked = f"regexp_replace({x}, '([.!?])([\\s\\x0B])', '\\1' || chr(1) || '\\2', 'g')"
    parts = f"list_filter(string_split({marked}, chr(1)), lambda s: regexp_matches(s, '[^\\s\\x0B]'))"
    return f"regexp_replace(array_to_string(list_slice({parts}, 1, {n}), ''), '^{W}+|{W}+$', '', 'g')"


def _vec(src: str, key: str, prefix: str) -> str:
    return f""",
{prefix}c AS (SELECT {key} AS k, {clean_text('text')} AS t FROM {src}),
{prefix}tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({tokens('t')}) AS term FROM {prefix}c) GROUP BY ALL)"""


EVIDENCE_CTE = "nd AS (SELECT count(*) AS n FROM documents)" + _vec("documents", "doc_id", "d") + \
    _vec("benchmark", "item_id", "q") + f""",
terms AS (SELECT term, count(*) AS df FROM dtf GROUP BY term),
dw0 AS (SELECT dtf.k, dtf.term, (1 + ln(dtf.tf)) * {idf_sql('terms.df')} AS w
        FROM dtf JOIN terms ON dtf.term = terms.term CROSS JOIN nd),
dw AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM dw0),
qw0 AS (SELECT qtf.k, qtf.term, (1 + ln(qtf.tf)) * {idf_sql('terms.df')} AS w
        FROM qtf JOIN terms ON qtf.term = terms.term CROSS JOIN nd),
qw AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM qw0),
sc AS (SELECT qw.k AS q, dw.k AS doc, round(sum(qw.w * dw.w), 9) AS r
       FROM qw JOIN dw ON qw.term = dw.term GROUP BY qw.k, dw.k),
top AS (SELECT q, max(r) AS r FROM sc GROUP BY q),
tied AS (SELECT sc.* FROM sc JOIN top ON sc.q = top.q AND sc.r = top.r),
summ AS (SELECT q, count(*) AS n_best, min(doc) AS first_doc, max(r) AS best_score,
                list_slice(list_sort(list(doc)), 1, 3) AS shown FROM tied GROUP BY q),
ev AS (
  SELECT b.item_id, CASE WHEN s.n_best = 1 THEN s.first_doc END AS best_doc_id,
         round(s.best_score, 6) AS best_score, CAST(coalesce(s.n_best, 0) AS BIGINT) AS n_best,
         CASE WHEN s.n_best IS NULL THEN {q('No search results found.')}
              WHEN s.n_best > 1 THEN {q('Search is too ambiguous. Possible matches: ')} || '['
                   || array_to_string(list_transform(s.shown, lambda x: CAST(x AS VARCHAR)), ', ') || ']'
              ELSE {first_sentences('d.text')} END AS evidence
  FROM benchmark b LEFT JOIN summ s ON b.item_id = s.q LEFT JOIN documents d ON d.doc_id = s.first_doc
)"""
