"""SQL twins of ``fixtures``: common table expressions for the reference queries."""

from __future__ import annotations

from ..constants import EMOJI_PATTERN, ENGLISH_STOP_WORDS
from .fixtures import CV_TRIALS, NOISE, SUFFIXES

SPACE = r"[\t\n\x0B\f\r ]"
NON_SPACE = r"[^\t\n\x0B\f\r ]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def u(seed: int, key: str = "doc_id") -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def replace_all(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"


_STOPS = ", ".join(quoted(w) for w in ENGLISH_STOP_WORDS)
STOP_LIST, STOP_ARRAY = f"({_STOPS})", f"[{_STOPS}]"


def strip_emoji(text: str) -> str:
    return replace_all(text, EMOJI_PATTERN)


def strip_links(text: str) -> str:
    links = "|".join(p + NON_SPACE + "+" for p in ("https?://", r"www\.", r"\.com", r"youtu\.be/"))
    return replace_all(replace_all(text, links), r"(@|#)\w+")


def strip_urls_mentions(text: str) -> str:
    return replace_all(strip_links(text), "<unk>")


def normalize_alpha(text: str) -> str:
    lowered = replace_all(f"lower({text})", r"\d+")
    letters = replace_all(lowered, r"[^a-zA-Z\t\n\x0B\f\r ]")
    return replace_all(letters, SPACE + "+", " ")


def drop_stop_words(text: str) -> str:
    kept = f"[w for w in string_split({text}, ' ') if w <> '' AND w NOT IN {STOP_LIST}]"
    return f"CASE WHEN {text} <> '' THEN array_to_string({kept}, ' ') END"


def clean_select(source: str, text: str, columns: str) -> str:
    """Cleaned ``text`` next to ``columns``, in two levels so that the chain is written once."""
    chain = normalize_alpha(strip_urls_mentions(strip_emoji(text)))
    return f"SELECT {columns}, {drop_stop_words('_t')} AS text FROM (SELECT *, {chain} AS _t FROM {source})"


def words_of(text: str = "text") -> str:
    return f"[w for w in regexp_split_to_array({text}, {quoted(SPACE + '+')}) if w <> '']"


LABELED = """labeled AS (
  SELECT d.doc_id, d.source AS product, d.lang, d.n_chars, d.text AS body,
         CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS name
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

DIRTY = f"""{LABELED}, dirty AS (
  SELECT doc_id, product, lang,
         CASE WHEN {u(1)} < 0.05 THEN 'Irrelevant' WHEN {u(1)} < 0.08 THEN 'Other'
              WHEN {u(1)} < 0.10 THEN '' ELSE name END AS name,
         CASE WHEN {u(2)} < 0.03 THEN NULL WHEN {u(2)} < 0.05 THEN '   ' ELSE body END AS body
  FROM labeled)"""

ENCODE = "CASE name WHEN 'Negative' THEN 0 WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Irrelevant' THEN 3 END"

PREPROCESSED = f"""{DIRTY}, cleaned AS (
  {clean_select("(SELECT doc_id, body, " + ENCODE + " AS label FROM dirty WHERE trim(body) <> '' AND trim(name) <> '')", "body", "doc_id, label")}
), preprocessed AS (SELECT doc_id, label, text FROM cleaned WHERE label IS NOT NULL AND length(text) > 0)"""

NOISY = "noisy AS (SELECT doc_id, text || ' ' || CASE floor(" + u(9) + f" * {len(NOISE) + 1}) " + " ".join(
    f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(NOISE)
) + " ELSE '' END AS body FROM documents)"

CLEAN_DOCS = f"clean_docs AS (SELECT * FROM ({clean_select('documents', 'text', 'doc_id')}) WHERE length(text) > 0)"

DOC_WORDS = f"""{CLEAN_DOCS}, doc_words AS (
  SELECT doc_id, [w for w in string_split(text, ' ') if w NOT IN {STOP_LIST}] AS words FROM clean_docs),
words AS (SELECT doc_id, unnest(words) AS term FROM doc_words)"""

PREDICTIONS = f"""{LABELED}, coded AS (SELECT *, {ENCODE} AS label FROM labeled),
predictions AS (
  SELECT doc_id, product, lang, n_chars, body, label,
         CASE WHEN {u(3)} < 0.8 THEN label ELSE (label + 1) % 3 END AS prediction,
         0.34::DOUBLE + 0.66::DOUBLE * {u(6)} AS confidence
  FROM coded),
predictions_new AS (
  SELECT doc_id, product, lang, n_chars, body, label,
         CASE WHEN {u(4)} < 0.65 THEN label ELSE (label + 1) % 3 END AS prediction
  FROM coded)"""


def evaluation(source: str, by: str = "", name: str = "ev") -> str:
    """CTEs ``<name>_cls`` (per class) and ``<name>`` (weighted and macro figures) per group of ``by``."""
    keys = [k for k in by.split(", ") if k]
    cols = "".join(f"{k}, " for k in keys)
    on = "".join(f" AND x.{k} = a.{k}" for k in keys)
    group = f"GROUP BY {by}" if keys else ""
    return f"""{name}_all AS (
  SELECT DISTINCT {cols}label AS class FROM {source} UNION SELECT DISTINCT {cols}prediction FROM {source}),
{name}_cnt AS (
  SELECT {cols}class,
    (SELECT count(*) FROM {source} x WHERE x.label = a.class{on}) AS support,
    (SELECT count(*) FROM {source} x WHERE x.prediction = a.class{on}) AS predicted,
    (SELECT count(*) FROM {source} x WHERE x.label = a.class AND x.prediction = a.class{on}) AS tp
  FROM {name}_all a),
{name}_pr AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS recall FROM {name}_cnt),
{name}_cls AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
    ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM {name}_pr),
{name} AS (
  SELECT {cols}sum(tp)::DOUBLE / sum(support) AS accuracy,
    sum(precision * support) / sum(support) AS precision,
    sum(recall * support) / sum(support) AS recall,
    sum(f1 * support) / sum(support) AS f1,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1
  FROM {name}_cls {group})"""


CV = f"""{PREDICTIONS}, guesses AS (
""" + " UNION ALL ".join(
    f"""SELECT {trial} AS trial, floor({u(42)} * 3)::INT AS fold, label,
    CASE WHEN {u(seed)} < {rate} THEN label ELSE (label + 1) % 3 END AS prediction FROM predictions"""
    for trial, seed, rate in CV_TRIALS
) + "), " + evaluation("guesses", "trial, fold", "trials")


def psi(ref: str, cur: str, column: str, name: str, text: bool) -> str:
    """CTE ``<name>`` with the stability index of one column of two relations."""
    if text:
        bins = f"""{name}_bins AS (SELECT DISTINCT k FROM (
  SELECT {column}::VARCHAR AS k FROM {ref} UNION ALL SELECT {column}::VARCHAR FROM {cur}) WHERE k IS NOT NULL)"""
        key = f"{column}::VARCHAR"
        prelude = ""
    else:
        prelude = f"""{name}_s AS (
  SELECT min(v) AS lo, max(v) AS hi, ceil(log2(count(v)) + 1)::INT AS bins
  FROM (SELECT {column}::DOUBLE AS v FROM {ref} UNION ALL SELECT {column}::DOUBLE FROM {cur})),
"""
        bins = f"{name}_bins AS (SELECT unnest(range(bins))::INT AS k FROM {name}_s)"
        key = (
            f"least(floor(({column}::DOUBLE - (SELECT lo FROM {name}_s)) / "
            f"((SELECT hi - lo FROM {name}_s) / (SELECT bins FROM {name}_s))), (SELECT bins - 1 FROM {name}_s))::INT"
        )
    fill = "CASE WHEN {0} = 0 THEN CASE WHEN min(nullif({0}, 0)) OVER () <= 0.0001 THEN min(nullif({0}, 0)) OVER () / 1e6 ELSE 0.0001 END ELSE {0} END"
    return f"""{prelude}{bins},
{name}_r AS (SELECT {key} AS k, count(*) AS n FROM {ref} WHERE {column} IS NOT NULL GROUP BY 1),
{name}_c AS (SELECT {key} AS k, count(*) AS n FROM {cur} WHERE {column} IS NOT NULL GROUP BY 1),
{name}_p AS (
  SELECT coalesce(r.n, 0)::DOUBLE / sum(r.n) OVER () AS r, coalesce(c.n, 0)::DOUBLE / sum(c.n) OVER () AS c
  FROM {name}_bins b LEFT JOIN {name}_r r ON b.k = r.k LEFT JOIN {name}_c c ON b.k = c.k),
{name}_f AS (SELECT {fill.format('r')} AS r, {fill.format('c')} AS c FROM {name}_p),
{name} AS (SELECT sum((r - c) * ln(r / c)) AS psi FROM {name}_f)"""


def score(seed: int) -> str:
    return f"'0.' || lpad(floor({u(seed)} * 10000)::BIGINT::VARCHAR, 4, '0')"


ANNOTATIONS = f"""forms AS (
  SELECT doc_id, floor({u(20)} * 13)::INT AS pick, {score(21)} AS a, {score(22)} AS b, {score(23)} AS c FROM documents),
annotations AS (SELECT doc_id, CASE pick
  WHEN 0 THEN '[Row(annotatorType=''category'', result=''1'', metadata={{''0'': ''' || a || ''', ''1'': ''' || b || ''', ''sentence'': ''7'', ''2'': ''' || c || '''}}, embeddings=[])]'
  WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'no meta' WHEN 4 THEN 'metadata={{''sentence'': ''0''}}'
  WHEN 5 THEN 'metadata={{''0'': ''' || a || ''', ''1'': ''' || b || ''''
  WHEN 6 THEN 'metadata={{''0'': ''' || a || '''}} metadata={{''0'': ''0.99''}}'
  WHEN 7 THEN 'metadata={{''0'': ' || a || ', ''1'': ' || b || '}}'
  WHEN 8 THEN 'metadata={{''0'': ''abc'', ''1'': ''' || b || '''}}'
  WHEN 9 THEN 'metadata={{"0": "' || c || '"}}' WHEN 10 THEN 'metadata= {{''0'': ''' || a || '''}}'
  WHEN 11 THEN 'metadata={{''0'': ''' || a || ''', ''more'': {{''1'': ''0.99''}}, ''2'': ''' || b || '''}}'
  WHEN 12 THEN 'metadata={{''0'': ''' || a || 'd'', ''1'': ''' || c || '''}}' END AS category, pick, a, b, c FROM forms)"""

LEMMAS = f"""bench_clean AS ({clean_select('benchmark', 'text', 'item_id')}),
bench_words AS (SELECT DISTINCT unnest({words_of()}) AS form FROM bench_clean),
lemmas AS (SELECT form, lemma FROM (SELECT form, CASE """ + " ".join(
    f"WHEN form LIKE '%{s}' AND length(form) >= {len(s) + 3} THEN substr(form, 1, length(form) - {len(s)})" for s in SUFFIXES
) + " END AS lemma FROM bench_words) WHERE lemma IS NOT NULL)"

HASHED = f"""{CLEAN_DOCS},
slots AS (SELECT count(*) + floor(count(*) / 8)::BIGINT AS slots FROM embeddings),
positions AS (SELECT doc_id, unnest({words_of()}) AS term FROM clean_docs),
hashed AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT slots FROM slots) AS bucket FROM positions)"""

VERSIONS = """versions AS (
  SELECT 'model_' || user_id AS name, event_id AS version,
    CASE event_type WHEN 'purchase' THEN 'Production' WHEN 'view' THEN 'Staging' WHEN 'click' THEN 'Archived' END AS stage,
    md5(event_id::VARCHAR) AS run_id, ts AS last_updated_timestamp,
    CASE WHEN event_type <> 'error' THEN value / (value + 2) END AS accuracy, event_type AS kind
  FROM events)"""

OBJECTS = f"""objects AS (
  SELECT 'u' || user_id || '/' || event_type || '.csv' AS key, 'v' || event_id AS version_id,
    event_id = max(event_id) OVER (PARTITION BY user_id, event_type) AS is_latest, value < 5 AS is_delete_marker
  FROM events),
requests AS (
  SELECT c_custkey, CASE WHEN uu < 0.3 THEN 's3' WHEN uu < 0.6 THEN 's3a' WHEN uu < 0.8 THEN 's3n' ELSE 'https' END AS scheme,
    'u' || c_custkey || '/' || CASE WHEN uu < 0.5 THEN 'click.csv' WHEN uu < 0.9 THEN 'view.csv' ELSE 'view.csv.bak' END AS key
  FROM (SELECT c_custkey, {u(31, 'c_custkey')} AS uu FROM customer))"""
