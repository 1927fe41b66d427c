"""The queries in SQL. Written on their own: windows and joins over whole tables, as the semantics
read, not as the Spark jobs run."""

from __future__ import annotations

from postscreen.bindings.queries import LABEL, MIXED, SMILE, SPACES
from postscreen.functions.text import EMOJI_RANGES, NA_VALUES, WHITE_SPACE, regex_class
from postscreen.operators.features import FIRST_ID


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = regex_class(WHITE_SPACE)
_EMOJI = (
    "[0-9#*]\\x{FE0F}?\\x{20E3}(?:[\\x{FE0E}\\x{FE0F}]?\\x{200D})?"
    "|[\\x{1F1E6}-\\x{1F1FF}]{2}(?:[\\x{FE0E}\\x{FE0F}]?\\x{200D})?"
    f"|[{regex_class(EMOJI_RANGES)}](?:[\\x{{E0020}}-\\x{{E007E}}]+\\x{{E007F}})?"
    "(?:[\\x{FE0E}\\x{FE0F}]?\\x{200D})?"
    "|[\\x{FE0E}\\x{FE0F}]"
)
_NA = ", ".join(_text(v) for v in NA_VALUES)


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _no_emoji(column: str) -> str:
    return f"regexp_replace({column}, '{_EMOJI}', '', 'g')"


def _number(column: str, digits: int = 8) -> str:
    return f"('0x' || substr(md5({column}), 1, {digits}))::BIGINT"


def _text_sums(source: str, by: str) -> str:
    return (
        f"SELECT {by}, count(*) AS rows, sum({_number('text')})::BIGINT AS text_sum "
        f"FROM {source} GROUP BY {by}"
    )


_HASH = "md5('42:' || doc_id)"
_IS_VAL = f"substr({_HASH}, 1, 8) < '33333333'"

_POSTS_ALL = f"""posts_all AS (
  SELECT d.*, l.quality, l.toxic AS {LABEL} FROM documents d LEFT JOIN labels l USING (doc_id))"""
_LABELLED = f"""labelled AS (
  SELECT d.*, l.quality, l.toxic AS {LABEL} FROM documents d JOIN labels l USING (doc_id))"""
_SCORED = f"""{_LABELLED}, scored AS (
  SELECT *, 1 - quality AS pred, 0.1 + 0.8 * (1 - quality) AS p1 FROM labelled)"""
_DIRTY = f"""dirty AS (
  SELECT doc_id, lang, source,
    CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN {_text(SPACES)} WHEN 2 THEN {_text(SMILE)}
      WHEN 3 THEN text || {_text(" " + SMILE)} ELSE text END AS text,
    CASE doc_id % 7 WHEN 0 THEN ' 1 ' WHEN 1 THEN '1.0' WHEN 2 THEN NULL WHEN 3 THEN 'maybe'
      ELSE '0' END AS {LABEL}
  FROM documents)"""
_VALID = f"coalesce({_strip(LABEL)} IN ('0', '1'), false)"


def _first(source: str, order: str = "doc_id", key: str = "text") -> str:
    return (
        f"SELECT * FROM {source} "
        f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
    )


def _cells(source: str, by: str = "") -> str:
    return f"""SELECT {by}
      count(*) FILTER ({LABEL} = 0 AND pred = 0) AS tn,
      count(*) FILTER ({LABEL} = 0 AND pred = 1) AS fp,
      count(*) FILTER ({LABEL} = 1 AND pred = 0) AS fn,
      count(*) FILTER ({LABEL} = 1 AND pred = 1) AS tp
    FROM {source}"""


def _metrics(cells: str, by: str = "") -> str:
    return f"""SELECT {by}
      round(coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0.0), 4) AS accuracy,
      round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1,
      tn, fp, fn, tp
    FROM {cells}"""


def _tokens(fold: bool = True) -> str:
    return f"regexp_extract_all({'lower(text)' if fold else 'text'}, '[\\p{{L}}]+')"


# Naive Bayes: words per class, log-odds per token, margin per post.
def _bayes(name: str, train: str, scored: str, fold: bool = True, keep: str = "") -> str:
    return f"""{name}_words AS (
      SELECT {LABEL}, unnest({_tokens(fold)}) AS token FROM {train}),
    {name}_counts AS (
      SELECT token, count(*) AS n, count(*) FILTER ({LABEL} = 0) AS n0,
        count(*) FILTER ({LABEL} = 1) AS n1
      FROM {name}_words GROUP BY token),
    {name}_totals AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM {name}_counts),
    {name}_prior AS (
      SELECT ln(count(*) FILTER ({LABEL} = 1) / count(*) FILTER ({LABEL} = 0)) AS prior
      FROM {train}),
    {name}_weights AS (
      SELECT token, n, ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)) AS w
      FROM {name}_counts, {name}_totals),
    {name}_sums AS (
      SELECT doc_id, sum(w) AS s
      FROM (SELECT doc_id, unnest({_tokens(fold)}) AS token FROM {scored})
      JOIN {name}_weights USING (token) GROUP BY doc_id),
    {name}_scores AS (
      SELECT d.doc_id, {keep} round(coalesce(s, 0) + prior, 9) AS margin,
        1 / (1 + exp(-round(coalesce(s, 0) + prior, 9))) AS p1,
        (round(coalesce(s, 0) + prior, 9) > 0)::INTEGER AS pred
      FROM {scored} d LEFT JOIN {name}_sums USING (doc_id), {name}_prior)"""


_TRAIN = f"{_LABELLED}, train AS (SELECT * FROM labelled WHERE NOT ({_IS_VAL}))"
_VOCAB = f"""words AS (SELECT unnest({_tokens()}) AS token FROM train),
  ranked AS (
    SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS r
    FROM words GROUP BY token),
  vocab AS (SELECT token, (r + {FIRST_ID - 1})::INTEGER AS id FROM ranked
    WHERE r <= 30522 - {FIRST_ID})"""

_OUT_OF_FOLD = f"""{_LABELLED},
  folded AS (
    SELECT doc_id, text, {LABEL}, {_number("'42:fold:' || doc_id")} % 5 AS fold FROM labelled),
  words AS (SELECT fold, {LABEL}, unnest({_tokens()}) AS token FROM folded),
  slots AS (SELECT unnest(range(5)) AS slot),
  counts AS (
    SELECT slot, token, count(*) FILTER ({LABEL} = 0) AS n0, count(*) FILTER ({LABEL} = 1) AS n1
    FROM words JOIN slots ON fold <> slot GROUP BY slot, token),
  totals AS (SELECT slot, sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM counts GROUP BY slot),
  weights AS (
    SELECT slot, token, ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)) AS w
    FROM counts JOIN totals USING (slot)),
  priors AS (
    SELECT slot, ln(count(*) FILTER ({LABEL} = 1) / count(*) FILTER ({LABEL} = 0)) AS prior
    FROM folded JOIN slots ON fold <> slot GROUP BY slot),
  sums AS (
    SELECT t.doc_id, sum(w) AS s
    FROM (SELECT doc_id, fold AS slot, unnest({_tokens()}) AS token FROM folded) t
    JOIN weights USING (slot, token) GROUP BY t.doc_id),
  fold_scores AS (
    SELECT doc_id, {LABEL}, fold, round(coalesce(s, 0) + prior, 9) AS margin
    FROM folded LEFT JOIN sums USING (doc_id) JOIN priors ON slot = fold)"""


def _cleaned(text: str, source: str) -> str:
    kept = f"(SELECT * FROM filled WHERE {_strip('text')} <> '')"
    return f"""filled AS (SELECT doc_id, coalesce({text}, '') AS text, {LABEL} FROM {source}),
    cleaned AS ({_first(kept)})"""


def _parts(name: str = "part") -> str:
    return f"""SELECT (r - 1) // 500 + 1 AS {name}, count(*) AS rows, min(doc_id) AS first_id,
      max(doc_id) AS last_id, sum({_number('text')})::BIGINT AS text_sum
    FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents) GROUP BY 1"""


def _errors(truth: int, pred: int, relabel: bool = True, distinct: bool = True) -> str:
    rows = f"(SELECT * FROM scored WHERE {LABEL} = {truth} AND pred = {pred})"
    label = str(pred) if relabel else LABEL
    return (
        f"WITH {_SCORED} SELECT doc_id, md5(text) AS digest, {label} AS {LABEL} "
        f"FROM ({_first(rows) if distinct else rows})"
    )


_OUTCOME = f"""CASE WHEN {LABEL} = 0 AND pred = 1 THEN 'false_positive'
    WHEN {LABEL} = 1 AND pred = 0 THEN 'false_negative'
    WHEN {LABEL} = 1 AND pred = 1 THEN 'true_positive'
    WHEN {LABEL} = 0 AND pred = 0 THEN 'true_negative' END"""

_FREQUENCIES = """counts AS (SELECT {column}, count(*) AS count FROM documents
    WHERE {column} IS NOT NULL GROUP BY {column}),
  quartiles AS (SELECT quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.5) AS median,
    quantile_cont(count, 0.75) AS q3 FROM counts),
  fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM quartiles)"""

_P = "least(greatest(p1, 1e-15), 1 - 1e-15)"
_LOSS = f"CASE WHEN {LABEL} = 1 THEN -ln({_P}) ELSE -ln(1 - {_P}) END"

ORACLE: dict[str, str] = {
    "label_frequency": f"""WITH {_DIRTY},
      bare AS (SELECT doc_id, {_no_emoji("text")} AS text, {LABEL} FROM dirty),
      {_cleaned(text="text", source="bare")}
      SELECT {_strip(LABEL)}::INTEGER AS {LABEL}, count(*) AS count FROM cleaned
      WHERE {_VALID} GROUP BY 1""",
    "presence_flags": f"""WITH {_POSTS_ALL}
      SELECT doc_id, ({LABEL} IS NOT NULL)::INTEGER AS has_label,
        (quality IS NOT NULL)::INTEGER AS has_quality, 0 AS {LABEL} FROM posts_all""",
    "union_sources": """SELECT 0 AS source_rank, count(*) AS rows, count(text) AS n_text,
        count(doc_id) AS n_doc_id, count(lang) AS n_lang, count(source) AS n_source,
        0::BIGINT AS n_conv_id, 0::BIGINT AS n_turn, 0::BIGINT AS n_role FROM documents
      UNION ALL SELECT 1, count(*), count(text), 0, 0, 0, count(conv_id), count(turn), count(role)
      FROM conversations""",
    "valid_labels": f"""WITH {_DIRTY}
      SELECT doc_id, {_strip(LABEL)}::INTEGER AS {LABEL} FROM dirty WHERE {_VALID}""",
    "rejected_labels": f"WITH {_DIRTY} SELECT doc_id, {LABEL} FROM dirty WHERE NOT {_VALID}",
    "strip_blank": f"""WITH {_DIRTY}
      SELECT doc_id, length({_strip("text")})::INTEGER AS stripped_length FROM dirty
      WHERE coalesce({_strip("text")}, '') <> ''""",
    "remove_emoji": f"""WITH mixed AS (
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_text(MIXED)} || text || {_text(MIXED)}
          ELSE text END AS text FROM documents),
      bare AS (SELECT doc_id, {_no_emoji("text")} AS text FROM mixed)
      SELECT doc_id, length(text)::INTEGER AS length, md5(text) AS digest FROM bare""",
    "keep_first": f"SELECT doc_id, lang, source, n_chars FROM ({_first('documents')})",
    "keep_first_incremental": f"SELECT doc_id, lang, source, n_chars FROM ({_first('documents')})",
    "keep_first_folded": f"""WITH folded AS (
        SELECT doc_id, lower(CASE doc_id % 2 WHEN 0 THEN 'NOTE ' ELSE 'note ' END || text) AS text
        FROM documents)
      SELECT doc_id FROM ({_first("folded")})""",
    "dedup_then_filter": f"""SELECT doc_id, 1 AS {LABEL}
      FROM ({_first("documents")}) WHERE source >= 'src5'""",
    "head_rows": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 20",
    "with_ordinal": """SELECT doc_id, n_chars, md5(text) AS digest,
        row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS ord FROM documents""",
    "number_parts": _parts(),
    "profile": f"WITH {_POSTS_ALL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS non_null FROM posts_all"
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", LABEL)
    ),
    "box_summary": f"""WITH {_FREQUENCIES.format(column="source")}
      SELECT count(*) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
        min(count) FILTER (count BETWEEN low AND high) AS whisker_low,
        max(count) FILTER (count BETWEEN low AND high) AS whisker_high,
        count(*) FILTER (NOT count BETWEEN low AND high) AS n_outliers
      FROM counts, fences""",
    "box_outliers": f"""WITH {_FREQUENCIES.format(column="lang")}
      SELECT lang, count FROM counts, fences WHERE NOT count BETWEEN low AND high""",
    "frequency_report": f"""WITH {_POSTS_ALL}
      SELECT {LABEL}, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
      FROM posts_all WHERE {LABEL} IS NOT NULL GROUP BY {LABEL}""",
    "confusion": f"WITH {_SCORED} {_cells('scored')}",
    "metrics": f"WITH {_SCORED}, cells AS ({_cells('scored')}) {_metrics('cells')}",
    "metrics_by_source": f"""WITH {_SCORED}, cells AS ({_cells("scored", "source,")} GROUP BY source)
      {_metrics("cells", "source,")}""",
    "log_loss": f"""WITH {_SCORED},
      terms AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, {_LOSS} AS t FROM scored),
      means AS (SELECT avg(t) AS m FROM terms GROUP BY r // 8)
      SELECT 'rows' AS form, round(avg(t), 6) AS loss FROM terms
      UNION ALL SELECT 'batches', round(avg(m), 6) FROM means""",
    "first_errors": f"""WITH {_SCORED} SELECT doc_id, {LABEL}, pred FROM scored
      WHERE {LABEL} = 0 AND pred = 1 ORDER BY doc_id LIMIT 15""",
    "false_positives": _errors(0, 1),
    "false_negatives": _errors(1, 0),
    "true_positives": _errors(1, 1, relabel=False, distinct=False),
    "outcome_summary": f"""WITH {_SCORED}
      SELECT {_OUTCOME} AS kind, count(*) AS rows, count(DISTINCT text) AS distinct_texts
      FROM scored WHERE {_OUTCOME} IS NOT NULL GROUP BY 1""",
    "split_bucket": f"""SELECT doc_id, md5(text) AS digest, CASE WHEN {_IS_VAL} THEN 'val' ELSE 'train' END AS side
      FROM documents""",
    "split_exact": f"""SELECT doc_id, md5(text) AS digest, CASE WHEN row_number() OVER (ORDER BY {_HASH}, doc_id)
        <= ceil(0.2 * (SELECT count(*) FROM documents)) THEN 'val' ELSE 'train' END AS side
      FROM documents""",
    "oversample_even": f"""WITH {_LABELLED},
      sized AS (
        SELECT doc_id, {LABEL}, md5(text) AS digest, count(*) OVER (PARTITION BY {LABEL}) AS size,
          row_number() OVER (PARTITION BY {LABEL} ORDER BY {_HASH}, doc_id) AS r FROM labelled),
      largest AS (SELECT max(size) AS n FROM sized)
      SELECT doc_id, {LABEL}, digest, unnest(range(1, n // size + (r <= n % size)::INTEGER + 1)) AS copy
      FROM sized, largest""",
    "oversample_bootstrap": f"""WITH {_LABELLED},
      sized AS (
        SELECT doc_id, {LABEL}, md5(text) AS digest, count(*) OVER (PARTITION BY {LABEL}) AS size,
          row_number() OVER (PARTITION BY {LABEL} ORDER BY {_HASH}, doc_id) - 1 AS r
        FROM labelled),
      classes AS (SELECT DISTINCT {LABEL}, size, max(size) OVER () AS n FROM sized),
      draws AS (SELECT {LABEL}, size, unnest(range(n - size)) AS i FROM classes),
      hits AS (
        SELECT {LABEL}, {_number(f"'42:' || {LABEL} || ':' || i", 15)} % size AS r,
          count(*) AS k FROM draws GROUP BY 1, 2)
      SELECT doc_id, {LABEL}, digest, unnest(range(1, coalesce(k, 0) + 2)) AS copy
      FROM sized LEFT JOIN hits USING ({LABEL}, r)""",
    "shuffle": "SELECT doc_id, lang, md5(text) AS digest FROM documents ORDER BY md5('42:0:' || doc_id), doc_id",
    "shuffle_batches": """SELECT doc_id, md5(text) AS digest,
        (row_number() OVER (ORDER BY md5('42:0:' || doc_id), doc_id) - 1) // 8 AS batch
      FROM documents""",
    "tokens": f"""SELECT doc_id, len({_tokens()})::INTEGER AS n_tokens,
        md5(array_to_string({_tokens()}, ' ')) AS digest FROM documents""",
    "vocab": f"WITH {_TRAIN}, {_VOCAB} SELECT token, id FROM vocab",
    "encode": f"""WITH {_TRAIN}, {_VOCAB},
      cut AS (SELECT doc_id, {_tokens()}[1:126] AS words FROM documents),
      placed AS (SELECT doc_id, unnest(words) AS token, unnest(range(1, len(words) + 1)) AS pos
        FROM cut),
      coded AS (
        SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids
        FROM placed LEFT JOIN vocab USING (token) GROUP BY doc_id),
      whole AS (SELECT doc_id, coalesce(ids, []) AS ids, len(words) + 2 AS used
        FROM cut LEFT JOIN coded USING (doc_id))
      SELECT doc_id, used::INTEGER AS mask_sum, array_to_string(list_concat(
        list_concat([2], ids), list_concat([3], list_transform(range(128 - used), lambda x: 0))
      ), ',') AS ids FROM whole""",
    "nb_weights": f"""WITH {_TRAIN}, {_bayes("nb", "train", "documents")}
      SELECT token, n, round(w, 6) AS weight FROM nb_weights""",
    "nb_predict": f"""WITH {_TRAIN}, {_bayes("nb", "train", "documents")}
      SELECT doc_id, pred FROM nb_scores""",
    "nb_proba": f"""WITH {_TRAIN}, {_bayes("nb", "train", "documents")}
      SELECT doc_id, round(p1, 6) AS p1 FROM nb_scores""",
    "stack_features": f"""WITH {_TRAIN}, {_bayes("a", "train", "documents")},
      {_bayes("b", "train", "documents", fold=False)}
      SELECT doc_id, round(x.p1, 6) AS p_a, round(y.p1, 6) AS p_b
      FROM a_scores x JOIN b_scores y USING (doc_id)""",
    "out_of_fold": f"""WITH {_OUT_OF_FOLD}
      SELECT doc_id, {LABEL}, round(1 / (1 + exp(-margin)), 6) AS p1 FROM fold_scores""",
    "metrics_by_step": f"""WITH {_OUT_OF_FOLD},
      steps AS (
        SELECT 'bayes' AS run, fold::INTEGER AS step, {LABEL}, (margin > 0)::INTEGER AS pred
        FROM fold_scores),
      cells AS ({_cells("steps", "run, step,")} GROUP BY run, step)
      {_metrics("cells", "run, step,")}""",
    "compare_models": f"""WITH {_TRAIN}, {_bayes("a", "train", "labelled", keep=f"{LABEL},")},
      {_bayes("b", "train", "labelled", fold=False, keep=f"{LABEL},")},
      long AS (
        SELECT 'stand_in' AS model, {LABEL}, 1 - quality AS pred FROM labelled
        UNION ALL SELECT 'bayes_folded', {LABEL}, pred FROM a_scores
        UNION ALL SELECT 'bayes_cased', {LABEL}, pred FROM b_scores),
      cells AS ({_cells("long", "model,")} GROUP BY model)
      {_metrics("cells", "model,")}""",
    "error_report": f"""WITH {_TRAIN},
      {_bayes("nb", "train", "labelled", keep=f"{LABEL}, text,")}
      SELECT {_OUTCOME} AS kind, count(*) AS rows, count(DISTINCT text) AS distinct_texts
      FROM nb_scores WHERE pred <> {LABEL} GROUP BY 1""",
    "error_files": f"""WITH {_TRAIN},
      {_bayes("nb", "train", "labelled", keep=f"{LABEL}, text,")},
      firsts AS (
        SELECT *, row_number() OVER (PARTITION BY {LABEL}, text ORDER BY doc_id) AS place
        FROM nb_scores WHERE pred <> {LABEL})
      SELECT {_OUTCOME} AS kind, doc_id, md5(text) AS digest, 1 - {LABEL} AS {LABEL}
      FROM firsts WHERE place = 1""",
    "external_score": """WITH p AS (
        SELECT doc_id, 1 / (1 + exp(-(length(text) - 1500.0) / 1000.0)) AS p1 FROM documents)
      SELECT doc_id, round(p1, 6) AS p1, (p1 > 0.5)::INTEGER AS pred FROM p""",
    "build_scraped": f"""WITH both_scrapes AS (
        SELECT text, regexp_matches(text, 'https?://[^ \\n]+')::INTEGER AS link, 0 AS image
        FROM documents
        UNION ALL SELECT text, 0, coalesce(role <> 'user', false)::INTEGER FROM conversations),
      labelled_scrapes AS (SELECT *, 0 AS {LABEL} FROM both_scrapes)
      {_text_sums("labelled_scrapes", f"link, image, {LABEL}")}""",
    "build_final": f"""WITH {_DIRTY},
      final AS (
        SELECT {_no_emoji("text")} AS text, {_strip(LABEL)}::INTEGER AS {LABEL}
        FROM dirty WHERE {_VALID}
        UNION ALL SELECT {_no_emoji("text")}, 1 FROM ({_first("documents")}) WHERE source >= 'src5')
      {_text_sums("final", LABEL)}""",
    "prepare": f"""WITH {_DIRTY}, {_POSTS_ALL},
      raw AS (SELECT d.doc_id, d.text, coalesce(p.{LABEL}, 0) AS {LABEL}
        FROM dirty d JOIN posts_all p USING (doc_id)),
      {_cleaned(text="lower(text)", source="raw")},
      sides AS (
        SELECT *, row_number() OVER (ORDER BY {_HASH}, doc_id)
          <= ceil(0.2 * (SELECT count(*) FROM cleaned)) AS is_val FROM cleaned),
      sized AS (
        SELECT text, {LABEL}, count(*) OVER (PARTITION BY {LABEL}) AS size,
          row_number() OVER (PARTITION BY {LABEL} ORDER BY {_HASH}, doc_id) AS r
        FROM sides WHERE NOT is_val),
      largest AS (SELECT max(size) AS n FROM sized),
      balanced AS (
        SELECT 'train' AS side, text, {LABEL},
          unnest(range(1, n // size + (r <= n % size)::INTEGER + 1)) AS copy
        FROM sized, largest),
      both_sides AS (
        SELECT side, text, {LABEL} FROM balanced
        UNION ALL SELECT 'val', text, {LABEL} FROM sides WHERE is_val)
      {_text_sums("both_sides", f"side, {LABEL}")}""",
    "build_unlabelled": f"""WITH unlabelled AS (SELECT text, 0 AS {LABEL} FROM documents)
      {_text_sums("unlabelled", LABEL)}""",
    "leaked": f"""WITH cleaned AS (
        {_first("(SELECT doc_id, text FROM documents WHERE " + _strip("text") + " <> '')")}),
      train AS (SELECT text FROM cleaned WHERE NOT ({_IS_VAL})),
      vals AS (
        SELECT 'split_again' AS construction, text FROM documents WHERE {_IS_VAL}
        UNION ALL SELECT 'split_once', text FROM cleaned WHERE {_IS_VAL})
      SELECT construction, count(DISTINCT text) FILTER (text IN (SELECT text FROM train)) AS texts,
        count(*) FILTER (text IN (SELECT text FROM train)) AS val_rows
      FROM vals GROUP BY construction""",
    "csv_round_trip": f"""SELECT doc_id, lang,
        CASE WHEN text NOT IN ({_NA}) THEN md5(text) END AS digest FROM documents""",
    "csv_by_ranges": f"""SELECT doc_id, lang,
        CASE WHEN text NOT IN ({_NA}) THEN md5(text) END AS digest FROM documents""",
    "csv_by_name": f"""SELECT doc_id,
        CASE WHEN text NOT IN ({_NA}) THEN md5(text) END AS digest FROM documents""",
    "tolerant_scan": f"""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang,
        CASE WHEN doc_id % 5 <> 0 AND text NOT IN ({_NA}) THEN md5(text) END AS digest,
        (doc_id % 5 = 0)::INTEGER AS rejected FROM documents""",
    "tolerant_by_ranges": f"""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang,
        CASE WHEN doc_id % 5 <> 0 AND text NOT IN ({_NA}) THEN md5(text) END AS digest,
        (doc_id % 5 = 0)::INTEGER AS rejected FROM documents""",
    "unlabelled_file": f"""SELECT 0 AS {LABEL}, count(*) AS rows, sum({_number("text")})::BIGINT AS text_sum
        FROM documents WHERE doc_id % 5 <> 0""",
    "parts_round_trip": _parts(),
    "counts_round_trip": f"""WITH {_POSTS_ALL} SELECT {LABEL}, count(*) AS count FROM posts_all
      WHERE {LABEL} IS NOT NULL GROUP BY {LABEL}""",
    "model_round_trip": f"""WITH {_TRAIN}, {_bayes("nb", "train", "documents")}
      SELECT doc_id, pred, round(p1, 6) AS p1 FROM nb_scores""",
}
ORACLE["file_ordinal"] = ORACLE["with_ordinal"]
ORACLE["arriving_parts"] = ORACLE["parts_round_trip"]
ORACLE["encode_joined"] = ORACLE["encode"]
