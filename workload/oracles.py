"""SQL for DuckDB that gives the same rows as each named query, over the same whole tables."""

from __future__ import annotations

from voxframe.functions.text import ARABIC_FOLDS, BUCKWALTER

# The same signs as the package's whitespace class, in the notation of DuckDB's regex engine.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '[{SPACE}]+', ' ', 'g'))"


def generic(sql: str) -> str:
    return squeeze(rf"regexp_replace(lower({sql}), '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g')")


def arabic_script(sql: str) -> str:
    return f"translate({sql}, {quoted(''.join(BUCKWALTER))}, {quoted(''.join(BUCKWALTER.values()))})"


def arabic(sql: str) -> str:
    marks = r"[\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06ed}]"
    folded = f"translate(regexp_replace({sql}, '{marks}', '', 'g'), {quoted(''.join(ARABIC_FOLDS))}, {quoted(''.join(ARABIC_FOLDS.values()))})"
    return squeeze(rf"regexp_replace(lower({folded}), '[^\x{{0600}}-\x{{06ff}}{SPACE}]', '', 'g')")


def r6(sql: str) -> str:
    """Rounded to six places; a rounded negative is plain zero, as in Spark."""
    return f"CASE WHEN round({sql}, 6) = 0 THEN 0::DOUBLE ELSE round({sql}, 6) END"


def words(sql: str) -> str:
    return f"list_filter(regexp_split_to_array({sql}, '[{SPACE}]+'), lambda w: w <> '')"


UTT = "conv_id || '-' || turn"

ORACLES: dict[str, str] = {}

# --- text functions ------------------------------------------------------------------------------

ORACLES["normalize_generic"] = f"SELECT doc_id, {generic('text')} AS clean FROM documents"
ORACLES["normalize_ws"] = f"SELECT doc_id, {squeeze('lower(text)')} AS clean FROM documents"
ORACLES["normalize_extreme"] = ORACLES["normalize_generic"]
ORACLES["buckwalter"] = f"SELECT doc_id, {arabic_script('text')} AS arabic FROM documents"
ORACLES["normalize_ar"] = f"SELECT doc_id, {arabic(arabic_script('text'))} AS clean FROM documents"
ORACLES["squeeze_tokens"] = f"SELECT doc_id, {squeeze('text')} AS phones FROM documents"
ORACLES["word_counts"] = f"""
SELECT doc_id, len(ws)::BIGINT AS n_words, list_max(list_transform(ws, lambda w: length(w)))::BIGINT AS longest
FROM (SELECT doc_id, {words('text')} AS ws FROM documents)"""

def upper(sql: str) -> str:
    """Spark writes ß as SS in capitals, DuckDB as one letter."""
    return f"replace(upper({sql}), 'ẞ', 'SS')"


TAGGED = upper("text")
for _sign, _tag in ((",", " <COMMA>"), (".", " <PERIOD>"), ("?", " <QUESTIONMARK>"), ("!", " <EXCLAMATIONPOINT>")):
    TAGGED = f"replace({TAGGED}, '{_sign}', '{_tag}')"
TAGGED = f"replace({TAGGED}, chr(10), ' <SIL> I ')"

SENTENCE_CASE = rf"""
WITH tagged AS (SELECT {UTT} AS utt_id, {TAGGED} AS t FROM conversations),
plain AS (
  SELECT utt_id, regexp_replace(replace(replace(replace(replace(t, ' <COMMA>', ','), ' <PERIOD>', '.'),
    ' <QUESTIONMARK>', '?'), ' <EXCLAMATIONPOINT>', '!'), '<(SIL|MUSIC|NOISE|OTHER)>', '', 'g') AS t FROM tagged),
parts AS (SELECT utt_id, regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$') AS p FROM plain),
cased AS (
  SELECT utt_id, array_to_string(list_transform(p, lambda s:
    regexp_extract(s, '^\P{{L}}*') || upper(substr(s, length(regexp_extract(s, '^\P{{L}}*')) + 1, 1))
    || lower(substr(s, length(regexp_extract(s, '^\P{{L}}*')) + 2))), '') AS t FROM parts)
SELECT utt_id, replace(replace(t, ' i ', ' I '), ' i''', ' I''') AS clean FROM cased"""
ORACLES["restore_sentence_case"] = SENTENCE_CASE
ORACLES["clean_profile_both"] = f"SELECT utt_id, {squeeze('lower(clean)')} AS clean FROM ({SENTENCE_CASE})"
ORACLES["strip_time_tags"] = f"""
SELECT {UTT} AS utt_id, {squeeze("replace(text, '. ', '. [laugh] ')")} AS clean FROM conversations"""
ORACLES["extract_tagged"] = f"""
SELECT {UTT} AS utt_id, CASE (conv_id + turn) % 7
  WHEN 0 THEN btext WHEN 1 THEN btext WHEN 2 THEN 'base ' || text WHEN 3 THEN btext
  WHEN 4 THEN CASE WHEN length(btext) > 10 AND NOT regexp_matches(lower(text), 'error|sorry|cannot') THEN btext ELSE 'base ' || text END
  WHEN 5 THEN 'base ' || text
  ELSE CASE WHEN 1 < 0.3 * length('base ' || text) THEN 'base ' || text ELSE 'x' END END AS merged
FROM (SELECT *, regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS btext FROM conversations)"""
ORACLES["request_prompts"] = """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'Text: ' || text || chr(10) || 'Source: ' || source || chr(10)
  ELSE '[' || lang || '] ' || text END AS prompt FROM documents"""
ORACLES["speech_tokens"] = """
SELECT vec_id, array_to_string(list_transform(ids, lambda i: '<|speech_' || i || '|>'), '') AS codes,
  len(ids)::BIGINT AS n_ids, coalesce(list_sum(ids), 0)::BIGINT AS sum_ids,
  CASE WHEN len(ids) = 0 THEN 'no speech tokens' END AS error
FROM (SELECT vec_id, CASE WHEN label <> 0 THEN list_transform(embedding, lambda x: floor(abs(x) * 1000::FLOAT)::INT)
  ELSE []::INT[] END AS ids FROM embeddings)"""
ORACLES["file_keys"] = r"""
SELECT page_id, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem, regexp_replace(f, '\.[^./]+$', '.json') AS json_path,
  regexp_extract(f, '^(.*)/[^/]*$', 1) AS folder, substr(f, 2) AS rel_path
FROM (SELECT *, regexp_extract(f, '[^/]*$') AS name
  FROM (SELECT page_id, regexp_replace(url, '^https?://', '/') || '.v1.wav' AS f FROM pages))"""

# --- scores: the rules by which transcripts are made fix their edits -----------------------------


def made_scores(normal: str, source: str = "conversations") -> str:
    """Edits of each rule-made transcript, from the words of the normalised turn."""
    return f"""
WITH w AS (SELECT {UTT} AS utt_id, role, {words(normal)} AS ws FROM {source}),
n AS (SELECT utt_id, role, len(ws) AS n,
  list_sum(list_transform(ws, lambda x: length(x))) AS chars,
  coalesce(list_sum(list_transform(ws, lambda x, i: CASE WHEN i % 7 = 0 THEN length(x) ELSE 0 END)), 0) AS c7,
  coalesce(list_sum(list_transform(ws, lambda x, i: CASE WHEN i % 5 = 0 THEN length(x) ELSE 0 END)), 0) AS c5,
  coalesce(list_sum(list_transform(ws, lambda x, i: CASE WHEN i % 5 = 0 AND i % 7 <> 0 THEN length(x) ELSE 0 END)), 0) AS c5only
  FROM w),
e AS (
  SELECT utt_id, 'asr_a' AS system, n, chars, 0 AS s, n // 7 AS d, 0 AS i, c7 AS cd FROM n
  UNION ALL SELECT utt_id, 'asr_b', n, chars, n // 5, 0, 0, c5 FROM n
  UNION ALL SELECT utt_id, 'asr_c', n, chars, CASE WHEN role <> 'system' THEN 0 END, 0, n // 9, 2 * (n // 9) FROM n
  UNION ALL SELECT utt_id, 'judge', n, chars, n // 5 - n // 35, n // 7, 0, c7 + c5only FROM n),
scored AS (
  SELECT utt_id, system, n AS ref_words, n - d + i + 0 * s AS hyp_words, s + d + i AS distance,
    s AS substitutions, d + 0 * s AS deletions, i + 0 * s AS insertions,
    CASE WHEN n = 0 THEN CASE WHEN s IS NOT NULL THEN 1 END ELSE (s + d + i) / n END AS wer,
    CASE WHEN n = 0 THEN CASE WHEN s IS NOT NULL THEN 1 END ELSE (cd + 0 * s) / chars END AS cer,
    CASE WHEN n = 0 THEN 0 * s ELSE s / n END AS sub_rate,
    CASE WHEN n = 0 THEN 0 * s ELSE (d + 0 * s) / n END AS del_rate,
    CASE WHEN n = 0 THEN 0 * s ELSE (i + 0 * s) / n END AS ins_rate
  FROM e)"""


METRICS = ("wer", "cer", "sub_rate", "del_rate", "ins_rate")
MEANS = ", ".join(f"round(avg({m}) * 100, 6) AS {m}" for m in METRICS)
SUMMARY = f"""
SELECT system, count(*) AS n_files, count(wer) AS n_scored, count(*) - count(wer) AS n_missing, {MEANS}
FROM scored GROUP BY system"""
UNUSED = "SELECT 'unused', 0, 0, 0, " + ", ".join(f"NULL::DOUBLE" for _ in METRICS)

ORACLES["wide_to_long"] = """
SELECT doc_id AS utt_id, lang, 'a' AS system, text AS hyp FROM documents
UNION ALL SELECT doc_id, lang, 'b', lower(source) FROM documents UNION ALL SELECT doc_id, lang, 'c', NULL FROM documents"""
ORACLES["system_scores"] = f"{made_scores(generic('text'))} {SUMMARY} UNION ALL {UNUSED}"
ORACLES["utterance_scores"] = f"""{made_scores(generic('text'))}
SELECT utt_id, system, {', '.join(f'{c}::BIGINT AS {c}' for c in ('distance', 'ref_words', 'hyp_words', 'substitutions', 'deletions', 'insertions'))},
  {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM scored"""
ORACLES["system_scores_compat"] = f"""{made_scores(generic('text'))}
SELECT system, count(*) AS n_files, count(*) AS n_scored, 0::BIGINT AS n_missing,
  round(avg(coalesce(wer, 1)) * 100, 6) AS wer, round(avg(coalesce(cer, 1)) * 100, 6) AS cer FROM scored GROUP BY system"""
ORACLES["evaluate_arabic"] = f"{made_scores(arabic(arabic_script('text')))} {SUMMARY}"


# The first system makes no errors, the second and the judge those of the first rule; the third is asked in English only.
def job_summary(third: str) -> str:
    return f"""
, job AS (
  SELECT 'second' AS system, {', '.join(METRICS)} FROM scored WHERE system = 'asr_a'
  UNION ALL SELECT 'judge', {', '.join(METRICS)} FROM scored WHERE system = 'asr_a'
  UNION ALL SELECT 'first', (ref_words = 0)::INT, (ref_words = 0)::INT, 0, 0, 0 FROM scored WHERE system = 'asr_a'
  UNION ALL SELECT 'third', {third} FROM scored WHERE system = 'asr_a')
SELECT system, count(*) AS n_files, count(wer) AS n_scored, count(*) - count(wer) AS n_missing, {MEANS} FROM job GROUP BY system"""


ORACLES["evaluate_folder_job"] = f"{made_scores(arabic(arabic_script('text')))} {job_summary('NULL, NULL, NULL, NULL, NULL')}"
ORACLES["evaluate_chapters_job"] = f"{made_scores(generic('text'))} {job_summary('(ref_words = 0)::INT, (ref_words = 0)::INT, 0, 0, 0')}"
ORACLES["compare_folders_job"] = f"""
WITH d AS (SELECT len({words('text')}) AS n, turn % 4 <> 3 AS m FROM conversations)
SELECT count(*) AS n_refs, count(*) FILTER (m) AS n_matched, count(*) FILTER (NOT m) AS n_unmatched,
  round(avg((n // 7) / n) FILTER (m), 6) AS mean_wer, round(count(*) FILTER (NOT m) / count(*) * 100, 6) AS pct_unmatched FROM d"""

LINES = f"""
SELECT {UTT} AS utt_id, conv_id, role, turn, trim(CASE WHEN turn = 0 THEN lower(t) ELSE t END) AS text
FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM conversations)
WHERE (turn % 4 <> 3) AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 7)"""
ORACLES["utterance_lines"] = f"SELECT '/corpus/' || conv_id AS chapter, utt_id, text FROM ({LINES})"
ORACLES["chapter_lines"] = f"""
SELECT 'chapter=' || (conv_id % 7) AS chapter, 'u' || turn || '-' || (conv_id // 7) AS utt_id,
  regexp_replace(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM conversations"""
FIRST_LINES = f"(SELECT * FROM ({LINES}) ORDER BY utt_id LIMIT 100)"
ORACLES["evaluate_first_lines"] = f"{made_scores(generic('text'), FIRST_LINES)} {SUMMARY}"

ADJACENT = f"""
said AS (SELECT conv_id, turn, {UTT} AS utt_id, {generic('text')} AS t FROM conversations),
pairs AS (SELECT a.utt_id, a.t AS ref, b.t AS hyp FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

# The table of distances, one row of it per step: a row's cells are first reached from the row
# above, then from the left, which is a running minimum once the slope is taken out.
ORACLES["wer_adjacent_turns"] = f"""
WITH RECURSIVE {ADJACENT},
w AS (SELECT utt_id, {words('ref')} AS r, {words('hyp')} AS h FROM pairs),
dp AS (
  SELECT utt_id, 0 AS i, range(len(h) + 1) AS d FROM w
  UNION ALL
  SELECT utt_id, i + 1, list_transform(range(1, len(e) + 1), lambda j: list_min(e[1:j]) + j - 1)
  FROM (SELECT dp.utt_id, dp.i, list_prepend(dp.i + 1, list_transform(range(1, len(h) + 1), lambda j:
      least(dp.d[j] + CASE WHEN r[dp.i + 1] = h[j] THEN 0 ELSE 1 END, dp.d[j + 1] + 1) - j)) AS e
    FROM dp JOIN w USING (utt_id) WHERE dp.i < len(r))
)
SELECT utt_id, d[len(d)]::BIGINT AS distance, len(r)::BIGINT AS ref_words, len(h)::BIGINT AS hyp_words,
  d[len(d)]::BIGINT AS n_edits, (len(r) - len(h))::BIGINT AS net_deleted, round(d[len(d)] / len(r), 6) AS wer
FROM dp JOIN w USING (utt_id) WHERE i = len(r)"""

# The same table with the substitutions on the way to each cell and where that way leaves the border
# (a row above 0, a column below). A cell reached from the left continues the way of the last cell
# that was not: the running minimum of (cost without the slope, latest cell first) in one number.
ORACLES["edit_ops_adjacent_turns"] = f"""
WITH RECURSIVE {ADJACENT},
w AS (SELECT utt_id, {words('ref')} AS r, {words('hyp')} AS h FROM pairs),
dp AS (
  SELECT utt_id, 0 AS i, range(len(h) + 1) AS d, list_transform(range(len(h) + 1), lambda j: 0::BIGINT) AS s,
    list_transform(range(len(h) + 1), lambda j: -j) AS b FROM w
  UNION ALL
  SELECT utt_id, i + 1, list_transform(m, lambda x, j: x // 100000 - 100000 + j - 1),
    list_transform(m, lambda x: sb[100000 - x % 100000]), list_transform(m, lambda x: bb[100000 - x % 100000])
  FROM (SELECT *, list_transform(range(1, len(k) + 1), lambda j: list_min(k[1:j])) AS m
    FROM (SELECT *, list_transform(base, lambda v, x: (v - x + 1 + 100000) * 100000 + 100000 - x) AS k
      FROM (SELECT dp.utt_id, dp.i,
          list_prepend(dp.i + 1, list_transform(n, lambda x, j: least(dp.d[j] + x, dp.d[j + 1] + 1))) AS base,
          list_prepend(0::BIGINT, list_transform(n, lambda x, j:
            CASE WHEN dp.d[j] + x <= dp.d[j + 1] + 1 THEN dp.s[j] + x ELSE dp.s[j + 1] END)) AS sb,
          list_prepend(dp.i + 1, list_transform(n, lambda x, j:
            CASE WHEN dp.d[j] + x <= dp.d[j + 1] + 1 THEN dp.b[j] ELSE dp.b[j + 1] END)) AS bb
        FROM (SELECT dp.*, list_transform(h, lambda x: CASE WHEN x = r[dp.i + 1] THEN 0 ELSE 1 END) AS n
          FROM dp JOIN w USING (utt_id) WHERE dp.i < len(r)) AS dp)))
),
ends AS (SELECT utt_id, d[len(d)] AS d, s[len(s)] AS s, b[len(b)] AS b, len(r) - len(h) AS more
  FROM dp JOIN w USING (utt_id) WHERE i = len(r))
SELECT utt_id, d::BIGINT AS distance, s::BIGINT AS substitutions, ((d - s + more) // 2)::BIGINT AS deletions,
  ((d - s - more) // 2)::BIGINT AS insertions,
  ((d - s + more) // 2 - CASE WHEN b > 0 THEN b - 1 ELSE 0 END)::BIGINT AS compat_deletions,
  ((d - s - more) // 2 + CASE WHEN b > 0 THEN 0 ELSE b + 1 END)::BIGINT AS compat_insertions
FROM ends"""

# DuckDB counts bytes: each accented letter of the normalised texts becomes one spare ASCII letter.
ACCENTED = "éßóçäñèíêüö"
ORACLES["cer_adjacent_turns"] = f"""
WITH {ADJACENT},
c AS (SELECT utt_id, translate(replace(ref, ' ', ''), '{ACCENTED}', 'ABCDEFGHIJK') AS r,
  translate(replace(hyp, ' ', ''), '{ACCENTED}', 'ABCDEFGHIJK') AS h FROM pairs)
SELECT utt_id, levenshtein(r, h)::BIGINT AS distance, length(r)::BIGINT AS ref_chars, length(h)::BIGINT AS hyp_chars,
  round(levenshtein(r, h) / length(r), 6) AS cer FROM c"""
ORACLES["pair_coverage"] = f"""
WITH d AS (SELECT doc_id, len({words('text')}) AS n, doc_id IN (SELECT doc_id FROM labels) AS m FROM documents)
SELECT count(*) AS n_refs, count(*) FILTER (m) AS n_matched, count(*) FILTER (NOT m) AS n_unmatched,
  round(avg((n // 7) / n) FILTER (m), 6) AS mean_wer, round(count(*) FILTER (NOT m) / count(*) * 100, 6) AS pct_unmatched FROM d"""

# --- joins and audits ----------------------------------------------------------------------------

ORACLES["left_pairing"] = """
SELECT d.doc_id AS utt_id, lang, quality, (l.doc_id IS NOT NULL)::INT AS matched
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
ORACLES["strict_pairing"] = "SELECT l.doc_id AS utt_id, quality, toxic, lang, n_chars FROM labels l JOIN documents d USING (doc_id)"
ORACLES["text_code_pairing"] = """
SELECT doc_id AS utt_id, lang, len(embedding)::BIGINT AS n_codes FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""
ORACLES["common_keys"] = "SELECT doc_id AS utt_id FROM documents INTERSECT SELECT doc_id FROM labels"
ORACLES["skip_finished"] = "SELECT doc_id AS utt_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["audit_missing"] = """
SELECT doc_id AS utt_id, 'output' AS missing_in FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'input' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["audit_counts"] = """
SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS n_input, (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_output,
  (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_missing,
  (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS n_extra"""
ORACLES["completeness"] = "SELECT count(*) AS n_input, count(*) AS n_output, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra FROM documents"
ORACLES["audit_differing"] = """
SELECT doc_id AS utt_id, 'output' AS missing_in FROM documents WHERE doc_id = 17 OR doc_id = (SELECT max(doc_id) FROM documents)
UNION ALL SELECT -max(doc_id), 'input' FROM documents"""
ORACLES["last_event_wins"] = """
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""

# --- order ---------------------------------------------------------------------------------------

STRING_KEYS = "SELECT doc_id::VARCHAR AS utt_id, lang, source FROM documents"
ORACLES["sorted_keys"] = f"{STRING_KEYS} ORDER BY utt_id"
ORACLES["first_n_sorted"] = f"{STRING_KEYS} ORDER BY utt_id LIMIT 100"
ORACLES["skip_n_sorted"] = f"{STRING_KEYS} ORDER BY utt_id OFFSET 100"
ORACLES["running_number"] = f"SELECT *, row_number() OVER (PARTITION BY lang ORDER BY utt_id) AS utt_no FROM ({STRING_KEYS})"

# --- similarity ----------------------------------------------------------------------------------

SIMILAR = """
SELECT a.vec_id AS name, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLES["embedding_similarity"] = f"SELECT name, {r6('s')} AS similarity FROM ({SIMILAR})"
ORACLES["embedding_mean"] = f"""
SELECT count(*) AS n_pairs, count(s) AS n_scored, {r6('avg(s)')} AS mean_similarity FROM ({SIMILAR})"""

# --- consensus -----------------------------------------------------------------------------------

ORACLES["consensus_vote"] = f"""
SELECT {UTT} AS utt_id, array_to_string(list_transform({words('text')}, lambda w: lower(w)), ' ') AS merged FROM conversations"""
ORACLES["consensus_tie_votes"] = f"""
WITH t AS (SELECT conv_id, turn, {words('text')} AS ws FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(len(ws))) AS pos, lower(unnest(ws)) AS word FROM t),
c AS (SELECT conv_id, pos, word, count(*) AS n, min(turn) AS first FROM p GROUP BY ALL)
SELECT conv_id, pos, word FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1"""
ORACLES["longest_transcript"] = f"""
SELECT conv_id, rank, text FROM (
  SELECT conv_id, turn AS rank, regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY len({words('text')}) DESC, turn) AS rn FROM conversations) WHERE rn = 1"""

# Words are told apart by their position, so the aligner has no choice. Where the third voter lacks
# a word and the first one errs on the next, the third's word stands for the missing one: the first
# then meets only the second and wins the tie.
ORACLES["merge_transcripts"] = f"""
SELECT {UTT} AS utt_id, array_to_string(list_transform({words('text')}, lambda w, i: lower(
  CASE WHEN (i - 1) % 4 = 0 AND (i % 7 = 0 OR (i > 1 AND (i - 1) % 7 = 0)) THEN 'v0' ELSE '' END || w || '_' || (i - 1))), ' ') AS merged
FROM conversations"""
ORACLES["align_words"] = f"""
WITH n AS (SELECT {UTT} AS utt_id, len({words('text')}) AS n FROM conversations)
SELECT utt_id, 'dropped' AS target, pos, pos + pos // 6 AS ref_pos FROM (SELECT *, unnest(range(n - n // 7)) AS pos FROM n)
UNION ALL SELECT utt_id, 'replaced', pos, pos FROM (SELECT *, unnest(range(n)) AS pos FROM n)
UNION ALL SELECT utt_id, 'inserted', pos, CASE WHEN pos % 10 = 9 THEN least(pos // 10 * 9 + 9, n - 1) ELSE pos // 10 * 9 + pos % 10 END
FROM (SELECT *, unnest(range(n + n // 9)) AS pos FROM n)"""

# --- records -------------------------------------------------------------------------------------

ORACLES["word_timings"] = f"""
SELECT utt_id, pos, word, pos / 2 AS start, (pos + 1) / 2 AS "end", CASE WHEN pos % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS probability
FROM (SELECT {UTT} AS utt_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT conv_id, turn, {words('text')} AS ws FROM conversations))"""
SPEECH = "SELECT *, len(string_split(text, chr(10))) AS n FROM conversations"
ORACLES["speaker_count"] = f"""
SELECT {UTT} AS utt_id, n::BIGINT AS n_segments, least(n, 3)::BIGINT AS n_speakers, n::DOUBLE AS spoken FROM ({SPEECH})"""
ORACLES["speaking_rate"] = f"""
SELECT {UTT} AS utt_id, CASE WHEN turn % 5 = 4 OR n = 0 THEN NULL ELSE round(n / (n / 2), 6) END AS word_per_sec,
  CASE WHEN turn % 5 = 4 OR n = 0 THEN NULL ELSE round(n / (n / 2 / 60), 6) END AS word_per_min
FROM (SELECT conv_id, turn, len({words('text')}) AS n FROM conversations)"""
ORACLES["language_argmax"] = """
SELECT source, lang, round(n / total, 6) AS share FROM (
  SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total,
    row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) WHERE rn = 1"""
ORACLES["labelled_variant"] = """
SELECT d.doc_id AS utt_id, CASE WHEN toxic = 1 AND (n_chars % 10) / 10 > 0.6 THEN '[laugh] ' || text ELSE text END AS variant
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
ORACLES["language_route"] = """
SELECT doc_id AS utt_id, (lang = 'en')::INT AS wanted, CASE WHEN lang = 'en' THEN text END AS third,
  CASE WHEN lang <> 'en' THEN 'skipped (' || lang || ' audio)' END AS status FROM documents"""
ORACLES["fallback_chain"] = f"""
SELECT d.doc_id AS utt_id, CASE WHEN quality = 1 AND regexp_matches(text, '[^{SPACE}]') THEN text
  WHEN lang = 'en' THEN source ELSE 'none' END AS chosen
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
ORACLES["nonblank_lines"] = f"""
SELECT doc_id, line, text FROM (
  SELECT doc_id, line, regexp_replace(t, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM (
    SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM (
      SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE text <> ''"""
def annotated(first: str, judged: str, final: str) -> str:
    return f"""
WITH r AS (SELECT *, (conv_id + turn) % 4 AS k, {UTT} AS u, {squeeze('text')} AS second,
    regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS bare,
    len(string_split(text, chr(10))) AS segs, len({words('text')}) AS n FROM conversations),
m AS (SELECT *, CASE WHEN k = 0 AND length({judged}) >= 0.3 * length(second) THEN {upper(judged)} ELSE second END AS merged FROM r)
SELECT u AS utt_id, role || '/' || u || '.wav' AS rel_path, CASE WHEN k < 3 THEN 'en' ELSE 'ar' END AS lang,
  {first} AS first, second, CASE WHEN k < 3 THEN text END AS third,
  CASE WHEN k = 3 THEN 'skipped (ar audio)' END AS third_status, merged,
  CASE WHEN k = 1 AND turn % 2 = 0 THEN '[laugh] ' || second ELSE second END AS with_label,
  {final} AS final,
  CASE WHEN k = 1 THEN 'laugh' ELSE 'no_sounds' END AS label, 0.25::DOUBLE AS noise_confidence,
  n::BIGINT AS n_aligned, 12.5::DOUBLE AS snr, least(segs, 3)::BIGINT AS num_speakers,
  CASE WHEN turn % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
  CASE WHEN turn % 5 = 4 THEN 0 ELSE n / 2 END::DOUBLE AS duration,
  CASE WHEN turn % 5 = 4 OR n = 0 THEN NULL
    ELSE round(len({words('merged')}) / (n / 2), 6) END AS word_per_sec
FROM m"""


RECORDS = annotated("lower(text)", "bare", "CASE WHEN k <> 2 THEN text || ' ok' ELSE merged END")
ORACLES["annotated_record"] = RECORDS
ORACLES["record_sink"] = RECORDS
ORACLES["annotate_recordings"] = annotated(
    "lower(text) || ' ' || k", "second", "CASE WHEN contains(merged, 'zz') THEN merged ELSE merged || ' ok' END"
)
# only the judge's polished text differs from the turn, by one more word of two letters
ORACLES["evaluate_annotations"] = f"""
WITH r AS (SELECT (conv_id + turn) % 4 AS k, len({words(generic('text'))}) AS n, length(replace({generic('text')}, ' ', '')) AS chars
  FROM conversations),
scored AS (
  SELECT s AS system, CASE WHEN s = 'third' AND k = 3 THEN NULL ELSE 0 END AS sub_rate,
    CASE WHEN s = 'third' AND k = 3 THEN NULL ELSE 0 END AS del_rate,
    CASE WHEN s = 'third' AND k = 3 THEN NULL WHEN s = 'judge' AND k <> 2 THEN 1 / n ELSE 0 END AS ins_rate,
    CASE WHEN s = 'third' AND k = 3 THEN NULL WHEN s = 'judge' AND k <> 2 THEN 1 / n ELSE 0 END AS wer,
    CASE WHEN s = 'third' AND k = 3 THEN NULL WHEN s = 'judge' AND k <> 2 THEN 2 / chars ELSE 0 END AS cer
  FROM r, (SELECT unnest(['first', 'second', 'judge', 'third']) AS s))
{SUMMARY}"""
ORACLES["report_sink"] = f"""{made_scores(generic('text'))}
SELECT *, (SELECT count(*) FROM conversations) AS num_files FROM ({SUMMARY})"""
ORACLES["catalog_roles"] = """
SELECT source AS path, lang AS name, CASE WHEN m % 2 = 0 THEN 'doc_id' ELSE 'id' END AS id_col,
  CASE WHEN m % 5 = 0 THEN 'text_normalized' WHEN m % 5 < 3 THEN 'body' ELSE 'text' END AS text_col,
  CASE WHEN m % 7 = 0 THEN 'sound' ELSE 'audio' END AS audio_col
FROM (SELECT source, lang, max(doc_id) AS m FROM documents GROUP BY ALL) WHERE m % 3 <> 0"""
ORACLES["text_files"] = f"""
SELECT regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text, count(*) AS n_files FROM benchmark GROUP BY 1"""
ORACLES["file_manifest"] = """
SELECT 'folder=' || item_id % 5 AS folder, strlen(text) + 1 AS length, count(*) AS n_files FROM benchmark GROUP BY ALL"""

# --- models, corpora, resuming -------------------------------------------------------------------

ORACLES["infer_stub"] = f"""
SELECT doc_id, CASE WHEN length(text) <= 2000 THEN len({words('text')}) ELSE -1 END::BIGINT AS n_spoken,
  CASE WHEN length(text) <= 1000 THEN 'full' WHEN length(text) <= 2000 THEN 'patient' END AS attempt,
  CASE WHEN length(text) <= 1000 THEN 'ok' WHEN length(text) <= 2000 THEN 'retried' ELSE 'default' END AS status,
  CASE WHEN length(text) > 2000 THEN 'ValueError: too long' END AS error FROM documents"""
ORACLES["folder_run"] = """
SELECT n AS n_bytes, NULL::VARCHAR AS error, count(*) AS n_files FROM (SELECT strlen(text) + 1 AS n FROM benchmark) GROUP BY n
UNION ALL SELECT NULL, 'ValueError: too large', count(*) FROM benchmark WHERE strlen(text) + 1 > 150 HAVING count(*) > 0"""
ORACLES["folder_collision"] = """
SELECT 'folder=' || (item_id % 5) AS folder, count(*) AS n_files, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM benchmark GROUP BY ALL
UNION ALL SELECT 'missing', 0, 0"""
ORACLES["gaps_of_labels"] = """
SELECT coalesce(l.doc_id, d.doc_id) AS utt_id, CASE WHEN d.doc_id IS NULL THEN 'output' ELSE 'input' END AS missing_in
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT doc_id FROM documents WHERE length(text) > 1000) d ON l.doc_id = d.doc_id
WHERE l.doc_id IS NULL OR d.doc_id IS NULL"""
ORACLES["prepare_corpus"] = """
SELECT lang AS split, count(*) AS n_done, max(doc_id) AS last_key, count(*) AS n_codes,
  sum(list_sum(list_transform(string_split(source, ''), lambda ch: ascii(ch) % 32)))::BIGINT AS sum_codes,
  sum(length(text))::BIGINT AS n_chars, sum(length(source))::BIGINT AS n_samples FROM documents GROUP BY lang"""
ORACLES["prepare_broken_off"] = """
SELECT lang AS split, count(*) AS n_done, max(doc_id) AS last_key, count(*) AS n_codes,
  coalesce(sum(list_sum(list_transform(range(length(text)), lambda i: i % 97 % 32))), 0)::BIGINT AS sum_codes,
  sum(length(text))::BIGINT AS n_chars, sum(length(text))::BIGINT AS n_samples FROM documents GROUP BY lang"""
ORACLES["clean_catalog"] = f"{ORACLES['normalize_generic']} WHERE lang <> 'fr'"
ORACLES["resume_clean"] = ORACLES["normalize_extreme"]
ORACLES["progress_counts"] = "SELECT source, count(*) AS n_done, max(doc_id) AS last_key FROM documents GROUP BY source"

# --- sequences -----------------------------------------------------------------------------------

TOKENS = """
t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id AS token,
  user_id % 7 AS p FROM events),
l AS (SELECT user_id, any_value(p) AS p, max(seq) + 1 AS len FROM t GROUP BY user_id),
k AS (SELECT *, CASE WHEN len - p >= 30 THEN (len - p - 30) // 25 + 1 ELSE 0 END AS regular FROM l)"""
CHUNKS = f"""
WITH {TOKENS},
c AS (SELECT *, p + 25 * chunk AS n FROM (SELECT *, unnest(range(regular + 1)) AS chunk FROM k)),
w AS (SELECT user_id, chunk, n, greatest(n - 51, 0) AS ctx_start,
  CASE WHEN chunk < regular THEN n + 30 ELSE len END AS ctx_end, (chunk = regular)::INT AS is_final
  FROM c WHERE chunk < regular OR len > n)
SELECT w.user_id, chunk, n, ctx_start, ctx_end, is_final, string_agg(token::VARCHAR, ' ' ORDER BY seq) AS tokens
FROM w JOIN t ON t.user_id = w.user_id AND seq >= ctx_start AND seq < ctx_end GROUP BY ALL"""
ORACLES["chunk_windows_batch"] = CHUNKS
ORACLES["chunk_stream"] = CHUNKS
ORACLES["chunk_stream_redelivered"] = CHUNKS


def overlapped(weight: str) -> str:
    return f"""
WITH f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS no, embedding AS e FROM embeddings),
s AS (SELECT label, no * 48 + j AS sample, x::DOUBLE AS x, (j + 1) / (len + 1) AS t FROM (
  SELECT label, no, unnest(range(len(e))) AS j, unnest(e) AS x, len(e) AS len FROM f))
SELECT label, sample, {r6('v')} AS value FROM (
  SELECT label, sample, sum({weight} * x) / sum({weight}) AS v FROM s GROUP BY ALL)"""


ORACLES["overlap_add_ramp"] = overlapped("(1 - t)")
ORACLES["overlap_add_triangle"] = overlapped("(0.5 - abs(t - 0.5))")
# decoded samples do not depend on the context, so the stitched signal is that of the tokens
ORACLES["stitched_signal"] = """
WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id AS token,
  user_id % 7 AS p FROM events)
SELECT user_id, (seq - p) * 4 + j AS sample, round(token % 1000 + j / 10, 6) AS value
FROM t, (SELECT unnest(range(4)) AS j) WHERE seq >= p"""

# The historical layout puts the remainder's frame, which starts a token early, at its chunk's own
# place; the tail of the chunk before covers its first two tokens.
LAYOUT = f"""
WITH {TOKENS},
j AS (SELECT unnest(range(4)) AS j),
v AS (SELECT user_id, seq, j, token % 1000 + j / 10 AS v FROM t, j),
regular AS (SELECT v.user_id, (seq - p) * 4 + j AS sample, v FROM v JOIN k ON k.user_id = v.user_id
  WHERE seq >= p AND seq < p + 25 * regular),
f AS (SELECT *, p + 25 * regular AS n, CASE WHEN regular = 0 AND p = 0 THEN 0 ELSE 1 END AS lead FROM k WHERE len > p + 25 * regular),
final AS (SELECT f.user_id, regular, n, (len - n + lead) * 4 AS size, (seq - n + lead) * 4 + j AS o, v
  FROM f JOIN v ON v.user_id = f.user_id AND seq >= n - lead),
tail AS (SELECT f.user_id, (seq - n) * 4 + j AS o, v FROM f JOIN v ON v.user_id = f.user_id AND seq >= n AND seq < n + 2 WHERE regular > 0),
mixed AS (SELECT final.user_id, regular * 100 + final.o AS sample,
  CASE WHEN tail.o IS NULL THEN final.v
    ELSE (tail.v * (1 - (101 + tail.o) / 109) + final.v * (1 - (final.o + 1) / (size + 1)))
      / ((1 - (101 + tail.o) / 109) + (1 - (final.o + 1) / (size + 1))) END AS v
  FROM final LEFT JOIN tail ON tail.user_id = final.user_id AND tail.o = final.o)
SELECT user_id, sample, round(v, 6) AS value FROM (SELECT user_id, sample, v FROM regular UNION ALL SELECT * FROM mixed)"""
ORACLES["stitched_layout"] = LAYOUT
ORACLES["stitch_stream"] = LAYOUT

ORACLES["paced_calls"] = """
SELECT count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars, 0::BIGINT AS n_too_soon, 0::BIGINT AS n_too_many, 0::BIGINT AS n_failed FROM benchmark"""
ORACLES["overlap_add_hot"] = f"""
WITH s AS (SELECT event_id % 2 * 4 + j AS sample, 1 - (j + 1) / 9.0::DOUBLE AS w, value * (j + 1) AS x FROM events, range(8) r(j))
SELECT 'all' AS label, sample::BIGINT AS sample, round(sum(w * x) / sum(w), 3) AS value FROM s GROUP BY sample"""
