"""SQL for DuckDB over the same whole tables, where SQL can express the operator."""

from __future__ import annotations

from voxframe.llm import licenses as L

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    not_word = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rules = ", ".join(f"({i}, {_quoted(p)}, {_quoted(n)}, {k}, {_quoted(w)})" for i, (p, n, k, w) in enumerate(L.rules()))
    base = []
    for label, phrase in L.BASE.items():
        parts = phrase.split(" ")
        same = " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(parts))
        base.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, greatest(len(words) - {len(parts) - 1}, 0)), lambda i: {same})) AS place FROM w WHERE len(words) >= {len(parts)}")
    score = " ".join(f"WHEN strongest = {k} THEN {v}::DOUBLE" for k, v in L.CONFIDENCE.items())
    return rf"""
WITH rules(ord, pattern, label, priority, keyword) AS (VALUES {rules}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), {_quoted(not_word)}), lambda x: x <> '') AS words FROM documents),
norm AS (SELECT doc_id, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM w),
hit AS (SELECT doc_id, ord, label, priority, regexp_extract_all(norm, pattern) AS found, regexp_split_to_array(norm, pattern) AS between
        FROM norm, rules WHERE contains(norm, keyword) AND regexp_matches(norm, pattern)),
one AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM hit),
det AS (SELECT doc_id, ord, label, priority,
          coalesce(list_sum(list_transform(between[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k-1], lambda x: length(x))), 0) AS start,
          coalesce(list_sum(list_transform(between[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k], lambda x: length(x))), 0) AS stop
        FROM one),
marked AS (SELECT *,
          max(CASE WHEN priority <= 1 THEN stop END) OVER before AS e1,
          max(CASE WHEN priority <= 2 THEN stop END) OVER before AS e2,
          max(stop) OVER before AS e3
        FROM det WINDOW before AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT * FROM marked WHERE coalesce(CASE priority WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, -1) < stop),
base AS ({" UNION ALL ".join(base)}),
bases AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
named AS (SELECT doc_id, label, priority FROM kept UNION ALL SELECT doc_id, label, 1 FROM base),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(priority) AS strongest FROM named GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE {score} ELSE 0.0::DOUBLE END AS score
FROM w LEFT JOIN bases USING (doc_id) LEFT JOIN labels USING (doc_id)"""


ORACLES["op6_license_scan"] = _licenses()

ORACLES["op7_decontamination"] = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
item AS (SELECT DISTINCT id AS item_id, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
         FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item),
doc AS (SELECT DISTINCT id AS doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM words, lengths WHERE kind = 'd')),
sizes AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
held AS (SELECT doc_id, item_id, count(DISTINCT item.gram) AS n_shared FROM doc JOIN item ON doc.gram = item.gram GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment
FROM held JOIN sizes USING (item_id) WHERE n_shared * 100 >= n_item * 75"""

ORACLES["op10_near_duplicates"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)"""

ORACLES["op2_line_dedup"] = r"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
spoken AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
two AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS line2 FROM spoken),
starts AS (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) AS nth2, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM two),
gone AS (
  SELECT doc_id, seq FROM starts WHERE line2 IS NOT NULL AND nth2 > 1
  UNION SELECT doc_id, seq + 1 FROM starts WHERE line2 IS NOT NULL AND nth2 > 1
  UNION SELECT doc_id, seq FROM starts WHERE length(line) >= 200 AND nth > 1),
kept AS (SELECT line.doc_id, string_agg(line.line, chr(10) ORDER BY line.pos) AS text
         FROM line LEFT JOIN spoken USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = spoken.doc_id AND gone.seq = spoken.seq
         WHERE gone.doc_id IS NULL GROUP BY line.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS lines_before, coalesce(n, 0)::BIGINT AS lines_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

ORACLES["op13_periodic_runs"] = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
g AS (SELECT doc_id, w, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) AS g FROM d),
s AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM g),
tok AS (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM s)),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS isle FROM pairs),
stretch AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM isles GROUP BY doc_id, p, isle HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretch GROUP BY doc_id, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS nth FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS list FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT tok.doc_id, string_agg(word, ' ' ORDER BY tok.i) AS text FROM tok ANTI JOIN gone ON tok.doc_id = gone.doc_id AND tok.i = gone.i GROUP BY tok.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE nth = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _drawn(name: str, classes: str, goals: str) -> str:
    """CTEs of one draw: ``name``_decided (source, class, whole, chance), ``name``_more (doc_id), ``name``_spent (source, spent)."""
    return f"""
{name}_e AS ({_rates(classes, goals)}),
{name}_decided AS (SELECT source, class, words, goal, floor(copies)::BIGINT AS whole, copies - floor(copies) AS chance FROM {name}_e),
{name}_budget AS (SELECT source, sum(whole * words)::BIGINT AS certain, round(any_value(goal))::BIGINT - sum(whole * words)::BIGINT AS budget FROM {name}_decided GROUP BY source),
{name}_ranked AS (
  SELECT u.*, budget, sum(size) OVER (PARTITION BY u.source ORDER BY odds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM (SELECT r.*, (luck / (1 - luck)) / (chance / (1 - chance)) AS odds FROM r JOIN {name}_decided c ON r.source IS NOT DISTINCT FROM c.source AND r.class = c.class WHERE chance > 0) u
  JOIN {name}_budget b ON u.source IS NOT DISTINCT FROM b.source),
{name}_more AS (SELECT doc_id FROM {name}_ranked WHERE upto <= budget),
{name}_spent AS (
  SELECT b.source, any_value(certain) + coalesce(sum(size), 0)::BIGINT AS spent
  FROM {name}_budget b LEFT JOIN (SELECT source, size FROM {name}_ranked SEMI JOIN {name}_more USING (doc_id)) m ON b.source IS NOT DISTINCT FROM m.source GROUP BY b.source)"""


def _rates(classes: str, goals: str) -> str:
    """Expected copies of each class, so that the words of a source are its goal."""
    return f"""
  WITH summed AS (
    SELECT c.source, c.class, c.words, goal, sqrt(sqrt((1::BIGINT << c.class)::DOUBLE)) AS liking, sum(words) OVER (PARTITION BY c.source)::BIGINT AS words_all,
           sum(words) OVER shorter::BIGINT AS upto, sum(sqrt(sqrt((1::BIGINT << c.class)::DOUBLE)) * words) OVER shorter AS liked
    FROM {classes} c JOIN {goals} t ON c.source IS NOT DISTINCT FROM t.source
    WINDOW shorter AS (PARTITION BY c.source ORDER BY c.class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  rated AS (SELECT *, (goal - 3 * (words_all - upto)) / liked AS rate FROM summed),
  lowest AS (SELECT source, max(class) AS top, max_by(rate, class) AS rate FROM rated WHERE rate * liking < 3 GROUP BY source)
  SELECT a.source, a.class, a.words, a.goal, CASE WHEN top IS NULL OR a.class > top THEN 3::DOUBLE ELSE l.rate * liking END AS copies
  FROM rated a LEFT JOIN lowest l ON a.source IS NOT DISTINCT FROM l.source"""


ORACLES["op11_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix ' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS luck FROM documents),
r AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM d),
named AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM r GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weighs,
         coalesce(sum(3 * source_size) OVER lower_limits, 0)::BIGINT AS most_before, coalesce(sum(weight) OVER lower_limits, 0)::BIGINT AS weight_before
  FROM named WINDOW lower_limits AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limited AS (SELECT *, most::DOUBLE * (weighs - weight_before) <= weight::DOUBLE * (words - most_before) AS is_full FROM ordered),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most::DOUBLE
              ELSE ((words - coalesce(sum(most) FILTER (is_full) OVER (), 0)::BIGINT) * weight)::DOUBLE / (weighs - coalesce(sum(weight) FILTER (is_full) OVER (), 0)::BIGINT) END AS target
  FROM limited),
aims AS (SELECT source, target AS goal FROM targets),
classes AS (SELECT source, class, sum(size)::BIGINT AS words FROM r WHERE class > 0 GROUP BY source, class),
split AS (SELECT *, (1::BIGINT << class) * 16 > goal AS is_large FROM ({_rates("classes", "aims")})),
large AS (SELECT * EXCLUDE (goal) FROM split WHERE is_large),
small AS (SELECT * EXCLUDE (goal) FROM split WHERE NOT is_large),
of_large AS (SELECT source, sum(copies * words) AS goal FROM split WHERE is_large GROUP BY source),
{_drawn("one", "large", "of_large")},
of_small AS (SELECT a.source, greatest(goal - coalesce(spent, 0), 0::DOUBLE) AS goal FROM aims a LEFT JOIN one_spent s ON a.source IS NOT DISTINCT FROM s.source),
{_drawn("two", "small", "of_small")},
whole AS (SELECT source, class, whole FROM one_decided UNION ALL SELECT source, class, whole FROM two_decided),
more AS (SELECT doc_id FROM one_more UNION SELECT doc_id FROM two_more),
drawn AS (
  SELECT r.*, coalesce(whole, 0) + (more.doc_id IS NOT NULL)::BIGINT AS copies
  FROM r LEFT JOIN whole ON r.source IS NOT DISTINCT FROM whole.source AND r.class = whole.class LEFT JOIN more ON r.doc_id = more.doc_id),
gaps AS (
  SELECT t.source, round(any_value(target))::BIGINT - sum(copies * size)::BIGINT AS gap
  FROM targets t JOIN drawn d ON t.source IS NOT DISTINCT FROM d.source GROUP BY t.source),
closing AS (
  SELECT doc_id, row_number() OVER (PARTITION BY d.source ORDER BY abs(gap - size), luck) AS nth
  FROM drawn d JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source WHERE copies < 3 AND size > 0 AND size < 2 * gap)
SELECT r.doc_id, r.size, source_size, target, r.size * (copies + (c.doc_id IS NOT NULL)::BIGINT) AS taken, copies + (c.doc_id IS NOT NULL)::BIGINT AS copies
FROM drawn r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN (SELECT doc_id FROM closing WHERE nth = 1) c ON r.doc_id = c.doc_id"""

ORACLES["op12_ranked_search"] = rf"""
WITH doc AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
item AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM item GROUP BY ALL),
length AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM length),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
sized AS (SELECT doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM length, whole),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM tf JOIN asked USING (term) JOIN df USING (term) JOIN sized USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
