"""DuckDB SQL of the training-data queries that SQL can express."""

from rankflow.llm import licences

QUALITY = """
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT row_id, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
marked AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row_id, count(DISTINCT place) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM marked)
  GROUP BY row_id),
measured AS (
  SELECT doc_id,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(t, '\\p{Lu}')) AS BIGINT) AS n_capitals
  FROM split LEFT JOIN covered USING (row_id)),
judged AS (
  SELECT *,
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
  CAST(failed AS INTEGER) AS failed, failed & 3 <> 0 AS base_failed, failed = 0 AS kept
FROM judged
"""

CHAT = """
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM rows),
written AS (
  SELECT *, length(replace(role, chr(92), chr(92) || chr(92))) + length(replace(text, chr(92), chr(92) || chr(92))) + 20
    + len(regexp_extract_all(role, '</?s>|\\[/?INST\\]|<</?SYS>>'))
    + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]|<</?SYS>>')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

SEARCH = """
WITH words AS (
  SELECT row_number() OVER () AS doc_row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM words WHERE len(terms) > 0),
sized AS (SELECT doc_row, doc_id, 75 + (25 * CAST(len(terms) AS BIGINT) * n_docs) // all_terms AS m FROM words, totals WHERE len(terms) > 0),
held AS (SELECT doc_row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_row, unnest(terms) AS term FROM words) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM held GROUP BY term), totals),
items AS (
  SELECT row_number() OVER () AS item_row, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_row, item_id, doc_row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items JOIN held USING (term) JOIN weights USING (term) JOIN sized USING (doc_row) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""


def licence_sql() -> str:
    """Every template tried at every place, without an index."""
    rows = [
        f"({number}, '{t.label}', {t.base}, {at}, '{word}', {at in t.key_places()})"
        for number, t in enumerate(licences.TEMPLATES)
        for at, word in enumerate(t.text.split())
    ]
    return f"""
WITH templates(template, label, base, spot, word, key_word) AS (VALUES {", ".join(rows)}),
texts AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
places AS (SELECT row_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts),
known AS (SELECT * FROM places WHERE word IN (SELECT word FROM templates)),
held AS (SELECT word, count(DISTINCT row_id) AS df FROM known GROUP BY word),
weighted AS (
  SELECT t.*, greatest(1, CAST(floor(1000 * ln((2 * (SELECT count(*) FROM texts) + 2) / (2 * coalesce(df, 0) + 1))) AS BIGINT)) AS weight
  FROM templates t LEFT JOIN held USING (word)),
totals AS (SELECT template, any_value(label) AS label, any_value(base) AS base, sum(weight) AS total, count_if(key_word) AS n_keys
  FROM weighted GROUP BY template),
stands AS (
  SELECT row_id, template, place - spot AS start, sum(weight) AS aligned, count_if(key_word) AS keys
  FROM known JOIN weighted USING (word) GROUP BY ALL),
matches AS (
  SELECT * FROM stands JOIN totals USING (template) WHERE 100 * aligned >= {licences.SHARE} * total AND keys = n_keys),
judged AS (
  SELECT row_id, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(CAST(aligned AS DOUBLE) / CAST(total AS DOUBLE)) AS score
  FROM matches GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM texts LEFT JOIN judged USING (row_id)
"""
