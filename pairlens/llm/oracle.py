"""DuckDB SQL for the queries of this subpackage that SQL can express.

Fingerprints, edit joins under a hash, token ids, packings, images and the trained field have none; tests hold them against
brute force or exact round trips.
"""
from __future__ import annotations

from pairlens.llm import chat_events, line_rules, url_lm

ORACLE: dict[str, str] = {}

ORACLE["op4_warc_chunks"] = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM first
"""

# Every line with a word, or of at least 20 bytes, against every other of like length; the shorter of two sets the edits.
ORACLE["op5_line_join"] = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(own))) AS line_no, unnest(own) AS line FROM split
), sized AS (
  SELECT *, strlen(line) AS n_bytes FROM lines
), classes AS (
  SELECT line, n_bytes, min({'d': doc_id, 'l': line_no}) AS first FROM sized
  WHERE n_bytes >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line, n_bytes
), pairs AS (
  SELECT a.line AS line, b.first AS other FROM classes a
  JOIN (SELECT *, unnest(range(n_bytes - 2, n_bytes + 3)) AS near FROM classes WHERE n_bytes >= 10) b ON a.n_bytes = b.near
  WHERE a.n_bytes >= 10 AND a.line <> b.line AND levenshtein(a.line, b.line) <= CASE WHEN least(a.n_bytes, b.n_bytes) >= 20 THEN 2 ELSE 1 END
), links AS (
  SELECT line, count(*) AS n_links, min(other) AS earliest FROM pairs GROUP BY line
)
SELECT doc_id, line_no::INTEGER AS line_no, s.n_bytes::INTEGER AS n_bytes,
       coalesce(c.first.d, doc_id) AS first_doc_id, coalesce(c.first.l, line_no)::INTEGER AS first_line_no,
       coalesce(n_links, 0) AS n_links,
       c.line IS NULL OR (c.first.d = doc_id AND c.first.l = line_no AND (earliest IS NULL OR c.first < earliest)) AS kept
FROM sized s LEFT JOIN classes c ON s.line = c.line LEFT JOIN links k ON s.line = k.line
"""

# Words, windows and lines as rows; every document is numbered, so rows that repeat an id stay apart.
_RULES = line_rules.Rules()
ORACLE["op10_line_rules"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs
), windows AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS pos, unnest([words[i:i + 2] for i in range(1, len(words) - 1)]) AS held FROM worded
), counted AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, held) AS n FROM windows
), covered AS (
  SELECT rid, count(DISTINCT word_at) AS n_repeat_words
  FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS word_at FROM counted WHERE n > 1) GROUP BY rid
), lines AS (
  SELECT rid, unnest(range(len(own))) AS line_no, unnest(own) AS line FROM (SELECT rid, string_split(text, chr(10)) AS own FROM docs)
), sized AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word, length(replace(line, ' ', '')) AS chars,
         length(line) - length(replace(line, ' ', '')) + 1 AS n_words,
         length(line) - length(regexp_replace(line, '[{line_rules.SEPARATORS}]', '', 'g')) AS n_separators,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         right(rtrim(rtrim(right(line, {line_rules.TAIL}), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     '{line_rules.CLOSING.replace("'", "''")}'), 1) AS last
  FROM lines
), tested AS (
  SELECT *, NOT has_word OR NOT (
      n_separators >= {_RULES.separators} AND n_words <= 5 * n_separators
      OR n_words >= {_RULES.long_line} AND (last = '' OR NOT contains('{line_rules.ENDINGS}', last))
      OR {" OR ".join(f"contains(lower(line), '{phrase}')" for phrase in line_rules.BOILERPLATE)}
      OR n_words >= {_RULES.shout_words} AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}')
      OR n_symbols > {_RULES.symbol_share}::DOUBLE * chars) AS passes
  FROM sized
), judged AS (
  SELECT rid, (count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word))::BIGINT AS n_dup_lines,
         length(replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (passes), ''), ' ', '')) AS left_chars
  FROM tested GROUP BY rid
), every AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(replace(text, ' ', '')) AS text_chars, left_chars
  FROM docs JOIN worded USING (rid) JOIN judged USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words)
         AND text_chars - left_chars <= {_RULES.lost_share}::DOUBLE * text_chars AS kept
FROM every
"""

# Every character of every URL by the recursion itself: each longer context that the counts know mixes its own share in.
_UPPER, _LOWER = url_lm.UPPER, url_lm.LOWER


def _rule_sql() -> str:
    """Name of the longest rule that fits, the rules being tried from the longest on."""
    tried = sorted(url_lm.RULES, key=lambda r: -len(r.name))
    cases = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in tried
    ]
    return "CASE " + " ".join(cases) + " END"


def _mixed_sql(kind: str, n: int) -> str:
    low = f"p{n - 1}_{kind}"
    weight = f"(c.all_{kind} + c.kinds_{kind})"
    return f"CASE WHEN {weight} > 0 THEN (coalesce(s.n_{kind}, 0) + c.kinds_{kind} * {low}) / {weight} ELSE {low} END AS p{n}_{kind}"


def _level_sql(n: int) -> str:
    """Probabilities with contexts of up to n - 1 characters."""
    part = f"CASE WHEN pos >= {n} THEN substring(marked, pos - {n - 1}, {n}) END"
    context = f"CASE WHEN pos >= {n} THEN substring(marked, pos - {n - 1}, {n - 1}) END"
    return f"""level{n} AS (
  SELECT l.*, {_mixed_sql("a", n)}, {_mixed_sql("r", n)}
  FROM level{n - 1} l LEFT JOIN contexts c ON c.context = {context} LEFT JOIN counted s ON s.part = {part}
)"""


ORACLE["op9_url_lm"] = rf"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM cut
), parted AS (
  SELECT page_id, url, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substring(rest, length(raw) + 1), '^([^?#]*)', 1) AS path
  FROM hosts
), ruled AS (
  SELECT *, {_rule_sql()} AS rule FROM parted
), named AS (
  SELECT *, CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in url_lm.RULES)} END AS rule_verdict FROM ruled
), known AS (
  SELECT DISTINCT url, rule_verdict = 'allow' AS accepted FROM named WHERE rule IS NOT NULL AND length(url) <= 500
), sample AS (
  SELECT url, accepted, right(md5(url), 1) < '{url_lm.CALIBRATE}' AS calibrates FROM known
  QUALIFY row_number() OVER (PARTITION BY accepted ORDER BY md5(url), url) <= 4000
), marked AS (
  SELECT url, chr(2) || url || chr(3) AS marked FROM (SELECT url FROM sample UNION SELECT url FROM named)
), places AS (
  SELECT url, marked, unnest(range(2, length(marked) + 1)) AS pos FROM marked
), parts AS (
  SELECT accepted, substring(marked, pos - n + 1, n) AS part
  FROM sample JOIN places USING (url) JOIN range(1, {url_lm.ORDER + 2}) sizes(n) ON pos >= n WHERE NOT calibrates
), counted AS (
  SELECT part, count(*) FILTER (accepted)::DOUBLE AS n_a, count(*) FILTER (NOT accepted)::DOUBLE AS n_r FROM parts GROUP BY part
), contexts AS (
  SELECT left(part, length(part) - 1) AS context, sum(n_a) AS all_a, sum(n_r) AS all_r,
         count(*) FILTER (n_a > 0)::DOUBLE AS kinds_a, count(*) FILTER (n_r > 0)::DOUBLE AS kinds_r
  FROM counted GROUP BY context
), level0 AS (
  SELECT *, 1.0::DOUBLE / {url_lm.ALPHABET} AS p0_a, 1.0::DOUBLE / {url_lm.ALPHABET} AS p0_r FROM places
), {", ".join(_level_sql(n) for n in range(1, url_lm.ORDER + 2))}, scored AS (
  SELECT url, round(sum(ln(p{url_lm.ORDER + 1}_a) - ln(p{url_lm.ORDER + 1}_r)) / count(*), 9) AS score FROM level{url_lm.ORDER + 1} GROUP BY url
), steps AS (
  SELECT floor(score / {url_lm.STEP}::DOUBLE) AS step, count(*) FILTER (accepted) AS a, count(*) FILTER (NOT accepted) AS r
  FROM sample JOIN scored USING (url) WHERE calibrates GROUP BY step
), gains AS (
  SELECT step, sum(a) OVER () AS every_a, sum(r) OVER () AS every_r,
         sum(a) OVER (ORDER BY step DESC) AS above, coalesce(sum(r) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM steps
), best AS (
  SELECT step * {url_lm.STEP}::DOUBLE AS threshold FROM gains WHERE every_a > 0 AND every_r > 0
  ORDER BY round(above::DOUBLE / every_a + below::DOUBLE / every_r, 9) DESC, step LIMIT 1
)
SELECT page_id, host, path, rule,
       coalesce(rule_verdict, CASE WHEN score >= coalesce((SELECT threshold FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM named JOIN scored USING (url)
"""

# Turns in order; escaping adds a backslash to each control string, marks add their own length.
_MARKS = " ".join(f"WHEN '{role}' THEN length(text) + {len(opens) + len(closes) + 2}" for role, opens, closes in chat_events.TURNS)
ORACLE["op11_chat_events"] = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM given
), escaped AS (
  SELECT * EXCLUDE (text), text AS plain, regexp_replace(text, '([\[<])(\\*(?:{chat_events.TAILS}))', '\1\\\2', 'g') AS text,
         regexp_replace(role, '([\[<])(\\*(?:{chat_events.TAILS}))', '\1\\\2', 'g') AS held_role FROM numbered
), sized AS (
  SELECT *, CASE role {_MARKS} ELSE length(held_role) + length(text)
            + {len(chat_events.OTHER_OPEN) + len(chat_events.OTHER_ROLE) + len(chat_events.OTHER_CLOSE) + 4} END AS chars FROM escaped
), grouped AS (
  SELECT conv_id, alone, count(*) AS n_turns, string_agg(role || chr(10) || plain || chr(10), '' ORDER BY turn NULLS FIRST, role, plain) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN plain END, '' ORDER BY turn NULLS FIRST, role, plain), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id, alone
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM grouped
"""

ORACLE["op12_ball_tree"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs
), items AS (
  SELECT row_number() OVER () AS query, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark
), asked AS (
  SELECT query, item_id, unnest(terms) AS term FROM items
), tf AS (
  SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), scored AS (
  SELECT query, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN asked USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# Every phrase of one to four words, counted; the operator counts only what can be frequent.
ORACLE["op13_phrase_tries"] = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM cut GROUP BY lang
), counted AS (
  SELECT lang, k, words, count(*) AS f FROM (
    SELECT lang, k, unnest([words[i:i + k - 1] FOR i IN range(1, len(words) - k + 2)]) AS words FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k)
  ) GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, cut_at, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM counted WHERE k > 1) c
  JOIN counted l ON l.lang = c.lang AND l.words = c.words[1:c.cut_at] JOIN counted r ON r.lang = c.lang AND r.words = c.words[c.cut_at + 1:]
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut_at) = 1
), inner_ AS (
  SELECT DISTINCT lang, f, words[i:i + size - 1] AS words
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM counted WHERE k > 2))
), longer AS (
  SELECT lang, words, max(f) AS longer FROM inner_ GROUP BY lang, words
), kept AS (
  SELECT t.* FROM least t LEFT JOIN longer o ON t.lang = o.lang AND t.words = o.words WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * t.a
), ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM kept
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked
)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
