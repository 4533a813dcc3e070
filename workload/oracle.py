"""SQL with the same results as ``queries``, for DuckDB.

The relational definitions are written independently of the engine's array expressions: mentions come
from joins of numbered spans, support from grouped joins, signatures from unnested hashes.
"""
from __future__ import annotations

import re

from pairlens.functions import tagging as tg
from pairlens.functions import text as tx
from pairlens.sources.catalogue import KEEP_ORDER_ON_PASSIVE, RELATIONS
from workload import fixtures as fx

ORACLE: dict[str, str] = {}

SPAN = "<[A-Z]+>[^<]+</[A-Z]+>"
GROUPED = "<([A-Z]+)>([^<]+)</[A-Z]+>"
DOC_SIGS, DOC_BANDS, DOC_ROWS, DOC_K = 100, 25, 4, 7


def source(sql: str) -> str:
    for table in fx.TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]::VARCHAR[]"


def words(expr: str) -> str:
    """Space-separated words; enough for the derived sentences, whose punctuation stands alone."""
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '')"


def treebank(expr: str) -> str:
    """The word rules as nested replacements; rewrites know nine groups, so contractions go one by one."""
    for n, (pattern, replacement) in enumerate(tx.PTB_RULES):
        if n == 5:
            expr = f"(' ' || {expr} || ' ')"
        elif n in (10, 11):
            parts = ["can|not", "gim|me", "gon|na", "got|ta", "lem|me", "wan|na"] if n == 10 else ["d|'ye", "mor|'n"]
            for part in parts:
                left, right = part.split("|")
                expr = f"regexp_replace({expr}, {quote(rf'(?i)\b({left})({right})\b')}, '\\1 \\2', 'g')"
        else:
            expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
    return rf"list_filter(string_split_regex({expr}, '\s+'), lambda w: w <> '')"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


IN_USE = [r for r in RELATIONS if r[0] in fx.RELATIONS_IN_USE]
KEEP = ", ".join(quote(r) for r in KEEP_ORDER_ON_PASSIVE)
STOPS = sql_list(tx.BAD_TOKENS + tx.STOP_WORDS)

CTES = {
    "catalogue": (
        (),
        "SELECT * FROM (VALUES "
        + values([(quote(r[0]), quote(r[1]), quote(r[2]), sql_list(r[3]), sql_list(r[4])) for r in IN_USE])
        + ") AS t(rel_type, e1_type, e2_type, unigrams, bigrams)",
    ),
    "sent": ((), "SELECT *, row_number() OVER () AS rid FROM (" + source(fx.SENTENCES) + ")"),
    "kb": ((), "SELECT DISTINCT * FROM (" + source(fx.KB) + ")"),
    "orderfacts": ((), source(fx.ORDER_FACTS)),
    "spans": (
        ("sent",),
        f"""SELECT *, string_split_regex(text, '{SPAN}') AS seg, regexp_extract_all(text, '{GROUPED}', 2) AS nm,
                   regexp_extract_all(text, '{GROUPED}', 1) AS ty,
                   {words("regexp_replace(text, '</?[A-Z]+>', '', 'g')")} AS toks FROM sent""",
    ),
    # One row per tagged name: its token position, and its position when every name is one token.
    "ent": (
        ("spans",),
        f"""SELECT rid, k, nm[k] AS s, ty[k] AS ty, len({words("nm[k]")}) AS n,
                   list_sum(list_transform(seg[1:k], lambda g: len({words("g")}))) AS before,
                   coalesce(list_sum(list_transform(nm[1:k-1], lambda g: len({words("g")}))), 0) AS names_before
            FROM (SELECT *, unnest(range(1, len(nm) + 1)) AS k FROM spans)""",
    ),
    "pos": (("ent",), "SELECT rid, k, s, ty, n, before + names_before AS p, before + k - 1 AS tp FROM ent"),
    "near": (
        ("pos",),
        """SELECT DISTINCT a.rid, a.ty AS e1_type, b.ty AS e2_type, a.s AS e1, b.s AS e2
           FROM pos a JOIN pos b ON a.rid = b.rid AND b.tp - a.tp BETWEEN 1 AND 6""",
    ),
    "adjacent": (
        ("pos",),
        """SELECT a.rid, a.s AS e1, a.ty AS e1_type, b.s AS e2, b.ty AS e2_type, b.p - a.p AS gap,
                  a.p AS p1, a.p + a.n AS q1, b.p AS p2, b.p + b.n AS q2
           FROM pos a JOIN pos b ON a.rid = b.rid AND b.k = a.k + 1""",
    ),
    "men": (
        ("adjacent", "spans"),
        f"""SELECT * FROM (
              SELECT m.*, s.sent_id, s.rel_type, s.text, s.score, s.in_s, s.passive,
                     list_slice(toks, greatest(p1 - 1, 1), p1) AS bef, list_slice(toks, q1 + 1, p2) AS bet,
                     list_slice(toks, q2 + 1, q2 + 2) AS aft,
                     list_slice(toks, greatest(p1 - 2, 1), p1) AS bef3, list_slice(toks, q2 + 1, q2 + 3) AS aft3
              FROM adjacent m JOIN spans s ON m.rid = s.rid
              WHERE gap BETWEEN 1 AND 6 AND e1 <> e2)
            WHERE len(list_filter(bet, lambda w: NOT list_contains({STOPS}, w))) > 0""",
    ),
    "typed": (("men", "catalogue"), "SELECT m.* FROM men m SEMI JOIN catalogue USING (e1_type, e2_type)"),
    "facts": (
        ("typed", "catalogue"),
        f"""SELECT DISTINCT rel_type, CASE WHEN turn THEN e2 ELSE e1 END AS e1, CASE WHEN turn THEN e1 ELSE e2 END AS e2,
                   score, bef, bet, aft, sentence
            FROM (SELECT m.rel_type, m.e1, m.e2, m.score, array_to_string(bef, ' ') AS bef,
                         array_to_string(bet, ' ') AS bet, array_to_string(aft, ' ') AS aft, m.text AS sentence,
                         m.passive AND m.rel_type NOT IN ({KEEP}) AS turn
                  FROM typed m JOIN catalogue c ON m.rel_type = c.rel_type
                  WHERE in_s AND score >= 0.5
                    AND ((m.e1_type = c.e1_type AND m.e2_type = c.e2_type)
                         OR (m.passive AND m.e1_type = c.e2_type AND m.e2_type = c.e1_type)))""",
    ),
    "superset": (
        ("typed", "near"),
        """SELECT t.e1_type, t.e2_type, t.e1, t.e2, bef, bet, aft, count(*) AS n, count(n.rid) AS n_near
           FROM typed t LEFT JOIN near n ON t.rid = n.rid AND t.e1 = n.e1 AND t.e2 = n.e2
                AND t.e1_type = n.e1_type AND t.e2_type = n.e2_type
           GROUP BY ALL""",
    ),
    "flagged": (
        ("superset", "catalogue"),
        """SELECT *, in_bet OR list_has_any(bef, unigrams) OR list_has_any(aft, unigrams) AS in_context
           FROM (SELECT s.*, rel_type, unigrams,
                        list_has_any(bet, unigrams) OR list_has_any(list_transform(range(1, len(bet)),
                            lambda i: bet[i] || ' ' || bet[i + 1]), bigrams) AS in_bet
                 FROM superset s JOIN catalogue c ON s.e1_type = c.e1_type AND s.e2_type = c.e2_type)""",
    ),
    "pairs": (
        ("flagged",),
        """SELECT rel_type, e1, e2, count(*) FILTER (in_context) AS keyword_mentions, sum(n_near)::BIGINT AS total,
                  coalesce(sum(n_near) FILTER (in_bet), 0)::BIGINT AS with_word
           FROM flagged GROUP BY ALL""",
    ),
    # The markup between names that are no neighbours makes more than six tokens, so no phrase there.
    "hits": (
        ("pos", "spans"),
        f"""SELECT s.sent_id, a.ty AS e1_type, b.ty AS e2_type, a.s AS e1, b.s AS e2,
                   CASE WHEN b.k = a.k + 1 AND len({words("seg[b.k]")}) BETWEEN 1 AND 6
                        THEN array_to_string({words("seg[b.k]")}, ' ') END AS phrase
            FROM pos a JOIN pos b ON a.rid = b.rid AND b.tp - a.tp BETWEEN 1 AND 6 JOIN spans s ON a.rid = s.rid""",
    ),
    "pairhits": (("hits",), "SELECT e1_type, e2_type, e1, e2, count(*) AS pair_hits FROM hits GROUP BY ALL"),
    "phrasehits": (
        ("hits",),
        "SELECT e1_type, e2_type, e1, e2, phrase, count(*) AS phrase_hits FROM hits WHERE phrase IS NOT NULL GROUP BY ALL",
    ),
    "verdicts": (
        ("facts", "pairhits", "phrasehits", "catalogue"),
        """SELECT rel_type, e1, e2, bet, n_facts, phrase_hits, pair_hits, listed,
                  pair_hits > 0 AND (phrase_hits / nullif(pair_hits, 0) >= 0.65 OR listed) AS supported
           FROM (SELECT f.rel_type, f.e1, f.e2, f.bet, n_facts, coalesce(phrase_hits, 0) AS phrase_hits,
                        coalesce(pair_hits, 0) AS pair_hits,
                        list_contains(unigrams, trim(bet)) OR list_contains(bigrams, trim(bet)) AS listed
                 FROM (SELECT rel_type, e1, e2, bet, count(*) AS n_facts FROM facts GROUP BY ALL) f
                 JOIN catalogue c ON f.rel_type = c.rel_type
                 LEFT JOIN pairhits p ON p.e1 = f.e1 AND p.e2 = f.e2 AND p.e1_type = c.e1_type AND p.e2_type = c.e2_type
                 LEFT JOIN phrasehits h ON h.e1 = f.e1 AND h.e2 = f.e2 AND h.e1_type = c.e1_type
                      AND h.e2_type = c.e2_type AND h.phrase = f.bet)""",
    ),
    "regions": (
        ("facts", "verdicts", "kb"),
        """SELECT f.*, CASE WHEN k.e1 IS NOT NULL THEN 'b' WHEN v.supported THEN 'a' ELSE 'not_found' END AS region
           FROM facts f JOIN verdicts v USING (rel_type, e1, e2, bet) LEFT JOIN kb k USING (rel_type, e1, e2)""",
    ),
    "missed": (
        ("pairs", "regions", "kb"),
        """SELECT rel_type, e1, e2, 'c' AS region, keyword_mentions FROM pairs SEMI JOIN kb USING (rel_type, e1, e2)
             ANTI JOIN (SELECT * FROM regions WHERE region = 'b') USING (rel_type, e1, e2) WHERE keyword_mentions > 0
           UNION ALL
           SELECT rel_type, e1, e2, 'd' AS region, keyword_mentions FROM pairs ANTI JOIN kb USING (rel_type, e1, e2)
             ANTI JOIN (SELECT * FROM regions WHERE region = 'a') USING (rel_type, e1, e2)
           WHERE keyword_mentions > 0 AND total > 0 AND with_word / total >= 0.65""",
    ),
    "truth": (
        ("missed", "regions"),
        "SELECT rel_type, e1, e2 FROM regions WHERE region IN ('a', 'b') UNION SELECT rel_type, e1, e2 FROM missed",
    ),
    "sizes": (
        ("catalogue", "regions", "missed", "truth"),
        """SELECT c.rel_type, coalesce(s, 0) AS s, coalesce(a, 0) AS a, coalesce(b, 0) AS b,
                  coalesce(not_found, 0) AS not_found, coalesce(cm, 0)::BIGINT AS c, coalesce(dm, 0)::BIGINT AS d,
                  coalesce(c_pairs, 0) AS c_pairs, coalesce(d_pairs, 0) AS d_pairs, coalesce(g_pairs, 0) AS g_pairs
           FROM catalogue c
           LEFT JOIN (SELECT rel_type, count(*) AS s, count(*) FILTER (region = 'a') AS a,
                             count(*) FILTER (region = 'b') AS b, count(*) FILTER (region = 'not_found') AS not_found
                      FROM regions GROUP BY rel_type) r ON c.rel_type = r.rel_type
           LEFT JOIN (SELECT rel_type, sum(keyword_mentions) FILTER (region = 'c') AS cm,
                             sum(keyword_mentions) FILTER (region = 'd') AS dm,
                             count(*) FILTER (region = 'c') AS c_pairs, count(*) FILTER (region = 'd') AS d_pairs
                      FROM missed GROUP BY rel_type) m ON c.rel_type = m.rel_type
           LEFT JOIN (SELECT rel_type, count(*) AS g_pairs FROM truth GROUP BY rel_type) g ON c.rel_type = g.rel_type""",
    ),
    "metrics": (
        ("sizes",),
        """SELECT rel_type, s, a, b, p AS precision, r AS recall,
                  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1
           FROM (SELECT *, CASE WHEN s > 0 AND a + b > 0 THEN (a + b) / s ELSE 0.0 END AS p,
                        CASE WHEN s > 0 AND a + b > 0 THEN (a + b) / (a + b + c_pairs + d_pairs) ELSE 0.0 END AS r
                 FROM sizes)""",
    ),
    # Whole documents as distinct hashes of their character 4-grams.
    "grams": (
        (),
        """SELECT rel_id, rel_type, unnest(list_transform(range(1, len(c) - 2),
                  lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3] || '_BET')) AS gram
           FROM (SELECT rel_id, rel_type, string_split(replace(text, ' ', '_'), '') AS c FROM (""" + source(fx.PASSAGES) + "))",
    ),
    "hashes": (
        ("grams",),
        """SELECT DISTINCT rel_id, rel_type, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS h FROM grams""",
    ),
    "coef": (
        (),
        f"""SELECT k - 1 AS position, 1 + ('0x' || substr(md5('a' || k), 1, 8))::BIGINT % 2147483646 AS a,
                   ('0x' || substr(md5('b' || k), 1, 8))::BIGINT % 2147483647 AS b
            FROM range(1, {DOC_SIGS + 1}) AS t(k)""",
    ),
    "sig": (
        ("hashes", "coef"),
        """SELECT rel_id, any_value(rel_type) AS rel_type, position, min((h * a + b) % 2147483647) AS value
           FROM hashes, coef GROUP BY rel_id, position""",
    ),
    "chunks": (
        ("sig",),
        f"""SELECT rel_id, any_value(rel_type) AS rel_type, position // {DOC_ROWS} AS band,
                   list_sort(list(value)) AS chunk FROM sig GROUP BY rel_id, position // {DOC_ROWS}""",
    ),
    "buckets": (
        ("chunks",),
        "SELECT band, chunk, max(rel_id) AS rel_id FROM chunks WHERE rel_type IS NOT NULL GROUP BY band, chunk",
    ),
    "cand": (
        ("chunks", "buckets"),
        """SELECT q.rel_id AS query_id, b.rel_id, count(*) AS shared_bands
           FROM chunks q JOIN buckets b ON q.band = b.band AND q.chunk = b.chunk WHERE q.rel_type IS NULL GROUP BY ALL""",
    ),
    "scored": (
        ("cand", "sig"),
        f"""SELECT query_id, c.rel_id, any_value(o.rel_type) AS rel_type,
                   count(*) FILTER (q.value = o.value) / {DOC_SIGS}.0 AS similarity
            FROM cand c JOIN sig q ON q.rel_id = c.query_id JOIN sig o ON o.rel_id = c.rel_id AND o.position = q.position
            GROUP BY query_id, c.rel_id""",
    ),
    "topk": (
        ("scored",),
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rel_id) AS rank
                           FROM scored) WHERE rank <= {DOC_K}""",
    ),
    "votes": (
        ("topk",),
        "SELECT query_id, rel_type, count(*) AS votes, sum(similarity) AS weight FROM topk GROUP BY query_id, rel_type",
    ),
    "winner": (
        ("votes",),
        """SELECT query_id, rel_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id
             ORDER BY votes DESC, round(weight, 9) DESC, rel_type) AS place FROM votes) WHERE place = 1""",
    ),
}


def needed(names, seen: list[str]) -> list[str]:
    for name in names:
        needed(CTES[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def oracle(name: str, sql: str, *ctes: str) -> None:
    parts = [f"{c} AS MATERIALIZED ({CTES[c][1]})" for c in needed(ctes, [])]
    ORACLE[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


FACT_COLUMNS = "rel_type, e1, e2, score, bef, bet, aft, sentence"
BAGGED = "array_to_string(bef, ' ') AS bef, array_to_string(bet, ' ') AS bet, array_to_string(aft, ' ') AS aft"
MENTION = f"e1, e1_type, e2, e2_type, {BAGGED}"
ROUNDED = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"

# -- sources
oracle("read_tagged_corpus", "SELECT text FROM sent", "sent")
oracle(
    "read_system_output",
    """SELECT CASE WHEN passive THEN e2 ELSE e1 END AS e1, CASE WHEN passive THEN e1 ELSE e2 END AS e2,
              round(score, 9) AS score, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Today' END AS bef, bet, '' AS aft,
              'Today ' || e1 || ' ' || bet || ' ' || e2 AS sentence, passive
       FROM orderfacts WHERE score >= 0.5""",
    "orderfacts",
)
oracle("read_classified_output", "SELECT e1, e2, rel_type, bet FROM orderfacts", "orderfacts")
KB_ROWS = {
    "read_kb_ntriples": """SELECT 'Supplier ' || s_suppkey AS e1, unnest(['NATION ' || s_nationkey, 'City ' || s_suppkey % 5]) AS e2
                           FROM supplier""",
    "read_kb_freebase": "SELECT 'Supplier ' || s_suppkey AS e1, 'NATION ' || s_nationkey AS e2 FROM supplier",
    "read_kb_manual": "SELECT 'Supplier ' || s_suppkey AS e1, 'Town ' || s_suppkey % 3 AS e2 FROM supplier",
}
KB_ROWS["read_kb_yago"] = KB_ROWS["read_kb_ntriples"]
for kb_name, kb_sql in KB_ROWS.items():
    oracle(kb_name, kb_sql)
EVERY_KB = " UNION ".join(KB_ROWS.values())
oracle("union_kb", EVERY_KB)
oracle(
    "load_kb",
    f"""SELECT 'has-installations' AS rel_type, e1, e2 FROM ({EVERY_KB})
        UNION SELECT 'has-installations2', e2, e1
              FROM ({KB_ROWS['read_kb_ntriples']} UNION {KB_ROWS['read_kb_freebase']})
        UNION SELECT 'has-installations2', e1, e2 FROM ({KB_ROWS['read_kb_manual']})""",
)
oracle("symmetric_relation", f"SELECT e1, e2 FROM ({KB_ROWS['read_kb_freebase']}) UNION ALL SELECT e2, e1 FROM ({KB_ROWS['read_kb_freebase']})")
oracle("quarantined_lines", "SELECT 'broken line ' || s_suppkey AS line FROM supplier WHERE s_suppkey % 9 = 0")
for reader, broken in (
    ("training", fx.BAD_TRAINING_LINES), ("features", fx.BAD_FEATURE_LINES), ("classified", fx.BAD_CLASSIFIED_RECORDS),
    ("shingles", fx.BAD_SHINGLE_RECORDS), ("positives", fx.BAD_POSITIVE_RECORDS),
):
    oracle(f"quarantined_{reader}", f"SELECT value FROM ({source(broken)})")
oracle("normalise_kb_name", "SELECT s_name || '_(id_' || s_suppkey || ')_x' AS raw, s_name || '  x' AS name FROM supplier")
oracle("kb_multimap", "SELECT rel_type, e1, string_agg(e2, '|' ORDER BY e2) AS objects FROM kb GROUP BY rel_type, e1", "kb")
oracle(
    "relation_catalogue",
    """SELECT rel_type, count(*) AS mentions, max(len(unigrams)) AS unigrams, max(len(bigrams)) AS bigrams
       FROM (SELECT c.* FROM typed t JOIN catalogue c ON t.e1_type = c.e1_type AND t.e2_type = c.e2_type)
       GROUP BY rel_type""",
    "typed",
)
TAGGED_ORDER = "'<PER>' || e1 || '</PER> ' || bet || ' <ORG>' || e2 || '</ORG> last month .'"
oracle("read_training", f"SELECT o_orderkey AS rel_id, rel_type, e1, e2, {TAGGED_ORDER} AS sentence FROM orderfacts", "orderfacts")
oracle("read_features", "SELECT p_partkey AS rel_id, p_type AS rel_type, replace(p_name, ' ', '|') || '|' || p_brand AS shingles FROM part")
oracle("read_shingle_records", "SELECT p_brand AS e1, p_type AS e2, p_name AS sentence, replace(p_name, ' ', '|') || '|' || p_size || '_SIZE' AS shingles FROM part")
oracle("read_unlabelled_sentences", "SELECT 'order ' || o_orderkey AS text FROM orders WHERE o_orderkey % 10 > 1")
oracle("facts_to_training", f"SELECT DISTINCT rel_type, e1, e2, {TAGGED_ORDER} AS sentence FROM orderfacts WHERE NOT (passive AND rel_type IN ({KEEP}))", "orderfacts")

# -- text to mentions
oracle("strip_tags", "SELECT regexp_replace(text, '</?[A-Z]+>', '', 'g') AS plain FROM sent", "sent")
oracle("tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {treebank('text')} AS t FROM documents)")
oracle("extract_entities", "SELECT s, ty FROM ent", "ent")
oracle("has_two_entities", "SELECT text FROM spans WHERE len(nm) >= 2", "spans")
oracle("locate_entities", "SELECT s, ty, p::BIGINT AS pos, n AS len FROM pos", "pos")
oracle("distinct_entities", "SELECT s, ty, count(*) AS sentences FROM (SELECT DISTINCT rid, s, ty FROM ent) GROUP BY s, ty", "ent")
ADJ = "SELECT e1, e1_type, e2, e2_type, gap::BIGINT AS gap FROM adjacent"
oracle("candidate_pairs", ADJ, "adjacent")
oracle("distance_filter", f"{ADJ} WHERE gap BETWEEN 1 AND 6 AND e1 <> e2", "adjacent")
oracle("type_filter", f"{ADJ} WHERE gap BETWEEN 1 AND 6 AND e1 <> e2 AND e2_type = 'ORG' AND e1_type IN ('PER', 'ORG')", "adjacent")
oracle("distinct_arguments", "SELECT nm[1] AS e1, nm[-1] AS e2 FROM spans", "spans")
oracle("extract_mentions", f"SELECT sent_id, {MENTION} FROM typed", "typed")
oracle("context_windows", f"SELECT DISTINCT e1, e1_type, e2, e2_type, array_to_string(bef3, ' ') AS bef, array_to_string(bet, ' ') AS bet, array_to_string(aft3, ' ') AS aft FROM men", "men")
oracle(
    "relational_bet",
    f"""SELECT bet, len(list_filter({words('bet')}, lambda w: NOT list_contains({STOPS}, w))) > 0 AS relational, count(*) AS n
        FROM (SELECT trim(seg[2]) AS bet FROM spans) GROUP BY ALL""",
    "spans",
)
oracle("distinct_mentions", f"SELECT {MENTION}, count(*) AS n FROM typed GROUP BY e1, e1_type, e2, e2_type, typed.bef, typed.bet, typed.aft", "typed")
oracle("adjacent_entities", "SELECT s AS e1, e2, count(*) AS n FROM (SELECT s, lead(s) OVER (PARTITION BY rid ORDER BY p) AS e2 FROM pos) WHERE e2 IS NOT NULL GROUP BY s, e2", "pos")
oracle("order_positions", "SELECT string_agg(p::BIGINT::VARCHAR, ' ' ORDER BY p) AS positions FROM pos GROUP BY rid", "pos")
oracle("known_pair_locations", "SELECT o_orderkey AS rel_id, '' AS bef, bet, 'last month .' AS aft FROM orderfacts", "orderfacts")
oracle(
    "token_bigrams",
    f"""SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram
        FROM (SELECT {treebank("array_to_string(t, ' ')")} AS t FROM (SELECT {treebank('text')} AS t FROM documents))) GROUP BY bigram""",
)

# -- knowledge base and corpus support
oracle("score_threshold", "SELECT e1, e2, bet FROM orderfacts WHERE score >= 0.5", "orderfacts")
oracle(
    "orient_arguments",
    """SELECT o_orderkey, CASE WHEN passive AND o_orderkey % 2 = 1 THEN e2 ELSE e1 END AS e1,
              CASE WHEN passive AND o_orderkey % 2 = 1 THEN e1 ELSE e2 END AS e2 FROM orderfacts""",
    "orderfacts",
)
oracle("distinct_facts", f"SELECT {FACT_COLUMNS} FROM facts", "facts")
oracle("rank_facts", "SELECT rel_type, e1, e2, score, sentence FROM facts ORDER BY score DESC, rel_type, e1, e2, sentence", "facts")
oracle("facts_in_kb", f"SELECT {FACT_COLUMNS} FROM facts SEMI JOIN kb USING (rel_type, e1, e2)", "facts", "kb")
oracle("facts_not_in_kb", f"SELECT {FACT_COLUMNS} FROM facts ANTI JOIN kb USING (rel_type, e1, e2)", "facts", "kb")
oracle("keyword_context_filter", f"SELECT rel_type, {MENTION}, n FROM flagged WHERE in_context", "flagged")
oracle("superset_in_kb", f"SELECT rel_type, {MENTION} FROM flagged SEMI JOIN kb USING (rel_type, e1, e2) WHERE in_context", "flagged", "kb")
oracle("superset_not_in_kb", f"SELECT rel_type, {MENTION} FROM flagged ANTI JOIN kb USING (rel_type, e1, e2) WHERE in_context", "flagged", "kb")
oracle("proximity_hits", "SELECT sent_id, e1_type, e2_type, e1, e2, phrase FROM hits", "hits")
oracle(
    "phrase_counts",
    """SELECT e1_type, e2_type, e1, e2, phrase, phrase_hits AS hits FROM phrasehits
       UNION ALL SELECT e1_type, e2_type, e1, e2, '', pair_hits FROM pairhits""",
    "phrasehits", "pairhits",
)
oracle("pmi_relational_words", "SELECT rel_type, e1, e2, total, with_word FROM pairs WHERE total > 0 AND with_word / total >= 0.65", "pairs")
oracle("pmi_exact_phrase", "SELECT rel_type, e1, e2, bet, phrase_hits, pair_hits, supported FROM verdicts", "verdicts")
oracle("pmi_for_facts", "SELECT rel_type, e1, e2, bet, n_facts, pair_hits AS hits FROM verdicts WHERE pair_hits > 0", "verdicts")
oracle("verdict_fallback", "SELECT rel_type, e1, e2, bet FROM verdicts WHERE pair_hits > 0 AND listed AND phrase_hits / pair_hits < 0.65", "verdicts")
oracle("verdict_join_back", f"SELECT {FACT_COLUMNS}, region FROM regions", "regions")
oracle("missed_kb_facts", "SELECT rel_type, e1, e2 FROM missed WHERE region = 'c'", "missed")
oracle("missed_new_facts", "SELECT rel_type, e1, e2 FROM missed WHERE region = 'd'", "missed")
oracle("distinct_pairs", "SELECT DISTINCT rel_type, region, e1, e2 FROM missed", "missed")
oracle("ground_truth_estimate", "SELECT rel_type, e1, e2 FROM truth", "truth")
oracle("region_sizes", "SELECT * FROM sizes", "sizes")
oracle("evaluation_metrics", f"SELECT rel_type, s, a, b, {ROUNDED} FROM metrics", "metrics")
oracle("collect_results", f"SELECT 200 AS sigs, 25 AS bands, 7 AS k, rel_type, {ROUNDED} FROM metrics", "metrics")
RESULT = "SELECT rel_type, e1, e2, score, sentence, bet FROM regions WHERE region"
oracle("write_positives", f"{RESULT} IN ('a', 'b') ORDER BY score DESC", "regions")
oracle("write_negatives", f"{RESULT} = 'not_found' ORDER BY score DESC", "regions")
oracle("union_positives", "SELECT rel_type, region, count(*) AS facts FROM regions WHERE region IN ('a', 'b') GROUP BY ALL", "regions")
oracle(
    "inspect_high_pmi",
    """SELECT rel_type, e1, e2, keyword_mentions AS mentions FROM pairs ANTI JOIN kb USING (rel_type, e1, e2)
       WHERE keyword_mentions > 0 AND total > 0 AND with_word / total >= 0.65""",
    "pairs", "kb",
)
oracle(
    "materialise_superset",
    " UNION ALL ".join(
        f"""SELECT {w} AS context_window, e1_type, e2_type, count(*) AS mentions, sum(n)::BIGINT AS n
            FROM (SELECT e1_type, e2_type, e1, e2, typed.{bef}, bet, typed.{aft}, count(*) AS n FROM typed GROUP BY ALL)
            GROUP BY e1_type, e2_type"""
        for w, bef, aft in ((2, "bef", "aft"), (3, "bef3", "aft3"))
    ),
    "typed",
)
oracle(
    "materialise_kb_split",
    " UNION ALL ".join(
        f"""SELECT '{words_in}' AS words, rel_type, known, count(*) AS pairs, sum(keyword_mentions)::BIGINT AS keyword_mentions
            FROM (SELECT rel_type, e1, e2, bool_or(known) AS known, sum(keyword_mentions) AS keyword_mentions
                  FROM (SELECT rel_type, e1, e2, false AS known, keyword_mentions FROM pairs WHERE {keep}
                        UNION ALL SELECT rel_type, e1, e2, true, 0 FROM kb) GROUP BY rel_type, e1, e2)
            GROUP BY rel_type, known"""
        for words_in, keep in (("all", "true"), ("one", "rel_type = 'has-installations'"))
    ),
    "pairs", "kb",
)
oracle(
    "materialise_high_pmi",
    " UNION ALL ".join(
        f"""SELECT {t}::DOUBLE AS threshold, rel_type, e1, e2, keyword_mentions AS mentions FROM pairs ANTI JOIN kb USING (rel_type, e1, e2)
            WHERE keyword_mentions > 0 AND total > 0 AND with_word / total >= {t}"""
        for t in (0.65, 0.9)
    ),
    "pairs", "kb",
)
oracle(
    "data_checks",
    """SELECT * FROM (VALUES
         ('facts_in_one_region', 'error', (SELECT count(*) FROM sizes WHERE s <> a + b + not_found)),
         ('region_c_not_empty', 'warning', (SELECT count(*) FROM sizes WHERE s > 0 AND c_pairs = 0)),
         ('region_d_not_empty', 'warning', (SELECT count(*) FROM sizes WHERE s > 0 AND d_pairs = 0)),
         ('word_hits_within_hits', 'error', (SELECT count(*) FROM pairs WHERE with_word > total)),
         ('pair_in_a_or_b', 'error', (SELECT count(*) FROM (SELECT rel_type, e1, e2 FROM regions WHERE region = 'a'
                                      INTERSECT SELECT rel_type, e1, e2 FROM regions WHERE region = 'b'))),
         ('phrase_hits_within_hits', 'error', (SELECT count(*) FROM verdicts WHERE phrase_hits > pair_hits))
       ) AS t("check", level, failures)""",
    "sizes", "pairs", "regions", "verdicts",
)
oracle(
    "macro_average",
    """SELECT k, round(avg(f1), 9) AS macro_f1, count(*) AS relations
       FROM (SELECT k, rel_type, count(*) FILTER (region IN ('a', 'b')) / count(*) AS f1
             FROM regions, (VALUES (1), (3), (5), (7)) AS t(k) WHERE score >= 0.5 + k / 20 GROUP BY k, rel_type)
       GROUP BY k""",
    "regions",
)

# -- features
oracle(
    "tag_with_lexicon",
    """SELECT p_partkey, string_agg(w || '/' || CASE WHEN w IN (SELECT lower(p_type) FROM part) THEN 'NNP' ELSE tag END, ' ' ORDER BY i) AS tagged
       FROM (SELECT *, CASE WHEN w LIKE '%ing' THEN 'VBG' WHEN w LIKE '%ed' THEN 'VBN'
                            WHEN regexp_matches(w, '(ous|ful|ive|able|ible|ical|ish|less|large)$') THEN 'JJ'
                            WHEN regexp_matches(w, '[^s]s$') THEN 'NNS' ELSE 'NN' END AS tag
             FROM (SELECT p_partkey, t[i] AS w, i
                   FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i
                         FROM (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS t FROM part))))
       GROUP BY p_partkey""",
)
oracle("entity_type_shingles", "SELECT unnest([e1_type || '_ENTITY1', e2_type || '_ENTITY2']) AS shingle, count(*) AS n FROM typed GROUP BY shingle", "typed")
oracle("char_4grams", "SELECT gram, count(*) AS n, count(DISTINCT rel_id) AS docs FROM grams GROUP BY gram", "grams")

# -- similarity classification
oracle("hash_family", "SELECT h, count(*) AS docs FROM hashes GROUP BY h", "hashes")
oracle("minhash_signature", "SELECT rel_id, position, value FROM sig", "sig")
oracle("sort_band_chunk", "SELECT rel_id, band, array_to_string(chunk, ' ') AS chunk FROM chunks", "chunks")
oracle("band_keys", "SELECT band, count(*) AS members, min(rel_id) AS first_id FROM chunks GROUP BY band, chunk", "chunks")
oracle("bucket_last_writer", "SELECT band, rel_id FROM buckets", "buckets")
oracle("build_lsh_index", "SELECT rel_id, count(*) AS buckets FROM buckets GROUP BY rel_id", "buckets")
oracle("band_join", "SELECT query_id, rel_id, shared_bands FROM cand", "cand")
oracle("candidate_signatures", "SELECT query_id, c.rel_id, s.rel_type, s.value AS first_value FROM cand c JOIN sig s ON c.rel_id = s.rel_id WHERE position = 0", "cand", "sig")
oracle("signature_similarity", "SELECT query_id, rel_id, round(similarity, 9) AS similarity FROM scored", "scored")
oracle("top_k_neighbours", "SELECT query_id, rel_id, rank FROM topk", "topk")
oracle("vote_counts", "SELECT query_id, rel_type, votes FROM votes", "votes")
oracle("knn_vote", "SELECT query_id, rel_type, votes FROM winner", "winner")
oracle(
    "classify_features",
    """SELECT q.rel_id AS query_id, coalesce(w.rel_type, 'None') AS rel_type, coalesce(votes, 0) AS votes
       FROM (""" + source(fx.PASSAGES) + """) q LEFT JOIN winner w ON q.rel_id = w.query_id WHERE q.rel_type IS NULL""",
    "winner",
)


# -- features of the derived sentences: tags of their few words, written out
BET_WORDS = {
    "is": ("VBZ", "be"), "based": ("VBN", "base"), "in": ("IN", "in"), "has": ("VBZ", "have"), "was": ("VBD", "be"),
    "offices": ("NNS", "office"), "headquarters": ("NNS", "headquarter"), "keeps": ("VBZ", "keep"),
    "head": ("NN", "head"), "office": ("NN", "office"), "opened": ("VBN", "open"), "sold": ("VBD", "sell"),
    "goods": ("NNS", "good"), "to": ("TO", "to"), "ships": ("VBZ", "ship"), "a": ("DT", "a"), "very": ("RB", "very"),
    "large": ("JJ", "large"), "number": ("NN", "number"), "of": ("IN", "of"), "boxes": ("NNS", "box"),
    "founded": ("VBN", "found"), "by": ("IN", "by"), "graduated": ("VBN", "graduate"), "from": ("IN", "from"),
    "the": ("DT", "the"), "chairman": ("NN", "chairman"), "works": ("VBZ", "work"), "for": ("IN", "for"),
    "co-founded": ("VBN", "co-found"), "which": ("WDT", "which"), "acquired": ("VBN", "acquire"),
    "met": ("VBD", "meet"), ",": (",", ","), "and": ("CC", "and"),
}
WORD_TABLE = "(VALUES " + values([(quote(w), quote(t), quote(m)) for w, (t, m) in BET_WORDS.items()]) + ") AS t(w, tag, lemma)"
# One letter per tag class: v(erb), r adverb, p(article), w filler, a(dposition), x other.
CLASS = """CASE WHEN tag LIKE 'V%' THEN 'v' WHEN tag LIKE 'RB%' OR tag = 'WRB' THEN 'r' WHEN tag IN ('TO', 'RP', 'POS') THEN 'p'
                WHEN tag LIKE 'NN%' OR tag LIKE 'JJ%' OR tag IN ('DT', 'WDT', 'PRP', 'PRP$', 'WP', 'EX') THEN 'w' WHEN tag = 'IN' THEN 'a' ELSE 'x' END"""
CTES["bets"] = (
    ("typed",),
    "SELECT array_to_string(bet, ' ') AS bet, any_value(bet) AS words, count(*) AS n FROM typed GROUP BY array_to_string(bet, ' ')",
)
CTES["bettags"] = (
    ("bets",),
    f"""SELECT bet, any_value(n) AS n, list(w ORDER BY i) AS w, list(tag ORDER BY i) AS tag, list(lemma ORDER BY i) AS lemma,
               string_agg({CLASS}, '' ORDER BY i) AS classes
        FROM (SELECT bet, n, i, words[i] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM bets))
        JOIN {WORD_TABLE} ON word = w GROUP BY bet""",
)
# A phrase is v[vrp]*[wr]*[ap]*; the letter after it is used up.  Marks: kept letters in upper case.
CTES["phrases"] = (
    ("bettags",),
    r"""SELECT *, list_filter(range(1, len(classes) + 1), lambda i: regexp_matches(marked[i], '[A-Z]')) AS kept
        FROM (SELECT *, string_split(array_to_string(list_transform(
                 regexp_extract_all(classes, 'v[vrp]*[wr]*[ap]*.?|.'),
                 lambda p: CASE WHEN p NOT LIKE 'v%' THEN p
                                ELSE upper(regexp_extract(p, '^v[vrp]*[wr]*[ap]*')) ||
                                     substr(p, length(regexp_extract(p, '^v[vrp]*[wr]*[ap]*')) + 1) END), ''), '') AS marked
              FROM bettags)""",
)
PHRASE = "list_transform(kept, lambda i: {})"
oracle(
    "relation_phrase",
    f"SELECT bet, array_to_string({PHRASE.format('''w[i] || '/' || tag[i] || '/' || lemma[i]''')}, ' ') AS phrase, n FROM phrases",
    "phrases",
)
PASSIVE = """len(kept) >= 2 AND w[kept[-1]] = 'by' AND CASE WHEN len(kept) = 2 THEN tag[kept[-2]] IN ('VBN', 'VBD')
             ELSE tag[kept[-2]] IN ('VBN', 'VBD') OR (lemma[kept[1]] = 'be' AND tag[kept[2]] IN ('VBN', 'VBD')) END"""
oracle("passive_voice", f"SELECT bet, coalesce({PASSIVE}, false) AS passive FROM phrases", "phrases")
oracle(
    "phrase_shingles",
    f"""SELECT bet, CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string({PHRASE.format('w[i]')}, '_') ||
                   CASE WHEN coalesce({PASSIVE}, false) THEN '_RVB_PASSIVE ' ELSE '_RVB ' END ||
                   array_to_string({PHRASE.format('lemma[i]')}, '_') || '_RVB_NORM' END AS shingles FROM phrases""",
    "phrases",
)


def per_word(name: str, keep: str, form: str) -> None:
    oracle(
        name,
        f"""SELECT bet, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: {keep}),
                   lambda i: {form}), ' ') AS shingles FROM bettags""",
        "bettags",
    )


per_word("verb_shingles", "tag[i] LIKE 'V%' AND lemma[i] NOT IN ('be', 'have')", "w[i] || '_' || tag[i] || '_BET'")
per_word("preposition_shingles", "tag[i] LIKE 'IN%' OR tag[i] LIKE 'TO%'", "w[i] || '_PREP'")
per_word("noun_shingles", "tag[i] = 'NN'", "w[i] || '_NN_BET'")
# In the universal set TO is a particle and numbers of verbs stay apart by phrase.
oracle(
    "relation_phrase_universal",
    r"""SELECT bet, array_to_string(list_transform(list_filter(starts, lambda s: s.k > 0),
               lambda s: array_to_string(w[s.b:s.b + s.k - 1], ' ')), '|') AS phrases
        FROM (SELECT bet, w, list_transform(range(1, len(parts) + 1), lambda j: {
                     'b': 1 + coalesce(list_sum(list_transform(parts[1:j - 1], lambda p: length(p))), 0)::BIGINT,
                     'k': length(regexp_extract(parts[j], '^v[vrp]*[wr]*[ap]*'))}) AS starts
              FROM (SELECT bet, w, regexp_extract_all(classes, 'v[vrp]*[wr]*[ap]*.?|.') AS parts FROM bettags))""",
    "bettags",
)
# Two types, two phrase shingles, a verb or a preposition with a noun, and the character 4-grams of BET and AFT.
oracle(
    "write_features",
    """SELECT o_orderkey AS rel_id, rel_type, (2 + 2 + CASE bet WHEN 'founded' THEN 1 ELSE 2 END
              + length(bet) - 3 + length('last month .') - 3)::BIGINT AS shingles FROM orderfacts""",
    "orderfacts",
)

# -- the tag rules as one CASE over words
LEXICON = "(VALUES " + values([tuple(map(quote, e)) for e in tg.word_entries()]) + ") AS l(word, listed_tag, listed_lemma)"
VERB_LEMMA = r"""CASE WHEN low LIKE '%ied' THEN regexp_replace(low, 'ied$', 'y')
       WHEN length(stem) > 1 AND right(stem, 1) = right(left(stem, length(stem) - 1), 1) AND right(stem, 1) IN ('b', 'd', 'g', 'm', 'n', 'p', 'r', 't')
         THEN left(stem, length(stem) - 1)
       WHEN regexp_matches(stem, '(at|iz|as|us|c|g|v|u|[^aeo]ir)$') THEN stem || 'e' ELSE stem END"""
NOUN_LEMMA = r"""CASE WHEN low LIKE '%ies' THEN regexp_replace(low, 'ies$', 'y')
       WHEN regexp_matches(low, '(ss|x|ch|sh)es$') THEN regexp_replace(low, 'es$', '') ELSE regexp_replace(low, 's$', '') END"""


def tags_of(tokens: str) -> str:
    """(tok, tag, lemma) of the distinct words of a query with a column tok."""
    return rf"""SELECT tok, coalesce(listed_tag, rule_tag) AS tag,
       CASE WHEN listed_lemma IS NOT NULL THEN listed_lemma WHEN rule_tag IN ('VBN', 'VBG') THEN {VERB_LEMMA}
            WHEN rule_tag = 'NNS' THEN {NOUN_LEMMA} ELSE low END AS lemma
FROM (SELECT tok, lower(tok) AS low, regexp_replace(lower(tok), '(ed|ing)$', '') AS stem,
             CASE WHEN NOT regexp_matches(tok, '[A-Za-z]') THEN CASE WHEN regexp_matches(tok, '[0-9]') THEN 'CD' ELSE tok END
                  WHEN tok = chr(39) || 's' THEN 'POS' WHEN regexp_matches(tok, '^[A-Z]') THEN 'NNP'
                  WHEN lower(tok) LIKE '%ing' THEN 'VBG' WHEN lower(tok) LIKE '%ed' THEN 'VBN' WHEN lower(tok) LIKE '%ly' THEN 'RB'
                  WHEN regexp_matches(lower(tok), '(ous|ful|ive|able|ible|ical|ish|less|large)$') THEN 'JJ'
                  WHEN regexp_matches(lower(tok), '[^s]s$') THEN 'NNS' ELSE 'NN' END AS rule_tag
      FROM (SELECT DISTINCT tok FROM ({tokens}))) LEFT JOIN {LEXICON} ON low = word"""


def kept_of(rows: str) -> str:
    """Rows with a string ``classes``, a letter per token, and ``kept``, the numbers of the tokens in phrases."""
    return rf"""SELECT *, list_filter(range(1, len(marked) + 1), lambda i: regexp_matches(marked[i], '[A-Z]')) AS kept
        FROM (SELECT *, string_split(array_to_string(list_transform(
                 regexp_extract_all(classes, 'v[vrp]*[wr]*[ap]*.?|.'),
                 lambda p: CASE WHEN p NOT LIKE 'v%' THEN p
                                ELSE upper(regexp_extract(p, '^v[vrp]*[wr]*[ap]*')) ||
                                     substr(p, length(regexp_extract(p, '^v[vrp]*[wr]*[ap]*')) + 1) END), ''), '') AS marked
              FROM ({rows}))"""


CTES["doctoks"] = (
    (),
    f"""SELECT doc_id, i, t[i] AS tok FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i
        FROM (SELECT doc_id, {treebank('text')} AS t FROM documents))""",
)
CTES["doctags"] = (("doctoks",), tags_of("SELECT tok FROM doctoks"))
oracle("tag_and_lemmatise", "SELECT tok, tag, lemma, count(*) AS n FROM doctoks JOIN doctags USING (tok) GROUP BY ALL", "doctoks", "doctags")
CTES["docphrases"] = (
    ("doctoks", "doctags"),
    kept_of(f"""SELECT doc_id, list(tok ORDER BY i) AS w, string_agg({CLASS}, '' ORDER BY i) AS classes
                FROM doctoks JOIN doctags USING (tok) GROUP BY doc_id"""),
)
oracle(
    "relation_phrase_raw",
    """SELECT doc_id, coalesce(len(kept), 0)::BIGINT AS phrase_tokens,
              md5(coalesce(array_to_string(list_transform(kept, lambda i: w[i]), ' '), '')) AS phrase_md5
       FROM documents LEFT JOIN docphrases USING (doc_id)""",
    "docphrases",
)
# Contexts of all mentions, their sides tagged word by word, and their bags in the order of the kinds.
SIDES = ("bef", "bet", "aft")
CTES["contexts"] = (
    ("men",),
    """SELECT row_number() OVER () AS cid, * FROM (
         SELECT e1_type, e2_type, bef3 AS bef, bet, aft3 AS aft, count(*) AS n FROM men GROUP BY ALL)""",
)
CTES["sidetoks"] = (
    ("contexts",),
    " UNION ALL ".join(
        f"SELECT cid, '{s}' AS side, i, {s}[i] AS tok FROM (SELECT *, unnest(range(1, len({s}) + 1)) AS i FROM contexts)" for s in SIDES
    ),
)
CTES["sidetags"] = (("sidetoks",), tags_of("SELECT tok FROM sidetoks"))
CTES["sides"] = (
    ("sidetoks", "sidetags"),
    kept_of(f"""SELECT cid, side, list(tok ORDER BY i) AS w, list(tag ORDER BY i) AS tag, list(lemma ORDER BY i) AS lemma,
                       string_agg({CLASS}, '' ORDER BY i) AS classes
                FROM sidetoks JOIN sidetags USING (tok) GROUP BY cid, side"""),
)
PICKED = "list_transform(list_filter(range(1, len(w) + 1), lambda i: {}), lambda i: {})"
CTES["sidebags"] = (
    ("sides",),
    f"""SELECT cid, side,
          CASE WHEN side <> 'bet' OR len(kept) = 0 THEN [] ELSE
            [array_to_string({PHRASE.format('w[i]')}, '_') || CASE WHEN coalesce({PASSIVE}, false) THEN '_RVB_PASSIVE' ELSE '_RVB' END,
             array_to_string({PHRASE.format('lemma[i]')}, '_') || '_RVB_NORM'] END AS phrase,
          {PICKED.format("tag[i] IN ('VB', 'VBD', 'VBN', 'VBP', 'VBZ', 'VBG') AND lemma[i] NOT IN ('be', 'have')", "w[i] || '_' || tag[i] || '_' || upper(side)")} AS verbs,
          {PICKED.format("tag[i] LIKE 'IN%' OR tag[i] LIKE 'TO%'", "w[i] || '_PREP'")} AS preps,
          {PICKED.format("tag[i] = 'NN'", "w[i] || '_NN_BET'")} AS nouns,
          list_transform(range(1, length(array_to_string(w, ' ')) - 2),
                         lambda i: replace(substring(array_to_string(w, ' '), i, 4), ' ', '_') || '_' || upper(side)) AS grams
        FROM sides""",
)


def _side(kind: str, side: str) -> str:
    return f"coalesce({side}s.{kind}, [])"


CTES["bags"] = (
    ("contexts", "sidebags"),
    "SELECT c.*, list_concat([e1_type || '_ENTITY1', e2_type || '_ENTITY2'], "
    + ", ".join(
        [_side("phrase", "bet"), *[_side("verbs", s) for s in SIDES], _side("preps", "bet"), _side("nouns", "bet"), *[_side("grams", s) for s in SIDES]]
    )
    + ") AS shingles FROM contexts c "
    + " ".join(f"LEFT JOIN sidebags {s}s ON {s}s.cid = c.cid AND {s}s.side = '{s}'" for s in SIDES),
)
oracle(
    "assemble_shingles",
    f"SELECT e1_type, e2_type, {BAGGED}, array_to_string(shingles, ' ') AS shingles, n FROM bags",
    "bags",
)

# -- classification of mentions: labelled contexts, signatures, buckets, neighbours, votes
CTES["labelledcontexts"] = (
    (),
    f"""SELECT -row_number() OVER () AS cid, e1_type, e2_type, bef, bet, aft, max(id) AS rel_id, arg_max(rel_type, id) AS rel_type
        FROM (SELECT id, rel_type, t1 AS e1_type, t2 AS e2_type, {words("bet")} AS bet,
                     list_slice({words("bef")}, -3, -1) AS bef, list_slice({words("aft")}, 1, 3) AS aft
              FROM ({source(fx.LABELLED_ROWS)}))
        GROUP BY e1_type, e2_type, bef, bet, aft""",
)


def renamed(names: list[str], renames: dict[str, str]) -> None:
    """Copies of CTEs that read other CTEs in place of some."""
    renames = {**renames, **{n: f"l{n}" for n in names}}

    def swap(text: str) -> str:
        return re.sub(rf"\b({'|'.join(renames)})\b(?!\.)", lambda m: renames[m[1]], text)

    for n in names:
        needs, sql = CTES[n]
        CTES[renames[n]] = tuple(renames.get(c, c) for c in needs), swap(sql)


# Rows that name a column or alias like a CTE stay as they are: only the CTEs listed are read under another name.
renamed(["sidetoks", "sidetags", "sides", "sidebags", "bags"], {"contexts": "labelledcontexts"})
M_SIGS, M_BANDS, M_K = 200, 25, 7
M_ROWS = M_SIGS // M_BANDS
HASH = "('0x' || substr(md5(s), 1, 8))::BIGINT"
CTES["mhashes"] = (
    ("bags", "lbags"),
    f"""SELECT DISTINCT cid, {HASH} AS h FROM (SELECT cid, unnest(shingles) AS s FROM bags
        UNION ALL SELECT cid, unnest(shingles) FROM lbags) WHERE s <> ''""",
)
CTES["mcoef"] = ((), CTES["coef"][1].replace(f"range(1, {DOC_SIGS + 1})", f"range(1, {M_SIGS + 1})"))
CTES["msig"] = (
    ("mhashes", "mcoef"),
    "SELECT cid, position, min((h * a + b) % 2147483647) AS value FROM mhashes, mcoef GROUP BY cid, position",
)
CTES["mchunks"] = (
    ("msig",),
    f"SELECT cid, position // {M_ROWS} AS band, list_sort(list(value)) AS chunk FROM msig GROUP BY cid, position // {M_ROWS}",
)
CTES["mbuckets"] = (
    ("mchunks", "lbags"),
    "SELECT band, chunk, max(rel_id) AS rel_id FROM mchunks JOIN lbags USING (cid) GROUP BY band, chunk",
)
CTES["mscored"] = (
    ("mchunks", "mbuckets", "msig", "lbags"),
    f"""SELECT c.query_id, c.rel_id, any_value(c.rel_type) AS rel_type, count(*) FILTER (q.value = o.value) / {M_SIGS}.0 AS similarity
        FROM (SELECT DISTINCT q.cid AS query_id, b.rel_id, l.cid, l.rel_type
              FROM mchunks q JOIN mbuckets b ON q.band = b.band AND q.chunk = b.chunk JOIN lbags l ON l.rel_id = b.rel_id WHERE q.cid > 0) c
        JOIN msig q ON q.cid = c.query_id JOIN msig o ON o.cid = c.cid AND o.position = q.position GROUP BY c.query_id, c.rel_id""",
)
CTES["mwinner"] = (
    ("mscored",),
    f"""SELECT query_id, rel_type, votes FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, round(weight, 9) DESC, rel_type) AS place
          FROM (SELECT query_id, rel_type, count(*) AS votes, sum(similarity) AS weight
                FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rel_id) AS rank FROM mscored)
                WHERE rank <= {M_K} GROUP BY query_id, rel_type)) WHERE place = 1""",
)
CTES["classified"] = (
    ("men", "contexts", "mwinner"),
    """SELECT m.e1, m.e2, m.text AS sentence, m.bet, coalesce(w.rel_type, 'None') AS rel_type, coalesce(votes, 0)::BIGINT AS votes
       FROM men m JOIN contexts c ON m.e1_type = c.e1_type AND m.e2_type = c.e2_type AND m.bef3 = c.bef AND m.bet = c.bet AND m.aft3 = c.aft
       LEFT JOIN mwinner w ON w.query_id = c.cid""",
)
oracle("classify_mentions", "SELECT e1, e2, sentence, rel_type, votes FROM classified", "classified")
oracle("write_classified", "SELECT e1, e2, sentence, rel_type FROM classified", "classified")
oracle("write_by_relation", "SELECT rel_type, count(*) AS n FROM classified GROUP BY rel_type", "classified")
# What the labels state, evaluated as any system's facts are.
CTES["labelfacts"] = (
    ("classified",),
    """SELECT DISTINCT rel_type, e1, e2, NULL::DOUBLE AS score, '' AS bef, array_to_string(bet, ' ') AS bet, '' AS aft, sentence
       FROM classified WHERE rel_type <> 'None'""",
)
renamed(["verdicts", "regions", "missed", "truth", "sizes", "metrics"], {"facts": "labelfacts"})
oracle("evaluate_classified", f"SELECT rel_type, s, a, b, {ROUNDED} FROM lmetrics", "lmetrics")
oracle("write_wrong", "SELECT rel_type, e1, e2, sentence, bet FROM lregions WHERE region = 'not_found'", "lregions")
