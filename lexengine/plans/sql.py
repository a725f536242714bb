"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from lexengine.functions.text import ARPABET, LANGUAGES
from lexengine.operators.classify import OTHERS, RULES, SUBRULES

CATEGORIES = """
categories AS (
  SELECT n_nationkey AS id, n_name AS name, upper(n_name[1]) || lower(n_name[2:]) AS display_name, r_name AS topic, n_regionkey + 1000 AS parent_id, n_nationkey % 7 AS display_order FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_regionkey + 1000, r_name, upper(r_name[1]) || lower(r_name[2:]), r_name, NULL, NULL FROM region
), members AS (SELECT c_nationkey AS category_id, c_custkey AS word_id FROM customer),
counts AS (
  SELECT c.id, c.name, c.display_name, c.topic, c.parent_id, count(DISTINCT m.word_id) AS word_count, count(DISTINCT k.id) AS subcategory_count
  FROM categories c LEFT JOIN members m ON m.category_id = c.id LEFT JOIN categories k ON k.parent_id = c.id GROUP BY ALL
)"""

WORDS = "words AS (SELECT c_custkey AS id, c_name AS word, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS INT) END AS frequency_rank, c_nationkey AS category_id, trim(lower(c_name)) AS key FROM customer)"


def _keywords(name: str, rules: dict[str, tuple[str, ...]]) -> str:
    return f"{name}(name, k) AS (VALUES " + ", ".join(f"('{n}', '{k.lower()}')" for n, words in rules.items() for k in words) + ")"


_LINES = "lines AS (SELECT doc_id AS word, lower(unnest(string_split(text, chr(10)))) AS t FROM documents)"
_HITS = _keywords("kw", {r.name: r.keywords for r in RULES}) + ", hits AS (SELECT DISTINCT word, name AS category FROM lines JOIN kw ON contains(t, k))"
CATEGORIZED = f"{_LINES}, {_HITS}, mem AS (SELECT * FROM hits UNION ALL SELECT doc_id, '{OTHERS}' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.word = d.doc_id))"


def _subcategorized(subrules: dict) -> str:
    words = _keywords("skw", {f"{p}|{p}-{r.name}": r.keywords for p, rules in subrules.items() for r in rules})
    parents = ", ".join(f"'{p}'" for p in subrules)
    return f"""WITH {CATEGORIZED}, {words}, found AS (SELECT DISTINCT split_part(name, '|', 1) AS parent, split_part(name, '|', 2) AS subcategory, word FROM lines JOIN skw ON contains(t, k)),
own AS (SELECT category AS parent, word FROM mem WHERE category IN ({parents})), sub AS (SELECT s.* FROM found s SEMI JOIN own ON own.parent = s.parent AND own.word = s.word)
SELECT parent, subcategory, word FROM sub UNION ALL SELECT parent, parent || '-general', word FROM own WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.parent = own.parent AND sub.word = own.word)"""


_NAMES = ", ".join(f"('{r.name}', '{r.topic}')" for r in RULES)

# White space as the engine's regular expressions know it.
S = r"[ \t\n\x0B\f\r]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def _decoded(x: str) -> str:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _clean(x: str) -> str:
    x = f"regexp_replace(regexp_replace({_decoded(x)}, '<[^>]+>', '', 'g'), '''{{2,5}}', '', 'g')"
    return _strip(f"regexp_replace({x}, '{S}+', ' ', 'g')")


def _wikitext(x: str) -> str:
    for a, b in ((r"\{\{lb\|en\|([^}]+)\}\}", r"(\1)"), (r"\{\{gloss\|([^}]+)\}\}", r"\1"), (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1"), (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return _clean(x)


SQL = {
    "topic_list": f"WITH {CATEGORIES} SELECT topic, count(id) AS category_count FROM categories GROUP BY topic",
    "category_list": f"WITH {CATEGORIES} SELECT id, name, topic, word_count, subcategory_count FROM counts",
    "category_list_filtered": f"WITH {CATEGORIES} SELECT id, name, topic, word_count, subcategory_count FROM counts WHERE topic = 'ASIA' AND parent_id IS NULL",
    "subcategory_counts": f"WITH {CATEGORIES} SELECT c.id, c.name, count(k.c_custkey) AS word_count FROM categories c LEFT JOIN customer k ON k.c_nationkey = c.id AND k.c_acctbal > 9000 WHERE c.parent_id = 1002 GROUP BY c.id, c.name",
    "category_page": f"WITH {WORDS} SELECT id, word, frequency_rank FROM words WHERE category_id = 3 ORDER BY frequency_rank NULLS LAST, word, id LIMIT 10 OFFSET 10",
    "category_page_meta": "SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages, 20 < count(*) AS has_more FROM customer WHERE c_nationkey = 3",
    "category_search_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%'",
    "tree_detail": f"WITH {CATEGORIES} SELECT p.name AS parent_name, c.name AS child_name, c.word_count AS child_words, p.word_count AS parent_words FROM counts c JOIN counts p ON c.parent_id = p.id",
    "subcategory_summary": f"WITH {CATEGORIES} SELECT p.name, count(DISTINCT c.id) AS subcategories, count(DISTINCT m.word_id) AS words FROM categories p JOIN categories c ON c.parent_id = p.id LEFT JOIN members m ON m.category_id = c.id GROUP BY p.id, p.name",
    "semi_join_children": f"WITH {CATEGORIES} SELECT category_id, word_id FROM members WHERE category_id IN (SELECT id FROM categories WHERE parent_id = 1001)",
    "word_autocomplete": f"WITH {WORDS} SELECT id, word, coalesce(frequency_rank, -1) AS frequency_rank FROM words WHERE starts_with(key, 'customer#00000') ORDER BY key, id LIMIT 15",
    "word_autocomplete_ranked": f"WITH {WORDS} SELECT id, word, frequency_rank FROM words WHERE starts_with(key, 'customer#') ORDER BY frequency_rank NULLS LAST, key, id LIMIT 15",
    "category_autocomplete": f"WITH {CATEGORIES}, k AS (SELECT id, name, display_name, word_count, unnest([name, display_name]) AS k FROM counts), h AS (SELECT * FROM k WHERE starts_with(lower(k), 'nation_1') ORDER BY lower(k), id, k LIMIT 5) SELECT DISTINCT id, name, display_name, word_count FROM h",
    "topic_autocomplete": f"WITH {CATEGORIES}, h AS (SELECT * FROM categories WHERE starts_with(lower(topic), 'a') ORDER BY lower(topic), id LIMIT 8) SELECT topic, count(*) AS category_count FROM h GROUP BY topic",
    "user_list_prefix": "SELECT o_custkey AS user_id, CAST(o_orderkey AS VARCHAR) AS word FROM orders WHERE o_custkey = 7 AND CAST(o_orderkey AS VARCHAR) LIKE '1%'",
    "exact_key": "SELECT c_custkey AS id, c_name AS word FROM customer WHERE c_name = 'customer#000000042' OR lower(c_name) = 'customer#000000042' ORDER BY 1 LIMIT 1",
    "index_statistics": f"WITH {WORDS} SELECT count(DISTINCT key) AS distinct_keys, count(*) AS entries FROM words",
    "categorize": f"WITH {CATEGORIZED} SELECT word, category FROM mem",
    "categorize_others": f"WITH {_LINES}, {_HITS} SELECT doc_id AS word FROM documents d WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.word = d.doc_id)",
    "categorize_summary": f"WITH {CATEGORIZED} SELECT v.category, v.topic, count(mem.word) AS word_count FROM (VALUES {_NAMES}, ('{OTHERS}', 'other')) v(category, topic) LEFT JOIN mem ON mem.category = v.category GROUP BY 1, 2",
    "multi_category_words": f"WITH {CATEGORIZED} SELECT word, count(*) AS categories FROM mem GROUP BY word HAVING count(*) > 1",
    "uncategorized_check": f"WITH {CATEGORIZED} SELECT count(*) AS uncategorized FROM documents WHERE doc_id NOT IN (SELECT word FROM mem)",
    "categorized_words": f"WITH {CATEGORIZED} SELECT count(DISTINCT word) AS words, count(*) AS memberships FROM mem",
    "subcategorize": _subcategorized(SUBRULES),
    "subcategorize_members": _subcategorized({p: SUBRULES[p] for p in ("water", "time")}),
    "synonyms_pairs": "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS w FROM lineitem) SELECT a.w AS word, count(DISTINCT b.w) AS synonyms FROM s a JOIN s b ON a.o = b.o AND a.w <> b.w GROUP BY a.w",
    "synonym_top10": "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS w FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY w) AS n FROM s) SELECT o AS synset, count(*) AS n, min(w) AS first, max(w) AS last FROM r WHERE n <= 10 GROUP BY o",
    "word_forms_last_wins": "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "accent_pick": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS n FROM events) WHERE n = 1",
    "merge_three_sources": "SELECT c_custkey AS id, c_name AS word, coalesce(o.n, -1) AS orders, s_acctbal AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey AND s_acctbal > 0",
    "backfill_missing": "SELECT c_custkey AS id, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 5000 GROUP BY 1 HAVING count(*) > 5",
    "level_classifier": f"WITH {WORDS} SELECT id, CASE WHEN frequency_rank > 0 THEN CASE WHEN frequency_rank <= 1000 THEN 'beginner' WHEN frequency_rank <= 5000 THEN 'intermediate' ELSE 'advanced' END WHEN length(word[10:]) <= 5 THEN 'beginner' WHEN length(word[10:]) <= 8 THEN 'intermediate' ELSE 'advanced' END AS level FROM words",
    "frequency_order": f"WITH {WORDS} SELECT id, word, coalesce(frequency_rank, -1) AS frequency_rank FROM words ORDER BY CASE WHEN frequency_rank > 0 THEN frequency_rank END NULLS LAST, word",
    "inflection_classifier": "WITH t AS (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS f FROM documents), p AS (SELECT f, unnest(['noun', 'verb', 'adj', 'adv']) AS pos FROM t) SELECT pos, CASE WHEN pos = 'noun' THEN 'plural' WHEN pos = 'verb' AND f LIKE '%ed' THEN 'past' WHEN pos = 'verb' AND f LIKE '%ing' THEN 'present_participle' WHEN pos = 'verb' AND f LIKE '%s' THEN 'third_person' WHEN pos = 'adj' AND f LIKE '%er' THEN 'comparative' WHEN pos = 'adj' AND f LIKE '%est' THEN 'superlative' ELSE 'none' END AS kind, count(*) AS n FROM p GROUP BY 1, 2",
    "arpabet_ipa": "WITH m AS (SELECT ["
    + ", ".join(f"'{i}'" for i in ARPABET.values())
    + "] AS ipa, ["
    + ", ".join("true" if p[0] in "AEIOU" else "false" for p in ARPABET)
    + "] AS vowel), c AS (SELECT p_partkey, p_size, list_transform(string_split(p_name, ''), lambda x: ascii(x) % "
    + str(len(ARPABET))
    + " + 1) AS places FROM part) SELECT p_partkey, '/' || array_to_string(list_transform(places, lambda i: CASE WHEN vowel[i] THEN ['', 'ˈ', 'ˌ'][p_size % 3 + 1] ELSE '' END || ipa[i]), '') || '/' AS ipa FROM c, m",
    "hex_word_count": "SELECT p_partkey, p_size AS words FROM part",
    "title_extract": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "html_clean": f"WITH c AS (SELECT page_id, {_clean('html')} AS c FROM pages) SELECT page_id, length(c) AS chars, md5(c) AS digest FROM c",
    "wikitext_clean": "SELECT p_partkey, " + _wikitext("('{{lb|en|rare}} [[' || p_name || '|' || p_brand || ']] {{a|{{b}}}} {{gloss|' || p_type || '}} ''''''x''''''  &amp;lt;b&gt;')") + " AS clean FROM part",
    "regex_all": """SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""",
    "normalize_key": f"SELECT doc_id, md5(lower({_strip('text')})) AS key FROM documents",
    "definition_order": "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS definition_order, md5(unnest(string_split(text, chr(10)))) AS digest FROM documents",
    "language_names": "SELECT coalesce(v.n, lang) AS language, count(*) AS documents FROM documents LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LANGUAGES.items()) + ") v(c, n) ON v.c = lang GROUP BY 1",
    "coverage_stats": "WITH r AS (SELECT d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT count(*) AS total, count(quality) AS with_label, round(100.0 * count(quality) / count(*), 1) AS label_percent, count(*) FILTER (quality = 1) AS with_quality, round(100.0 * count(*) FILTER (quality = 1) / count(*), 1) AS quality_percent, count(*) FILTER (n_chars > 2000) AS with_long_text, round(100.0 * count(*) FILTER (n_chars > 2000) / count(*), 1) AS long_text_percent FROM r",
    "template_audit": "SELECT m AS marker, count(*) FILTER (contains(text, m)) AS hits FROM documents CROSS JOIN (VALUES ('***'), ('%%%'), ('!!'), (' | ')) v(m) GROUP BY m",
    "template_cleanup": "SELECT doc_id FROM documents WHERE NOT (contains(text, '***') OR contains(text, '%%%') OR contains(text, '!!') OR contains(text, ' | '))",
    "table_counts": "SELECT (SELECT count(*) FROM customer) AS n_customer, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem) AS n_lineitem, (SELECT count(*) FROM documents) AS n_documents",
    "verify_chain": "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1",
    "missing_translation_worklist": "SELECT doc_id, n_chars FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id) WHERE quality IS NULL ORDER BY n_chars DESC, doc_id LIMIT 25",
    "lookup_flat": "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "import_skip_existing": "WITH t AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) SELECT * FROM t UNION ALL SELECT c_custkey + 100, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM t)",
    "add_words_outcome": "WITH r AS (SELECT o_orderkey AS seq, o_custkey AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT CASE WHEN c.c_custkey IS NULL THEN 'not_found' WHEN c.c_nationkey = 3 OR r.n > 1 THEN 'skipped' ELSE 'added' END AS status, count(*) AS n FROM r LEFT JOIN customer c ON c.c_custkey = r.w AND c.c_acctbal >= 0 GROUP BY 1",
    "user_list_import": "SELECT DISTINCT user_id, event_type AS word FROM events e WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.value > 90 AND x.user_id = e.user_id AND x.event_type = e.event_type)",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "orphan_parents": "SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE -1 END AS n_regionkey FROM nation",
    "update_notes": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name FROM nation",
    "translate_coalesce": "SELECT doc_id, coalesce('q' || quality, 'from ' || lang) AS vi FROM documents LEFT JOIN labels USING (doc_id)",
    "json_in_text": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "sentence_parse": f"WITH u AS (SELECT doc_id, {_strip('unnest(string_split(text, chr(10)))')} AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u WHERE length(s) > 10) SELECT d.doc_id, count(r.s) AS sentences, md5(coalesce(string_agg(r.s, chr(10) ORDER BY i), '')) AS digest FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.n <= 3 GROUP BY d.doc_id",
    "cache_ratio": "WITH f AS (SELECT row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS miss FROM events) SELECT CAST(count(*) FILTER (NOT miss) AS BIGINT) AS hits, CAST(count(*) FILTER (miss) AS BIGINT) AS misses, round(100.0 * count(*) FILTER (NOT miss) / count(*), 1) AS ratio FROM f",
}

# --- more of the lexicon --------------------------------------------------------------------------


def _letters(x: str) -> str:
    return f"'w' || translate(CAST({x} AS VARCHAR), '0123456789', 'abcdefghij')"


_IPA_OF = "CASE WHEN p_size IN (7) OR p_size % 3 = 1 THEN 'D AO1 G' WHEN p_size % 3 = 0 THEN 'K AE1 T' ELSE 'HH AH0 L OW1' END"
_SYNONYMS = f"ls AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS w FROM lineitem), syn AS (SELECT a.w AS w, count(DISTINCT b.w) AS n, coalesce(min(CASE WHEN b.w <> a.w THEN {_letters('b.w')} END), '') AS first, count(DISTINCT CASE WHEN b.w <> a.w THEN b.w END) AS others FROM ls a JOIN ls b ON a.o = b.o GROUP BY a.w)"
_ENTRIES = f"""{_SYNONYMS}, net AS (SELECT w, others FROM syn), entries AS (
  SELECT p_partkey AS k, {_letters('p_partkey')} AS word, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS pronunciations, 2 AS definitions, coalesce(least(others, 10), -1) AS synonyms, p_size, 1 AS examples FROM part LEFT JOIN net ON w = p_partkey WHERE p_size >= 10
  UNION ALL SELECT p_partkey, {_letters('p_partkey')}, 1, 0, least(others, 10), p_size, 0 FROM part JOIN net ON w = p_partkey WHERE p_size < 10 AND others > 0)"""
_URL = "'http://x/' || event_id || CASE event_type WHEN 'view' THEN '-us.mp3' WHEN 'click' THEN '-uk.mp3' WHEN 'purchase' THEN '/uk/x.mp3' ELSE '.mp3' END"
_RECORDINGS = f"""r AS (SELECT user_id AS word, min_by({_URL}, event_id) FILTER (event_type = 'view') AS us0, min_by({_URL}, event_id) FILTER (event_type IN ('click', 'purchase')) AS uk, min_by({_URL}, event_id) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS other FROM events GROUP BY 1),
rec AS (SELECT word, coalesce(us0, CASE WHEN uk IS NULL THEN other END) AS us, uk FROM r)"""
_DEFINED = "defs AS (SELECT o_custkey AS k, count(*) AS n, string_agg(o_orderpriority, ',' ORDER BY o_orderkey % 3, o_orderkey) AS t FROM orders GROUP BY 1)"
_LOOKUP = f"""WITH {WORDS}, {_DEFINED}, ex AS (SELECT o_custkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
f AS (SELECT user_id AS k, count(DISTINCT event_type) AS n, CAST(max(CASE WHEN event_type = 'click' THEN event_id END) AS VARCHAR) AS click FROM events GROUP BY 1), sy AS (SELECT s_suppkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT id, word, coalesce(defs.n, 0) AS definitions, coalesce(ex.n, 0) AS examples, coalesce(defs.n, 0) AS pronunciations, coalesce(sy.n, 0) AS synonyms, coalesce(f.n, 0) AS forms, md5(coalesce(defs.t, '')) AS digest, coalesce(f.click, '') AS click
FROM words LEFT JOIN defs ON defs.k = id LEFT JOIN ex ON ex.k = id LEFT JOIN f ON f.k = id LEFT JOIN sy ON sy.k = id"""

SQL |= {
    "category_list_ordered": f"WITH {CATEGORIES} SELECT id, name, coalesce(display_order, -1) AS display_order FROM categories ORDER BY categories.display_order NULLS LAST, display_name, id LIMIT 10",
    "category_resolve": f"WITH {CATEGORIES} SELECT '1003' AS reference, id, name FROM categories WHERE id = 1003 UNION ALL SELECT 'ASIA', id, name FROM categories WHERE name = 'ASIA'",
    "category_page_full": f"""WITH {WORDS}, m AS (SELECT id, word, length(c_mktsegment) AS o FROM words JOIN customer ON c_custkey = id WHERE c_nationkey = 3),
d AS (SELECT o_custkey AS k, count(*) AS n, md5(string_agg(o_orderstatus || o_orderpriority, ',' ORDER BY o_orderkey % 3, o_orderkey)) AS t FROM orders GROUP BY 1), c AS (SELECT count(*) AS n FROM m)
SELECT 'NATION_3' AS category, id AS word_id, word, o AS display_order, coalesce(d.n, 0) AS definitions, coalesce(d.t, '') AS digest, c.n AS total, CAST(ceil(c.n / 10.0) AS BIGINT) AS total_pages, 20 < c.n AS has_more
FROM (SELECT * FROM m ORDER BY o, word, id LIMIT 10 OFFSET 10) p LEFT JOIN d ON d.k = p.id CROSS JOIN c""",
    "category_members_sorted": "SELECT c_custkey AS word_id, c_name AS word, length(c_mktsegment) AS display_order FROM customer WHERE c_nationkey = 5 ORDER BY 3, 2, 1 LIMIT 20",
    "word_autocomplete_hydrated": f"""WITH {WORDS}, h AS (SELECT * FROM words WHERE starts_with(key, 'customer#0000001') ORDER BY key, id LIMIT 15)
SELECT h.id, h.word, coalesce((SELECT '/' || o_orderpriority || '/' FROM orders WHERE o_custkey = h.id ORDER BY o_orderstatus <> 'F', o_orderkey LIMIT 1), '') AS ipa,
coalesce((SELECT o_orderstatus FROM orders WHERE o_custkey = h.id ORDER BY o_orderkey % 3, o_orderkey LIMIT 1), '') AS pos FROM h""",
    "autocomplete_fallback": f"WITH {WORDS} SELECT 'hel' AS prefix, unnest(['hello', 'help']) AS word UNION ALL SELECT * FROM (SELECT 'customer#00000000', word FROM words WHERE starts_with(key, 'customer#00000000') ORDER BY key, id LIMIT 2)",
    "collation_order": "WITH r AS (SELECT CASE WHEN c_nationkey < 12 THEN lower(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END || c_custkey AS name, c_custkey FROM customer) SELECT name, c_custkey FROM r ORDER BY lower(name), c_custkey LIMIT 20",
    "try_cast_ids": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_custkey END AS number FROM customer",
    "map_merge": "SELECT o_orderkey, 3 AS n, o_orderstatus AS a, o_orderpriority AS b, 'right' AS c FROM orders",
    "rank_list": "SELECT n_nationkey, CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 WHEN 'NATION_11' THEN 4 ELSE 0 END AS frequency_rank FROM nation",
    "request_record": "SELECT o_orderstatus AS part_of_speech, o_orderpriority AS definition_en, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'noun', 'a land', 1 UNION ALL SELECT 'noun', 'a place', 1",
    "import_rejects": "SELECT c_custkey, 'kept' AS outcome FROM customer WHERE c_acctbal >= 0 OR c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'negative balance' FROM customer WHERE c_acctbal < 0",
    "create_categories": "WITH c AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1) SELECT name, 'created' AS status, 1 AS n FROM c UNION ALL SELECT name, 'conflict', n - 1 FROM c WHERE n > 1 UNION ALL SELECT r_name, 'conflict', count(*) FROM region GROUP BY 1",
    "seed_categories": """WITH k AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 12), s AS (SELECT DISTINCT n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey),
g AS (SELECT * FROM k UNION ALL SELECT n_nationkey + 5000, n_name FROM s WHERE n_name NOT IN (SELECT name FROM k)),
m AS (SELECT c_nationkey AS category_id, c_custkey AS word_id FROM customer WHERE c_acctbal < 0 UNION SELECT g.id, c_custkey FROM customer JOIN s ON s.n_nationkey = c_nationkey JOIN g ON g.name = s.n_name)
SELECT g.id, g.name, CASE WHEN s.n_name IS NULL THEN '' WHEN k.id IS NULL THEN 'created' ELSE 'updated' END AS status, count(m.word_id) AS words
FROM g LEFT JOIN s ON s.n_name = g.name LEFT JOIN k ON k.name = g.name LEFT JOIN m ON m.category_id = g.id GROUP BY ALL
UNION ALL SELECT n_nationkey + 1000 AS id, n_name AS name, '', 0 FROM nation WHERE false""",
    "remove_outcomes": "WITH own AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM own) THEN 'removed' ELSE 'not_found' END AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'left', count(*) FROM own WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) HAVING count(*) > 0",
    "upsert_rules": f"WITH {CATEGORIES}, rules AS (SELECT n_name AS name, 'overwritten' AS topic FROM nation WHERE n_regionkey = 1 UNION ALL SELECT DISTINCT p_brand, 'brand' FROM part) SELECT * FROM rules UNION ALL SELECT name, topic FROM categories WHERE name NOT IN (SELECT name FROM rules) AND name NOT IN ('AFRICA', 'NATION_1', 'NATION_2')",
    "stamped_rows": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM orders",
    "recordings": f"WITH {_RECORDINGS} SELECT word, coalesce(us, '') AS us, coalesce(uk, '') AS uk, coalesce(us, uk, '') AS for_us, coalesce(uk, us, '') AS for_uk FROM rec",
    "audio_write_back": f"WITH {_RECORDINGS} SELECT o_orderkey AS id, coalesce(us, uk, '') AS audio_url FROM orders LEFT JOIN rec ON word = o_custkey",
    "fetched_entries": """WITH w AS (SELECT c_name AS word, right(c_name, 1) = '0' AS bad FROM customer)
SELECT word, CASE WHEN bad THEN 0 ELSE 6 END AS definitions, CASE WHEN bad THEN '' ELSE md5('noun:' || word || ' 0,noun:' || word || ' 1,verb:' || word || ' 0,verb:' || word || ' 1,adj:' || word || ' 0,adj:' || word || ' 1') END AS digest,
CASE WHEN bad THEN '' ELSE 'a,noun,verb,adj' END AS synonyms, CASE WHEN bad THEN 'No Definitions Found' ELSE '' END AS problem FROM w""",
    "translate_fallback": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'there' WHEN starts_with(o_orderpriority, '1') THEN 'second ' || o_orderpriority ELSE 'first ' || o_orderpriority END AS vi FROM orders",
    "example_worklist": f"WITH {WORDS}, e AS (SELECT DISTINCT l_orderkey AS definition_id, l_partkey * 10 + l_linenumber AS id, l_returnflag FROM lineitem WHERE l_returnflag <> 'R') SELECT definition_id, e.id, word, coalesce(frequency_rank, -1) AS frequency_rank FROM e JOIN orders ON o_orderkey = definition_id JOIN words ON words.id = o_custkey ORDER BY words.frequency_rank NULLS LAST, definition_id, e.id LIMIT 50",
    "lookup_nested": _LOOKUP,
    "word_lookup": f"SELECT * FROM ({_LOOKUP}) WHERE lower(word) = 'customer#000000007'",
    "cmudict_parse": f"SELECT {_letters('p_partkey')} AS word, {_IPA_OF} AS pronunciation, CASE {_IPA_OF} WHEN 'K AE1 T' THEN '/kˈæt/' WHEN 'D AO1 G' THEN '/dˈɔɡ/' ELSE '/hʌlˈoʊ/' END AS ipa FROM part",
    "wordnet_parse": f"WITH {_SYNONYMS}, f AS (SELECT p_partkey AS w, {_letters('p_partkey')} || 's' AS plural FROM part WHERE p_size = 3) SELECT {_letters('coalesce(syn.w, f.w)')} AS word, coalesce(others, -1) AS synonyms, coalesce(first, '') AS first, coalesce(plural, '') AS plural FROM syn FULL JOIN f ON f.w = syn.w",
    "wiktionary_parse": f"SELECT {_letters('p_partkey')} AS word, 'noun:A thing of ' || p_type || '.:An example of ' || p_brand || '.;verb:To ' || p_name || '.:' AS definitions, CASE WHEN p_size > 25 THEN 'UK' ELSE 'US' END || '/a/' AS pronunciations FROM part WHERE p_size >= 10",
    "combine_sources": f"WITH {_ENTRIES} SELECT word, pronunciations, definitions, synonyms, CASE WHEN definitions = 0 THEN '' WHEN p_size <= 25 THEN 'intermediate' ELSE 'advanced' END AS level, p_size * 200 AS frequency_rank FROM entries",
    "normalize_tables": f"""WITH {_ENTRIES} SELECT 'words' AS name, count(*) AS n FROM entries UNION ALL SELECT 'definitions', CAST(sum(definitions) AS BIGINT) FROM entries UNION ALL SELECT 'examples', CAST(sum(examples) AS BIGINT) FROM entries
UNION ALL SELECT 'pronunciations', CAST(sum(pronunciations) AS BIGINT) FROM entries UNION ALL SELECT 'synonyms', CAST(sum(greatest(synonyms, 0)) AS BIGINT) FROM entries UNION ALL SELECT 'word_forms', count(*) FILTER (p_size = 3) FROM entries""",
}
