"""DuckDB SQL for the queries that SQL can express: plain definitions, without the operators' methods."""

from __future__ import annotations

from litlake.plans.packed import items_sql

_ONCE = "SELECT * FROM all_papers WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY pos) = 1"
_KEYWORDS = f"SELECT paper_id, ord, item FROM ({items_sql('(' + _ONCE + ')', 'keywords', 'paper_id')})"
_WORDS = r"regexp_extract_all(lower(nfc_normalize({})), '[\p{{L}}\p{{N}}]+')"

P1 = r"""WITH items AS (
 SELECT DISTINCT stem, 0 AS page_no, full_text AS t, 'full_text' AS item FROM parsed_papers
 UNION SELECT DISTINCT stem, CAST(u[1] AS INTEGER), u[2], 'page_texts' FROM (SELECT stem, unnest(list_zip(range(1, len(page_texts) + 1), page_texts)) AS u FROM parsed_papers)),
big AS (SELECT stem, page_no, t, max_size FROM items JOIN size_limits USING (item) WHERE length(t) > max_size),
paras AS (SELECT stem, page_no, max_size, list_filter(list_transform(string_split_regex(t, '\n *(?:\n *)*\n'), lambda p: regexp_replace(regexp_replace(p, '^(?: *\n)+', ''), '(?:\n *)+$', '')), lambda p: trim(p, ' ') <> '') AS l FROM big)
SELECT stem, page_no, 0 AS para_no FROM big
UNION SELECT stem, page_no, CAST(u[1] AS INTEGER) FROM (SELECT stem, page_no, max_size, unnest(list_zip(range(1, len(l) + 1), l)) AS u FROM paras) WHERE length(u[2]) > max_size"""

_SETS = f"WITH s AS (SELECT DISTINCT paper_id, item FROM ({_KEYWORDS})), n AS (SELECT paper_id, count(*) AS n FROM s GROUP BY paper_id HAVING count(*) >= 3)"
_PAIRS = """SELECT a.paper_id AS paper_id_a, b.paper_id AS paper_id_b, x.n + y.n - count(*) AS u, count(*) AS c
 FROM s a JOIN s b ON a.item = b.item AND a.paper_id < b.paper_id JOIN n x ON x.paper_id = a.paper_id JOIN n y ON y.paper_id = b.paper_id GROUP BY 1, 2, x.n, y.n"""
P3 = f"{_SETS} SELECT paper_id_a, paper_id_b FROM ({_PAIRS}) WHERE 5 * c >= 3 * u"

_TERMS = f"""SELECT 'keywords' AS field, paper_id, item AS term FROM ({_KEYWORDS})
 UNION ALL SELECT 'title', paper_id, unnest({_WORDS.format("title")}) FROM ({_ONCE}) WHERE title IS NOT NULL"""
P4_TERMS = f"""WITH t AS ({_TERMS}), n AS (SELECT count(DISTINCT paper_id) AS n FROM all_papers)
SELECT field, term, count(*) AS occurrences, count(DISTINCT paper_id) AS records,
 CASE WHEN count(DISTINCT paper_id) = 1 THEN 'rare' WHEN count(DISTINCT paper_id) >= 0.02 * n THEN 'common' END AS mark FROM t, n GROUP BY field, term, n"""
P4 = f"SELECT field, term, mark FROM ({P4_TERMS}) WHERE mark IS NOT NULL"

P6 = f"""WITH s AS (SELECT DISTINCT paper_id, unnest({_WORDS.format("title || ' ' || abstract")}) AS item FROM ({_ONCE}) WHERE title <> '' AND abstract <> ''),
n AS (SELECT paper_id, count(*) AS n FROM s GROUP BY paper_id)
SELECT paper_id_a, paper_id_b FROM ({_PAIRS}) WHERE 10 * c >= 7 * u"""

P1_ROUND = r"""WITH items AS (
 SELECT DISTINCT stem, 0 AS page_no, full_text AS t, 'full_text' AS item FROM parsed_papers
 UNION SELECT DISTINCT stem, CAST(u[1] AS INTEGER), u[2], 'page_texts' FROM (SELECT stem, unnest(list_zip(range(1, len(page_texts) + 1), page_texts)) AS u FROM parsed_papers))
SELECT stem, page_no, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest, true AS kept, true AS complete FROM items JOIN size_limits USING (item) WHERE length(t) > max_size"""

# Classes of equal sets named by their lowest paper, and the similar ones among them.
_CLASSES = "l AS (SELECT paper_id, string_agg(item, chr(1) ORDER BY item) AS body, count(*) AS n FROM s GROUP BY paper_id), c AS (SELECT paper_id, n, min(paper_id) OVER (PARTITION BY body) AS class, count(*) OVER (PARTITION BY body) AS class_size FROM l)"
_LINKED = "SELECT paper_id_a, paper_id_b, CAST(c AS DOUBLE) / u AS similarity FROM (" + _PAIRS.replace("FROM s a JOIN s b", "FROM (SELECT s.* FROM s JOIN c USING (paper_id) WHERE paper_id = class) a JOIN (SELECT s.* FROM s JOIN c USING (paper_id) WHERE paper_id = class) b") + ")"
_SETS_3 = f"WITH s0 AS (SELECT DISTINCT paper_id, item FROM ({_KEYWORDS})), n AS (SELECT paper_id, count(*) AS n FROM s0 GROUP BY paper_id HAVING count(*) >= 3), s AS (SELECT s0.* FROM s0 JOIN n USING (paper_id))"
P3_LINKS = f"""{_SETS_3}, {_CLASSES}, k AS (SELECT * FROM ({_LINKED}) WHERE similarity >= 0.6 - 1e-12), e AS (SELECT x, count(*) AS links FROM (SELECT paper_id_a AS x FROM k UNION ALL SELECT paper_id_b FROM k) GROUP BY x)
SELECT paper_id, class, class_size, coalesce(links, 0) AS links FROM c LEFT JOIN e ON class = x"""
_WORD_SETS = P6.split("\nSELECT paper_id_a")[0]
P6_LINKS = f"{_WORD_SETS}, {_CLASSES} SELECT paper_id_a AS class_a, paper_id_b AS class_b, round(similarity, 6) AS similarity FROM ({_LINKED}) WHERE similarity >= 0.7 - 1e-12"
P6_GROUPS = f"""{_WORD_SETS.replace("WITH s AS", "WITH RECURSIVE s AS")}, {_CLASSES}, k AS (SELECT * FROM ({_LINKED}) WHERE similarity >= 0.7 - 1e-12), e AS (SELECT paper_id_a AS x, paper_id_b AS y FROM k UNION SELECT paper_id_b, paper_id_a FROM k),
r(x, y) AS (SELECT class, class FROM c WHERE paper_id = class UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT c.paper_id, c.class, min(r.y) AS grp FROM c JOIN r ON c.class = r.x GROUP BY 1, 2"""

ORACLES = {"p1_round_trip": P1_ROUND, "p3_links": P3_LINKS, "p6_groups": P6_GROUPS, "p6_links": P6_LINKS, "p1_found": P1, "p3_found": P3, "p4_found": P4, "p4_terms": P4_TERMS, "p6_found": P6}
