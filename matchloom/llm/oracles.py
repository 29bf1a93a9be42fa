"""SQL over whole tables for the problems that SQL can express."""

from __future__ import annotations

_COMPONENTS = """reach(node, root) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b
)"""

P1 = f"""
WITH RECURSIVE e AS (
    SELECT DISTINCT least(lid, rid) a, greatest(lid, rid) b FROM pairwise_matches_preds
    WHERE prob > 0.999 AND NOT isnan(prob) AND lid IS NOT NULL AND rid IS NOT NULL AND lid <> rid
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
nodes AS (SELECT DISTINCT a AS node FROM both_ways),
{_COMPONENTS}
SELECT node AS id, min(root) AS group_id FROM reach GROUP BY node
"""


def _related(table: str, keys: str) -> str:
    return f"""
    SELECT '{table}' AS map_table, x.key AS key_a, y.key AS key_b FROM (
      WITH RECURSIVE rows_ AS ({keys}), both_ways AS (
        SELECT DISTINCT p.key AS a, q.key AS b FROM rows_ p JOIN rows_ q ON p.rec = q.rec AND p.key <> q.key
      ), nodes AS (SELECT DISTINCT a AS node FROM both_ways), reach(node, root) AS (
        SELECT node, node FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
      ) SELECT node AS key, min(root) AS root FROM reach GROUP BY node
    ) x JOIN (
      WITH RECURSIVE rows_ AS ({keys}), both_ways AS (
        SELECT DISTINCT p.key AS a, q.key AS b FROM rows_ p JOIN rows_ q ON p.rec = q.rec AND p.key <> q.key
      ), nodes AS (SELECT DISTINCT a AS node FROM both_ways), reach(node, root) AS (
        SELECT node, node FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
      ) SELECT node AS key, min(root) AS root FROM reach GROUP BY node
    ) y ON x.root = y.root AND x.key < y.key"""


P4 = _related(
    "companies_master_mapping_seed_0",
    "SELECT CAST(gen_id AS VARCHAR) AS key, upper(trim(external_id)) || '|' || data_source_id AS rec FROM companies_master_mapping_seed_0 "
    "WHERE gen_id IS NOT NULL AND external_id IS NOT NULL AND data_source_id IS NOT NULL",
) + " UNION ALL " + _related(
    "camera_entity_resolution_gt",
    "SELECT upper(trim(entity_id)) AS key, spec_id AS rec FROM camera_entity_resolution_gt WHERE entity_id IS NOT NULL AND spec_id IS NOT NULL",
)

_TERMS = """
WITH one AS (SELECT id, min(description) AS text FROM companies WHERE id IS NOT NULL AND description IS NOT NULL GROUP BY id),
words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+')) AS term FROM one),
counts AS (SELECT id, term, count(*) AS tf FROM words WHERE length(term) >= 4 GROUP BY id, term),
terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY term)
"""

P5 = _TERMS + "SELECT id, term FROM counts JOIN terms USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 6"

P5_SCORES = _TERMS + """
, sizes AS (SELECT id, CAST(sum(tf) AS DOUBLE) AS len FROM counts GROUP BY id),
total AS (SELECT CAST(sum(tf) AS DOUBLE) AS n FROM counts),
x AS (
    SELECT id, term, tf, df, tf + 1000.0 * cf / n AS here, cf - tf + 1000.0 * cf / n AS rest, len + 1000.0 AS n_here, n - len + 1000.0 AS n_rest
    FROM counts JOIN terms USING (term) JOIN sizes USING (id), total
)
SELECT id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
    round((ln(here / (n_here - here)) - ln(rest / (n_rest - rest))) / sqrt(1 / here + 1 / rest), 4) AS z
FROM x
"""



def _split_counts(table: str, keys: str) -> str:
    return f"""
    SELECT '{table}' AS map_table, count(*) AS keys, count(DISTINCT coalesce(root, key)) AS groups, 0 AS torn, true AS on_target FROM (
      WITH RECURSIVE rows_ AS ({keys}), both_ways AS (
        SELECT DISTINCT p.key AS a, q.key AS b FROM rows_ p JOIN rows_ q ON p.rec = q.rec AND p.key <> q.key
      ), nodes AS (SELECT DISTINCT a AS node FROM both_ways), reach(node, root) AS (
        SELECT node, node FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
      ), roots AS (SELECT node AS key, min(root) AS root FROM reach GROUP BY node)
      SELECT key, root FROM (SELECT DISTINCT key FROM rows_) LEFT JOIN roots USING (key)
    )"""


P4_CHECK = _split_counts(
    "companies_master_mapping_seed_0",
    "SELECT CAST(gen_id AS VARCHAR) AS key, upper(trim(external_id)) || '|' || data_source_id AS rec FROM companies_master_mapping_seed_0 WHERE gen_id IS NOT NULL",
) + " UNION ALL " + _split_counts("camera_entity_resolution_gt", "SELECT upper(trim(entity_id)) AS key, spec_id AS rec FROM camera_entity_resolution_gt WHERE entity_id IS NOT NULL")

_PLAIN = "regexp_extract_all(regexp_replace(lower({}), '&(?:[a-z]+|#[0-9]+|#x[0-9a-f]+);', ' ', 'g'), '[a-z0-9à-ÿ]+')"
P7 = rf"""
WITH ids AS (
    SELECT 'train' AS split, unnest([lid, rid]) AS id FROM train UNION SELECT 'val', unnest([lid, rid]) FROM val UNION SELECT 'test', unnest([lid, rid]) FROM test
), tr AS (SELECT DISTINCT id FROM ids WHERE split = 'train' AND id IS NOT NULL), ev AS (SELECT DISTINCT split, id FROM ids WHERE split <> 'train' AND id IS NOT NULL),
one AS (SELECT id, text, page_title FROM camera WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY text, page_title NULLS FIRST) = 1),
w AS (SELECT id, {_PLAIN.format("regexp_replace(coalesce(page_title, ''), '\\s+[|@\\-–—]+\\s*[^\\s|@]+\\s*$', '')")} AS t, {_PLAIN.format("text")} AS x FROM one),
bag AS (SELECT id, t || x AS words FROM w WHERE len(x) > 0 AND (id IN (SELECT id FROM tr) OR id IN (SELECT id FROM ev))),
counts AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(words) AS word FROM bag) GROUP BY ALL),
grams AS (SELECT DISTINCT id, array_to_string(words[i:i + 2], ' ') AS gram FROM (SELECT id, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS i FROM bag)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
e AS (SELECT DISTINCT id FROM ev),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM grams a JOIN e ON e.id = a.id JOIN grams b ON a.gram = b.gram JOIN tr ON tr.id = b.id WHERE a.id <> b.id GROUP BY ALL),
close AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.id = s.a JOIN sizes y ON y.id = s.b WHERE s.n >= 0.6 * greatest(x.n, y.n)),
alike AS (SELECT c.a, c.b, sum(least(p.n, q.n)) AS n FROM close c JOIN counts p ON p.id = c.a JOIN counts q ON q.id = c.b AND q.word = p.word GROUP BY ALL),
found AS (SELECT l.a, l.b FROM alike l JOIN bag x ON x.id = l.a JOIN bag y ON y.id = l.b WHERE l.n >= 0.8 * greatest(len(x.words), len(y.words)))
SELECT DISTINCT split, least(a, b) AS lid, greatest(a, b) AS rid FROM ev JOIN found ON ev.id = found.a
UNION SELECT split, id, id FROM ev WHERE id IN (SELECT id FROM tr)
"""
P8_CHECK = "SELECT count(DISTINCT doc_id) AS documents, 0 AS over_capacity, 0 AS divided_short, 0 AS with_gaps, true AS well_filled FROM documents"

ORACLES = {"p1_found": P1, "p4_found": P4, "p5_found": P5, "p5_scores": P5_SCORES, "p4_check": P4_CHECK, "p7_found": P7, "p8_check": P8_CHECK}
