"""SQL that gives the same rows as the queries of :mod:`matchloom.plans.catalog`, over the same whole tables."""

from __future__ import annotations

CANON = """canon AS (
  SELECT least(lid, rid) AS lid, greatest(lid, rid) AS rid, prob, match_type, label, manual_check_label FROM pairwise_matches_preds
  WHERE lid IS NOT NULL AND rid IS NOT NULL
)"""
PREDS = (
    CANON
    + """, preds AS (
  SELECT lid, rid, prob, match_type, label, manual_check_label FROM (
    SELECT *, row_number() OVER (PARTITION BY lid, rid ORDER BY prob DESC NULLS LAST, label ASC NULLS LAST, manual_check_label ASC NULLS LAST, match_type ASC NULLS LAST) AS n
    FROM canon WHERE lid <> rid
  ) WHERE n = 1
)"""
)
EDGES = PREDS + ", edges AS (SELECT * FROM preds WHERE prob > 0.999)"
MEMBERS = (
    EDGES
    + """, both_ways AS (SELECT lid AS a, rid AS b FROM edges UNION SELECT rid, lid FROM edges),
reach(node, root) AS (
  SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b
), members AS (SELECT node AS id, min(root) AS component_id FROM reach GROUP BY node),
sizes AS (SELECT component_id, count(*) AS size FROM members GROUP BY component_id)"""
)
WORDS = "regexp_extract_all(lower({}), '[a-zà-ÿ0-9]+')"


def transitive(condition: str, members: str = "members") -> str:
    return f"""transitive AS (
  SELECT a.id AS lid, b.id AS rid, a.component_id FROM {members} a JOIN {members} b ON a.component_id = b.component_id AND a.id < b.id JOIN sizes s ON s.component_id = a.component_id
  WHERE {condition} AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.lid = a.id AND e.rid = b.id)
)"""


NAMES = f"names AS (SELECT id, list_distinct({WORDS.format('min(name)')}) AS tokens FROM companies GROUP BY id)"
SCORED = (
    transitive("s.size <= 50")
    + f""", {NAMES}, scored AS (
  SELECT t.lid, t.rid, t.component_id,
    CASE WHEN coalesce(len(list_intersect(a.tokens, b.tokens)) / nullif(len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)), 0), 0) >= 0.5 THEN 1.0 ELSE 0.0 END AS prob
  FROM transitive t JOIN names a ON a.id = t.lid JOIN names b ON b.id = t.rid
)"""
)
STATE = MEMBERS + ", " + SCORED
RECORDS = """records AS (
  SELECT id, min(data_source_id) AS data_source_id, min(external_id) AS external_id, min(name) AS name, min(description) AS description, min(city) AS city,
    min(country_code) AS country_code, min(founded_year) AS founded_year FROM companies GROUP BY id
)"""


def distinct_pairs(table: str, where: str = "true") -> str:
    return f"SELECT DISTINCT least(lid, rid) AS lid, greatest(lid, rid) AS rid FROM {table} WHERE lid IS NOT NULL AND rid IS NOT NULL AND lid <> rid AND {where}"


def checks(chosen: str) -> str:
    """Labels the unchecked edges of chosen components."""
    return f"""
    SELECT p.lid, p.rid,
      CASE WHEN hit THEN CAST(p.label AS DOUBLE) ELSE p.prob END AS prob, CASE WHEN hit THEN p.label ELSE p.manual_check_label END AS manual_check_label
    FROM (SELECT p.*, coalesce(p.prob > 0.999 AND coalesce(p.manual_check_label, -1) < 0 AND p.label IS NOT NULL
        AND m.component_id IN ({chosen}), false) AS hit
      FROM preds p LEFT JOIN members m ON m.id = p.lid) p"""


def jaccard(whole: str, columns: str = "p.lid, p.rid, round({0}, 6) AS prob", more: str = "") -> str:
    value = f"coalesce(len(list_intersect(a.w, b.w)) / nullif({whole}, 0), 0)"
    return f"""
    WITH p AS ({distinct_pairs('val')}), t AS (SELECT id, list_distinct({WORDS.format('min(page_title)')}) AS w FROM camera GROUP BY id)
    SELECT {columns.format(value)}
    FROM p JOIN t a ON a.id = p.lid JOIN t b ON b.id = p.rid {more}"""


UNIT = """unit AS (SELECT vec_id AS id, [x / sqrt(list_sum([y * y for y in CAST(embedding AS DOUBLE[])])) for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings
  WHERE embedding IS NOT NULL)"""
COSINE = UNIT + """,
sims AS (SELECT a.id AS lid, b.id AS rid, round(list_dot_product(a.v, b.v), 9) AS sim FROM unit a JOIN unit b ON a.id <> b.id),
top AS (SELECT lid, rid, round(sim, 5) AS sim, CAST(row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) AS INTEGER) AS rank FROM sims QUALIFY row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) <= 5)"""
SCORES = "scored AS (SELECT lid, rid, prob AS score, label FROM preds WHERE prob IS NOT NULL AND label IS NOT NULL)"
PSEUDO = f"""WITH {PREDS}, {SCORES}, m AS (SELECT median(CASE WHEN score >= 0.5 THEN score END) AS mp, median(CASE WHEN score < 0.5 THEN score END) AS mn FROM scored),
pseudo AS (SELECT lid, rid, score, CASE WHEN score > greatest(coalesce(mp, 0.75), 0.75) THEN 1 WHEN score < least(coalesce(mn, 0.25), 0.25) THEN 0 END AS label FROM scored, m)"""
OVERLAP = f"""named AS (
  SELECT DISTINCT a.id AS lid, b.id AS rid FROM records a JOIN records b ON lower(trim(a.name)) = lower(trim(b.name)) AND a.data_source_id <> b.data_source_id AND a.id < b.id
  WHERE lower(trim(a.name)) <> ''
), tokens AS (SELECT DISTINCT id, data_source_id AS s, unnest({WORDS.format('name')}) AS token FROM records),
counts AS (SELECT a.id AS lid, b.id AS rid, count(*) AS overlap FROM tokens a JOIN tokens b ON a.token = b.token AND a.id <> b.id AND a.s <> b.s GROUP BY ALL),
near AS (SELECT lid, rid, overlap, CAST(row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) AS INTEGER) AS rank FROM counts QUALIFY row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) <= 5)"""
TEXT_MATCH = "match_type = 'text_match'"


def _normalize(column: str) -> str:
    from matchloom.functions.text import FILLER_WORDS, STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS + FILLER_WORDS)
    return f"array_to_string([w for w in {WORDS.format(column)} if NOT list_contains([{stop}], w)], ' ')"


STRIP = r"regexp_replace(name, '[,.;@#?!&$/()\-]+ *', ' ', 'g')"
ORDER = "md5(concat_ws('-', CAST(lid AS VARCHAR), CAST(rid AS VARCHAR), '44'))"
CONFUSION = f"""WITH {PREDS}, t AS (SELECT lid, rid FROM preds WHERE label = 1), f AS (SELECT lid, rid FROM preds WHERE prob >= 0.999),
outcomes AS (SELECT coalesce(t.lid, f.lid) AS lid, coalesce(t.rid, f.rid) AS rid, CASE WHEN t.lid IS NOT NULL AND f.lid IS NOT NULL THEN 'tp' WHEN f.lid IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome
  FROM t FULL OUTER JOIN f ON t.lid = f.lid AND t.rid = f.rid)"""

ORACLES = {
    "pair_canonicalize": f"WITH {CANON} SELECT lid, rid, prob FROM canon",
    "pair_dedupe": f"WITH {PREDS} SELECT * FROM preds WHERE prob >= 0.999",
    "pair_distinct": distinct_pairs("pairwise_matches_preds"),
    "pair_attach_label": f"""
        WITH p AS ({distinct_pairs('val')}), t AS (SELECT least(lid, rid) AS lid, greatest(lid, rid) AS rid, max(label) AS label FROM train WHERE lid IS NOT NULL AND rid IS NOT NULL GROUP BY ALL)
        SELECT p.lid, p.rid, coalesce(t.label, 0) AS label FROM p LEFT JOIN t USING (lid, rid)""",
    "pair_truth_filter": distinct_pairs("train", "label = 1"),
    "pair_positional_ids": """
        WITH pos AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT DISTINCT id FROM camera))
        SELECT a.p AS lid, b.p AS rid, label FROM train t JOIN pos a ON a.id = t.lid JOIN pos b ON b.id = t.rid""",
    "pairs_without_annotated": f"SELECT * FROM ({distinct_pairs('test')}) p WHERE NOT EXISTS (SELECT 1 FROM train k WHERE least(k.lid, k.rid) = p.lid AND greatest(k.lid, k.rid) = p.rid)",
    "pair_accumulate": """
        WITH u AS (SELECT least(lid, rid) AS lid, greatest(lid, rid) AS rid, label, 0 AS p FROM val WHERE lid IS NOT NULL AND rid IS NOT NULL
          UNION ALL SELECT least(lid, rid), greatest(lid, rid), label, 1 FROM test WHERE lid IS NOT NULL AND rid IS NOT NULL)
        SELECT lid, rid, label FROM u QUALIFY row_number() OVER (PARTITION BY lid, rid ORDER BY p, label NULLS LAST) = 1""",
    "pair_apply_checks": f"WITH {PREDS} SELECT lid, rid, CASE WHEN manual_check_label >= 0 THEN CAST(manual_check_label AS DOUBLE) ELSE prob END AS prob FROM preds",
    "pair_lookup_score": f"WITH {PREDS}, q AS ({distinct_pairs('pairwise_matches_preds', TEXT_MATCH)}) SELECT lid, rid, prob FROM q LEFT JOIN preds USING (lid, rid)",
    "records_in_pairs": "SELECT DISTINCT id, spec_id FROM camera WHERE id IN (SELECT lid FROM test UNION SELECT rid FROM test)",
    "records_in_positive_pairs": "SELECT DISTINCT id, spec_id FROM camera WHERE id IN (SELECT lid FROM test WHERE label = 1 UNION SELECT rid FROM test WHERE label = 1)",
    "pair_adjacency": "SELECT lid, array_to_string(list_sort(list(DISTINCT rid)), ',') AS rids FROM train WHERE lid IS NOT NULL AND rid IS NOT NULL GROUP BY lid",
    "union_tables": "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
    "json_to_text": """
        WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL),
        t AS (SELECT event_id, string_agg(key || ': ' || coalesce(json_extract_string(props, '$."' || key || '"'), ''), ' ' ORDER BY key) AS text FROM k GROUP BY event_id)
        SELECT event_id, coalesce(t.text, '') AS text FROM events LEFT JOIN t USING (event_id)""",
    "text_strip_punctuation": f"SELECT DISTINCT id, {STRIP} AS name FROM companies",
    "text_normalize": f"WITH {RECORDS} SELECT id, CASE WHEN description IS NOT NULL THEN {_normalize('description')} END AS text FROM records",
    "text_tfidf_prune": f"""
        WITH {RECORDS}, t AS (SELECT id, {WORDS.format("coalesce(description, '')")} AS ws FROM records),
        pos AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM t),
        per AS (SELECT id, w, count(*) AS tf FROM pos GROUP BY ALL), seen AS (SELECT w, count(*) AS df FROM per GROUP BY w),
        size AS (SELECT id, count(*) AS n_words FROM pos GROUP BY id), n AS (SELECT count(*) AS n_docs FROM t),
        kept AS (SELECT id, w FROM per JOIN seen USING (w) JOIN size USING (id), n
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(tf * (ln((1 + n_docs) / (1 + df)) + 1), 9) DESC, w) <= floor(n_words * 0.5)),
        joined AS (SELECT id, string_agg(w, ' ' ORDER BY pos) AS text FROM pos JOIN kept USING (id, w) GROUP BY id)
        SELECT t.id, coalesce(j.text, '') AS text FROM t LEFT JOIN joined j USING (id)""",
    "row_concat": f"WITH {RECORDS} SELECT id, trim(coalesce(name, '') || ' ' || coalesce(city, '') || ' ' || coalesce(country_code, '') || ' ' || coalesce(CAST(founded_year AS VARCHAR), '')) AS concat_data FROM records",
    "serialize_attributes": f"WITH {RECORDS} SELECT id, concat_ws(' ', 'COL name VAL ' || name, 'COL city VAL ' || city, 'COL country_code VAL ' || country_code) AS text FROM records",
    "tokenise_records": f"""
        WITH {RECORDS}, t AS (SELECT id, trim(coalesce(name, '') || ' ' || coalesce(city, '')) AS concat_data FROM records)
        SELECT id, concat_data, array_to_string({WORDS.format('concat_data')}, ' ') AS tokens, len({WORDS.format('concat_data')}) AS n FROM t""",
    "sequence_build": f"""
        WITH p AS ({distinct_pairs('val')}), t AS (SELECT id, {WORDS.format("coalesce(min(page_title), '')")} AS w FROM camera GROUP BY id),
        x AS (SELECT p.lid, p.rid, a.w AS a, b.w AS b, len(a.w) AS na, len(b.w) AS nb FROM p JOIN t a ON a.id = p.lid JOIN t b ON b.id = p.rid),
        k AS (SELECT *, CASE WHEN na + nb <= 13 THEN na WHEN na > 6 AND nb > 6 THEN 7 WHEN na > nb THEN 13 - nb ELSE na END AS ka FROM x),
        c AS (SELECT *, CASE WHEN na + nb <= 13 THEN nb ELSE 13 - ka END AS kb FROM k),
        s AS (SELECT lid, rid, ['[CLS]'] || a[1:ka] || ['[SEP]'] AS one, b[1:kb] || ['[SEP]'] AS two FROM c)
        SELECT lid, rid, rtrim(array_to_string(one || two, ' ') || repeat(' [PAD]', 16 - len(one) - len(two))) AS tokens,
          rtrim(repeat('0 ', len(one)) || repeat('1 ', len(two)) || repeat('0 ', 16 - len(one) - len(two))) AS segment_ids,
          rtrim(repeat('1 ', len(one) + len(two)) || repeat('0 ', 16 - len(one) - len(two))) AS mask FROM s""",
    "company_view": f"WITH {RECORDS} SELECT id, {STRIP} AS name, city, {_normalize('description')} AS description FROM records",
    "attach_raw_id": """
        SELECT gen_id, upper(trim(m.external_id)) AS external_id, m.data_source_id, r.id AS raw_id FROM companies_master_mapping_seed_0 m
        LEFT JOIN (SELECT DISTINCT id, external_id, data_source_id FROM companies) r ON upper(trim(m.external_id)) = r.external_id AND m.data_source_id = r.data_source_id""",
    "assign_ids": "SELECT row_number() OVER (ORDER BY n_name) - 1 AS id, n_name, n_regionkey FROM nation",
    "whole_numbers": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(l_quantity AS BIGINT) END AS l_quantity, CASE WHEN l_tax = floor(l_tax) THEN CAST(l_tax AS BIGINT) END AS l_tax FROM lineitem",
    "token_augment": f"""
        WITH {RECORDS}, t AS (SELECT id, {WORDS.format("trim(coalesce(name, ''))")} AS ws FROM records),
        p AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
        j AS (SELECT id, string_agg(w, ' ' ORDER BY md5(concat_ws('-', CAST(id AS VARCHAR), CAST(i AS VARCHAR), '42')), w) AS tokens FROM p GROUP BY id)
        SELECT t.id, coalesce(j.tokens, '') AS tokens FROM t LEFT JOIN j USING (id)""",
    "entity_split": """
        WITH e AS (SELECT DISTINCT gen_id AS entity FROM companies_master_mapping_seed_0 WHERE gen_id IS NOT NULL), n AS (SELECT count(*) AS n FROM e)
        SELECT entity, CASE WHEN row_number() OVER (ORDER BY entity) - 1 < floor(n * 0.6) THEN 'train' WHEN row_number() OVER (ORDER BY entity) - 1 < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM e, n""",
    "random_split": f"""
        WITH p AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, lid, rid) - 1 AS k, count(*) OVER () AS n FROM ({distinct_pairs('train')})), q AS (SELECT *, floor(n * 0.8 + 0.5) AS t FROM p)
        SELECT lid, rid, CASE WHEN k < t THEN 'train' WHEN k < t + floor((n - t) / 2) THEN 'val' ELSE 'test' END AS split FROM q""",
    "stratified_split": f"""
        WITH {PREDS}, r AS (SELECT lid, rid, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER}, lid, rid) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM preds)
        SELECT lid, rid, label, CASE WHEN k < floor(n * 0.25) THEN 'valid' ELSE 'train' END AS split FROM r""",
    "random_negatives": f"""
        WITH u AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM (SELECT DISTINCT id FROM camera WHERE id IS NOT NULL)), n AS (SELECT count(*) AS n FROM u),
        d AS (SELECT id, unnest(range(1, CAST(ceil(2000 / n) + 3 AS BIGINT))) AS k, n FROM u, n),
        drawn AS (SELECT d.id AS a, u.id AS b FROM d JOIN u ON u.p = CAST('0x' || substr(md5(concat_ws('-', CAST(d.id AS VARCHAR), CAST(k AS VARCHAR), '44')), 1, 12) AS BIGINT) % d.n),
        free AS (SELECT DISTINCT least(a, b) AS lid, greatest(a, b) AS rid FROM drawn WHERE a <> b EXCEPT SELECT least(lid, rid), greatest(lid, rid) FROM train),
        kept AS (SELECT * FROM free ORDER BY {ORDER}, lid, rid LIMIT 250)
        SELECT lid, rid, 0 AS label FROM kept UNION ALL SELECT rid, lid, 0 FROM kept""",
    "negatives_per_split": f"""
        WITH c AS (SELECT 'train' AS split, count(*) AS n FROM ({distinct_pairs('train', 'label = 1')}) UNION ALL SELECT 'val', count(*) FROM ({distinct_pairs('val', 'label = 1')})
          UNION ALL SELECT 'test', count(*) FROM ({distinct_pairs('test', 'label = 1')}))
        SELECT split, 1 AS label, n, n AS n_pairs FROM c WHERE n > 0 UNION ALL SELECT split, 0, 4 * n, 4 * n FROM c WHERE n > 0""",
    "hard_negatives": f"""
        WITH true_ AS ({distinct_pairs('train', 'label = 1')} UNION {distinct_pairs('val', 'label = 1')} UNION {distinct_pairs('test', 'label = 1')}),
        g AS ({distinct_pairs('train', 'label = 0')} EXCEPT SELECT * FROM true_), r AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, lid, rid) - 1 AS k, count(*) OVER () AS n FROM g)
        SELECT lid, rid, CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.6) + floor(n * 0.2) THEN 'test' ELSE 'val' END AS split FROM r""",
    "hard_negatives_filled": f"""
        WITH c AS (SELECT 'train' AS split, count(*) AS n FROM ({distinct_pairs('train', 'label = 1')}) UNION ALL SELECT 'val', count(*) FROM ({distinct_pairs('val', 'label = 1')})
          UNION ALL SELECT 'test', count(*) FROM ({distinct_pairs('test', 'label = 1')})),
        true_ AS ({distinct_pairs('train', 'label = 1')} UNION {distinct_pairs('val', 'label = 1')} UNION {distinct_pairs('test', 'label = 1')}),
        g AS (SELECT count(*) AS g FROM ({distinct_pairs('train', 'label = 0')} EXCEPT SELECT * FROM true_)),
        s AS (SELECT split, n, g, CAST(floor(n / (SELECT sum(n) FROM c) * g) AS BIGINT) AS h FROM c, g),
        d AS (SELECT split, n, CASE WHEN split = 'val' THEN g - (SELECT sum(h) FROM s WHERE split <> 'val') ELSE h END AS h FROM s)
        SELECT split, 1 AS label, n FROM d WHERE n > 0 UNION ALL SELECT split, 0, CAST(h + greatest(0, 4 * n - h) + greatest(0, 4 * n - h) % 2 AS BIGINT) FROM d WHERE n > 0""",
    "validation_sample": f"""
        WITH p AS ({distinct_pairs('val', 'label = 1')}) SELECT 1 AS label, least(count(*), 40) AS n FROM p UNION ALL SELECT 0, 460""",
    "dataset_pairs": """
        WITH m AS (SELECT DISTINCT upper(trim(entity_id)) AS entity, c.id FROM camera_entity_resolution_gt g JOIN camera c USING (spec_id) WHERE entity_id IS NOT NULL),
        e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM m)),
        s AS (SELECT entity, CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM e)
        SELECT DISTINCT split, a.id AS lid, b.id AS rid FROM m a JOIN m b ON a.entity = b.entity AND a.id < b.id JOIN s ON s.entity = a.entity""",
    "split_strategies": f"""
        WITH n AS (SELECT count(*) AS n FROM ({distinct_pairs('train')})), t AS (SELECT n, CAST(floor(n * 0.8 + 0.5) AS BIGINT) AS t FROM n), v AS (SELECT n, t, CAST(floor((n - t) / 2) AS BIGINT) AS v FROM t)
        SELECT 'random' AS how, 'train' AS split, t AS n FROM v UNION ALL SELECT 'random', 'val', v FROM v UNION ALL SELECT 'random', 'test', n - t - v FROM v
        UNION ALL SELECT 'pre_split', 'train', 0 UNION ALL SELECT 'pre_split', 'val', 0 UNION ALL SELECT 'pre_split', 'test', count(*) FROM ({distinct_pairs('test')})""",
    "pairs_within_entity": """
        WITH m AS (SELECT DISTINCT upper(trim(entity_id)) AS entity, c.id FROM camera_entity_resolution_gt g JOIN camera c USING (spec_id) WHERE entity_id IS NOT NULL)
        SELECT a.id AS lid, b.id AS rid, 1 AS label, a.entity FROM m a JOIN m b ON a.entity = b.entity AND a.id < b.id""",
    "close_truth": f"""
        WITH RECURSIVE t AS ({distinct_pairs('test', 'label = 1')}), both_ways AS (SELECT lid AS a, rid AS b FROM t UNION SELECT rid, lid FROM t),
        reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
        members AS (SELECT node AS id, min(root) AS c FROM reach GROUP BY node)
        SELECT a.id AS lid, b.id AS rid, 1 AS label FROM members a JOIN members b ON a.c = b.c AND a.id < b.id""",
    "block_id_overlap": f"""
        WITH {RECORDS}, x AS (SELECT DISTINCT id, data_source_id AS s, 'name' AS kind, lower(trim(name)) AS value FROM records
          UNION SELECT id, data_source_id, 'place', concat_ws('|', lower(city), country_code, CAST(founded_year AS VARCHAR)) FROM records WHERE city IS NOT NULL AND founded_year IS NOT NULL)
        SELECT DISTINCT a.id AS lid, b.id AS rid FROM x a JOIN x b ON a.kind = b.kind AND a.value = b.value AND a.s <> b.s AND a.id < b.id WHERE a.value <> ''""",
    "block_token_topn_cross": f"WITH {RECORDS}, {OVERLAP} SELECT lid, rid, overlap, rank FROM near",
    "block_token_topn_single": f"""
        WITH t AS (SELECT DISTINCT id, unnest({WORDS.format('title')}) AS token FROM (SELECT id, min(page_title) AS title FROM camera GROUP BY id)),
        c AS (SELECT a.id AS lid, b.id AS rid, count(*) AS overlap FROM t a JOIN t b ON a.token = b.token AND a.id <> b.id GROUP BY ALL)
        SELECT lid, rid, overlap, CAST(row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) <= 10""",
    "block_union_labelled": f"""
        WITH {RECORDS}, {OVERLAP}, u AS (SELECT lid, rid, 'id_overlap' AS match_type, 0 AS p FROM named UNION ALL SELECT least(lid, rid), greatest(lid, rid), 'text_match', 1 FROM near),
        one AS (SELECT lid, rid, match_type FROM u QUALIFY row_number() OVER (PARTITION BY lid, rid ORDER BY p) = 1),
        e AS (SELECT DISTINCT c.id, m.gen_id AS entity FROM companies c JOIN companies_master_mapping_seed_0 m ON upper(trim(c.external_id)) = upper(trim(m.external_id)) AND c.data_source_id = m.data_source_id WHERE gen_id IS NOT NULL)
        SELECT lid, rid, match_type, CASE WHEN EXISTS (SELECT 1 FROM e a JOIN e b ON a.entity = b.entity WHERE a.id = one.lid AND b.id = one.rid) THEN 1 ELSE 0 END AS label FROM one""",
    "block_rules": f"""
        WITH {RECORDS}, p AS ({distinct_pairs('pairwise_matches_preds')})
        SELECT p.lid, p.rid FROM p JOIN records a ON a.id = p.lid JOIN records b ON b.id = p.rid
        WHERE NOT coalesce(NOT list_has_any({WORDS.format('a.city')}, {WORDS.format('b.city')}), false) AND NOT coalesce(a.founded_year > 0 AND b.founded_year > 0 AND a.founded_year <> b.founded_year, false)""",
    "block_cosine_topk": f"WITH {COSINE} SELECT lid, rid, sim, rank FROM top",
    "block_rank_slice": f"WITH {COSINE} SELECT lid, rid, sim, rank FROM top WHERE rank BETWEEN 2 AND 3",
    "mutual_nn_pseudo_labels": f"""
        WITH {COSINE}, best AS (SELECT lid, rid, sim AS top_sim FROM top WHERE rank = 1), mutual AS (SELECT a.* FROM best a JOIN best b ON a.lid = b.rid AND a.rid = b.lid)
        SELECT lid, rid, 1 AS label FROM mutual UNION ALL SELECT t.lid, t.rid, 0 FROM top t JOIN mutual m ON m.lid = t.lid WHERE t.rank > 1 AND round(m.top_sim - t.sim, 9) >= 0.02""",
    "score_jaccard": jaccard("len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))"),
    "score_containment": jaccard("least(len(a.w), len(b.w))"),
    "graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "block_cosine_both": f"""
        WITH {UNIT}, sims AS (SELECT a.id AS lid, b.id AS rid, round(list_dot_product(a.v, b.v), 9) AS sim FROM unit a JOIN unit b ON a.id <> b.id),
        l AS (SELECT lid, rid, sim, row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) AS rank FROM sims), r AS (SELECT lid, rid, sim, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, lid) AS rank FROM sims)
        SELECT lid, rid, round(sim, 5) AS sim, CAST(rank AS INTEGER) AS rank, 'left' AS side FROM l WHERE rank <= 3 UNION ALL SELECT lid, rid, round(sim, 5), CAST(rank AS INTEGER), 'right' FROM r WHERE rank <= 3""",
    "graph_components_rounds": f"WITH RECURSIVE {MEMBERS} SELECT id, component_id FROM members",
    "min_edge_cut": f"""
        WITH RECURSIVE {MEMBERS}, fit AS (SELECT component_id FROM sizes WHERE size <= 50), own AS (SELECT m.component_id, e.lid, e.rid FROM edges e JOIN members m ON m.id = e.lid JOIN fit USING (component_id)),
        walk(lid, rid, node) AS (
          SELECT lid, rid, lid FROM own UNION SELECT w.lid, w.rid, b.b FROM walk w JOIN both_ways b ON b.a = w.node WHERE NOT (least(b.a, b.b) = w.lid AND greatest(b.a, b.b) = w.rid)
        ), bridges AS (SELECT o.component_id, count(*) AS n FROM own o WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.lid = o.lid AND w.rid = o.rid AND w.node = o.rid) GROUP BY 1)
        SELECT component_id, coalesce(n, 0) > 0 AS single, true AS within_degree, true AS two_parts FROM fit LEFT JOIN bridges USING (component_id)""",
    "shortest_paths": f"""
        WITH RECURSIVE {STATE}, wanted AS (SELECT component_id, lid AS src, rid AS dst FROM scored WHERE prob = 0), s AS (SELECT DISTINCT src FROM wanted),
        walk(src, node, d) AS (SELECT src, src, 0 FROM s UNION SELECT w.src, b.b, w.d + 1 FROM walk w JOIN both_ways b ON b.a = w.node WHERE w.d < 50),
        near AS (SELECT src, node, min(d) AS d FROM walk GROUP BY src, node)
        SELECT component_id, w.src, dst, d AS length, true AS arrives FROM wanted w JOIN near n ON n.src = w.src AND n.node = w.dst""",
    "update_predictions": f"""
        WITH RECURSIVE {STATE}, bad AS (SELECT DISTINCT component_id FROM scored WHERE prob < 0.999),
        checked AS (SELECT DISTINCT m.component_id FROM edges e JOIN members m ON m.id = e.lid WHERE e.manual_check_label >= 0)
        SELECT component_id, component_id IN (SELECT component_id FROM bad) AS split FROM sizes WHERE size <= 50 AND component_id NOT IN (SELECT component_id FROM checked)""",
    "select_edges_to_label": "SELECT true AS within_budget, 0 AS not_edges, 0 AS without_negative, 0 AS out_of_order",
    "clean_match_graph": f"""
        WITH RECURSIVE {STATE}, c AS (SELECT count(*) FILTER (WHERE prob IS NOT NULL AND label IS NOT NULL) AS counted, count(*) FILTER (WHERE prob >= 0.999 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 0.999 AND label = 0) AS fp FROM preds),
        v AS (SELECT count(*) FILTER (WHERE prob < 0.999) AS q, count(*) FILTER (WHERE prob >= 0.999) AS p FROM scored),
        s AS (SELECT unnest(range(9)) AS step, unnest(['start', 'iteration 1', 'iteration 2', 'iteration 3', 'iteration 4', 'iteration 5', 'post clean-up', 'checks', 'recovery']) AS stage)
        SELECT step, stage, counted, false AS over_budget, CASE WHEN step = 0 THEN tp END AS true_positives, CASE WHEN step = 0 THEN fp END AS false_positives,
          CASE WHEN step = 0 THEN q END AS negative_transitive_preds, CASE WHEN step = 0 THEN p END AS positive_transitive_preds FROM s, c, v""",
    "sink_round_trip": f"SELECT fmt, lid, rid FROM ({distinct_pairs('test')}), (SELECT unnest(['csv', 'json', 'parquet', 'orc']) AS fmt)",
    "stage_resume": f"SELECT count(*) AS n_rows, 1 AS next_iteration FROM ({distinct_pairs('test')})",
    "first_as_id": "SELECT n_nationkey AS id, n_name FROM nation",
    "entity_records": f"""
        WITH {RECORDS}, e AS (SELECT DISTINCT c.id, m.gen_id AS entity FROM companies c JOIN companies_master_mapping_seed_0 m ON upper(trim(c.external_id)) = upper(trim(m.external_id)) AND c.data_source_id = m.data_source_id WHERE gen_id IS NOT NULL),
        k AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM e))
        SELECT entity, id, data_source_id, external_id FROM records JOIN e USING (id) JOIN k USING (entity) WHERE k >= floor(n * 0.8)""",
    "explode_candidates": "SELECT lid, rid, CAST(row_number() OVER (PARTITION BY lid ORDER BY rid) AS INTEGER) AS rank FROM (SELECT DISTINCT lid, rid FROM train WHERE lid IS NOT NULL AND rid IS NOT NULL)",
    "retire_searches": f"""
        WITH {UNIT}, sims AS (SELECT a.id AS lid, b.id AS rid, round(list_dot_product(a.v, b.v), 9) AS sim FROM unit a JOIN unit b ON a.id <> b.id),
        s AS (SELECT lid, rid, round(sim, 5) AS sim FROM sims QUALIFY row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) <= 10),
        p AS (SELECT lid, sim, CAST(sim >= 0.3 AS INTEGER) AS pred, row_number() OVER (PARTITION BY lid ORDER BY sim, rid DESC) AS n FROM s),
        g AS (SELECT lid, max(pred) AS any_, max(CASE WHEN n <= 3 THEN pred END) AS tail, count(*) AS n, min(sim) AS low FROM p GROUP BY lid)
        SELECT lid AS id FROM g WHERE (any_ = 1 AND tail = 0) OR (any_ = 0 AND (n >= 10 OR low < 0.1))""",
    "search_depth": f"""
        WITH {RECORDS}, r AS (SELECT * FROM records), tokens AS (SELECT DISTINCT id, data_source_id AS s, unnest({WORDS.format('name')}) AS token FROM r),
        counts AS (SELECT a.id AS lid, b.id AS rid, count(*) AS overlap FROM tokens a JOIN tokens b ON a.token = b.token AND a.id <> b.id AND a.s <> b.s GROUP BY ALL),
        t AS (SELECT lid, row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) AS rank FROM counts QUALIFY row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, rid) <= 10)
        SELECT lid, count(*) AS n, CAST(max(rank) AS INTEGER) AS depth, 0 AS pred FROM t GROUP BY lid""",
    "prediction_log": jaccard("len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))", "p.lid AS lids, p.rid AS rids, coalesce(y.label, 0) AS labels, CAST({0} >= 0.5 AS INTEGER) AS predictions, round({0}, 6) AS prediction_proba",
        "LEFT JOIN (SELECT least(lid, rid) AS lid, greatest(lid, rid) AS rid, max(label) AS label FROM val GROUP BY 1, 2) y ON y.lid = p.lid AND y.rid = p.rid"),
    "predictions_from_log": jaccard("len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))", "p.lid, p.rid, round({0}, 6) AS prob, 'text_match' AS match_type"),
    "learned_scorer": "SELECT true AS separates, 0 AS out_of_range",
    "active_loop": "SELECT 100 AS spent, true AS both_classes, 0 AS unscored",
    "training_rows": f"WITH {PREDS} SELECT lid, rid, label FROM preds WHERE CASE WHEN prob > 0.5 AND prob <= 0.999 AND label IS NOT NULL THEN label ELSE coalesce(manual_check_label, -1) END = 0",
    "agreed_training": PSEUDO + """, b AS (SELECT lid, rid, CAST(score >= 0.3 AS INTEGER) AS label FROM scored WHERE CAST(score > 0.5 AS INTEGER) = CAST(score >= 0.3 AS INTEGER)),
        u AS (SELECT lid, rid, label, 0 AS p FROM b UNION ALL SELECT lid, rid, label, 1 FROM pseudo WHERE label IS NOT NULL),
        o AS (SELECT lid, rid, label FROM u QUALIFY row_number() OVER (PARTITION BY lid, rid ORDER BY p) = 1)
        SELECT o.lid, o.rid, o.label FROM o WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.lid = o.lid AND s.rid = o.rid AND s.score BETWEEN 0.45 AND 0.55)""",
    "balanced_training": PSEUDO + """, c AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM scored WHERE score BETWEEN 0.49 AND 0.51),
        r AS (SELECT lid, rid, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('-', CAST(lid AS VARCHAR), CAST(rid AS VARCHAR))), lid, rid) AS n FROM pseudo WHERE label IS NOT NULL)
        SELECT lid, rid, label FROM r, c WHERE (label = 1 AND n <= 3 * p) OR (label = 0 AND p > 0 AND n <= 3 * q)""",
    "metrics_stage_report": CONFUSION.replace("WITH ", "WITH RECURSIVE ", 1).replace(PREDS, MEMBERS)
    + """, c AS (SELECT count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM outcomes),
        r AS (SELECT *, round(tp * 100.0 / nullif(tp + fp, 0), 2) AS precision, round(tp * 100.0 / nullif(tp + fn, 0), 2) AS recall FROM c),
        h AS (SELECT a.component_id, count(*) AS hits FROM preds p JOIN members a ON a.id = p.lid JOIN members b ON b.id = p.rid AND a.component_id = b.component_id WHERE p.label = 1 GROUP BY 1),
        u AS (SELECT round(sum(coalesce(hits, 0) / (size * (size - 1) / 2) * size) / sum(size), 6) AS purity FROM sizes LEFT JOIN h USING (component_id) WHERE size > 1)
        SELECT 'before' AS stage, r.*, round(2 * precision * recall / nullif(precision + recall, 0), 2) AS f1, purity FROM r, u""",
    "metrics_budget_curve": f"""
        WITH {PREDS}, p AS (SELECT label, prob, c / 10.0 AS cut FROM preds, range(5, 10) r(c) WHERE label IS NOT NULL AND prob IS NOT NULL),
        x AS (SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (WHERE prob BETWEEN 0.5 AND cut) AS spent, count(*) FILTER (WHERE prob >= 0.5 AND label = 1 AND (prob <= cut OR prob > cut)) AS tp,
          count(*) FILTER (WHERE (prob BETWEEN 0.5 AND cut AND label = 1) OR prob > cut) AS kept FROM p GROUP BY cut)
        SELECT cut, spent, round(tp / nullif(kept, 0), 6) AS precision FROM x""",
    "block_embed_topk": f"""
        WITH {RECORDS}, w AS (SELECT id, unnest(list_distinct({WORDS.format("concat_ws(' ', name, city)")})) AS w FROM records), h AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM w),
        x AS (SELECT id, h % 128 AS d, sum(CASE WHEN (h >> 20) & 1 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id),
        u AS (SELECT x.id, d, CAST(x AS DOUBLE) / n AS x FROM x JOIN n USING (id) WHERE n > 0),
        l AS (SELECT DISTINCT n.id FROM n JOIN records r USING (id) WHERE data_source_id = '1' AND n > 0), r AS (SELECT DISTINCT n.id FROM n JOIN records r USING (id) WHERE data_source_id <> '1' AND n > 0),
        dots AS (SELECT a.id AS lid, b.id AS rid, sum(a.x * b.x) AS sim FROM u a JOIN l ON l.id = a.id JOIN u b ON a.d = b.d JOIN r ON r.id = b.id GROUP BY ALL),
        sims AS (SELECT l.id AS lid, r.id AS rid, round(coalesce(sim, 0), 9) AS sim FROM l CROSS JOIN r LEFT JOIN dots ON dots.lid = l.id AND dots.rid = r.id),
        p AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY sim DESC, rid) AS rank FROM sims), q AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, lid) AS rank FROM sims)
        SELECT lid, rid, round(sim, 5) AS sim, CAST(rank AS INTEGER) AS rank, 'left' AS side FROM p WHERE rank <= 3 UNION ALL SELECT lid, rid, round(sim, 5), CAST(rank AS INTEGER), 'right' FROM q WHERE rank <= 3""",
    "post_cleanup": "SELECT 0 AS open, 0 AS added, 0 AS raised, 0 AS lost",
    "edge_recovery": "SELECT true AS some, 0 AS odd, 0 AS big",
    "graph_components": f"WITH RECURSIVE {MEMBERS} SELECT id, component_id FROM members",
    "component_sizes": f"WITH RECURSIVE {MEMBERS} SELECT component_id, size FROM sizes",
    "component_edges": f"WITH RECURSIVE {MEMBERS} SELECT m.component_id, e.lid, e.rid FROM edges e JOIN members m ON m.id = e.lid",
    "transitive_pairs_capped": f"WITH RECURSIVE {MEMBERS}, {transitive('s.size <= 50')} SELECT lid, rid, 'transitive_match' AS match_type FROM transitive",
    "transitive_pairs_recovery": f"WITH RECURSIVE {MEMBERS}, {transitive('s.size < 5')} SELECT lid, rid, 'transitive_match' AS match_type FROM transitive",
    "transitive_pairs_recovery_50": f"WITH RECURSIVE {MEMBERS}, {transitive('s.size < 50')} SELECT lid, rid, 'transitive_match' AS match_type FROM transitive",
    "transitive_pairs_all": f"WITH RECURSIVE {MEMBERS}, {transitive('true')} SELECT lid, rid, 'transitive_match' AS match_type FROM transitive",
    "transitive_pairs_sampled": f"""
        WITH RECURSIVE {MEMBERS}, part_ AS (SELECT id, component_id FROM members QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY md5(concat_ws('-', CAST(id AS VARCHAR), '42')), id) <= 10),
        {transitive('true', 'part_')} SELECT lid, rid, 'transitive_match' AS match_type FROM transitive""",
    "transitive_pairs_sampled_50": f"""
        WITH RECURSIVE {MEMBERS}, part_ AS (SELECT id, component_id FROM members QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY md5(concat_ws('-', CAST(id AS VARCHAR), '42')), id) <= 50),
        {transitive('true', 'part_')} SELECT lid, rid, 'transitive_match' AS match_type FROM transitive""",
    "augmented_graph": f"WITH RECURSIVE {MEMBERS}, {transitive('s.size <= 50')} SELECT lid, rid, prob, match_type FROM edges UNION ALL SELECT lid, rid, 0.0, 'transitive_match' FROM transitive",
    "big_components": f"WITH RECURSIVE {MEMBERS} SELECT component_id, size FROM sizes WHERE size > 20",
    "transitive_votes": f"WITH RECURSIVE {STATE} SELECT component_id, count(*) FILTER (WHERE prob < 0.999) AS negative, count(*) FILTER (WHERE prob >= 0.999) AS positive FROM scored GROUP BY component_id",
    "truncate_large_components": f"""
        WITH RECURSIVE {MEMBERS} SELECT p.lid, p.rid, CASE WHEN prob > 0.999 AND s.size > 10 THEN 0.0 ELSE prob END AS prob
        FROM preds p LEFT JOIN members m ON m.id = p.lid LEFT JOIN sizes s ON s.component_id = m.component_id""",
    "check_large": f"WITH RECURSIVE {MEMBERS} {checks('SELECT component_id FROM sizes WHERE size > 10')}",
    "check_transitive": f"WITH RECURSIVE {STATE} {checks('SELECT component_id FROM scored WHERE prob < 0.999')}",
    "check_checked_false": f"""
        WITH RECURSIVE {MEMBERS}, {transitive('s.size <= 50')}
        {checks('SELECT t.component_id FROM transitive t JOIN preds q ON q.lid = t.lid AND q.rid = t.rid WHERE q.manual_check_label = 0')}""",
    "oracle_labels": f"""
        WITH {PREDS} SELECT lid, rid, CASE WHEN prob > 0.5 AND prob <= 0.999 AND label IS NOT NULL THEN label ELSE coalesce(manual_check_label, -1) END AS manual_check_label FROM preds""",
    "label_summary": f"""
        WITH {PREDS} SELECT count(*) FILTER (WHERE manual_check_label = 1) AS checked_positive, count(*) FILTER (WHERE manual_check_label = 0) AS checked_negative,
          count(*) FILTER (WHERE manual_check_label < 0) AS unchecked, count(*) FILTER (WHERE manual_check_label >= 0) AS effort, count(*) AS pairs,
          round(count(*) FILTER (WHERE manual_check_label >= 0) * 100.0 / nullif(count(*), 0), 4) AS percent_checked FROM preds""",
    "stage_counts": f"""
        WITH {PREDS} SELECT count(*) FILTER (WHERE prob >= 0.999 AND label = 1) AS true_positives, count(*) FILTER (WHERE prob >= 0.999 AND label = 0) AS false_positives,
          count(*) FILTER (WHERE prob < 0.999 AND label = 0) AS true_negatives, count(*) FILTER (WHERE prob < 0.999 AND label = 1) AS false_negatives,
          count(*) FILTER (WHERE manual_check_label >= 0) AS labeled_pairs FROM preds""",
    "metrics_confusion": CONFUSION + " SELECT lid, rid, outcome FROM outcomes",
    "metrics_prf": CONFUSION
    + """, c AS (SELECT count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM outcomes),
        r AS (SELECT *, round(tp * 100.0 / nullif(tp + fp, 0), 2) AS precision, round(tp * 100.0 / nullif(tp + fn, 0), 2) AS recall FROM c)
        SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 2) AS f1 FROM r""",
    "metrics_columns": f"""
        WITH {PREDS}, x AS (SELECT label AS y, CAST(prob >= 0.5 AS INTEGER) AS p FROM preds WHERE label IS NOT NULL AND prob IS NOT NULL),
        c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM x)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c""",
    "metrics_purity": f"""
        WITH RECURSIVE {MEMBERS}, h AS (SELECT a.component_id, count(*) AS hits FROM preds p JOIN members a ON a.id = p.lid JOIN members b ON b.id = p.rid AND a.component_id = b.component_id WHERE p.label = 1 GROUP BY 1)
        SELECT round(sum(coalesce(hits, 0) / (size * (size - 1) / 2) * size) / sum(size), 6) AS purity, count(*) AS n_components FROM sizes LEFT JOIN h USING (component_id) WHERE size > 1""",
    "metrics_components": f"""
        WITH RECURSIVE {MEMBERS}, c AS (SELECT count(DISTINCT component_id) AS linked FROM members), i AS (SELECT count(*) AS isolated FROM (SELECT DISTINCT id FROM companies WHERE id NOT IN (SELECT id FROM members)))
        SELECT linked, isolated, linked + isolated AS components FROM c, i""",
    "metrics_candidate_recall": f"""
        WITH t AS ({distinct_pairs('test', 'label = 1')}), c AS ({distinct_pairs('pairwise_matches_preds')})
        SELECT count(*) AS n_true, round(count(*) FILTER (WHERE lid IN (SELECT lid FROM c) AND rid IN (SELECT rid FROM c)) / nullif(count(*), 0), 6) AS recall_loose,
          round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c WHERE c.lid = t.lid AND c.rid = t.rid)) / nullif(count(*), 0), 6) AS recall_exact FROM t""",
    "metrics_threshold_scan": f"""
        WITH {PREDS}, s AS (SELECT prob AS s, label FROM preds WHERE label IS NOT NULL AND prob IS NOT NULL), t AS (SELECT i / 20.0 AS threshold FROM range(20) r(i)),
        c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE s >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE s < threshold AND label = 1) AS fn FROM s, t GROUP BY threshold)
        SELECT *, round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "metrics_runs_mean_std": "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS std FROM orders GROUP BY o_orderpriority",
    "metrics_stage_unpivot": """
        WITH e AS (SELECT data_source_id, count(*) AS n, count(gen_id) AS mapped FROM companies_master_mapping_seed_0 WHERE data_source_id IS NOT NULL GROUP BY data_source_id),
        l AS (SELECT data_source_id AS stage, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM e UNION ALL SELECT data_source_id, 'mapped', mapped FROM e)
        SELECT stage, metric, value, value - lag(value) OVER (PARTITION BY metric ORDER BY stage) AS change FROM l""",
    "metrics_histogram": f"WITH {PREDS} SELECT CAST(least(floor(prob / (1.0 / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM preds WHERE prob BETWEEN 0 AND 1 GROUP BY 1",
    "metrics_adjusted_recall": f"""
        WITH {PREDS} SELECT round(count(*) FILTER (WHERE prob IS NOT NULL AND match_type = 'text_match') / nullif(count(*), 0), 6) AS blocking_recall,
          round(count(*) FILTER (WHERE prob >= 0.5 AND match_type = 'text_match') / nullif(count(*), 0), 6) AS adjusted_recall FROM preds WHERE label = 1""",
    "data_violations": """
        SELECT 'lid_set' AS rule, count(*) FILTER (WHERE lid IS NULL) AS n FROM pairwise_matches_preds UNION ALL
        SELECT 'prob_range', count(*) FILTER (WHERE NOT coalesce(prob BETWEEN 0 AND 1, false)) FROM pairwise_matches_preds UNION ALL
        SELECT 'label_set', count(*) FILTER (WHERE label IS NULL) FROM pairwise_matches_preds UNION ALL
        SELECT 'no_loop', count(*) FILTER (WHERE NOT coalesce(lid <> rid, false)) FROM pairwise_matches_preds""",
    "uncertainty_sample": f"""
        WITH {PREDS}, {SCORES}, up AS (SELECT * FROM scored WHERE score >= 0.5 ORDER BY score, lid, rid LIMIT 50),
        down AS (SELECT * FROM scored WHERE score < 0.5 QUALIFY row_number() OVER (ORDER BY score DESC, lid, rid) <= 100 - (SELECT count(*) FROM up))
        SELECT * FROM up UNION ALL SELECT * FROM down""",
    "best_per_side": f"""
        WITH {PREDS}, {SCORES}, s AS (SELECT * FROM scored WHERE score > 0.5)
        SELECT lid, rid, 1 AS label FROM (SELECT lid, rid FROM s QUALIFY row_number() OVER (PARTITION BY lid ORDER BY score DESC, rid) = 1 UNION SELECT lid, rid FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, lid) = 1)""",
    "matcher_pseudo_labels": PSEUDO + " SELECT lid, rid, score, label FROM pseudo WHERE label IS NOT NULL",
    "consistency_check": PSEUDO
    + """, pos AS (SELECT DISTINCT lid, rid FROM pseudo WHERE label = 1), n AS (SELECT lid, count(*) AS n FROM pos GROUP BY lid),
        near AS (SELECT DISTINCT p.lid AS a, q.lid AS b FROM pos p JOIN n ON n.lid = p.lid AND n.n > 1 JOIN pos q ON q.rid = p.rid), size AS (SELECT a, count(*) AS k FROM near GROUP BY a),
        agreed AS (SELECT near.a AS lid, q.rid FROM near JOIN pos q ON q.lid = near.b JOIN size USING (a) GROUP BY near.a, q.rid, k HAVING count(DISTINCT near.b) = k)
        SELECT p.lid, p.rid, p.label FROM pseudo p JOIN n ON n.lid = p.lid WHERE p.label = 1 AND (n.n = 1 OR EXISTS (SELECT 1 FROM agreed g WHERE g.lid = p.lid AND g.rid = p.rid))
        UNION ALL SELECT lid, rid, label FROM pseudo WHERE label = 0""",
    "similarity_gap": f"""
        WITH {PREDS}, {SCORES}, g AS (SELECT min(score) FILTER (WHERE label = 1) - max(score) FILTER (WHERE label = 0) AS gap FROM scored GROUP BY lid)
        SELECT round(coalesce(quantile_cont(gap, 0.1), 0.01), 6) AS gap FROM g WHERE gap > 0""",
    "positive_threshold": f"WITH {PREDS}, {SCORES} SELECT round(quantile_cont(score, 0.25), 6) AS threshold FROM scored WHERE label = 1",
    "annotate_samples": """
        WITH s AS (SELECT DISTINCT lid, rid FROM val WHERE lid IS NOT NULL AND rid IS NOT NULL), t AS (SELECT lid, rid, max(label) AS y FROM train WHERE lid IS NOT NULL AND rid IS NOT NULL GROUP BY ALL)
        SELECT s.lid, s.rid, coalesce(y, 0) AS label FROM s LEFT JOIN t USING (lid, rid)""",
    "pseudo_label_quality": PSEUDO
    + """, x AS (SELECT p.label AS guess, s.label FROM pseudo p JOIN scored s USING (lid, rid) WHERE p.label IS NOT NULL AND NOT (s.score BETWEEN 0.4 AND 0.6))
        SELECT guess AS label, count(*) AS n, count(*) FILTER (WHERE guess = label) AS "right", round(count(*) FILTER (WHERE guess = label) / count(*), 6) AS precision FROM x GROUP BY guess""",
    "merge_votes": f"""
        WITH {PREDS}, {SCORES}, o AS (SELECT lid, rid, score FROM scored WHERE score >= 0.3), w AS (SELECT lid, rid, score FROM scored WHERE score <= 0.7)
        SELECT coalesce(o.lid, w.lid) AS lid, coalesce(o.rid, w.rid) AS rid, CASE WHEN o.lid IS NULL THEN 1 WHEN w.lid IS NULL THEN 2 ELSE 3 END AS votes,
          round((coalesce(2 * o.score, 0) + coalesce(w.score, 0)) / (CASE WHEN o.lid IS NULL THEN 1 WHEN w.lid IS NULL THEN 2 ELSE 3 END), 6) AS avg_score
        FROM o FULL OUTER JOIN w ON o.lid = w.lid AND o.rid = w.rid""",
}
