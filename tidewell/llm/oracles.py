"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from .quality_rules import BASE, BITS, CURRENT, RULES, mask

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _runs(n: int) -> str:
    """Runs of n words: (doc_id, p, g), c words each."""
    over = f"OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d), runs AS (SELECT doc_id, p, string_agg(x, ' ') {over} AS g, COUNT(*) {over} AS c FROM words)"


_OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
{_runs(20)},
win AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS rn FROM runs WHERE c = 20),
gone AS (SELECT DISTINCT doc_id, p + j AS p FROM win, range(20) r(j) WHERE rn > 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, COUNT(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
{_runs(4)},
s AS (SELECT DISTINCT doc_id, g FROM runs WHERE c = 4 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(MAX(n.n), 0) AS n_shingles, MIN(c) AS component_id, r.doc_id = MIN(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""

_FAILED = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())
_BASE = sum(BITS[name] for name in BASE)
_OP10 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
{_runs(8)},
win AS (SELECT doc_id, p, COUNT(*) OVER (PARTITION BY doc_id, g) AS again FROM runs WHERE c = 8),
again AS (SELECT doc_id, COUNT(DISTINCT p + j) AS n_repeat_words FROM win, range(8) r(j) WHERE again > 1 GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
f AS (SELECT *, {_FAILED} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {_BASE}) <> 0 AS base_failed, (failed & {mask(CURRENT) | _BASE}) = 0 AS kept, n_lines, failed FROM f"""

_OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5"""

_TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13 = f"""WITH d AS (SELECT doc_id, unnest({_TERMS.format(text=_LOWER)}) AS term FROM documents),
n AS (SELECT doc_id, COUNT(*) AS n FROM d GROUP BY 1), a AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS length FROM n),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format(text=_LOWER)}) AS term FROM benchmark),
f AS (SELECT doc_id, term, COUNT(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

ORACLES: dict[str, str] = {"op3_suffix_tree_dedup": _OP3, "op9_minhash_near_dedup": _OP9, "op10_quality_rules": _OP10, "op12_hard_negatives": _OP12, "op13_lexical_search": _OP13}
