"""SQL for queries of iterative operators that plain SQL can still state: the repair of conversations and vector codes."""

from __future__ import annotations

BLANK = r"[^\x20\x09-\x0D]"
NO_WAY = 1_000_000_000

#: CRC-32 of short texts, a byte at a time over a table of 256 values that a fold over eight bits gives.
CRC = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n))
"""


def _least(ways: list[tuple[str, str, str, str, str]]) -> str:
    """The least (cost, edits) of several ways to a state; a way: condition, state before, cost, edit, line it leaves."""
    made = [
        f"CASE WHEN {when} AND {state}.cost < {NO_WAY} THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', "
        f"'said': {f'list_append({state}.said, {line})' if line else f'{state}.said'}}} END"
        for when, state, cost, edit, line in ways
    ]
    return f"list_min(list_filter([{', '.join(made)}], lambda w: w IS NOT NULL))"


def repair_sql() -> str:
    """Turn by turn the least (cost, edits) of each state. Inserts never pay at these costs: deleting the turn that an
    inserted one would complete costs 2 against 5, so they are left out here; the operator has them.
    """
    follows = {"p0": [], "p1": [("p0", "s")], "p2": [("p0", "u"), ("p1", "u"), ("p3", "u")], "p3": [("p2", "a")]}
    said = {"u": "user", "a": "assistant"}
    none = f"{{'cost': {NO_WAY}, 'audit': '', 'said': []::VARCHAR[]}}"
    updates = []
    for to, steps in follows.items():
        ways = [("true", f"w.{to}", "2", "D", "")]
        for before, role in steps:
            ways.append((f"r.fault = '' AND r.initial = '{role}'", f"w.{before}", "r.extra", "K", "r.role || ':' || r.text"))
            if role in said:
                ways.append(("r.fault = ''", f"w.{before}", "r.extra + 1", "R", f"'{said[role]}:' || r.text"))
        updates.append(f"coalesce({_least(ways)}, {none}) AS {to}")
    return f"""
WITH RECURSIVE {CRC},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT g.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ord(k[i])), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind
    FROM given g, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
told AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS kind_of FROM seen),
rows_ AS (SELECT conv_id, turn, role, text, i, kind_of, left(role, 1) AS initial, CASE WHEN kind_of = 'truncated' THEN 5 ELSE 0 END AS extra,
    CASE WHEN kind_of IN ('blank', 'duplicate') THEN 'gone' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM told),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind_of = 'blank') AS blank,
    count(*) FILTER (kind_of = 'duplicate') AS duplicate, count(*) FILTER (kind_of = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS p0, {none} AS p1, {none} AS p2, {none} AS p3 FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL
  SELECT w.conv_id, r.i, {', '.join(updates)} FROM walk w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
ends AS (SELECT w.conv_id, list_min([w.p0, w.p3]) AS best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
    sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM convs v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry of its codebook, in whole numbers."""
    names = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row_, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT row_, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS q FROM kept, range({parts}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, e - 1 AS e, q FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM cut) WHERE e <= {entries})",
    ]
    for k in range(rounds + 1):
        # Equal distances: the least (distance, index).
        names.append(f"""a{k} AS MATERIALIZED (SELECT row_, p, any_value(q) AS q, min({{'d': d, 'e': e}}) AS m FROM (
  SELECT row_, c.p, c.q, b.e, list_inner_product(c.q, c.q) + list_inner_product(b.q, b.q) - 2 * list_inner_product(c.q, b.q) AS d FROM cut c JOIN b{k} b ON b.p = c.p) GROUP BY row_, p)""")
        if k < rounds:
            names.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.q, b.q) AS q FROM b{k} b LEFT JOIN (
  SELECT p, e, list(x ORDER BY i) AS q FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (
    SELECT p, m.e AS e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    names.append(f"coded AS (SELECT row_, string_agg(printf('%02x', CAST(m.e AS INT)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY row_)")
    names.append(f"book AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})")
    return "WITH " + ",\n".join(names) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (row_), book"""
