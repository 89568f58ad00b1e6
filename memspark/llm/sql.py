"""The same in DuckDB's SQL for those operators that it can express."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWERED + r", '[^\x20\x09-\x0D]+')"


def jaccard_groups(words: int, percent: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
every AS (
    SELECT doc_id, {joined} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM d WHERE len(w) >= {words})
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {words - 1}
),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM every),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def repeats(length: int) -> str:
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS x, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(range(1, octet_length(x) + 1)) AS p FROM d),
s AS MATERIALIZED (SELECT doc_id, p, hash(substr(h, 2 * p - 1, {2 * length})) AS s FROM p JOIN d USING (doc_id) WHERE p + {length - 1} <= octet_length(x)),
again AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, p FROM s SEMI JOIN again USING (s)),
covered AS MATERIALIZED (
    SELECT p.doc_id, p.p, coalesce(max(CASE WHEN starts.p IS NOT NULL THEN 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.p ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW), 0) AS c
    FROM p LEFT JOIN starts ON starts.doc_id = p.doc_id AND starts.p = p.p
),
edges AS (SELECT doc_id, p, c, lag(c, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM covered),
counts AS (SELECT doc_id, sum(c) AS n_removed, sum(CASE WHEN c = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans FROM edges GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS kept FROM covered JOIN d USING (doc_id) WHERE c = 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def dedup_lines(percent: int, grams: int) -> str:
    return rf"""
WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, {WORDS.format("t")} AS w, regexp_replace({LOWERED.format("t")}, '[\x20\x09-\x0D]', '', 'g') AS solid FROM l),
sets AS MATERIALIZED (
    SELECT doc_id, k, 'w' AS kind, list_distinct(w) AS s FROM w WHERE len(w) > 0
    UNION ALL SELECT doc_id, k, 'g', list_distinct(list_transform(range(1, length(solid) - 1), lambda i: substr(solid, i, 3)))
    FROM w WHERE len(w) > 0 AND length(solid) >= 3 AND strlen(solid) >= {grams} * len(w)
),
t AS (SELECT doc_id, k, kind, len(s) AS n, unnest(s) AS x FROM sets),
f AS (SELECT kind, x, count(*) AS f FROM t GROUP BY ALL),
r AS (SELECT doc_id, k, kind, n, x, row_number() OVER (PARTITION BY doc_id, k, kind ORDER BY f, x) AS place FROM t JOIN f USING (kind, x)),
prefix AS MATERIALIZED (SELECT * FROM r WHERE place <= n - ((n * {percent} + 99) // 100) + 1),
pairs AS (
    SELECT DISTINCT a.doc_id AS a, a.k AS ak, b.doc_id AS b, b.k AS bk, a.kind FROM prefix a JOIN prefix b
    ON a.kind = b.kind AND a.x = b.x AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.k < b.k) AND a.n * 100 >= b.n * {percent} AND b.n * 100 >= a.n * {percent}
),
gone AS (
    SELECT DISTINCT b AS doc_id, bk AS k FROM pairs p
    JOIN sets x ON x.doc_id = p.a AND x.k = p.ak AND x.kind = p.kind JOIN sets y ON y.doc_id = p.b AND y.k = p.bk AND y.kind = p.kind
    WHERE 100 * len(list_intersect(x.s, y.s)) >= {percent} * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(l.t, chr(10) ORDER BY l.k) FILTER (WHERE gone.k IS NULL), '') END AS text,
    CAST(count(l.k) AS BIGINT) AS n_lines, CAST(count(gone.k) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k GROUP BY d.doc_id, d.text
"""


def conversations() -> str:
    """The DP goes over the rows one by one; of each of its four states the cheapest edits, of equal
    cost the ASCII-least, so a state is a struct of cost and edits, and least() compares both."""

    def add(state: str, cost: str, edit: str) -> str:
        return f"struct_pack(c := {state}.c + {cost}, e := {state}.e || '{edit}')"

    def kept(letter: str, states: list[str]) -> list[str]:
        return [f"CASE WHEN stays AND letter = '{letter}' THEN {add(s, 'extra', 'K')} END" for s in states]

    def rerole(states: list[str]) -> list[str]:
        return [f"CASE WHEN stays THEN {add(s, '1 + extra', 'R')} END" for s in states]

    inserted = [
        ("i0", ["s0"]),
        ("i1", ["s1"]),
        ("i2", ["s2", *(add(s, "5", "I") for s in ("s0", "s1", "s3"))]),
        ("i3", ["s3", add("s2", "5", "I"), add("s0", "10", "II"), add("s1", "10", "II")]),
    ]
    moved = [
        ("s0", [add("i0", "2", "D")]),
        ("s1", [add("i1", "2", "D"), *kept("s", ["i0"])]),
        ("s2", [add("i2", "2", "D"), *kept("u", ["i0", "i1", "i3"]), *rerole(["i0", "i1", "i3"])]),
        ("s3", [add("i3", "2", "D"), *kept("a", ["i2"]), *rerole(["i2"])]),
    ]
    least = lambda parts: f"least({', '.join(parts)})" if len(parts) > 1 else parts[0]  # noqa: E731
    start = ", ".join(f"struct_pack(c := CAST({0 if k == 0 else 10**9} AS BIGINT), e := '') AS s{k}" for k in range(4))
    return rf"""
WITH RECURSIVE crc AS (
    SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
        lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda c, i: xor(c >> 1, (c & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT)) % 20 AS k
    FROM (SELECT dense_rank() OVER (ORDER BY conv_id) AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)
),
damaged AS (
    SELECT id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
    FROM crc WHERE k <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faults AS MATERIALIZED (
    SELECT id, i, turn, role, text, substr(role, 1, 1) AS letter, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(substr(role, 1, 1)) OVER (PARTITION BY id ORDER BY i) AS earlier
    FROM placed
),
counts AS (
    SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND earlier || letter NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY id
),
steps AS (
    SELECT id, CAST(0 AS BIGINT) AS i, {start} FROM counts
    UNION ALL
    SELECT id, i, {", ".join(f"{least(parts)} AS {name}" for name, parts in moved)} FROM (
        SELECT s.id, f.i, f.letter, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, {", ".join(f"{least(parts)} AS {name}" for name, parts in inserted)}
        FROM steps s JOIN faults f ON f.id = s.id AND f.i = s.i + 1
    )
),
ended AS MATERIALIZED (SELECT id, {least(["s0", "s3", add("s2", "5", "I"), add("s1", "10", "II")])} AS r FROM steps JOIN counts USING (id) WHERE i = n),
chars AS (SELECT id, r.e AS e, unnest(range(1, length(r.e) + 1)) AS p FROM ended),
marked AS (SELECT id, p, substr(e, p, 1) AS edit, sum(CASE WHEN substr(e, p, 1) <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS i FROM chars),
kept AS (
    SELECT m.id, p, edit, row_number() OVER (PARTITION BY m.id ORDER BY p) AS place, CASE WHEN edit <> 'I' THEN text ELSE '' END AS text, role, first_value(CASE WHEN edit = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.id ORDER BY p) AS shift
    FROM marked m LEFT JOIN faults f ON f.id = m.id AND f.i = m.i WHERE edit <> 'D'
),
repaired AS (
    SELECT id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM kept GROUP BY id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(r.c, 0) AS BIGINT) AS cost, coalesce(r.e, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT id, conv_id FROM crc) o LEFT JOIN counts c ON c.id = o.id LEFT JOIN ended e ON e.id = o.id LEFT JOIN repaired p ON p.id = o.id
"""


ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": jaccard_groups(3, 90),
    "op5_repeats": repeats(200),
    "op9_lines": dedup_lines(80, 16),
    "op11_conversations": conversations(),
}
