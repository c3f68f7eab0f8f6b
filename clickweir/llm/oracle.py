"""SQL of the operators that shard documents, mine phrases and repair conversations."""

from __future__ import annotations

from clickweir.llm import phrases, shards


def _crc_table() -> list[int]:
    """The table of the checksum's polynomial, reversed 0xEDB88320."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text that is not null."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda c, b: xor(c >> 8, list_extract({_crc_table()}, xor(c, b) % 256 + 1)), 4294967295::BIGINT))"""


_HALF = "(SELECT half FROM shape)"
_OUTSIDE = "place >= (SELECT n FROM shape)"


def _feistel() -> str:
    """Common table expressions r0 to the last round, over the numbers of the walk that are not inside yet."""
    steps = [f"r0 AS (SELECT number, place >> {_HALF} AS l, place & ((1::BIGINT << {_HALF}) - 1) AS r FROM walk WHERE step = 0 OR {_OUTSIDE})"]
    for i, (a, b, c) in enumerate(shards.round_keys(shards.SEED)):
        mixed = f"((r * {a} + {b}) & {shards._WORD})"
        steps.append(f"r{i + 1} AS (SELECT number, r AS l, xor(l, ((xor({mixed}, {mixed} >> 15) * {c}) & {shards._WORD}) >> (31 - {_HALF})) AS r FROM r{i})")
    return ", ".join(steps)


OP11 = f"""
WITH RECURSIVE numbered AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) - 1 AS number FROM documents),
shape AS (SELECT count(*) AS n, greatest(1, CASE WHEN count(*) < 2 THEN 0 ELSE (length(ltrim(bin(count(*) - 1), '0')) + 1) // 2 END)::INT AS half FROM documents),
walk AS (SELECT number, number AS place, 0 AS step FROM numbered
  UNION ALL (WITH {_feistel()} SELECT number, (l << {_HALF}) | r, 1 FROM r{shards.ROUNDS})),
placed AS (SELECT number, place FROM walk WHERE step = 1 AND NOT {_OUTSIDE})
SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, {_crc32("coalesce(text, '')")} AS text_crc32, '{shards.LAW}' AS law,
  (place % {shards.SHARDS})::INT AS shard, place // {shards.SHARDS} AS slot, NULL::INT AS grown_shard FROM numbered JOIN placed USING (number)
"""

OP12 = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM pieces, (VALUES (1), (2), (3), (4), (5)) lengths(k) WHERE len(w) >= k)),
listed AS (SELECT lang, phrase, k, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase, k HAVING count(*) >= {phrases.LEAST}),
within AS (SELECT lang, f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM listed WHERE k > 2),
kept AS (SELECT * FROM listed c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM within i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= {phrases.CONTAINED} * c.f)),
cuts AS (SELECT lang, phrase, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, j, ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN listed h ON h.lang = c.lang AND h.phrase = head JOIN listed t ON t.lang = c.lang AND t.phrase = tail JOIN totals s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {phrases.FIRST}
"""


# The state of a conversation's grammar -> the role that goes on from it: nothing yet, after a system, user or assistant row.
_WANTED = {"q": "u", "s": "u", "u": "a", "a": "u"}
_NEVER = 1 << 40


def _least(*ways: tuple[str, str]) -> str:
    """The cheapest of (cost, audit), of equals the least by ASCII."""
    structs = ", ".join(f"struct_pack(c := ({cost})::BIGINT, a := {audit})" for cost, audit in ways)
    return f"list_sort([{structs}])[1]"


def _with_row(state: str) -> str:
    """The best way from a state that deletes, keeps or changes the row first; columns q, s, u, a are those behind the row."""
    roles, late, wanted = (["s", "u"] if state == "q" else [_WANTED[state]]), "CASE WHEN fault = 't' THEN 3 ELSE 0 END", _WANTED[state]
    keep = " ".join(f"WHEN initial = '{r}' THEN {r}.c + {late}" for r in roles)
    kept = " ".join(f"WHEN initial = '{r}' THEN {r}.a" for r in roles)
    must = "fault IN ('b', 'd')"
    return _least((f"{state}.c + 4", f"'D' || {state}.a"), (f"CASE WHEN {must} THEN {_NEVER} {keep} ELSE {_NEVER} END", f"'K' || CASE {kept} ELSE '' END"),
                  (f"CASE WHEN {must} THEN {_NEVER} ELSE {wanted}.c + 3 + {late} END", f"'R' || {wanted}.a"))


def _with_insert(behind: str, name: str) -> str:
    """Columns `name`q and so on: the best way with no insert, or with one before the ways `behind`."""
    return ", ".join(_least((f"b{s}.c", f"b{s}.a"), (f"{behind}{w}.c + 3", f"'I' || {behind}{w}.a")) + f" AS {name}{s}" for s, w in _WANTED.items())


OP13 = f"""
WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
faults AS (SELECT conv_id, turn, role, text, place, role[1:1] AS initial, max(place) OVER (PARTITION BY conv_id) AS last,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY place) AS before, CASE WHEN trimmed = '' THEN 'b' WHEN again > 1 THEN 'd'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
-- From the last row to the first: cost and audit of the rest by state. Two inserts before a row help at most.
best AS (SELECT conv_id, last + 1 AS place, struct_pack(c := 0::BIGINT, a := '') AS q, struct_pack(c := 6::BIGINT, a := 'II') AS s,
    struct_pack(c := 3::BIGINT, a := 'I') AS u, struct_pack(c := 0::BIGINT, a := '') AS a FROM faults WHERE place = last UNION ALL
  (SELECT conv_id, place, {_with_insert("o", "")} FROM (SELECT *, {_with_insert("b", "o")} FROM (
    SELECT f.conv_id, f.place, {", ".join(f"{_with_row(s)} AS b{s}" for s in _WANTED)}
    FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.place = b.place - 1)))),
chosen AS (SELECT conv_id, q.c AS cost, q.a AS audit FROM best WHERE place = 1),
edits AS (SELECT conv_id, nth, audit[nth:nth] AS edit, sum(CASE WHEN audit[nth:nth] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth) AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS nth FROM chosen)),
kept AS (SELECT e.conv_id, e.edit, f.role, f.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.nth) AS seq,
    max(CASE WHEN f.initial = 's' AND e.edit = 'K' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN faults f ON e.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.place = e.place WHERE e.edit <> 'D'),
-- Users and assistants take turns, behind a kept system row if there is one.
lines AS (SELECT conv_id, seq, CASE WHEN edit = 'K' THEN role WHEN (seq + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM kept),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY seq)) AS hash FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
