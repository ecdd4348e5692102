"""DuckDB's text of what the newer operators return, written out step by step with recursion."""

from __future__ import annotations

#: crc32's table by its rule, and the checksum of an ASCII text x.
CRC = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32(x: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def merkle() -> str:
    said = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda n: "sha256(" + " || ".join(said(x) for x in ("doc_id::VARCHAR", "source", "lang", f"({n})::VARCHAR", "text")) + ")"
    tree = lambda name, base, key: f"""{name} AS ({base} UNION ALL SELECT {key}, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY {key}, level, pos // 2, n)"""
    fold = lambda s: f"CASE WHEN {s}.h IS NULL THEN sha256(f.h) WHEN f.pos & 1 = 1 THEN sha256({s}.h || f.h) ELSE sha256(f.h || {s}.h) END, proof || coalesce({s}.h, '')"
    return f"""WITH RECURSIVE {CRC},
        l AS (SELECT doc_id, coalesce('+' || lang, '') AS lang, {leaf('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {leaf('n_chars + 1')} END AS tampered FROM documents, crc),
        p AS (SELECT *, row_number() OVER (ORDER BY lang, doc_id NULLS FIRST, leaf) AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
        {tree('inside', 'SELECT lang, 0 AS level, pos, n, leaf AS h FROM p', 'lang')},
        subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang) - 1 AS pos, count(*) OVER () AS n FROM inside WHERE n = 1),
        {tree('outside', 'SELECT 0 AS tree, 0 AS level, pos, n, h FROM subroots', 'tree')},
        low AS (SELECT rid, lang, 0 AS level, pos, n, coalesce(tampered, leaf) AS h, '' AS proof FROM p
            UNION ALL SELECT f.rid, f.lang, f.level + 1, f.pos // 2, (f.n + 1) // 2, {fold('s')} FROM low f LEFT JOIN inside s ON s.lang = f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
        high AS (SELECT rid, 0 AS level, u.pos, u.n, f.h, proof FROM low f JOIN subroots u ON u.lang = f.lang WHERE f.n = 1
            UNION ALL SELECT f.rid, f.level + 1, f.pos // 2, (f.n + 1) // 2, {fold('s')} FROM high f LEFT JOIN outside s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
        SELECT doc_id, leaf, u.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM p JOIN subroots u ON u.lang = p.lang JOIN high f ON f.rid = p.rid AND f.n = 1, (SELECT h FROM outside WHERE n = 1) r"""


def repair() -> str:
    """A state is what a way to it costs, its audit and the text that is left; the ways of a turn are compared as such."""
    edit = lambda s, cost, letter, line="": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t" + (f" || CASE WHEN {s}.t = '' THEN '' ELSE chr(10) END || {line}" if line else "") + "}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    live = "more + CASE WHEN dead THEN 1000000000 ELSE 0 END"
    keep = lambda s, initial: edit(s, f"{live} + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000000 END", "K", "role || ':' || text")
    user, answer = "'user:'", "'assistant:'"
    far = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    return f"""WITH RECURSIVE {CRC},
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS time FROM k WHERE kind <> 0),
        i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
        f AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, right(body, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM i),
        g AS (SELECT *, blank OR duplicate AS dead, CASE WHEN cut THEN 1 ELSE 0 END AS more FROM f),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
            count(*) FILTER (WHERE cut AND NOT dead) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
        dp AS (SELECT conv_id, n, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {far} AS s1, {{'c': 2::BIGINT, 'a': 'I', 't': {user}}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 't': {user} || chr(10) || {answer}}} AS s3 FROM n
            UNION ALL SELECT conv_id, n, i, y0, y1, z2, {least('y3', edit('z2', 2, 'I', answer))} FROM (
                SELECT *, {least('y2', edit('y0', 2, 'I', user), edit('y1', 2, 'I', user), edit('y3', 2, 'I', user))} AS z2 FROM (
                    SELECT dp.conv_id, n, g.i, {edit('s0', 3, 'D')} AS y0, {least(edit('s1', 3, 'D'), keep('s0', 's'))} AS y1,
                        {least(edit('s2', 3, 'D'), *[x for s in ('s0', 's1', 's3') for x in (keep(s, 'u'), edit(s, f'2 + {live}', 'R', f"{user} || text"))])} AS y2,
                        {least(edit('s3', 3, 'D'), keep('s2', 'a'), edit('s2', f'2 + {live}', 'R', f"{answer} || text"))} AS y3
                    FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1))),
        b AS (SELECT conv_id, {least('s0', 's3')} AS s FROM dp WHERE i = n)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost,
            coalesce(s.a, '') AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""
