"""DuckDB statements for the corpus queries that SQL can express over whole tables.

The trained operators, the fingerprints (XXH64), the knapsack, the shuffle and the bootstrapped
extraction have none; their tests compare them with brute force, held-out rows or their laws.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _normal(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), "
            f"'{_NORMAL}')")


DECONTAMINATION = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, {_normal('text')} AS w FROM documents
), i AS (
    SELECT item_id, {_normal('text')} AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win
    FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
          FROM (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0))
), dw AS (
    SELECT rid, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
    FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s
          FROM d JOIN (SELECT DISTINCT k FROM iw) ON len(w) >= k)
), h AS (
    SELECT rid, s, k, item_id FROM dw JOIN iw USING (k, win)
), n AS (
    SELECT rid, count(DISTINCT p) AS n_hit
    FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT rid, s, k FROM h))
    GROUP BY rid
), x AS (
    SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM h
          WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN x USING (rid)
"""

SUBSTRING = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), win AS (
    SELECT rid, s, md5(array_to_string(w[s : s + 34], ' ')) AS h
    FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
), again AS (
    SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY h) AS c FROM win)
    WHERE c > 1
), gone AS (
    SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM again
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept
    FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
    ANTI JOIN gone USING (rid, p) GROUP BY rid
), n AS (
    SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token"))
# kind, pattern, group whose length counts, least length, in the order of a tie
_SECRETS = (
    ("assign", rf"""({_KEYS}|{_either_case('api')}_?{_either_case('key')})["'']?\x20*[:=]\x20*["'']?"""
               r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
)


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a kind with their places: lengths of the pieces between and the matches."""
    return f"""
    SELECT rid, {rank} AS rank, '{kind}' AS kind, stop - len(m) AS start, stop
    FROM (SELECT rid, m, g, sum(len(gap) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS stop
          FROM (SELECT rid, unnest(ms) AS m, unnest(gs) AS g,
                       unnest(gaps[1 : len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i
                FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms,
                             regexp_extract_all(t, '{pattern}', {group}) AS gs,
                             regexp_split_to_array(t, '{pattern}') AS gaps FROM d)))
    WHERE len(g) >= {least}"""


SECRETS = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), m AS ({' UNION ALL '.join(_matches(i, *rule) for i, rule in enumerate(_SECRETS))}
), s AS (
    SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
           count(*) FILTER (rank = 2) AS n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)
               FILTER (rank <= 2) AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM (SELECT rid, rank, kind, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
          FROM m) GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)
"""

SUFFIXES = """
WITH d AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS rid,
           doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), piece AS (    -- 500 bytes, and 99 more for strings that start in them
    SELECT rid, k, substr(x, k * 1000 + 1, 1198) AS p
    FROM (SELECT rid, x, unnest(range(0, (len(x) + 999) // 1000)) AS k FROM d)
), s AS (
    SELECT rid, k * 500 + i AS pos, md5(substr(p, 2 * i + 1, 200)) AS h
    FROM (SELECT rid, k, p, unnest(range(0, least(500, len(p) // 2 - 99))) AS i
          FROM piece WHERE len(p) >= 200)
), again AS (
    SELECT rid, pos FROM (SELECT rid, pos, row_number() OVER (PARTITION BY h ORDER BY rid, pos) AS r
                         FROM s) WHERE r > 1
), run AS (
    SELECT rid, min(pos) AS a, max(pos) + 100 AS b
    FROM (SELECT rid, pos, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS g
          FROM (SELECT rid, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) <= 100
                                     THEN 0 ELSE 1 END AS fresh FROM again))
    GROUP BY rid, g
), cut AS (
    SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM run
), kept AS (
    SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
    FROM cut JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    bits = ("list_reduce(range(8), lambda v, k: xor(v >> 1, "
            "CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))")
    # the first element starts the sum, so that an empty text has its checksum too
    codes = (f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST(concat('0x', "
             f"substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))")
    return (f"xor(list_reduce({codes}, lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), "
            "4294967295)")


TRIE = f"""
WITH own AS (
    SELECT conv_id AS c, list(struct_pack(t := md5(len(coalesce(role, '')) || ':'
               || coalesce(role, '') || coalesce(text, '')), n := len(coalesce(text, '')))
               ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(len(coalesce(role, '')) || ':'
               || coalesce(role, '') || coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), conv AS (
    SELECT o.c, list_concat(coalesce(b.turns, [])[1 : h], o.turns[h + 1 :]) AS turns
    FROM (SELECT *, {_crc32('CAST(c AS VARCHAR)')} % 6 AS h FROM own) o
    LEFT JOIN own b ON b.c = o.c - o.c % 100
), begun AS (    -- conversations by the nodes they start with
    SELECT c, d, len(turns) = d AS ends, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n,
           md5(array_to_string(list_transform(turns[1 : d], lambda x: x.t), '')) AS node,
           CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1 : d - 1],
               lambda x: x.t), '')) END AS parent,
           list_transform(range(0, d + 1), lambda k: md5(array_to_string(list_transform(
               turns[1 : k], lambda x: x.t), ''))) AS above
    FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM conv)
), node AS (
    SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
           any_value(above) AS above, (count(*) - 1) * any_value(n) AS saved,
           sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ','
               ORDER BY c), '')) AS ends_sha256
    FROM begun GROUP BY node, d
), child AS (
    SELECT parent, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent
), below AS (
    SELECT up AS node, CAST(sum(saved) AS BIGINT) AS saved,
           count(*) FILTER (n IS NULL) AS leaves
    FROM (SELECT unnest(above) AS up, saved, node FROM node)
    LEFT JOIN child ON child.parent = node GROUP BY up
)
SELECT node.conv_id, node.d AS depth, p.conv_id AS parent_conv_id, node.n_convs,
       coalesce(child.n, 0) AS n_children, below.leaves AS n_leaves,
       below.saved AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (node) LEFT JOIN child ON child.parent = node.node
LEFT JOIN (SELECT node, conv_id FROM node) p ON p.node = node.parent
"""

SPELLING = f"""
WITH RECURSIVE run AS (
    SELECT id, r, count(*) AS n
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                 translate(unnest(regexp_extract_all(coalesce(text, ''),
                     '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS r
          FROM documents)
    WHERE len(r) >= 5 GROUP BY id, r
), word AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % len(r)) || substr(r, h % len(r) + 2)
                ELSE r END AS word, n
    FROM (SELECT r, n, {_crc32("id || ':' || r")} AS h FROM run)
), v AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE len(word) >= 5
    GROUP BY word HAVING sum(n) >= 3
), part AS (    -- the word (place -1), and the word without the code point at a place
    SELECT word, n, word AS rest, -1 AS place FROM v
    UNION ALL SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest, i AS place
    FROM (SELECT word, n, unnest(range(0, len(word))) AS i FROM v)
), near AS (    -- one replaced: both without the same place; one more: one is the other's rest
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
    FROM part a JOIN part b USING (rest)
    WHERE a.word <> b.word AND (a.place = b.place OR (a.place = -1) <> (b.place = -1))
), best AS (
    SELECT word, n, count(*) AS n_near, min_by(other, (-other_n, other)) AS form,
           max(other_n) AS form_n FROM near GROUP BY word, n
), link AS (SELECT word, form, form_n FROM best WHERE form_n >= 2 * n
), walk AS (
    SELECT word, form AS root FROM link
    UNION ALL SELECT walk.word, link.form FROM walk JOIN link ON walk.root = link.word
), last AS (
    SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM link)
)
SELECT v.word, link.form, coalesce(last.root, v.word) AS root, v.n,
       coalesce(n_near, 0) AS n_near, link.form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN link USING (word) LEFT JOIN last USING (word)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op4_substring_dedup": SUBSTRING,
    "op5_secret_scan": SECRETS,
    "op11_suffix_dedup": SUFFIXES,
    "op12_spelling": SPELLING,
    "op13_prefix_trie": TRIE,
}
