"""Plain SQL for DuckDB of the operators that SQL can state, over whole tables of moderate size."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRINGS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS a FROM docs WHERE len(w) >= 20),
runs AS (SELECT r, a, rank() OVER (PARTITION BY array_to_string(w[a : a + 19], ' ') ORDER BY doc_id, a) AS place FROM starts),
gone AS (SELECT DISTINCT r, unnest(range(a, a + 20)) AS i FROM runs WHERE place > 1),
words AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

PHRASES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS.format(_LOWER.format('text'))}, []) AS w FROM documents),
items AS (SELECT item_id, coalesce({_TERMS.format(_LOWER.format('text'))}, []) AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[a : a + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS a FROM sized)),
sizes AS (SELECT DISTINCT n FROM phrases),
runs AS (SELECT r, n, a, array_to_string(w[a : a + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT r, a, n, item_id FROM runs JOIN phrases USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS i FROM found) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r),
places AS (SELECT r, i, w[i] AS t FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
counts AS (SELECT t, count(*) AS c FROM places GROUP BY t),
terms AS (SELECT phrase, n, o, string_split(phrase, ' ')[o] AS t FROM (SELECT phrase, n, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT phrase, n FROM phrases))),
rare AS (SELECT phrase, n, arg_min(t, coalesce(c, 0) * 100 + o) AS t FROM terms LEFT JOIN counts USING (t) GROUP BY phrase, n),
centres AS (SELECT phrase, n, r, i FROM rare JOIN places USING (t)),
around AS (SELECT c.phrase, c.r, c.i FROM centres c JOIN terms x ON x.phrase = c.phrase JOIN places p ON p.r = c.r AND p.t = x.t AND p.i BETWEEN c.i - 20 AND c.i + 20
           GROUP BY c.phrase, c.r, c.i, c.n HAVING count(DISTINCT x.o) = c.n),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM around JOIN phrases USING (phrase) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(n_near, 0) AS n_near,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r) LEFT JOIN near USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda a: array_to_string(w[a : a + 4], ' ')) END) AS s FROM docs),
copies AS (SELECT s, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT first, len(s) AS n, unnest(s) AS x FROM copies),
pairs AS (SELECT a.first AS a, b.first AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS shared FROM items a JOIN items b ON a.x = b.x AND a.first < b.first GROUP BY a.first, b.first),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n - shared) UNION SELECT b, a FROM pairs WHERE 100 * shared >= 85 * (n - shared)),
reached AS (SELECT first AS origin, first AS other FROM copies UNION SELECT r.origin, l.b FROM reached r JOIN links l ON r.other = l.a),
names AS (SELECT origin AS first, min(other) AS component FROM reached GROUP BY origin)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN copies ON copies.s = sets.s LEFT JOIN names USING (first)
"""

# The CRC-32 of the strings of a table keys(key): a table of 256 steps, then a step for each byte.
_CRC = """steps(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
walked(key, h, p, c) AS (SELECT key, hex(encode(key)), 1, 4294967295::BIGINT FROM keys
    UNION ALL SELECT key, h, p + 2, xor(w.c >> 8, t.c) FROM walked w JOIN steps t ON t.k = 8 AND t.i = xor(w.c & 255, ('0x' || substr(h, p, 2))::BIGINT) WHERE p <= len(h)),
crcs AS (SELECT key, xor(c, 4294967295) AS crc FROM walked WHERE p > len(h))"""


def _tree(name: str, nodes: str, levels: int) -> str:
    """Levels of runs of the trees of nodes (tree, pos, size, digest): {name}0 on; a level's vertices are the hashes of the last one's runs."""
    out = [f"{name}0 AS (SELECT tree, pos // 16 AS run, any_value(size) AS size, list(digest ORDER BY pos) AS d FROM {nodes} GROUP BY ALL)"]
    for k in range(1, levels):
        vertex = f"SELECT tree, run AS pos, (size + 15) // 16 AS size, sha256(array_to_string(d, '')) AS digest FROM {name}{k - 1} WHERE size > 16"
        out.append(f"{name}{k} AS (SELECT tree, pos // 16 AS run, any_value(size) AS size, list(digest ORDER BY pos) AS d FROM ({vertex}) GROUP BY ALL)")
    tops = " UNION ALL ".join(f"SELECT tree, CASE WHEN size = 1 THEN d[1] ELSE sha256(array_to_string(d, '')) END AS digest FROM {name}{k} WHERE size <= 16" for k in range(levels))
    return ", ".join([*out, f"{name}_root AS ({tops})"])


def _climb(name: str, start: str, levels: int) -> str:
    """start (tree, pos, size, ...) with a proof and a digest that go up the levels of a tree, one step for each."""
    out, last = [], start
    for k in range(levels):
        place = f"(s.pos // {16**k}) % 16"
        left, right = f"array_to_string(r.d[1 : {place}], '')", f"array_to_string(r.d[{place} + 2 :], '')"
        out.append(f"""{name}_up{k} AS (SELECT s.* EXCLUDE (digest, proof), CASE WHEN r.d IS NULL OR r.size = 1 THEN s.digest ELSE sha256({left} || s.digest || {right}) END AS digest,
            CASE WHEN r.d IS NULL OR r.size = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {last} s LEFT JOIN {name}{k} r ON r.tree = s.tree AND r.run = s.pos // {16 ** (k + 1)})""")
        last = f"{name}_up{k}"
    return ", ".join(out)


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_DEPTH, _TOP = 6, 4
MANIFEST = f"""
WITH RECURSIVE keys AS (SELECT DISTINCT doc_id::VARCHAR AS key FROM documents WHERE doc_id IS NOT NULL), {_CRC},
leaves AS (SELECT doc_id, coalesce('.' || source, '') AS tree, {_LEAF.format('text')} AS leaf, {_LEAF.format(_LOWER.format('text'))} AS changed, coalesce(crc % 5 = 0, FALSE) AS tampered
    FROM documents LEFT JOIN crcs ON key = doc_id::VARCHAR),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size, leaf AS digest FROM leaves),
{_tree('part', 'placed', _DEPTH)},
sources AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size, digest FROM part_root),
{_tree('trunk', 'sources', _TOP)},
begun AS (SELECT doc_id, tree, pos, size, leaf, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS digest FROM placed),
{_climb('part', 'begun', _DEPTH)},
joined AS (SELECT u.doc_id, u.leaf, u.digest, u.proof, t.digest AS subroot, '' AS tree, t.pos FROM part_up{_DEPTH - 1} u JOIN sources t ON t.source = u.tree),
{_climb('trunk', 'joined', _TOP)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM trunk_up{_TOP - 1}, (SELECT digest AS root FROM trunk_root)
"""

SPELLINGS = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS key, w FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE len(w) >= 5),
keys AS (SELECT DISTINCT key FROM runs), {_CRC},
spelt AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, crc % len(w)) || substr(w, crc % len(w) + 2) ELSE w END AS word FROM runs JOIN crcs USING (key)),
words AS (SELECT word, count(*) AS n FROM spelt WHERE len(word) >= 5 GROUP BY word HAVING count(*) >= 3),
rests AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(len(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT word, rest FROM rests JOIN words USING (word) WHERE rest IN (SELECT word FROM words)
    UNION SELECT rest, word FROM rests WHERE rest IN (SELECT word FROM words)),
best AS (SELECT a.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS form, max(w.n) AS form_n FROM near a JOIN words w ON w.word = a.other GROUP BY a.word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
ways(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w USING (word) JOIN forms e ON e.word = w.here WHERE e.form IS NULL
"""
