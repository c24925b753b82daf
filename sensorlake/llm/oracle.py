"""The training-data queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from sensorlake.llm.secret_links import ACCESS, ASSIGN, BARE, ENDPOINT, HEX, KEY_ID

# words of op1: A-Z folded, then runs of digits, a-z and everything beyond ASCII
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS1 = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS1.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS1.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
              FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.n, g.i, win.item_id FROM grams g JOIN win ON win.n = g.n AND win.g = g.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
       FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP2 = r"""
WITH l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, line, k,
             [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
              FOR t IN regexp_split_to_array(line, '[ \t\x0B\f\r]+') IF t <> ''] AS w FROM l0),
long AS (SELECT DISTINCT doc_id, text, w, list_slice(w, 1, 3) AS head FROM l WHERE len(w) >= 3),
leaf AS (SELECT len(w) AS n, head FROM long GROUP BY 1, 2 HAVING count(*) >= 10),
near AS (SELECT long.* FROM long JOIN leaf ON leaf.n = len(long.w) AND leaf.head = long.head),
dl AS (SELECT w, head, count(*) AS docs FROM near GROUP BY w, head),
tok AS (SELECT w, head, docs, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS c FROM dl),
con AS (SELECT len(w) AS n, head, p, c FROM tok GROUP BY 1, 2, 3, 4 HAVING sum(docs) >= 10),
tpl AS (SELECT tok.w, list(coalesce(con.c, '<*>') ORDER BY tok.p) AS t,
               avg(CASE WHEN coalesce(con.c, '<*>') <> '<*>' THEN 1.0 ELSE 0.0 END) AS share
        FROM tok LEFT JOIN con ON con.n = len(tok.w) AND con.head = tok.head AND con.p = tok.p AND con.c = tok.c
        GROUP BY tok.w),
held AS (SELECT near.doc_id, near.text, near.w, tpl.t FROM near JOIN tpl ON near.w = tpl.w WHERE share >= 0.7),
often AS (SELECT t FROM (SELECT DISTINCT doc_id, text, t FROM held) GROUP BY t HAVING count(*) >= 10),
rec AS (SELECT DISTINCT doc_id, text, w FROM held JOIN often USING (t)),
f AS (SELECT l.doc_id, l.text, l.line, l.k, len(l.w) AS n, rec.w IS NOT NULL AS r
      FROM l LEFT JOIN rec ON rec.doc_id = l.doc_id AND rec.text = l.text AND rec.w = l.w),
g AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN r THEN 1 ELSE 0 END) AS n_recurring, sum(n) AS words,
             coalesce(sum(n) FILTER (r), 0) AS gone, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT r), '') AS clean,
             any_value(text) AS text
      FROM f GROUP BY doc_id),
over AS (SELECT doc_id, text FROM g WHERE gone > 0.5 * words),
ow AS (SELECT doc_id, regexp_extract_all(LOW, '[^\x20\x09-\x0D]+') AS w FROM over),
os AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM ow WHERE len(w) > 0)),
sn AS (SELECT doc_id, count(*) AS n FROM os GROUP BY doc_id),
copies AS (SELECT DISTINCT x AS doc_id
           FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM os a JOIN os b ON a.s = b.s AND a.doc_id <> b.doc_id
                 GROUP BY 1, 2) JOIN sn a ON a.doc_id = x JOIN sn b ON b.doc_id = y
           WHERE 100 * c >= 80 * (a.n + b.n - c)),
h AS (SELECT g.*, n_recurring > 0 AND gone < words AND copies.doc_id IS NULL AS drops FROM g LEFT JOIN copies USING (doc_id))
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_recurring, 0) AS BIGINT) AS n_recurring,
       CAST(CASE WHEN drops THEN n_recurring ELSE 0 END AS BIGINT) AS n_dropped,
       sha256(CASE WHEN drops THEN clean ELSE d.text END) AS clean_sha256
FROM documents d LEFT JOIN h USING (doc_id)
""".replace("LOW", _LOW.format("text"))

OP3 = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
           FROM pages),
p AS (SELECT page_id, url, r,
             coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')
               AS host,
             coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
c AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/$', '')
        || coalesce('?' || nullif(array_to_string(list_sort(
             [q FOR q IN string_split(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '&')
              IF q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')]), '&'), ''), '') AS key FROM p),
bad AS (SELECT DISTINCT key FROM c
        WHERE list_has_any(string_split(host, '.'),
                           ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, pre, ruling)),
best AS (SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(ruling, length(h || pre)) AS ruling
         FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(ruling, CASE WHEN bad.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (page_id) LEFT JOIN bad USING (key)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
q AS (SELECT *, sha256(t) AS s, min(page_id) OVER (PARTITION BY t) AS least FROM p)
SELECT page_id, b AS payload_bytes, s AS payload_digest,
       CASE WHEN b >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""

OP5 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w
                     FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT x AS d, y AS m FROM l UNION SELECT r.d, l.y FROM r JOIN l ON l.x = r.m),
c AS (SELECT d, min(m) AS component FROM r GROUP BY d)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, documents.doc_id) AS component_id,
       coalesce(component, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = documents.doc_id
"""


def _kind(rank: int, kind: str, pattern: str, part: str, where: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, '{part}' AS part, e - length(m) AS s, e FROM (
      SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '(?s)(.*?)({quoted})', 1)) AS g,
               unnest(regexp_extract_all(t, '(?s)(.*?)({quoted})', 2)) AS m,
               unnest(range(len(regexp_extract_all(t, '(?s)(.*?)({quoted})', 1)))) AS k
        FROM d WHERE regexp_matches(t, '{quoted}'))) WHERE {where}"""


_ASSIGN9 = "regexp_extract(m, '^" + ASSIGN.replace("'", "''") + "', 2)"
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_kind(0, 'assign', ASSIGN, 'secret', f'length({_ASSIGN9}) >= 8')}
  UNION ALL {_kind(1, 'access', ACCESS, 'id')} UNION ALL {_kind(2, 'hex', HEX, 'secret')}),
bare AS ({_kind(4, 'bare', BARE, 'secret',
                "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")}),
weak AS ({_kind(3, 'key_id', KEY_ID, 'id')}
  UNION ALL SELECT bare.* FROM bare ANTI JOIN base ON bare.doc_id = base.doc_id AND base.s < bare.e AND bare.s < base.e
  UNION ALL {_kind(5, 'endpoint', ENDPOINT, 'endpoint')}),
need AS (SELECT * FROM (VALUES ('key_id', 'secret'), ('bare', 'id'), ('endpoint', 'id'), ('endpoint', 'secret')) t(kind, need)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
lacks AS (SELECT w.doc_id, w.kind, w.s FROM weak w JOIN need n USING (kind)
          ANTI JOIN every o ON o.doc_id = w.doc_id AND o.part = n.need AND abs(o.s - w.s) <= 200),
linked AS (SELECT w.* FROM weak w ANTI JOIN lacks l ON l.doc_id = w.doc_id AND l.kind = w.kind AND l.s = w.s),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
             count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
      FROM base GROUP BY doc_id),
f AS (SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
      FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n FROM linked GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(f.spans, '') AS spans, coalesce(n, 0) AS n_linked
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits: a byte folded in, then eight steps, each by one element of a list."""
    steps = ", ".join(["-1"] * 8)
    return f"""xor(list_reduce(flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''),
        lambda z: [CAST(ascii(z) AS BIGINT), {steps}])),
        lambda a, z: CASE WHEN z >= 0 THEN xor(a, z) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
        4294967295), 4294967295)"""


OP11 = f"""
WITH t AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS k,
                  octet_length(encode(coalesce(text, ''))) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, sha256(k) AS k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, substr(sha256(k), 1, 32)) - 1 AS pos
      FROM t),
n AS (SELECT c, count(*) AS n, c - c % 5 AS base, {_crc32('c')} % 9 AS h FROM o GROUP BY c),
cs AS (SELECT n.c, n.base, n.h, least(n.h, coalesce(b.n, 0)) AS taken FROM n LEFT JOIN n b ON b.c = n.base),
r AS (SELECT cs.c, pos, k, w FROM cs JOIN o ON o.c = cs.base WHERE pos < h
      UNION ALL SELECT c, pos - h + taken, k, w FROM o JOIN cs USING (c) WHERE pos >= h),
z AS (SELECT c, count(r.pos) AS len FROM cs LEFT JOIN r USING (c) GROUP BY c),
p AS (SELECT c, 0 AS d, 0 AS w, 'root' AS name FROM cs
      UNION ALL SELECT c, pos + 1, w, sha256(string_agg(k, '') OVER (PARTITION BY c ORDER BY pos)) FROM r),
node AS (SELECT name, d, min(c) AS f, count(*) AS n, any_value(w) AS w,
                sha256(coalesce(string_agg(CASE WHEN d = len THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends
         FROM p JOIN z USING (c) GROUP BY name, d),
up AS (SELECT node.name, node.d, node.f, node.n, node.w, p.name AS above, p.d AS ad FROM node JOIN p ON p.c = node.f AND p.d <= node.d),
kids AS (SELECT above, count(*) AS n FROM up WHERE ad = d - 1 GROUP BY above),
tot AS (SELECT up.above, sum((up.n - 1) * w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
        FROM up LEFT JOIN kids ON kids.above = up.name GROUP BY up.above),
par AS (SELECT up.name, q.f FROM up JOIN node q ON q.name = up.above WHERE up.ad = up.d - 1)
SELECT node.f AS conv_id, CAST(node.d AS BIGINT) AS depth, par.f AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM node JOIN tot ON tot.above = node.name LEFT JOIN kids ON kids.above = node.name LEFT JOIN par ON par.name = node.name
"""


def _fields(text: str) -> str:
    one = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
    return "sha256(" + " || ".join(one.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, levels: int) -> str:
    """CTEs that climb ``levels`` levels from {name}n0 (g, i, h) and {name}q0 (rid, g, i, proof, f)."""
    out = []
    for k in range(levels):
        out.append(f"""{name}r{k} AS (SELECT g, p, run, sum(len(run)) OVER (PARTITION BY g) > 1 AS many
  FROM (SELECT g, i // 16 AS p, list(h ORDER BY i) AS run FROM {name}n{k} GROUP BY 1, 2)),
{name}n{k + 1} AS (SELECT g, p AS i, CASE WHEN many THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{k}),
{name}q{k + 1} AS (SELECT rid, g, i // 16 AS i, CASE WHEN many THEN proof || a || b ELSE proof END AS proof,
         CASE WHEN many THEN sha256(a || f || b) ELSE f END AS f
  FROM (SELECT q.*, many, array_to_string(list_slice(run, 1, i % 16), '') AS a,
               array_to_string(list_slice(run, i % 16 + 2, 16), '') AS b
        FROM {name}q{k} q JOIN {name}r{k} r ON q.g IS NOT DISTINCT FROM r.g AND r.p = q.i // 16))""")
    return ",\n".join(out)


_CLAIM = "CASE WHEN " + _crc32("doc_id") + " % 5 = 0 THEN " + _LOW.format("text") + " ELSE text END"
OP12 = f"""
WITH l AS (SELECT row_number() OVER () AS rid, doc_id, source, {_fields('text')} AS leaf, {_fields('(' + _CLAIM + ')')} AS claimed
           FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
an0 AS (SELECT source AS g, i, leaf AS h FROM o),
aq0 AS (SELECT rid, source AS g, i, '' AS proof, claimed AS f FROM o),
{_levels('a', 5)},
s AS (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM an5),
bn0 AS (SELECT 0 AS g, i, h FROM s),
bq0 AS (SELECT rid, 0 AS g, s.i, proof, f FROM aq5 JOIN s ON aq5.g IS NOT DISTINCT FROM s.source),
{_levels('b', 3)}
SELECT o.doc_id, o.leaf, s.h AS subroot, bn3.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = bn3.h AS verified
FROM o JOIN bq3 USING (rid) JOIN s ON o.source IS NOT DISTINCT FROM s.source, bn3
"""

SQL = {
    "op1_decontaminate": OP1,
    "op2_line_templates": OP2,
    "op3_url_filter": OP3,
    "op4_warc": OP4,
    "op5_exact_dedup": OP5,
    "op6_near_dedup": OP6,
    "op9_secrets": OP9,
    "op11_prefix_trie": OP11,
    "op12_merkle_manifest": OP12,
}
