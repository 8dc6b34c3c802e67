"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_NORM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: A table of the checksum's 256 steps, and the checksum of a text of ASCII characters.
_STEPS = ", ".join(f"t{k} AS (SELECT i, xor(v >> 1, CAST(3988292384 AS UBIGINT) * (v & 1)) v FROM t{k - 1})" for k in range(1, 9))
_CRC_TABLE = f"t0 AS (SELECT i, CAST(i AS UBIGINT) v FROM range(256) r(i)), {_STEPS}, tab AS (SELECT list(v ORDER BY i) tb FROM t8)"


def _crc(text: str) -> str:
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    return f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, tb[CAST(xor(a, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"


ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""
WITH b AS (SELECT item_id, {_NORM} w FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) k FROM bw),
d AS (SELECT doc_id, {_NORM} w FROM documents),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d CROSS JOIN lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (g)),
cov AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) md FROM g GROUP BY k),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) p FROM g JOIN m USING (k) WHERE md < g.doc_id)),
x AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t, count(*) n FROM x ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_periodic_runs": rf"""
WITH {_CRC_TABLE}, d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, CAST({_crc('CAST(doc_id AS VARCHAR)')} AS BIGINT) h FROM documents, tab),
d1 AS (SELECT *, len(w) n, h // 10 g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) p FROM d1),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END w FROM d2),
x AS (SELECT doc_id, unnest(w) word, unnest(range(len(w))) i FROM d),
k AS (SELECT doc_id, i, list_slice(w, i + 1, i + 6) k FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) i FROM d WHERE len(w) >= 12)),
e AS (SELECT a.doc_id, a.i, b.i - a.i q FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
s AS (SELECT doc_id, q, min(i) s, count(*) + 5 + q size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) z FROM e) GROUP BY doc_id, q, z),
r AS (SELECT doc_id, s, size, min(q) q FROM s WHERE size >= greatest(12, 2 * q) GROUP BY doc_id, s, size),
b AS (SELECT doc_id, count(*) n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) t, first({{'s': s, 'l': size, 'q': q}} ORDER BY size DESC, s, q) o FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) n_runs, CAST(o.s AS BIGINT) "start", CAST(o.l AS BIGINT) length, CAST(o.q AS BIGINT) period, CAST(1000 * o.l // o.q AS BIGINT) exponent_milli,
       sha256(coalesce(b.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_repair_turns": rf"""
WITH RECURSIVE {_CRC_TABLE}, c0 AS (SELECT conv_id, turn, coalesce(role, ' ') r0, coalesce(text, ' ') t0,
  CAST({_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS BIGINT) k FROM conversations, tab),
c1 AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r0 END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text,
  unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) again FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) rn, regexp_replace(text, '[\x20\x09-\x0D]+$', '') bare, left(role, 1) first FROM c1),
c3 AS (SELECT *, bare = '' blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 again_seen, right(bare, 1) NOT IN ('.', '!', '?') open,
  lag(first) OVER (PARTITION BY conv_id ORDER BY rn) || first two FROM c2),
rw AS (SELECT *, blank OR again_seen must, CASE WHEN open THEN 1 ELSE 0 END extra FROM c3),
tr AS (SELECT * FROM (VALUES ('E','D','E'), ('S','D','S'), ('U','D','U'), ('A','D','A'), ('E','S','S'), ('E','U','U'), ('S','U','U'), ('A','U','U'), ('U','A','A')) v(f, m, t)),
cl AS (SELECT f, t, c, a, string_split(o, '|')[2:] o FROM (VALUES ('E','E',0,'',''), ('E','U',2,'I','|user:'), ('E','A',4,'II','|user:|assistant:'), ('S','S',0,'',''), ('S','U',2,'I','|user:'), ('S','A',4,'II','|user:|assistant:'),
  ('U','U',0,'',''), ('U','A',2,'I','|assistant:'), ('A','A',0,'',''), ('A','U',2,'I','|user:')) v(f, t, c, a, o)),
st AS (SELECT conv_id, CAST(0 AS BIGINT) rn, cl.t s, CAST(cl.c AS BIGINT) cost, cl.a audit, cl.o lines FROM (SELECT DISTINCT conv_id FROM conversations), cl WHERE cl.f = 'E'
UNION ALL SELECT conv_id, rn, s, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) nth FROM (
  SELECT st.conv_id, rw.rn, cl.t s, st.cost + cl.c + CASE m WHEN 'D' THEN 3 ELSE extra + CASE WHEN first = lower(m) THEN 0 ELSE 2 END END cost,
    st.audit || CASE WHEN m = 'D' THEN 'D' WHEN first = lower(m) THEN 'K' ELSE 'R' END || cl.a audit,
    list_concat(list_concat(st.lines, CASE WHEN m = 'D' THEN [] ELSE [CASE WHEN first = lower(m) THEN role WHEN m = 'U' THEN 'user' ELSE 'assistant' END || ':' || text] END), cl.o) lines
  FROM st JOIN rw ON st.conv_id IS NOT DISTINCT FROM rw.conv_id AND rw.rn = st.rn + 1 JOIN tr ON tr.f = st.s AND (m = 'D' OR (NOT must AND (m <> 'S' OR first = 's'))) JOIN cl ON cl.f = tr.t)) WHERE nth = 1),
fin AS (SELECT conv_id, first({{'c': cost, 'a': audit, 'l': lines}} ORDER BY rn DESC, cost, audit) b FROM st WHERE s IN ('E', 'A') GROUP BY conv_id),
cn AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(CASE WHEN blank THEN 1 END) blank, count(CASE WHEN NOT blank AND again_seen THEN 1 END) duplicate,
  count(CASE WHEN NOT must AND open THEN 1 END) truncated, count(CASE WHEN two NOT IN ('su', 'ua', 'au') THEN 1 END) illegal FROM rw GROUP BY conv_id)
SELECT fin.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) gaps, CAST(coalesce(blank, 0) AS BIGINT) blank, CAST(coalesce(duplicate, 0) AS BIGINT) duplicate, CAST(coalesce(truncated, 0) AS BIGINT) truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) illegal, b.c AS cost, b.a audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) repaired_sha256
FROM fin LEFT JOIN cn ON fin.conv_id IS NOT DISTINCT FROM cn.conv_id""",
}
