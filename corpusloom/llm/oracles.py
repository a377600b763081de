"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import fill_middle, mixing, quality_rules, sharding
from corpusloom.llm.queries import SHARDS

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"


def _words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UP}', '{LOW}'), '{WORD}')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM d CROSS JOIN (SELECT DISTINCT n FROM p) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT doc_id, i, n, item_id FROM g JOIN p USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{TOKEN}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


def _md5_long(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


_SIZE = sharding.table_size(len(SHARDS))
_OWNERS = sharding.lookup_table(SHARDS, _SIZE)
OP5 = f"""
WITH t AS (SELECT doc_id, {_md5_long("coalesce(doc_id::VARCHAR, '')")} % {_SIZE} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(({_OWNERS})[slot + 1]::VARCHAR, 2, '0') AS shard FROM t
"""


_R = quality_rules


def _level(keys: str, name: str) -> str:
    k = f"{keys}, " if keys else ""
    q = ", ".join(f"min(step) FILTER (below * 100 >= total * {p})::DOUBLE AS {name}_{p}" for p in _R.QUANTILES)
    return f"""
{name}_s AS (SELECT {k}share, step, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {k}share ORDER BY step) AS below, sum(n) OVER (PARTITION BY {k}share) AS total FROM {name}_s),
{name} AS (SELECT {k}share, max(total)::DOUBLE AS {name}_n, {q} FROM {name}_c GROUP BY ALL)"""


def _drawn(name: str, towards: str) -> str:
    return ", ".join(f"({name}_n * {name}_{p} + {_R.PULL} * {towards}_{p}) / ({name}_n + {_R.PULL}) AS {name}_{p}" for p in _R.QUANTILES)


def _failed(share: str) -> str:
    n, of, unit = _R.SHARES[share]
    usual, w = f"(usual_{share} * {of} / {unit})", "(2 * line_words)" if share == "repeats" else "1::DOUBLE"
    return f"coalesce({n} > {usual} + {_R.SIGMAS} * sqrt({usual} * {w} + {w} * {w}), FALSE)"


_STEPS = ", ".join(f"{{'share': '{k}', 'step': least({_R.MAX_STEP}, {unit} * {n} // {of})}}" for k, (n, of, unit) in _R.SHARES.items())
_USUAL = ", ".join(f"max(usual) FILTER (share = '{k}') AS usual_{k}" for k in _R.RULES)
OP6 = rf"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS lk, coalesce('=' || source, '') AS sk, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{TOKEN}')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(0, 3)) AS u(k) GROUP BY doc_id),
m AS (SELECT doc_id, lk, sk, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN c USING (doc_id)),
d AS (SELECT lk, sk, text, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_lines) AS n_lines,
             any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words FROM m WHERE n_words > 0 GROUP BY ALL),
x AS (SELECT lk, sk, unnest([{_STEPS}], recursive := true) FROM d),
sketch AS (SELECT lk, sk, share, step, count(*) AS n FROM x GROUP BY ALL), {_level("lk, sk", "own")}, {_level("lk", "lang")}, {_level("", "every")},
dl AS (SELECT * EXCLUDE ({", ".join(f"lang_{p}" for p in _R.QUANTILES)}), {_drawn("lang", "every")} FROM own JOIN lang USING (lk, share) JOIN every USING (share)),
dr AS (SELECT lk, sk, share, lang_95, {_drawn("own", "lang")} FROM dl),
us AS (SELECT lk, sk, share, own_50, least(own_50 + {_R.FENCES} * (own_50 - own_10), {_R.BOUND} * lang_95) AS usual FROM dr),
most AS (SELECT lk, sk, {_USUAL}, max(own_50) FILTER (share = 'width') AS line_words FROM us GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {" OR ".join(map(_failed, _R.RULES))}) AS kept
FROM m LEFT JOIN most USING (lk, sk)
"""


def _keyed(seed: str, *columns: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"coalesce({c}::VARCHAR, '')" for c in columns]])
    return f"('0x' || substr(md5({text}), 1, {mixing.HASH_BITS // 4}))::BIGINT"


def _tree() -> str:
    """The urn of each node, emptied draw by draw; level by level."""
    out = ["m0 AS (SELECT 0 AS node, sk, count(*) AS q FROM draws GROUP BY sk)"]
    for k in range(mixing.LEVELS):
        out.append(f"""
u{k} AS (SELECT node, sk, row_number() OVER (PARTITION BY node ORDER BY sk, j) AS i, count(*) OVER (PARTITION BY node) AS n, {_keyed(f"{mixing.SEED}|{k}", "node", "sk", "j")} AS h
  FROM m{k}, unnest(range(1, q + 1)) AS t(j)),
r{k}(node, i, l) AS (SELECT DISTINCT node, 0::BIGINT, ceil(n / 2)::BIGINT FROM u{k}
  UNION ALL SELECT r.node, u.i, l - (h % (n - r.i) < l)::BIGINT FROM r{k} r JOIN u{k} u ON u.node = r.node AND u.i = r.i + 1),
m{k + 1} AS (SELECT u.node * 2 + 1 - (a.l - b.l) AS node, sk, count(*) AS q FROM u{k} u JOIN r{k} a ON a.node = u.node AND a.i = u.i - 1 JOIN r{k} b ON b.node = u.node AND b.i = u.i GROUP BY ALL)""")
    return ",".join(out)


_TOP = mixing.HASH_BITS - mixing.BITS[0]
OP7 = f"""
WITH RECURSIVE m AS (SELECT doc_id, source, coalesce('=' || source, '') AS sk, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS size FROM documents),
h AS (SELECT *, {_keyed(mixing.SEED, "sk", "doc_id")} AS hash FROM m),
s AS (SELECT sk, source, sum(size)::BIGINT AS source_size FROM m GROUP BY ALL),
w AS (SELECT *, ({list(mixing.WEIGHTS)})[((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s),
q AS (SELECT *, source_size * {mixing.MOST} / weight AS ratio FROM w),
v AS (SELECT *, (sum(source_size) OVER () * {mixing.SHARE} - coalesce(sum(source_size) OVER b, 0) * {mixing.MOST})
              / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM q WINDOW b AS (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS free FROM v WHERE level <= ratio ORDER BY ratio, sk LIMIT 1),
t AS (SELECT sk, source_size, least(source_size * {float(mixing.MOST)}, weight * free)::DOUBLE AS target FROM v, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS full_ FROM t),
n AS (SELECT *, target - full_ * source_size AS need FROM p),
c AS (SELECT h.*, n.* EXCLUDE (sk), sum(size) OVER (PARTITION BY sk ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY sk, hash) AS words FROM h JOIN n USING (sk)),
k AS (SELECT *, full_ + (upto <= need OR (upto - words <= need AND words < 2 * (need - (upto - words))))::INT AS copies FROM c),
draws AS (SELECT DISTINCT sk, hash >> {_TOP} AS block, copy FROM (
  SELECT sk, hash, full_, max(copies) OVER (PARTITION BY sk, hash >> {_TOP}) AS most FROM k), unnest(range(1, most::INT + 1)) AS u(copy)),
{_tree()},
e AS (SELECT sk, node AS shard, sum(q) OVER (PARTITION BY sk ORDER BY node) AS upto, q FROM m{mixing.LEVELS}),
o AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY {_keyed(f"{mixing.SEED}|blocks", "sk", "block", "copy")}, block, copy) AS place FROM draws),
g AS (SELECT o.sk, block, copy, shard::INT AS shard FROM o JOIN e ON e.sk = o.sk AND place <= upto AND place > upto - q)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, a.shard AS shard_1, b.shard AS shard_2,
       CASE WHEN copies >= 1 THEN {_keyed(f"{mixing.SEED}|local", "doc_id", "1")} END AS position_1, CASE WHEN copies >= 2 THEN {_keyed(f"{mixing.SEED}|local", "doc_id", "2")} END AS position_2
FROM k LEFT JOIN g a ON a.sk = k.sk AND a.block = k.hash >> {_TOP} AND a.copy = 1 AND copies >= 1
LEFT JOIN g b ON b.sk = k.sk AND b.block = k.hash >> {_TOP} AND b.copy = 2 AND copies >= 2
"""

OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


_SHIFTS = "c"
for _ in range(8):
    _SHIFTS = f"list_transform({_SHIFTS}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC32 = f"(SELECT {_SHIFTS} FROM (SELECT range(0, 256) AS c))"


def _then(cost: str, letter: str, *states: str) -> str:
    """The least of the states' costs and audits (the cost in nine digits), after one more edit."""
    return f"least({', '.join(f"lpad((substr({x}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'" for x in states)}, NULL)"


#: States: nothing yet, after s, after u, after a; i: with letters inserted.
_ENTERED = f"n0 AS i0, n1 AS i1, least(n2, {_then('3', 'I', 'n0', 'n1', 'n3')}) AS i2, least(n3, {_then('3', 'I', f'least(n2, {_then("3", "I", "n0", "n1", "n3")})')}) AS i3"


def _moved(target: str, letter: str, sources: list[str]) -> str:
    if not sources:
        return _then("4", "D", target)
    keep = f"CASE WHEN fault < 2 AND initial = '{letter}' THEN {_then('extra', 'K', *sources)} END"
    turn = f"CASE WHEN fault < 2 THEN {_then('3 + extra', 'R', *sources)} END" if letter != "s" else "NULL"
    return f"least({_then('4', 'D', target)}, {keep}, {turn})"


OP11 = f"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, {_CRC32} AS crc FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM t),
r AS (SELECT k, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, unnest(range(0, CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS initial,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM r),
f AS (SELECT *, CASE WHEN said = '' THEN 2 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 3 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
             lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM o),
g AS (SELECT k, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 2) AS blank, count_if(fault = 3) AS duplicate,
             count_if(fault = 1) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k),
s(k, i, n0, n1, n2, n3) AS (SELECT k, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM g
  UNION ALL SELECT k, i, {_moved("i0", "-", [])}, {_moved("i1", "s", ["i0"])}, {_moved("i2", "u", ["i0", "i1", "i3"])}, {_moved("i3", "a", ["i2"])}
  FROM (SELECT f.k, f.i, fault, initial, CASE fault WHEN 1 THEN 3 ELSE 0 END AS extra, {_ENTERED} FROM s JOIN f ON f.k = s.k AND f.i = s.i + 1) AS e),
b AS (SELECT k, least(i0, i3) AS best FROM (SELECT s.k, {_ENTERED} FROM s JOIN g ON g.k = s.k AND g.n = s.i) AS e),
a AS (SELECT k, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM b),
l AS (SELECT k, p, audit[p] AS edit, count_if(audit[p] <> 'I') OVER w AS i, count_if(audit[p] <> 'D') OVER w - 1 - length(replace(audit, 'D', '')) % 2 AS place
      FROM a, unnest(range(1, length(audit) + 1)) AS u(p) WINDOW w AS (PARTITION BY k ORDER BY p)),
m AS (SELECT l.k, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
      FROM l LEFT JOIN f ON f.k = l.k AND f.i = l.i WHERE edit <> 'D' GROUP BY l.k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(m.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM t) AS c LEFT JOIN g USING (k) LEFT JOIN a USING (k) LEFT JOIN m USING (k)
"""

OP12 = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({OP3.replace('w[i:i + 3]', 'w[i:i + 2]').replace('len(w) - 3', 'len(w) - 2')}) AS c"

_DRAWS = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
_MARKED = " OR ".join(f"contains(t, '{m}')" for m in (fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE))
OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {_DRAWS} FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR {_MARKED} OR h3 % 100 >= {fill_middle.RATE} THEN 'plain' WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op3_ngram_join": OP3, "op5_sharding": OP5, "op6_quality_rules": OP6, "op7_mixing": OP7, "op10_warc": OP10, "op11_turn_repair": OP11, "op12_minhash_forest": OP12, "op13_fill_middle": OP13}
