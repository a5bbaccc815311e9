"""DuckDB SQL for the queries of this package that SQL can express.

Not expressed: operators 1, 3 and 12 (tokenizers), 7 (fingerprints), 8 (trained pieces), 9 and 10 (positional index and
disclosure); tests compare these with brute force, libraries or held-out labels.
"""

from __future__ import annotations

from .chat import END, LEARNED, LINE, PROBE, START
from .feistel import MAX_BUCKETS, PRIME, ROUND_KEYS, ROWS_PER_BUCKET
from .lineclean import BOILERPLATE, SYMBOLS, Rules
from .unitdedup import MIN_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count_of(chars: str, of: str) -> str:
    return f"(length({of}) - length(translate({of}, {_quoted(chars)}, '')))"


def op2(rules: Rules = Rules()) -> str:
    boiler = " OR ".join(f"contains(lower(bare), {_quoted(b)})" for b in BOILERPLATE)
    marks, alone = r"\s[|»›>·•/]\s", r"(?i)\s*(?:home|menu|next|previous|back to top|skip to (?:main )?content|log ?in|sign (?:in|up))\s*[|»›>·]?\s*"
    end = r"""[.!?…:;。！？]["'”’»)\]]*$"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare, len(regexp_extract_all(line, '{_WORD}')) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT r, line, n, (({boiler}) OR len(regexp_extract_all(bare, '{marks}')) >= {rules.min_navigation_marks} OR regexp_full_match(bare, '{alone}')
  OR {_count_of(SYMBOLS, 'bare')} > {rules.max_symbol_share} * length(bare) OR NOT regexp_matches(bare, {_quoted(end)})) AS bad FROM l WHERE n > 0),
s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, sum(bad::INT)::BIGINT AS failed, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS lost FROM f GROUP BY r),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, {_count_of(SYMBOLS, 't')}::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(failed, 0) AS n_failed_lines, coalesce(lost, 0) AS lost_words FROM w LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, n_lines, n_failed_lines, lost_words, NOT base AND lost_words <= {rules.max_lost_share} * n_words AS kept
FROM (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_share} * n_words AS base FROM b)"""


OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || chr(1)] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = w.doc_id"""


OP5 = f"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?…] )', '\\1' || chr(31), 'g'), chr(31)) AS us FROM documents),
l AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM t),
p AS (SELECT doc_id, i, u, (sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT - length(u) AS b, len(regexp_extract_all(u, '\\S+')) AS n,
  trim(regexp_replace(regexp_replace(lower(u), '\\p{{Nd}}', '0', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM l),
h AS (SELECT doc_id, b, b + length(u) AS e, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, md5(plain) AS d FROM p WHERE plain <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY doc_id, k) > 1 AS later, count(*) OVER (PARTITION BY d) AS c, min(doc_id) OVER (PARTITION BY d) <> max(doc_id) OVER (PARTITION BY d) AS shared FROM h),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM r WHERE c > 1),
q AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, run) AS run_words FROM g) WHERE run_words >= {MIN_WORDS}),
x AS (SELECT doc_id, count(*) AS n_repeated, count(*) FILTER (shared) AS n_shared, count(*) FILTER (later) AS n_removed, coalesce(sum(n) FILTER (later), 0)::BIGINT AS removed_words,
  coalesce(string_agg(b::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY k) FILTER (later), '') AS removed FROM q GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_units FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_shared, 0) AS n_shared, coalesce(n_removed, 0) AS n_removed,
  coalesce(removed_words, 0) AS removed_words, coalesce(removed, '') AS removed FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""


def op6(shards: int = 8, seed: int = 20240229) -> str:
    def mix(x: str, key: int) -> str:
        t = f"(({x} * {key} + {(key + seed * 7919) % PRIME}) % {PRIME})"
        return f"(({t} * {t} + {key % 65521}) % {PRIME})"

    def one_pass(x: str) -> str:
        """l, r of one pass as nested selects over a row with x, a, b."""
        inner = f"(SELECT *, {x} % a AS l, {x} // a AS r FROM src)"
        for i, key in enumerate(ROUND_KEYS):
            inner = f"(SELECT * REPLACE ({f'(r + {mix('l', key)}) % b AS r' if i % 2 else f'(l + {mix('r', key)}) % a AS l'}) FROM {inner})"
        return inner

    crc = "list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]))"
    bit = "list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
WITH RECURSIVE tab AS (SELECT list({bit} ORDER BY i) AS tab FROM (SELECT unnest(range(256))::BIGINT AS i)),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
docs AS (SELECT doc_id, size, CASE WHEN len(bytes) = 0 THEN 0 ELSE xor({crc}, 4294967295) END AS text_crc32 FROM (SELECT doc_id, size, list_transform(range(size - 1), lambda k: ('0x' || substr(h, (2 * k + 1)::BIGINT, 2))::BIGINT) AS bytes FROM raw), tab),
k AS (SELECT count(*) AS n, least({MAX_BUCKETS}, greatest(16, 1::BIGINT << length(bin(count(*) // {ROWS_PER_BUCKET})))) AS buckets, (CASE WHEN count(*) <= 1 THEN 1 ELSE floor(sqrt(count(*) - 1)) + 1 END)::BIGINT AS a FROM docs),
placed AS (SELECT doc_id, size, text_crc32, (row_number() OVER (ORDER BY (coalesce(abs(doc_id % {PRIME}), 0) * 7919 + text_crc32) % buckets, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS row_no, n, a, (n + a - 1) // a AS b FROM docs, k),
walk AS (SELECT doc_id, size, text_crc32, row_no, n, a, b, l + r * a AS pos FROM {one_pass('row_no').replace('src', 'placed')}
  UNION ALL SELECT doc_id, size, text_crc32, row_no, n, a, b, l + r * a FROM {one_pass('pos').replace('src', '(SELECT * FROM walk WHERE pos >= n)')})
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos % {shards})::INTEGER AS shard, pos // {shards} AS slot, NULL::INTEGER AS grown_shard FROM walk WHERE pos < n"""


OP11 = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, count(*) AS n FROM t GROUP BY r),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
c AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r))::INTEGER AS rank, doc_id, score FROM c WHERE score > 0) WHERE rank <= 10"""


def op13() -> str:
    def escaped(value: str, names: str) -> str:
        return rf"regexp_replace({value}, '<(\\*)\|({names})\|>', '<\1\\|\2|>', 'g')"

    order, constant = "ORDER BY turn NULLS FIRST, role, text", len(START) + len(END) + 2
    role = f"replace({escaped('role', 'im_start|im_end|nl')}, chr(10), '{LINE}')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '{PROBE}'), (1, 'assistant', '{PROBE}'))),
e AS (SELECT *, {role} AS r, {escaped('text', 'im_start|im_end')} AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{LEARNED}'), '')) AS loss_sha256, sum({constant} + length(r) + length(t))::BIGINT AS formatted_chars, count(*) FILTER (r <> role OR t <> text) AS n_escaped FROM e GROUP BY conv_id"""


ORACLE_SQL = {"op2_line_first_cleaning": op2(), "op4_ngram_jaccard_join": OP4, "op5_line_hash_dedup": OP5, "op6_feistel_shards": op6(), "op11_ranked_search": OP11, "op13_chat_round_trip": op13()}
