"""DuckDB SQL for the numbered operators that SQL can express over whole tables.

Operators 3, 6, 9, 10 and 13 and the pipeline learn models, run a tokenizer's search, find eigenvectors or cut texts; they
are tested against brute force instead.
"""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The smallest node that links (a, b) in both directions reach, for each node of `nodes`.
_REACH = """
reach AS (
    SELECT a AS node, b AS other FROM links
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)"""

OP1 = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s
    FROM split),
kinds AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
posted AS (SELECT id, n, unnest(s) AS shingle FROM kinds),
shared AS (
    SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS m, any_value(y.n) AS n
    FROM posted x JOIN posted y ON x.shingle = y.shingle AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
links AS (SELECT a, b FROM shared UNION ALL SELECT b, a FROM shared), {_REACH.strip()}
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(least(l.other, k.id), k.id, d.doc_id) AS component_id,
    d.doc_id = coalesce(least(l.other, k.id), k.id, d.doc_id) AS kept
FROM sets d LEFT JOIN kinds k ON d.s = k.s LEFT JOIN least l ON l.node = k.id
"""

OP2 = f"""
WITH RECURSIVE clean AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM clean x JOIN clean y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
links AS (SELECT a, b FROM pairs), {_REACH.strip()}, counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(least(l.other, e.vec_id), e.vec_id) AS component_id,
    e.vec_id = coalesce(least(l.other, e.vec_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""

OP4 = """
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, unnest(range(0, length(h) // 2 - 199)) AS p, h FROM texts WHERE length(h) >= 400),
prints AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS f FROM strings),
twice AS (SELECT f FROM prints GROUP BY f HAVING count(*) > 1),
starts AS (SELECT r, p FROM prints SEMI JOIN twice USING (f)),
runs AS (
    SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM starts),
spans AS (
    SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM runs) GROUP BY r, k),
edges AS (
    SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
rest AS (
    SELECT t.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h,
        sum(b - a) AS removed, count(*) AS n
    FROM texts t JOIN edges e ON t.r = e.r GROUP BY t.r)
SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(x.removed, 0)::BIGINT AS n_removed, coalesce(x.n, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(x.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN rest x ON t.r = x.r
"""


def _alphanumeric(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_alphanumeric('text')} AS w FROM documents),
items AS (SELECT item_id, {_alphanumeric('text')} AS w FROM benchmark),
patterns AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM patterns),
windows AS (
    SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
    FROM (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT w.r, w.i, w.m, p.item_id FROM windows w JOIN patterns p ON w.m = p.m AND w.t = p.t),
hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM found) GROUP BY r),
named AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h ON h.r = d.r LEFT JOIN named n ON n.r = d.r
"""

OP7 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
    FROM pages),
named AS (
    SELECT page_id, payload_bytes, newest, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest
    FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < newest THEN newest END AS refers_to
FROM named
"""

_HASH = "('0x' || substr(md5({0}), 1, 15))::BIGINT"

OP8 = f"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM sized GROUP BY source),
given AS (
    SELECT sum(tokens)::DOUBLE AS total, count(*) AS n, list(tokens ORDER BY source) AS t FROM sources WHERE tokens > 0),
shares AS (SELECT total, n, list_transform(t, lambda x: x / total) AS s FROM given),
entropy_steps AS (
    SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS middle
    UNION ALL
    SELECT k + 1, CASE WHEN up THEN middle ELSE low END, CASE WHEN up THEN high ELSE middle END,
        CASE WHEN up THEN (middle + high) / 2 ELSE (low + middle) / 2 END
    FROM (
        SELECT e.*, -list_sum(list_transform(p, lambda x: x / list_sum(p) * ln(x / list_sum(p)))) >= 0.95 * ln(n) AS up
        FROM (SELECT e.*, n, list_transform(s, lambda x: pow(x, e.middle)) AS p FROM entropy_steps e, shares WHERE e.k < 40) e)),
repeat_steps AS (
    SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS middle
    UNION ALL
    SELECT k + 1, CASE WHEN up THEN middle ELSE low END, CASE WHEN up THEN high ELSE middle END,
        CASE WHEN up THEN (middle + high) / 2 ELSE (low + middle) / 2 END
    FROM (
        SELECT e.*, NOT (list_max(list_transform(s, lambda x: pow(x, e.middle) / list_sum(list_transform(s, lambda y: pow(y, e.middle))) / x)) <= 4.0 * (1 + 1e-9)) AS up
        FROM (SELECT r.*, s FROM repeat_steps r, shares WHERE r.k < 40) e)),
by_entropy AS (
    SELECT CASE WHEN -list_sum(list_transform(s, lambda x: x / list_sum(s) * ln(x / list_sum(s)))) >= 0.95 * ln(n) THEN 1.0 ELSE (SELECT low FROM entropy_steps WHERE k = 40) END AS e
    FROM shares),
exponent AS (
    SELECT CASE WHEN list_max(list_transform(s, lambda x: pow(x, e) / list_sum(list_transform(s, lambda y: pow(y, e))) / x)) <= 4.0 * (1 + 1e-9) THEN e
        ELSE greatest(e, (SELECT high FROM repeat_steps WHERE k = 40)) END AS e
    FROM by_entropy, shares),
per_source AS (
    SELECT source, n, tokens, floor(pow(tokens / total, e) / list_sum(list_transform(s, lambda x: pow(x, e))) * total)::BIGINT AS target
    FROM (SELECT o.source, o.n, o.tokens, s.total, s.s FROM sources o, shares s WHERE o.tokens > 0), exponent),
planned AS (SELECT source, target // tokens AS epochs, target % tokens AS part, ceil(sqrt(n))::BIGINT AS n_blocks FROM per_source),
blocked AS (
    SELECT s.*, epochs, part, {_HASH.format("coalesce(doc_id::VARCHAR, '')")} % n_blocks AS block
    FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
blocks AS (
    SELECT *, unnest(range(0, epochs + 1)) AS epoch
    FROM (SELECT source, block, epochs, part, sum(n_tokens) AS tokens FROM blocked GROUP BY ALL)),
placed AS (
    SELECT *, row_number() OVER o AS place, sum(tokens) OVER o - tokens AS before FROM blocks
    WINDOW o AS (PARTITION BY source, epoch ORDER BY {_HASH.format("block || ':' || epoch")}, block)),
taken AS (
    SELECT b.doc_id, b.source, b.n_tokens, p.epoch, b.block, p.place, p.epoch < b.epochs OR p.before + p.tokens <= b.part AS whole,
        p.before + sum(b.n_tokens) OVER (PARTITION BY b.source, b.block, p.epoch
            ORDER BY {_HASH.format("coalesce(b.doc_id::VARCHAR, '') || ':' || p.epoch")}, b.doc_id, b.n_tokens ROWS UNBOUNDED PRECEDING) AS upto, b.part
    FROM blocked b JOIN placed p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.block
    WHERE p.epoch < b.epochs OR p.before < b.part)
SELECT doc_id, source, n_tokens, epoch, block, place FROM taken WHERE whole OR upto <= part
"""

OP11 = f"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
        list_filter(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS all_n FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(any_value(c.n), 0) AS own_n FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) c USING (lang, source) GROUP BY lang, source),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.own_n + 5 * s.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 5) // (s.all_n + 5 * s.v) AS q
    FROM groups g JOIN sizes s ON g.lang = s.lang JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM rows QUALIFY part = 'pair' OR rank <= 50
"""

_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
_TOKEN = f"{_EMAIL}|[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _placed(table: str, pattern: str, columns: str) -> str:
    """Start, end and value of each match of a pattern in t of a table, which has its row number r."""
    return f"""
    SELECT {columns}, v[i] AS value, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS a
    FROM (SELECT {columns}, g, v, unnest(range(1, len(v) + 1)) AS i
        FROM (SELECT {columns}, string_split_regex(t, {pattern}) AS g, regexp_extract_all(t, {pattern}) AS v FROM {table}))"""


OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (
    SELECT d.*, k.* FROM d, (VALUES (1, 'email', '{_EMAIL}'), (2, 'ip', '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)'),
        (3, 'card', '[0-9](?:[\\x20-]?[0-9])+'), (4, 'phone', '\\+[0-9][\\x20().0-9-]+[0-9]')) AS k(kind, name, pattern)),
found AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({_placed('kinds', 'pattern', 'r, kind, name')})),
base AS (
    SELECT r, kind, name, a, a + length(value) AS b, kind || ':' || CASE kind WHEN 1 THEN lower(value) WHEN 2 THEN value ELSE digits END AS entity FROM found
    WHERE kind = 1
        OR kind = 2 AND len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0
        OR kind = 3 AND length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
            CASE WHEN i % 2 = 1 THEN digits[-i]::INT WHEN digits[-i]::INT > 4 THEN digits[-i]::INT * 2 - 9 ELSE digits[-i]::INT * 2 END)) % 10 = 0
        OR kind = 4 AND length(digits) BETWEEN 10 AND 15),
tokens AS (SELECT r, a, a + length(value) AS b, {_LOWER.format('value')} AS term FROM ({_placed('d', f"'{_TOKEN}'", 'r')}) WHERE NOT contains(value, '@')),
terms AS (SELECT r, term FROM tokens UNION SELECT r, left(term, 3) || '*' FROM tokens),
held AS (SELECT DISTINCT r, entity FROM base),
entities AS (SELECT entity, count(*) AS n FROM held GROUP BY entity HAVING count(*) >= 3),
counts AS (SELECT term, count(*) AS n FROM terms GROUP BY term),
pairs AS (
    SELECT entity, term, count(*) AS k, any_value(e.n) AS n FROM held h JOIN entities e USING (entity) JOIN terms USING (r) GROUP BY entity, term HAVING count(*) >= 3),
told AS (
    SELECT p.entity, p.term FROM pairs p JOIN counts c USING (term)
    WHERE 2 * p.k >= c.n AND p.k::HUGEINT * (SELECT count(*) FROM d) >= 8::HUGEINT * p.n * c.n),
disclosing AS (
    SELECT w.entity, w.term, c.term IS NOT NULL AS removed FROM told w LEFT JOIN told c ON w.entity = c.entity AND c.term = left(w.term, 3) || '*'
    WHERE NOT suffix(w.term, '*')),
marks AS (SELECT r, term, bool_or(removed) AS removed FROM held JOIN disclosing USING (entity) GROUP BY r, term),
spans AS (
    SELECT r, kind, name, a, b FROM base
    UNION ALL
    SELECT t.r, CASE WHEN removed THEN 6 ELSE 5 END, CASE WHEN removed THEN 'removed' ELSE 'generalised' END, t.a, t.b FROM tokens t JOIN marks m ON t.r = m.r AND t.term = m.term),
listed AS (
    SELECT r, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
        string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind <= 4) AS base,
        count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3, count(*) FILTER (kind = 4) AS n4
    FROM spans GROUP BY r)
SELECT doc_id, coalesce(n1, 0) AS n_email, coalesce(n2, 0) AS n_ip, coalesce(n3, 0) AS n_card, coalesce(n4, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""


def oracles() -> dict[str, str]:
    return {
        "op1_minhash_inverted_join": OP1, "op2_e8_lattice": OP2, "op4_suffix_array_family": OP4, "op5_wu_manber_decontamination": OP5,
        "op7_warc_round_trip": OP7, "op8_temperature_mixture": OP8, "op11_divergence_audit": OP11,
        "op12_information_sanitisation": OP12}
