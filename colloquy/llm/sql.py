"""SQL (DuckDB) for the queries that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

from . import chat, fim, lmscore, mixing, warc

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def chat_sql() -> str:
    """Examples' lengths are running sums of the turns' lengths."""
    fixed = len(chat.BEGIN) + len(chat.ROLE) + len(chat.END_ROLE) + len(chat.END)

    def escaped(x: str) -> str:
        return f"(length({x}) + " + " + ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in ("\\", "<", "[")) + ")"

    said = f"'{chat.ESCAPED_CONTROL}'"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
c AS (SELECT *, sum({fixed} + {escaped("role")} + {escaped("text")}) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(CASE WHEN role = 'assistant' OR i = n THEN so_far ELSE 0 END)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM c GROUP BY conv_id"""


def lmscore_sql() -> str:
    """Counts of one to three words over all documents less the document's own."""
    n = lmscore.ORDER
    grams = " UNION ALL ".join(f"SELECT k, i, {j} AS len, array_to_string(ws[i - {j - 1}:i], ' ') AS g FROM p WHERE i >= {j}" for j in range(1, n + 1))
    contexts = " UNION ALL ".join(f"SELECT k, i, {j} AS len, array_to_string(ws[i - {j - 1}:i - 1], ' ') AS g FROM p WHERE i >= {j}" for j in range(2, n + 1))
    joins = " ".join(f"LEFT JOIN o{j} ON o{j}.k = p.k AND o{j}.i = p.i" for j in range(1, n + 1))
    per = ", ".join(f"o{j} AS (SELECT k, i, c FROM seen WHERE len = {j})" for j in range(1, n + 1)) + ", " + ", ".join(f"x{j} AS (SELECT k, i, c FROM before WHERE len = {j})" for j in range(2, n + 1))
    more = " ".join(f"LEFT JOIN x{j} ON x{j}.k = p.k AND x{j}.i = p.i" for j in range(2, n + 1))
    value = f"CASE WHEN o1.c > 0 THEN ln(o1.c::DOUBLE / (p.total - p.n)) ELSE -ln(p.total - p.n + 1.0::DOUBLE) END"
    for j in range(2, n + 1):
        value = f"CASE WHEN p.i < {j} THEN {value} WHEN o{j}.c > 0 THEN ln(o{j}.c::DOUBLE / x{j}.c) ELSE ln({lmscore.BACKOFF}::DOUBLE) + {value} END"
    short = f"CASE WHEN p.i >= {n} THEN coalesce(o{n}.c, 0) <= 0 " + " ".join(f"WHEN p.i = {j} THEN coalesce(o{j}.c, 0) <= 0" for j in range(2, n)) + " ELSE false END"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
p AS MATERIALIZED (SELECT k, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, (SELECT sum(len(ws)) FROM d) AS total FROM d WHERE len(ws) > 0),
grams AS MATERIALIZED ({grams}), own AS MATERIALIZED (SELECT k, g, count(*) AS c FROM grams GROUP BY ALL), everywhere AS MATERIALIZED (SELECT g, sum(c) AS c FROM own GROUP BY g),
seen AS MATERIALIZED (SELECT grams.k, grams.i, grams.len, everywhere.c - own.c AS c FROM grams JOIN everywhere USING (g) JOIN own ON own.k = grams.k AND own.g = grams.g),
contexts AS ({contexts}), before AS MATERIALIZED (SELECT contexts.k, contexts.i, contexts.len, everywhere.c - own.c AS c FROM contexts JOIN everywhere USING (g) JOIN own ON own.k = contexts.k AND own.g = contexts.g),
{per},
scored AS (SELECT p.k, round_even(({value}) * {lmscore.UNIT}, 0)::BIGINT AS micro, {short} AS short FROM p {joins} {more}),
summed AS (SELECT k, sum(micro)::BIGINT AS micro, count(*) FILTER (short) AS short FROM scored GROUP BY k)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(short, 0) AS n_backed_off, coalesce(micro, 0) AS log_score_micro, CASE WHEN len(d.ws) > 0 THEN micro::DOUBLE / {lmscore.UNIT} / len(d.ws) END AS mean_log_score FROM d LEFT JOIN summed USING (k)"""


def warc_sql() -> str:
    """Base32 of the SHA-1 by five hexadecimal digits at a time."""
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    letters = " || ".join(f"substr({digits}, ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT // {32 ** (3 - j)}) % 32)::BIGINT + 1, 1)" for i in range(8) for j in range(4))
    http = "octet_length(encode('HTTP/1.1 200 OK' || crlf || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || n || crlf || crlf))"
    head = (
        f"'WARC/1.1' || crlf || 'WARC-Type: ' || kind || crlf || 'WARC-Record-ID: <urn:page:' || page_id || '>' || crlf || 'WARC-Date: {warc.DATE}' || crlf"
        " || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || crlf, '') || 'WARC-Payload-Digest: sha1:' || repeat('x', 32) || crlf"
        " || CASE WHEN kind = 'revisit' THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || crlf || 'WARC-Refers-To: <urn:page:' || first || '>' || crlf ELSE '' END"
        " || 'Content-Type: application/http; msgtype=response' || crlf || 'Content-Length: ' || (http + CASE WHEN kind = 'response' THEN n ELSE 0 END) || crlf || crlf"
    )
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS crlf FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
r AS (SELECT *, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS kind, {http} AS http FROM q)
SELECT page_id, n AS payload_bytes, {letters} AS payload_digest, kind AS record_type, CASE WHEN kind = 'revisit' THEN first END AS refers_to, (octet_length(encode({head})) + http + CASE WHEN kind = 'response' THEN n ELSE 0 END + 4)::INT AS record_bytes FROM r"""


def neardup_sql() -> str:
    """All pairs that share a shingle, by exact sets; then all that is reachable."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = _WORDS.replace("coalesce(text, '')", lower)
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {words} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
low AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""


def mixing_sql() -> str:
    """Excess shared anew, round after round, until no source is above its cap; then parts of the hash in order."""
    weights = ", ".join(f"{x}::DOUBLE" for x in mixing.WEIGHTS)
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, (('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', doc_id::VARCHAR, text)), 1, 3))::INT % {mixing.PARTS}) AS part FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, ([{weights}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight FROM d GROUP BY source),
f AS (SELECT 0 AS step, source, source_size, weight, false AS clamped, (sum(source_size) OVER ()) * {mixing.SHARE}::DOUBLE / (sum(weight) OVER ()) AS level FROM s
UNION ALL SELECT step + 1, source, source_size, weight, now, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(CASE WHEN now THEN source_size * {mixing.MAX_EPOCHS}.0::DOUBLE END) OVER (), 0)) / nullif(sum(CASE WHEN now THEN 0.0::DOUBLE ELSE weight END) OVER (), 0) FROM (SELECT *, clamped OR level * weight > source_size * {mixing.MAX_EPOCHS} AS now FROM f WHERE step < (SELECT count(*) FROM s))),
t AS MATERIALIZED (SELECT source, source_size, CASE WHEN clamped THEN source_size * {mixing.MAX_EPOCHS}.0::DOUBLE ELSE level * weight END AS target FROM f WHERE step = (SELECT count(*) FROM s)),
g AS MATERIALIZED (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), {mixing.MAX_EPOCHS})::BIGINT AS whole FROM t),
parts AS (SELECT source, part, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY part) - sum(size) / 2.0::DOUBLE AS mid FROM d GROUP BY source, part),
last AS (SELECT g.source, max(part) FILTER (mid <= target - whole * source_size AND whole < {mixing.MAX_EPOCHS}) AS last FROM parts JOIN g ON parts.source IS NOT DISTINCT FROM g.source GROUP BY g.source)
SELECT doc_id, size, source_size, target, size * (whole + (part <= coalesce(last, -1))::INT) AS taken, (whole + (part <= coalesce(last, -1))::INT)::INT AS copies
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN last ON d.source IS NOT DISTINCT FROM last.source"""


def fim_sql() -> str:
    """Cuts by left() and substr() over code points."""
    h = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marks = " OR ".join(f"contains(text, '{x}')" for x in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    p, m, s = "left(text, a)", "substr(text, a + 1, b - a)", "substr(text, b + 1)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SALT}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, text, length(text) AS n, {h} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR {marks} OR h3 % 100 >= {fim.PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {fim.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || {p} || '{fim.SUFFIX}' || {s} || '{fim.MIDDLE}' || {m} ELSE '{fim.SUFFIX}' || {s} || '{fim.PREFIX}' || {p} || '{fim.MIDDLE}' || {m} END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""


def repair_sql() -> str:
    """The four least audits turn by turn in a recursion; a state is eight digits of cost, then the audit."""
    crc = _sql_crc32("key")
    add = lambda x, cost, edit: f"(lpad(((left({x}, 8))::BIGINT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || {edit})"
    u, a = f"least(u, {add('n', 2, chr(39) + 'I' + chr(39))}, {add('s', 2, chr(39) + 'I' + chr(39))}, {add('a', 2, chr(39) + 'I' + chr(39))})", f"least(a, {add('ui', 2, chr(39) + 'I' + chr(39))})"
    gone = lambda x: add(x, 3, "'D'")
    stay = lambda x, role: f"CASE WHEN may THEN {add(x, f'cut + CASE WHEN i1 = {role} THEN 0 ELSE 2 END', f'CASE WHEN i1 = {role} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"
    return rf"""WITH RECURSIVE c AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
z AS MATERIALIZED (SELECT *, {crc} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE kind <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS i1 FROM o),
g AS (SELECT f.*, fault IN ('', 'truncated') AS may, (fault = 'truncated')::INT AS cut, f.i1 || lead(i1) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM f),
r AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM c)
UNION ALL SELECT conv_id, i, {gone("n")}, CASE WHEN may AND i1 = 's' THEN coalesce(least({gone("s")}, {add("n", "cut", "'K'")}), {add("n", "cut", "'K'")}) ELSE {gone("s")} END, least({gone("ui")}, {stay("least(n, s, ai)", "'u'")}), least({gone("ai")}, {stay("ui", "'a'")})
FROM (SELECT *, {a} AS ai FROM (SELECT r.conv_id, g.i, n, s, a, {u} AS ui, may, cut, i1 FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))),
e AS (SELECT conv_id, n, s, a, {u} AS ui FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
best AS MATERIALIZED (SELECT conv_id, least(n, {a}) AS x FROM e),
audits AS MATERIALIZED (SELECT conv_id, left(x, 8)::BIGINT AS cost, substr(x, 9) AS audit FROM best),
edits AS (SELECT conv_id, audit, p, substr(audit, p, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
places AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM edits),
made AS (SELECT y.*, g.role, g.text, y.edit <> 'D' AND NOT (y.edit = 'K' AND g.i1 = 's') AS counts FROM places y LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM y.conv_id AND g.i = y.i AND y.edit <> 'I'),
lines AS (SELECT *, CASE WHEN count(*) FILTER (counts) OVER (PARTITION BY conv_id ORDER BY p) % 2 = 1 THEN 'user' ELSE 'assistant' END AS due FROM made),
whole AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE due END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) FILTER (edit <> 'D') AS repaired FROM lines GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM audits t LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM t.conv_id"""


def _sql_crc32(text: str) -> str:
    """crc32 of an ASCII text, eight bits a character."""
    bits = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    return f"(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda x, y: xor(x >> 8, ({bits})[(xor(x, y) & 255) + 1])), 4294967295))"


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat_sql(), "op3_lmscore": lmscore_sql(), "op6_warc": warc_sql(), "op9_neardup": neardup_sql(), "op10_mixing": mixing_sql(), "op12_fim": fim_sql(), "op13_repair": repair_sql()}
