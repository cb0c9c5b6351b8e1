"""The same results as SQL for a second engine, where SQL can express them.

Fingerprints (hash cells), token counts, importance and packing are tested against brute force.
Main texts have SQL for the pages of the test tables, whose articles are all marked as such.
"""

from __future__ import annotations

from seriesmill.llm import chat, fim, mixing, near_join, target_sampling, url_filter
from seriesmill.llm.common import WORD

UPPER, LOWER = url_filter.UPPER, url_filter.LOWER


def _url_filter() -> str:
    """Mined rules by counting all token combinations of every labelled URL."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules)
    mark = lambda kind, parts: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{kind}' || x)"
    tokens = [
        mark("scheme:", f"[translate(regexp_extract(url, '^(.*?)://', 1), '{UPPER}', '{LOWER}')]"),
        mark("host:", "string_split(host, '.')"),
        mark("site:", "[regexp_extract(host, '^[^.]*\\.(.*\\..*)$', 1)]"),
        mark("path:", "list_transform(string_split(path, '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g'))"),
        mark("ending:", "[regexp_extract(path, '\\.([A-Za-z]+)$', 1)]"),
        mark("query:", "list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^([^=]*)', 1))"),
        mark("fragment:", "[CASE WHEN contains(url, '#') THEN 'yes' ELSE '' END]"),
    ]
    all_tokens = tokens[0]
    for more in tokens[1:]:
        all_tokens = f"list_concat({all_tokens}, {more})"
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rows AS (
  SELECT page_id, host, path, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_sort(list_distinct({all_tokens})) END AS tokens FROM parsed
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id
), labelled AS (
  SELECT row_number() OVER () AS n, tokens, bad FROM rows JOIN known ON page_id = doc_id WHERE len(tokens) > 0
), least AS (
  SELECT greatest({url_filter.MIN_ROWS}, ceil(count(*) * {url_filter.MIN_SUPPORT})) AS least FROM labelled
), one AS (SELECT n, bad, unnest(tokens) AS token FROM labelled
), often AS (
  SELECT token FROM one GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT least FROM least)
), baskets AS (
  SELECT n, bad, list(token ORDER BY token) AS tokens FROM one SEMI JOIN often USING (token) GROUP BY n, bad
), subsets AS (
  SELECT n, bad, tokens, unnest(range(1, (1 << len(tokens))::BIGINT)) AS mask FROM baskets
), combinations AS (
  SELECT bad, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS combination FROM subsets
), mined AS (
  SELECT combination FROM combinations GROUP BY combination
  HAVING count(*) FILTER (bad) >= (SELECT least FROM least) AND count(*) FILTER (bad) / count(*) >= {url_filter.MIN_CONFIDENCE}
), hits AS (
  SELECT DISTINCT r.tokens FROM (SELECT DISTINCT tokens FROM rows) r JOIN mined m ON list_has_all(r.tokens, m.combination)
)
SELECT page_id, host, path, CASE {rule} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN h.tokens IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM rows r LEFT JOIN hits h ON r.tokens = h.tokens
"""


def _mix() -> str:
    seed, block, epochs = mixing.SEED, mixing.BLOCK_WORDS, mixing.MAX_EPOCHS
    number = lambda digest: f"('0x' || substr({digest}, 1, 15))::BIGINT"
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS order_key FROM documents
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY shard, order_key, size)::BIGINT - size AS start FROM (
    SELECT *, {number('order_key')} % greatest(1, (SELECT (count(*) + {mixing.SHARD_ROWS - 1}) // {mixing.SHARD_ROWS} FROM sized)) AS shard FROM sized)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, {weights}[((source_rank - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight, (source_size * {epochs})::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, cap / weight AS full_at, ((SELECT sum(source_size) FROM sources)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT source, source_rank, source_size, greatest(1, round(source_size / {block}))::BIGINT AS blocks, CASE WHEN full_at > level
    THEN (SELECT level FROM levels WHERE full_at > level ORDER BY full_at, source_rank LIMIT 1) * weight ELSE cap END AS target FROM levels
), votes AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS votes FROM targets
), total AS (SELECT sum(votes) AS all_votes, count(*) / 2 AS half, round(sum(votes))::BIGINT AS seats FROM votes
), seats AS (
  SELECT source_rank, votes, seats, unnest(range(0, floor(votes / all_votes * (seats + half) + 0.5)::BIGINT + 2)) AS seat FROM votes, total WHERE votes > 0
), won AS (
  SELECT *, row_number() OVER (ORDER BY votes / (2 * seat + 1) DESC, source_rank) AS place FROM seats
), quotas AS (SELECT source_rank, count(*)::BIGINT AS quota FROM won WHERE place <= seats GROUP BY source_rank
), runs AS (
  SELECT v.*, least(coalesce(quota, 0), blocks * {epochs}) // blocks AS epochs, least(coalesce(quota, 0), blocks * {epochs}) % blocks AS extra,
    {number(f"md5('{seed}:0:' || source_rank)")} % blocks AS first FROM votes v LEFT JOIN quotas USING (source_rank)
), edges AS (
  SELECT *, source_size * first // blocks AS low, source_size * least(first + extra, blocks) // blocks AS high,
    source_size * greatest(first + extra - blocks, 0) // blocks AS wrapped FROM runs
)
SELECT p.doc_id, p.size, e.source_size, e.target, (e.epochs * p.size + greatest(least(start + p.size, high) - greatest(start, low), 0)
  + greatest(least(start + p.size, wrapped) - start, 0))::BIGINT AS taken
FROM placed p JOIN edges e ON p.source IS NOT DISTINCT FROM e.source
"""


def _near_join() -> str:
    n = near_join.WORDS
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - {n - 1}, 1) + 1), lambda i: array_to_string(words[i : i + {n - 1}], ' '))) AS shingles
  FROM worded
), one AS (SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM shingled
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= {near_join.THRESHOLD} * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
), links AS (SELECT a AS doc_id, count(*) AS n FROM pairs GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes LEFT JOIN links USING (doc_id)
"""


CHATS = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), lines AS (
  SELECT conv_id, turn, '{chat.START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{chat.END}' || chr(10) AS line FROM turns
), logs AS (
  SELECT conv_id, turn, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY turn) AS chat,
    count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM lines
), prefixes AS (SELECT DISTINCT chat FROM logs WHERE n < n_turns
), whole AS (SELECT chat, any_value(n_turns) AS n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM logs WHERE n = n_turns GROUP BY chat)
SELECT conv_id, n_turns, copies, length(chat)::BIGINT AS n_chars, chat FROM whole ANTI JOIN prefixes USING (chat)
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
), coded AS (
  SELECT page_id, payload, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(digest, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest FROM payloads
), best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM coded)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM best
"""

NEIGHBOURS = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda x, y: x + y) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

def _fill_in_middle() -> str:
    marks = " OR ".join(f"contains(text, '{m}')" for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    h = lambda group: f"('0x' || substr(digest, {8 * group + 1}, 8))::BIGINT"
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), cut AS (
  SELECT *, len(units)::BIGINT AS n, least({h(0)} % (len(units) + 1), {h(1)} % (len(units) + 1)) AS low,
    greatest({h(0)} % (len(units) + 1), {h(1)} % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR {marks} OR {h(2)} % 100 >= {fim.PERCENT} THEN 'plain'
      WHEN {h(3)} % 100 < {fim.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle
    WHEN 'spm' THEN '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


def _target_sampling() -> str:
    """CRC-32 is put together from its table, once for each different word."""
    n = target_sampling.BUCKETS
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words"
    return f"""
WITH divided AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crcs
  FROM range(256) t(b)
), docs AS (SELECT row_number() OVER () AS row, doc_id, {words} FROM documents
), wanted AS (SELECT {words} FROM benchmark
), doc_words AS (SELECT row, unnest(words) AS word FROM docs
), wanted_words AS (SELECT unnest(words) AS word FROM wanted
), vocabulary AS (
  SELECT DISTINCT word, hex(encode(word)) AS digits FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM wanted_words)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(0, len(digits) // 2), lambda i: ('0x' || substr(digits, (2 * i + 1)::INT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295)) % {n} AS bucket FROM vocabulary, divided
), s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (word) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM wanted_words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {n})::DOUBLE
    / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {n})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), sums AS (SELECT row, sum(gain) AS gain FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT docs.row, doc_id, len(words)::BIGINT AS n_features, coalesce(floor(gain / len(words)), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{target_sampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN sums USING (row)
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score, n_features >= {target_sampling.MIN_WORDS} AS open FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS place, count(*) OVER (PARTITION BY open) AS among FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= among * {target_sampling.PERCENT} // 100 THEN place END AS rank FROM placed
"""


MAIN_TEXT = r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '\s+', ' ', 'g') AS article FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(string_split_regex(article, '</?(p|h1)>'), lambda x:
    regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS marked FROM articles
), decoded AS (
  SELECT page_id, url, list_filter(list_transform(marked, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;|&#39;', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM blocks
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM decoded
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": _url_filter(),
    "op2_source_mix": _mix(),
    "op5_near_join": _near_join(),
    "op6_chat_snapshots": CHATS,
    "op8_warc_revisits": WARC,
    "op9_onebit_search": NEIGHBOURS,
    "op11_fill_in_middle": _fill_in_middle(),
    "op12_target_sampling": _target_sampling(),
    "op13_main_text": MAIN_TEXT,
}
