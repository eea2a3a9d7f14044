"""SQL of the scans over words (11 to 13). crc32, which DuckDB lacks, is put together from the table of its bytes: it is linear."""

from .licenses import mandatory

_CRC = """crc_bit(b, k, v) AS (SELECT b, 0, b FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bit WHERE k < 8),
  crc_byte AS (SELECT b, v FROM crc_bit WHERE k = 8),
  crc_most AS (SELECT max(len(hex(s)) // 2) AS most FROM crc_of),
  crc_at(d, b, v) AS (SELECT 0, b, v FROM crc_byte UNION ALL SELECT d + 1, a.b, xor(a.v >> 8, t.v) FROM crc_at a JOIN crc_byte t ON t.b = a.v & 255 WHERE d < (SELECT most FROM crc_most)),
  crc_start(n, v) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(s.v >> 8, t.v) FROM crc_start s JOIN crc_byte t ON t.b = s.v & 255 WHERE n <= (SELECT most FROM crc_most)),
  crc_hex AS (SELECT s, hex(s) AS x FROM (SELECT DISTINCT s FROM crc_of)),
  crc_bytes AS (SELECT s, len(x) // 2 AS n, unnest(range(len(x) // 2)) AS i, x FROM crc_hex),
  crc AS (SELECT s, xor(4294967295, xor(any_value(z.v), bit_xor(a.v))) AS c
    FROM crc_bytes y JOIN crc_at a ON a.d = n - 1 - i AND a.b = CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) JOIN crc_start z ON z.n = y.n GROUP BY s)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def periodic_sql() -> str:
    """All pairs of equal words of a document by lag; maximal stretches; those whose lag is their smallest period."""
    return rf"""WITH RECURSIVE d0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  crc_of AS (SELECT CAST(doc_id AS VARCHAR) AS s FROM d0),
  {_CRC},
  split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, c AS h, c // 10 AS g FROM d0 LEFT JOIN crc ON s = CAST(doc_id AS VARCHAR)),
  tail AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM split),
  lag_ AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM tail),
  word AS (SELECT doc_id, unnest(range(n)) AS i, unnest(CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN j < a THEN j ELSE a + (j - a) % p END + 1] FOR j IN range(n)] END) AS w FROM lag_),
  same AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS part
    FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
  long_ AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM same GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(12, 2 * q)),
  run AS (SELECT * FROM long_ l WHERE NOT EXISTS (SELECT 1 FROM long_ k WHERE k.doc_id = l.doc_id AND k.q < l.q AND l.q % k.q = 0 AND k.s <= l.s AND k.s + k.n >= l.s + l.n)),
  each AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list({{'l': -n, 's': s, 'q': q}} ORDER BY -n, s, q)[1] AS most FROM run GROUP BY doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM run),
  rest AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT d0.doc_id, coalesce(n_runs, 0) AS n_runs, most.s AS start, -most.l AS length, most.q AS period, CAST(1000 * -most.l // most.q AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
  FROM d0 LEFT JOIN each USING (doc_id) LEFT JOIN rest USING (doc_id)"""


def license_sql(templates, share: float) -> str:
    """Every template at every relative position at which a word agrees."""
    names = ", ".join(f"({t}, '{label}', {base})" for t, (label, base, _, _) in enumerate(templates))
    words = ", ".join(f"({t}, {i}, '{w}', {i in needed})" for t, (_, _, text, phrases) in enumerate(templates) for ws in [text.split()] for needed in [set(mandatory(ws, phrases))] for i, w in enumerate(ws))
    return rf"""WITH name(t, label, base) AS (VALUES {names}), tw(t, i, w, needed) AS (VALUES {words}),
  d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  word AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM d),
  df AS (SELECT w, count(DISTINCT doc_id) AS n FROM word GROUP BY w),
  weighed AS (SELECT t, i, tw.w, needed, CAST(floor(1000 * (1 + ln(((SELECT count(*) FROM d) + 1) / (coalesce(df.n, 0) + 1))) + 0.5) AS BIGINT) AS weight FROM tw LEFT JOIN df ON df.w = tw.w),
  total AS (SELECT t, sum(weight) AS total, count(*) FILTER (needed) AS needed FROM weighed GROUP BY t),
  place AS (SELECT doc_id, x.t, p - i AS start, sum(weight) AS got FROM word JOIN weighed x ON x.w = word.w JOIN total ON total.t = x.t
    GROUP BY doc_id, x.t, p - i HAVING sum(weight) >= {share} * any_value(total) AND count(*) FILTER (x.needed) = any_value(total.needed)),
  named AS (SELECT doc_id, start, label, base, got / total AS share FROM place JOIN name ON name.t = place.t JOIN total ON total.t = place.t)
  SELECT d.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
  FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id"""


def importance_sql(percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT {_WORDS} AS ws FROM benchmark),
  df AS (SELECT doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS s FROM d),
  bf AS (SELECT unnest(ws || [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) AS s FROM b),
  crc_of AS (SELECT DISTINCT s FROM df UNION SELECT s FROM bf),
  {_CRC},
  own AS (SELECT doc_id, c % {buckets} AS k FROM df JOIN crc ON crc.s = df.s),
  source AS (SELECT k, count(*) AS n FROM own GROUP BY k), target AS (SELECT c % {buckets} AS k, count(*) AS n FROM bf JOIN crc ON crc.s = bf.s GROUP BY 1),
  sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM source) AS s, (SELECT coalesce(sum(n), 0) FROM target) AS t),
  gain AS (SELECT source.k, CAST(floor(1000 * ln(CAST((coalesce(target.n, 0) + 1) * (s + {buckets}) AS DOUBLE) / CAST((source.n + 1) * (t + {buckets}) AS DOUBLE))) AS BIGINT) AS g FROM source LEFT JOIN target ON target.k = source.k, sums),
  weight AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM own JOIN gain ON gain.k = own.k GROUP BY doc_id),
  score AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weight ON weight.doc_id = d.doc_id),
  place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM score WHERE n_words >= {least_words})
  SELECT score.doc_id, n_features, weight, score, CASE WHEN nth <= n * {percent} // 100 THEN nth END AS rank FROM score LEFT JOIN place ON place.doc_id = score.doc_id"""
