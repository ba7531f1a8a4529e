"""SQL twins of the queries whose results SQL can state, for DuckDB: plain statements of the results, not of the methods."""

from __future__ import annotations

#: The crc32 of ``bytes`` (a list of numbers) by the table ``crc_table``.
CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS entry FROM range(256) x(i))"
CRC = "xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])))"

#: Groups of equal texts by hash; those far above an even share are taken, largest first; the least capacity by bisection, each guess walked shard by shard.
MINIMAX_SHARDS = f"""WITH RECURSIVE {CRC_TABLE},
r AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
g AS MATERIALIZED (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY key),
o AS (SELECT key, size, row_number() OVER (ORDER BY size DESC, key) AS m, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY size DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger FROM g),
f AS (SELECT *, size > (total - larger) / (41 - m) AND 2 * m + 1 <= 40 AS over FROM o),
own AS MATERIALIZED (SELECT key FROM f WHERE m < (SELECT min(m) FROM f WHERE NOT over)),
rest AS MATERIALIZED (SELECT key, size, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS upto FROM g WHERE key NOT IN (FROM own)),
p AS MATERIALIZED (SELECT list(upto ORDER BY key) AS ends, max(upto) AS total, 40 - (SELECT count(*) FROM own) AS shards,
  (SELECT list(DISTINCT w) FROM (SELECT max(upto) AS w FROM rest UNION ALL SELECT (SELECT max(upto) FROM rest WHERE rest.key < own.key) FROM own) WHERE w > 0) AS walls FROM rest),
search AS (
  SELECT (total + shards - 1) // shards AS low, total AS high, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS used FROM p
  UNION ALL SELECT CASE WHEN failed THEN middle + 1 ELSE low END, CASE WHEN done THEN middle ELSE high END, CASE WHEN failed OR done THEN 0 ELSE reach END, CASE WHEN failed OR done THEN 0 ELSE used + 1 END
  FROM (SELECT *, reach <= pos OR (reach < total AND used + 1 >= shards) AS failed, reach > pos AND reach = total AS done
    FROM (SELECT search.*, (low + high) // 2 AS middle, total, shards, least(list_min(list_filter(walls, lambda w: w > pos)), coalesce(list_max(list_filter(ends, lambda e: e <= pos + (low + high) // 2)), 0)) AS reach FROM search, p WHERE low < high))),
capacity AS (SELECT low AS c FROM search WHERE low = high),
cuts AS (SELECT CAST(0 AS BIGINT) AS pos UNION ALL SELECT least(list_min(list_filter(walls, lambda w: w > pos)), list_max(list_filter(ends, lambda e: e <= pos + c))) FROM cuts, p, capacity WHERE pos < total),
starts AS MATERIALIZED (SELECT key FROM own UNION SELECT key FROM rest JOIN cuts ON upto - size = pos),
placed AS (SELECT *, (SELECT count(*) FROM starts WHERE starts.key <= r.key) - 1 AS shard FROM r)
SELECT doc_id, size, CAST({CRC.format(text="text")} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY (coalesce(doc_id, 0) + key) % 256, doc_id NULLS FIRST, key) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed, crc_table"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c).lower() if isinstance(c, bool) else str(c) for c in r) + ")" for r in rows)


def license_scan(phrases, templates, slack: int = 3, least: float = 0.6) -> str:
    """Votes of equal word triples by template and diagonal, diagonals merged, shares of the templates' words covered."""
    listed = _values([(i, label, phrase, text) for i, (label, phrase, text) in enumerate([(a, True, b) for a, b in phrases] + [(a, False, b) for a, b in templates])])
    return rf"""WITH t AS (SELECT template, label, phrase, string_split(body, ' ') AS w FROM (VALUES {listed}) v(template, label, phrase, body)),
k AS (SELECT template, label, phrase, len(w) AS length, i AS place, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM t, unnest(range(len(w) - 2)) u(i)),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, p, w[p + 1] AS a, w[p + 2] AS b, w[p + 3] AS c FROM d, unnest(range(len(w) - 2)) u(p)),
diagonals AS (SELECT r, template, any_value(label) AS label, any_value(phrase) AS phrase, any_value(length) AS length, p - place AS diagonal, list(DISTINCT place) AS places FROM g JOIN k USING (a, b, c) GROUP BY r, template, p - place),
apart AS (SELECT *, phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {slack}, false) AS first FROM diagonals),
numbered AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM apart),
spans AS (SELECT r, template, any_value(label) AS label, any_value(phrase) AS phrase, any_value(length) AS length, min(diagonal) AS diagonal, len(list_distinct(flatten(list_transform(flatten(list(places)), lambda q: [q, q + 1, q + 2])))) AS covered FROM numbered GROUP BY r, template, span),
s AS (SELECT *, phrase AND covered = length AS base, (phrase AND covered = length) OR (NOT phrase AND covered / length >= {least}) AS found FROM spans)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE base) AS n_base, CAST(min(diagonal) FILTER (WHERE base) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (WHERE base) AS BIGINT) AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found), '') AS labels, coalesce(max(covered / length), 0.0) AS score
FROM d LEFT JOIN s USING (r) GROUP BY r"""


def quality_rules(strata, rules: dict, grid, risk: float = 0.02, level: float = 0.05, purity: float = 0.9) -> str:
    """Counts of each text; of every stratum and rule the labelled texts beyond each cutoff, and exact binomial bounds of the good ones among them."""
    white = r"\x20\x09-\x0D"
    cases = " UNION ALL ".join(f"SELECT r, '{name}' AS rule, coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0) AS value FROM f" for name, (part, whole) in rules.items())
    strata_sql = ", ".join(f"'{s}'" for s in strata)
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({strata_sql}) THEN lang ELSE 'other' END AS stratum, regexp_extract_all(coalesce(text, ''), '[^{white}]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{white}]')) AS lines FROM documents),
windows AS MATERIALIZED (SELECT r, p, w[p + 1:p + 5] AS v FROM d, unnest(range(len(w) - 4)) u(p)),
again AS (SELECT r, v FROM windows GROUP BY r, v HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p + j) AS n FROM windows JOIN again USING (r, v), range(5) x(j) GROUP BY r),
f AS MATERIALIZED (SELECT d.r, doc_id, text, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{white}]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, len(lines) AS n_lines, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_echoes FROM d LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
v AS MATERIALIZED ({cases}),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, text, rule, max(good) AS good, any_value(value) AS value FROM b JOIN good USING (doc_id) JOIN v USING (r) WHERE NOT base_failed GROUP BY stratum, text, rule),
cutoffs AS (SELECT unnest({list(grid)}::DOUBLE[]) AS cutoff),
n AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE good = 1) AS n_good, count(*) FILTER (WHERE good = 1 AND value > cutoff) AS x, count(*) FILTER (WHERE good <> 1 AND value > cutoff) AS bad FROM held, cutoffs GROUP BY stratum, rule, cutoff),
tested AS (SELECT *, CASE WHEN x >= n_good THEN 1.0 ELSE list_sum(list_transform(range(x + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({risk / len(rules)!r}) + (n_good - i) * ln(1 - {risk / len(rules)!r})))) END > {level / ((len(strata) + 1) * len(rules))!r} AS fails FROM n),
certified AS (SELECT * FROM tested t WHERE n_good > 0 AND NOT EXISTS (SELECT 1 FROM tested u WHERE u.stratum = t.stratum AND u.rule = t.rule AND u.cutoff >= t.cutoff AND u.fails)),
pure AS (SELECT *, arg_min(bad, cutoff) OVER (PARTITION BY stratum, rule) AS most FROM certified WHERE bad > 0 AND bad >= {purity} * (x + bad)),
chosen AS (SELECT stratum, rule, max(cutoff) AS cutoff FROM pure WHERE bad >= 0.98 * most GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT r FROM v JOIN b USING (r) JOIN chosen USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (FROM rejected) AS kept FROM b"""


#: Similarity of all pairs that share a shingle, and the rows that links connect.
NGRAM_JOIN = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, w[p + 1:p + 5] AS shingle FROM d, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) u(p)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r),
e AS MATERIALIZED (SELECT a, b, common = na.n AND common = nb.n AS same FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE common >= 0.8 * (na.n + nb.n - common) - 1e-6),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.other),
classes AS (SELECT reach.r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.other GROUP BY reach.r),
links AS (SELECT a AS r, count(*) AS n_links, count(*) FILTER (WHERE same) AS copies FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(copies, 0) + 1 AS n_copies, coalesce(n, 0) AS n_shingles FROM d JOIN classes USING (r) LEFT JOIN links USING (r) LEFT JOIN n USING (r)"""


#: Damage by crc32, first faults, then the cheapest edits from the last turn back to the first: for each state (start, system, user, assistant) least cost, audit and lines.
CONVERSATION_REPAIR = rf"""WITH RECURSIVE {CRC_TABLE},
k AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS MATERIALIZED (SELECT name, CAST({CRC.format(text="name")} AS BIGINT) % 20 AS kind FROM k, crc_table),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, kind FROM conversations JOIN h ON name = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
r AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM p),
f AS MATERIALIZED (SELECT *, NOT blank AND seen > 1 AS duplicate, NOT blank AND seen = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, coalesce(substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(i) AS last FROM f GROUP BY conv_id),
steps AS (
  SELECT conv_id, last AS i, [{{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 3, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}] AS s FROM n
  UNION ALL
  SELECT conv_id, i - 1, CASE WHEN goes THEN g ELSE list_transform([1, 2, 3, 4], lambda x: list_min([g[x], {{'c': 3 + g[nx[x]].c, 'a': 'I' || g[nx[x]].a, 't': list_prepend(who[x] || ':', g[nx[x]].t)}}, {{'c': 6 + g[nx[nx[x]]].c, 'a': 'II' || g[nx[nx[x]]].a, 't': list_prepend(who[x] || ':', list_prepend(who[nx[x]] || ':', g[nx[nx[x]]].t))}}])) END
  FROM (SELECT conv_id, i, goes, nx, who, list_transform([1, 2, 3, 4], lambda x: list_min(list_filter([
      {{'c': 4 + s[x].c, 'a': 'D' || s[x].a, 't': s[x].t}},
      CASE WHEN NOT goes AND initial = 's' AND x = 1 THEN {{'c': cut + s[2].c, 'a': 'K' || s[2].a, 't': list_prepend(role || ':' || text, s[2].t)}} WHEN NOT goes AND initial = substr(who[x], 1, 1) THEN {{'c': cut + s[nx[x]].c, 'a': 'K' || s[nx[x]].a, 't': list_prepend(role || ':' || text, s[nx[x]].t)}} END,
      CASE WHEN NOT goes THEN {{'c': 3 + cut + s[nx[x]].c, 'a': 'R' || s[nx[x]].a, 't': list_prepend(who[x] || ':' || text, s[nx[x]].t)}} END], lambda e: e IS NOT NULL))) AS g
    FROM (SELECT f.conv_id, f.i, blank OR duplicate AS goes, substr(role, 1, 1) AS initial, role, text, CASE WHEN truncated THEN 3 ELSE 0 END AS cut, s, [3, 3, 4, 3] AS nx, ['user', 'user', 'assistant', 'user'] AS who FROM steps JOIN f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.i = steps.i))),
e AS (SELECT conv_id, s[1] AS s FROM steps WHERE i = 0),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


#: Every run of up to five words inside a piece is counted; cuts in 128-bit integers.
PHRASES = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d, unnest(pieces) u(piece)),
g AS (SELECT lang, w[i:i + k - 1] AS w, k FROM p, unnest(range(1, len(w) + 1)) a(i), range(1, 6) b(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, w, k, count(*) AS f FROM g GROUP BY lang, w, k HAVING k = 1 OR count(*) >= 100),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
inside AS (SELECT lang, part AS w, max(f) AS longer FROM f, unnest([w[1:k - 1], w[2:k]]) u(part) WHERE k > 2 GROUP BY lang, part),
c AS MATERIALIZED (SELECT f.lang, f.w, f.k, f.f AS a FROM f LEFT JOIN inside USING (lang, w) WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * f.f)),
q AS (SELECT lang, w, a, j AS cut, w[1:j] AS head, w[j + 1:k] AS tail FROM c, unnest(range(1, k)) b(j)),
s AS (SELECT q.lang, q.w, q.a, cut, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * q.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM q JOIN n ON n.lang = q.lang JOIN f x ON x.lang = q.lang AND x.w = q.head JOIN f y ON y.lang = q.lang AND y.w = q.tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM m)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000"""
