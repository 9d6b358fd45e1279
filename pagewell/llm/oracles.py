"""SQL for the queries that SQL can express; written out apart from the operators."""

ORACLES: dict[str, str] = {}

ORACLES["op5_tree_scoring"] = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
), lines AS (
  SELECT page_id, url, list_filter(list_transform(
    string_split(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')))
  , lambda x: x <> '') AS blocks
  FROM article
), texts AS (
  SELECT page_id, url,
    array_to_string(list_transform(blocks, lambda x: regexp_replace(x, '\s+', ' ', 'g')), chr(10)) AS text
  FROM lines
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

ORACLES["op9_poisson_mixing"] = r"""
WITH docs AS (
  SELECT *, coalesce(source, '') AS src, strlen(coalesce(text, '')) + 1 AS size,
    coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT src, sum(size)::DOUBLE AS bytes, sqrt(sum(size)::DOUBLE) AS weight FROM docs GROUP BY src
), rates AS (
  SELECT src, sum(bytes) OVER () * weight / sum(weight) OVER () / bytes AS rate FROM sources
), terms AS (
  SELECT src, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, (SELECT unnest(range(0, 200)) AS k)
), steps AS (
  SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS total FROM terms
), tables AS (
  SELECT src, list(total ORDER BY k) AS cdf FROM steps GROUP BY src
), drawn AS (
  SELECT d.*, len(list_filter(t.cdf,
    lambda c: c <= CAST(CAST('0x' || substr(md5('mix-1|' || d.key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0
  ))::INTEGER AS copies
  FROM docs d JOIN tables t USING (src)
)
SELECT doc_id, text, lang, source, n_chars, copies, unnest(range(1, copies + 1))::INTEGER AS copy FROM drawn
"""

ORACLES["op1_circulant_minhash"] = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE
    WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3),
      lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM texts
), rows_ AS (
  SELECT r, doc_id, len(shingles) AS n, list_sort(shingles) AS bag FROM sets
), classes AS (
  SELECT bag, min(doc_id) AS id, min(r) AS c, any_value(n) AS n FROM rows_ WHERE n > 0 GROUP BY bag
), members AS (
  SELECT c, n, unnest(bag) AS shingle FROM classes
), pairs AS (
  SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS shared
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.c < b.c GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (an + bn - shared)
  UNION ALL SELECT b, a FROM pairs WHERE 100 * shared >= 75 * (an + bn - shared)
), reach(a, b) AS (
  SELECT c, c FROM classes
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_id AS (
  SELECT reach.a AS c, min(classes.id) AS component FROM reach JOIN classes ON reach.b = classes.c GROUP BY 1
)
SELECT r.doc_id, r.n::BIGINT AS n_shingles, coalesce(l.component, r.doc_id) AS component_id,
  r.doc_id = coalesce(l.component, r.doc_id) AS kept
FROM rows_ r LEFT JOIN classes k ON r.bag = k.bag AND r.n > 0 LEFT JOIN least_id l ON l.c = k.c
"""

ORACLES["op3_quality_rules"] = r"""
WITH common(lang, list) AS (VALUES
  ('en', ['the','of','and','to','in','a','is','that','for','it','on','was','be','with','as','by']),
  ('de', ['der','die','und','in','zu','den','das','von','ist','des','mit','auf','für','ein','im','als']),
  ('fr', ['de','la','le','et','les','des','en','un','du','que','est','pour','qui','par','sur','une']),
  ('es', ['de','la','que','el','en','y','los','se','las','un','por','con','una','del','es','para'])
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) > 2
), keyed AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + 2], ' ')) AS n FROM windows
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE n > 1) GROUP BY r
), counts AS (
  SELECT s.r, doc_id, s.lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(t) AS chars,
    length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS upper_,
    list_transform(coalesce(common.list, []), lambda c: len(list_filter(words, lambda w: w = c))) AS hits
  FROM split s LEFT JOIN covered ON s.r = covered.r LEFT JOIN common ON s.lang = common.lang
), bins AS (
  SELECT *, [word_chars - upper_ - n_symbols, upper_, n_symbols, chars - word_chars] AS cls,
    list_append(hits, n_words - coalesce(list_sum(hits), 0)::BIGINT) AS wrd
  FROM counts
), long AS (
  SELECT r, lang, 'c' AS kind, unnest(range(1, 5)) AS i, unnest(cls) AS p FROM bins
  UNION ALL SELECT r, lang, 'w', unnest(range(1, len(wrd) + 1)), unnest(wrd) FROM bins WHERE len(wrd) > 1
), refs AS (
  SELECT lang, kind, i, sum(p) AS q FROM long GROUP BY ALL
), shares AS (
  SELECT r, kind, p / nullif(sum(p) OVER (PARTITION BY r, kind), 0) AS a,
    q / nullif(sum(q) OVER (PARTITION BY r, kind), 0) AS b
  FROM long JOIN refs USING (lang, kind, i)
), distances AS (
  SELECT r, kind, sqrt(greatest(sum(
    (CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END
     + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2), 0)) AS d
  FROM shares WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
), limits AS (  -- three quarters of the distance of a text without common words; o: share of the other words
  SELECT lang, least(0.34, 0.75 * sqrt((1 - o + log2(2 / (1 + o)) + CASE WHEN o > 0 THEN o * log2(2 * o / (1 + o)) ELSE 0 END) / 2)) AS most
  FROM (SELECT lang, arg_max(q, i) / sum(q) AS o FROM refs WHERE kind = 'w' GROUP BY lang) WHERE o < 1
), judged AS (
  SELECT b.*, coalesce(c.d, 0) AS cd, coalesce(w.d, 0) AS wd, coalesce(most, 0.34) AS word_limit,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed
  FROM bins b LEFT JOIN distances c ON b.r = c.r AND c.kind = 'c' LEFT JOIN distances w ON b.r = w.r AND w.kind = 'w'
    LEFT JOIN limits ON b.lang = limits.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (chars >= 200 AND cd > 0.29) AND NOT (n_words >= 120 AND wd > word_limit) AS kept
FROM judged
"""

ORACLES["op6_seed_extend"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS k
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM repeated)
), places AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM places ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

ORACLES["op8_virtual_slots"] = r"""
WITH RECURSIVE crc_steps(i, c, step) AS (  -- the table of CRC-32 (reflected polynomial), 8 steps for each byte
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM crc_steps WHERE step = 8
), records AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS hexed,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS vslot
  FROM documents
), weights AS (
  SELECT vslot, sum(size)::BIGINT AS bytes, count(*) AS n,
    row_number() OVER (ORDER BY sum(size) DESC, vslot) AS turn FROM records GROUP BY vslot
), fold(turn, shard, loads) AS (
  SELECT 0::BIGINT, -1::BIGINT, list_transform(range(40), lambda x: 0::BIGINT)
  UNION ALL
  SELECT w.turn, list_position(f.loads, list_min(f.loads))::BIGINT - 1,
    list_transform(f.loads, lambda v, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN v + w.bytes ELSE v END)
  FROM fold f JOIN weights w ON w.turn = f.turn + 1
), slots AS (
  SELECT w.vslot, f.shard, coalesce(sum(w.n) OVER (PARTITION BY f.shard ORDER BY w.vslot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM fold f JOIN weights w USING (turn)
)
SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(
    list_transform(range(length(hexed) // 2), lambda i: CAST('0x' || substr(hexed, 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (first + row_number() OVER (PARTITION BY vslot ORDER BY doc_id, size) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM records JOIN slots USING (vslot), crc_table
"""

ORACLES["op11_ball_tree_search"] = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), item_terms AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM item_terms GROUP BY ALL
), totals AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS all_terms FROM doc_terms WHERE len(terms) > 0
), counted AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM doc_terms) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
), scored AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term), totals GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLES["op12_merkle_climb"] = r"""
WITH RECURSIVE crc_steps(i, c, step) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_steps WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM crc_steps WHERE step = 8
), crcs AS (
  SELECT *, coalesce('=' || lang, '-') AS tree, xor(4294967295, list_reduce(
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT),
    lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), 4294967295)) AS crc
  FROM documents, crc_table
), written AS (
  SELECT tree, doc_id, coalesce(crc % 7 = 0, false) AS tampered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more_chars,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM crcs
), leaves AS (
  SELECT tree, doc_id, sha256(head || chars || tail) AS leaf,
    sha256(head || CASE WHEN tampered THEN more_chars ELSE chars END || tail) AS changed FROM written
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), grown(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY i) FROM numbered GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], '')))
  FROM grown WHERE len(nodes) > 1
), subroots AS (
  SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM grown WHERE len(nodes) = 1
), top(tree, level, nodes) AS (
  SELECT '', 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT tree, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], '')))
  FROM top WHERE len(nodes) > 1
), levels AS (
  SELECT * FROM grown WHERE len(nodes) > 1 UNION ALL SELECT * FROM top WHERE len(nodes) > 1
), nodes AS (
  SELECT tree, level, unnest(range(0, len(nodes))) AS i, unnest(nodes) AS digest FROM levels
), heights AS (
  SELECT tree, max(level) + 1 AS height FROM levels GROUP BY tree
), climb(tree, first, level, i, proof, folded) AS (
  SELECT tree, i, 0, i, '', changed FROM numbered
  UNION ALL
  SELECT c.tree, c.first, c.level + 1, c.i // 2, c.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN s.digest IS NULL THEN c.folded WHEN s.i < c.i THEN s.digest || c.folded ELSE c.folded || s.digest END)
  FROM climb c JOIN heights h ON h.tree = c.tree AND c.level < h.height
    LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.i = xor(c.i, 1)
), at_subroot AS (
  SELECT c.*, s.subroot, s.place FROM climb c JOIN subroots s USING (tree) LEFT JOIN heights h USING (tree)
  WHERE c.level = coalesce(h.height, 0)
), upper_climb(tree, first, level, i, proof, folded) AS (
  SELECT tree, first, 0, place, proof, folded FROM at_subroot
  UNION ALL
  SELECT c.tree, c.first, c.level + 1, c.i // 2, c.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN s.digest IS NULL THEN c.folded WHEN s.i < c.i THEN s.digest || c.folded ELSE c.folded || s.digest END)
  FROM upper_climb c JOIN heights h ON h.tree = '' AND c.level < h.height
    LEFT JOIN nodes s ON s.tree = '' AND s.level = c.level AND s.i = xor(c.i, 1)
), ends AS (
  SELECT c.* FROM upper_climb c WHERE c.level = coalesce((SELECT height FROM heights WHERE tree = ''), 0)
)
SELECT n.doc_id, n.leaf, s.subroot, t.nodes[1] AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  e.folded = t.nodes[1] AS verified
FROM numbered n JOIN ends e ON e.tree = n.tree AND e.first = n.i JOIN subroots s ON s.tree = n.tree
  JOIN top t ON len(t.nodes) = 1
"""
