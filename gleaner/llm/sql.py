"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import FENCE, RULES, SKETCH_BITS, WINDOW

UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def quality_rules_sql(prior: int = 30) -> str:
    shift = f"greatest(0, length(bin(v)) - {SKETCH_BITS})"
    q = lambda p: f"min(bin) FILTER (WHERE upto * 100 >= total * {p})"
    pick = lambda side: "CASE metric " + " ".join(f"WHEN '{m}' THEN {s[side]}" for m, s in RULES.items() if s[side] is not None) + " END"
    fences = lambda bins, keys: f"""SELECT {keys}, metric, max(total) AS n, {q(10)} AS q10, {q(50)} AS q50, {q(90)} AS q90 FROM (
 SELECT *, sum(n) OVER (PARTITION BY {keys}, metric ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {keys}, metric) AS total FROM {bins}) GROUP BY {keys}, metric"""  # noqa: E731
    limits = f"""q50 + {FENCE} * greatest(q50 - q10, {pick(0)}) AS hi, CASE WHEN {pick(1)} IS NOT NULL THEN q50 - {FENCE} * greatest(least(q90 - q50, q50 - q10), {pick(1)}) END AS lo"""
    shrunk = lambda c: f"(u.n::DOUBLE * u.{c}::DOUBLE + {float(prior)}::DOUBLE * v.{c}::DOUBLE) / (u.n::DOUBLE + {float(prior)}::DOUBLE)"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM r" for m in RULES)
    broken = " OR ".join(f"max(CASE WHEN f.metric = '{m}' AND (r.{m} > f.hi OR coalesce(r.{m} < f.lo, false)) THEN 1 ELSE 0 END) = 1" for m in RULES)
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
 g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
 p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
 s AS (SELECT doc_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p) GROUP BY doc_id),
 m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter,
  len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g'))::BIGINT AS n_letters FROM d LEFT JOIN s ON d.doc_id = s.doc_id),
 r AS (SELECT *, 100 * word_chars // greatest(n_words, 1) AS word_len, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_stutter // greatest(n_words, 1) AS stutter, 1000 * (word_chars - n_letters) // greatest(word_chars, 1) AS marks FROM m),
 b AS (SELECT lang, source, metric, (v >> {shift}) << {shift} AS bin, count(*) AS n FROM ({long}) GROUP BY ALL),
 x AS ({fences("b", "lang, source")}), y AS ({fences("(SELECT lang, metric, bin, sum(n) AS n FROM b GROUP BY ALL)", "lang")}),
 u AS (SELECT lang, source, metric, n, {limits} FROM x), v AS (SELECT lang, metric, {limits} FROM y),
 f AS (SELECT u.lang, u.source, u.metric, {shrunk("hi")} AS hi, {shrunk("lo")} AS lo
  FROM u JOIN v ON u.lang IS NOT DISTINCT FROM v.lang AND u.metric = v.metric),
 k AS (SELECT r.doc_id, {broken} AS bad FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source GROUP BY r.doc_id)
 SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(bad, false) AS kept FROM r LEFT JOIN k ON r.doc_id = k.doc_id"""


def url_filters_sql(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rules)
    value = lambda name: f"trim(regexp_replace(regexp_extract(tag, '\\b{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1, 'is'), '^[\"'']|[\"'']$', '', 'g'))"
    split = lambda url, keep, source: f"""SELECT {keep}, translate(raw, {UP}, {LOW}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM (SELECT *, coalesce(CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) END, '') AS rest FROM {source}))"""  # noqa: E731
    head = lambda c: f"regexp_extract({c}, '^[^:/?#]*://[^/?#]*')"
    plain = lambda c: f"regexp_replace({c}, '#.*$', '')"
    tail = lambda c: f"substr({plain(c)}, length({head(plain(c))}) + 1)"
    node_of = lambda c: f"translate({head(plain(c))}, {UP}, {LOW}) || CASE WHEN {head(plain(c))} <> '' AND NOT starts_with({tail(c)}, '/') THEN '/' ELSE '' END || {tail(c)}"
    best = lambda source, key: f"""SELECT {key}, arg_max(rhost || rpath, length(rhost || rpath) * 2 + (verdict = 'allow')::INT) AS rule, arg_max(verdict, length(rhost || rpath) * 2 + (verdict = 'allow')::INT) AS verdict
  FROM {source}, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY {key}"""  # noqa: E731
    return f"""WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {values}),
 tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(?:link|meta)\\b[^>]*>', 0, 'is')) AS tag FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
 targets AS (SELECT url, regexp_replace(replace(CASE WHEN regexp_matches(tag, '(?i)^<link\\b') AND regexp_matches({value("rel")}, '(?i)(^|\\s)canonical(\\s|$)') THEN {value("href")}
   WHEN regexp_matches(tag, '(?i)^<meta\\b') AND regexp_matches({value("http-equiv")}, '(?i)^refresh$') THEN trim(regexp_extract({value("content")}, '^[0-9.\\s]*[;,]\\s*(?:url\\s*=)?\\s*["'']?([^"'']+)', 1, 'is')) END, '&amp;', '&'), '#.*$', '') AS target FROM tags),
 absolute AS (SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN target WHEN starts_with(target, '//') THEN regexp_extract(url, '^[^:/?#]*:') || target
   WHEN starts_with(target, '/') THEN {head("url")} || target ELSE CASE WHEN regexp_extract(url, '^[^:/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?') = {head("url")} THEN {head("url")} || '/' ELSE regexp_extract(url, '^[^:/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?') END || target END AS target
   FROM targets WHERE target <> ''),
 one AS (SELECT DISTINCT {node_of("url")} AS u, {node_of("target")} AS v FROM absolute), edges AS (SELECT u, v FROM one UNION SELECT v, u FROM one),
 nodes AS ({split("node", "node", "(SELECT DISTINCT u AS node FROM edges)")}),
 blocked AS (SELECT node FROM ({best("nodes", "node")}) WHERE verdict = 'block' UNION SELECT v FROM blocked JOIN edges ON node = u),
 parsed AS ({split("url", "page_id, url", "pages")}), ruled AS ({best("parsed", "page_id")})
 SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, CASE WHEN {node_of("p.url")} IN (SELECT node FROM blocked) THEN 'block' END, 'allow') AS verdict FROM parsed p LEFT JOIN ruled r ON p.page_id = r.page_id"""


def hard_negatives_sql() -> str:
    """Every product of an anchor with a row of its length."""
    return """WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score, a.label = c.label AS same
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.row <> c.row AND len(a.e) = len(c.e)),
 p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM s WHERE same QUALIFY place <= 5),
 n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5)
 SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n"""


def ranked_search_sql() -> str:
    """Every posting of an item's terms, without an index."""
    words = lambda c: f"regexp_extract_all(translate({c}, {UP}, {LOW}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words("text")} AS t FROM documents), b AS (SELECT row_number() OVER () AS item, item_id, list_distinct({words("text")}) AS t FROM benchmark),
 s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0), q AS (SELECT item, item_id, unnest(t) AS term FROM b), e AS (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d),
 p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
 r AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item, item_id, row, doc_id)
 SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50"""


def suffix_dedup_sql(length: int = 50) -> str:
    """Every window of ``length`` bytes, in hex; meant for tables of a few megabytes."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM d WHERE length(h) >= {2 * length})),
 c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
 s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM c)),
 r AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM s GROUP BY doc_id, run),
 k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM r),
 p AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY d.doc_id)
 SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)"""
