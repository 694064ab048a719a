"""SQL for the queries of this subpackage that SQL can express."""

def _level(own: list[str], weight: str, above: str | None) -> str:
    """Two CTEs that share the budgets of ``above`` among the nodes of one level."""
    keys, parent, child = ", ".join(own), ", ".join(own[:-1]), own[-1]
    group = f"PARTITION BY {parent}" if parent else ""
    order, ahead = f"{group} ORDER BY fill, {child}", f"{group} ORDER BY {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    budget = f"JOIN {above} USING ({parent})" if above else "CROSS JOIN amount"
    name = f"level{len(own)}"
    return f"""
{name}a AS (
    SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE -1.0 END AS fill, CASE WHEN weight > 0 THEN capacity ELSE 0 END AS room
    FROM (SELECT {keys}, sum(tokens)::BIGINT * 2 AS capacity, ({weight})::DOUBLE AS weight FROM leaves GROUP BY {keys}) n {budget}
), {name}b AS (
    SELECT *, CASE WHEN weight > 0 THEN (budget - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS level FROM {name}a
), {name}c AS (
    SELECT *, max(CASE WHEN level <= fill THEN level END) OVER ({group}) AS final FROM {name}b
), {name}d AS (
    SELECT *, CASE WHEN weight > 0 THEN greatest(least(room, floor(coalesce(final * weight, room) + 1e-6)::BIGINT), 0) ELSE 0 END AS share FROM {name}c
), {name}e AS (
    SELECT *, least(budget, sum(room) OVER ({group})) - sum(share) OVER ({group}) AS due, coalesce(sum(room - share) OVER ({ahead}), 0) AS before FROM {name}d
), {name} AS (
    SELECT {keys}, (share + greatest(0, least(room - share, due - before)))::BIGINT AS budget FROM {name}e
)"""


_CASE = lambda c, weights: "CASE " + c + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 0 END"

ORACLES: dict[str, str] = {
    "op1_warc_revisits": r"""
WITH base AS (
    SELECT page_id, url AS raw, coalesce(url, '') AS u, md5(coalesce(html, '')) AS digest FROM pages
), parts AS (
    SELECT *, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM base
), canon AS (
    SELECT page_id, u, digest, ('0x' || substr(md5(u), 1, 3))::BIGINT + 1 AS delay,
           list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept,
           regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') AS stem, contains(u, '://') AS ok FROM parts
), page AS (
    SELECT page_id, u, digest, delay, CASE WHEN ok THEN stem || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM canon
), found AS (
    SELECT v.*, v.page_id + v.delay AS ts, r.page_id AS rid, r.digest AS rdigest, r.u AS ru,
           row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS rn
    FROM page v LEFT JOIN page r ON r.url = v.url AND r.page_id < v.page_id + v.delay
)
SELECT page_id, url, ts, rid AS response_page_id, rid AS response_ts,
       CASE WHEN rid IS NULL THEN 'missing' WHEN substr(rdigest, 1, 16) = substr(digest, 1, 16) THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN substr(rdigest, 1, 16) = substr(digest, 1, 16) THEN rdigest END AS digest,
       CASE WHEN substr(rdigest, 1, 16) = substr(digest, 1, 16) THEN
            'cache-control: max-age=60; content-length: ' || length(ru) || '; content-type: text/html; date: ' || ts || '; etag: "' || substr(digest, 1, 16) || '"; server: origin' END AS headers
FROM found WHERE rn = 1
""",
    "op8_budget_mixing": rf"""
WITH doc AS (
    SELECT doc_id, ['web', 'books', 'forums', 'reference'][coalesce(try_cast(regexp_extract(source, '[0-9]+') AS BIGINT), 0) % 4 + 1] AS domain,
           coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
), words AS (
    SELECT * FROM doc WHERE tokens > 0
), leaves AS (
    SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM words GROUP BY ALL
), amount AS (
    SELECT floor(coalesce(sum(tokens), 0) * 0.5)::BIGINT AS budget FROM leaves
), {_level(["domain"], _CASE("domain", {"web": 0.4, "books": 0.3, "forums": 0.2, "reference": 0.1}), None)},
{_level(["domain", "lang"], _CASE("lang", {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}), "level1")},
{_level(["domain", "lang", "source"], "1.0", "level2")},
plan AS (
    SELECT domain, lang, source, budget // tokens AS passes, budget % tokens AS rest FROM leaves JOIN level3 USING (domain, lang, source)
), taken AS (
    SELECT doc_id, domain, lang, source, unnest(range(passes)) AS epoch, tokens, tokens AS tokens_taken FROM words JOIN plan USING (domain, lang, source)
), ordered AS (
    SELECT doc_id, domain, lang, source, passes AS epoch, tokens, rest, coalesce(sum(tokens) OVER (
        PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('7-' || passes || '-' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
    FROM words JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens, tokens_taken FROM taken
UNION ALL
SELECT doc_id, domain, lang, source, epoch::INT, tokens, least(tokens, rest - upto)::BIGINT FROM ordered WHERE upto < rest
""",
    "op9_url_filter": r"""
WITH listed(host, path, action, ruled) AS (VALUES
    ('com', '/en/', 'block', true), ('example.com', '/en/7', 'allow', true), ('net', '/de/', 'allow', true), ('example.net', '/de/8', 'block', true),
    ('org', '/es/', 'block', true), ('ads-track.example.com', '', 'block', false), ('casino-win.example.net', '', 'block', false), ('spam-farm.example.org', '', 'block', false),
    ('adult-x.example.com', '', 'block', false), ('cheap-pills.example.net', '', 'block', false), ('free-bets.example.net', '', 'block', false)
), page AS (
    SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), named AS (
    SELECT *, regexp_replace(host, ':(80|443)$', '') AS bare FROM page
), best AS (
    SELECT p.*, l.action, CASE WHEN l.ruled THEN l.host || l.path END AS rule,
           row_number() OVER (PARTITION BY r ORDER BY l.ruled DESC NULLS LAST, length(l.host || l.path) DESC) AS rn
    FROM named p LEFT JOIN listed l ON CASE WHEN l.ruled THEN p.host = l.host OR ends_with(p.host, '.' || l.host) ELSE p.bare = l.host OR ends_with(p.bare, '.' || l.host) END
         AND starts_with(p.path, l.path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best WHERE rn = 1
""",
    "op10_line_winnowing": r"""
WITH doc AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), line AS (
    SELECT doc_id, p - 1 AS pos, regexp_replace(ls[p], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM doc, unnest(range(1, len(ls) + 1)) AS t(p)
), run AS (
    SELECT doc_id, pos, bare, len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) AS w,
           lead(pos) OVER s AS pos2, lead(pos, 2) OVER s AS pos3, lead(bare) OVER s AS bare2, lead(bare, 2) OVER s AS bare3, row_number() OVER s AS i
    FROM line WHERE bare <> '' WINDOW s AS (PARTITION BY doc_id ORDER BY pos)
), sized AS (
    SELECT *, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM run WINDOW s AS (PARTITION BY doc_id ORDER BY pos)
), win AS (
    SELECT doc_id, i, [pos] AS pos, bare AS body FROM sized WHERE w >= 50
    UNION ALL
    SELECT doc_id, i, [pos, pos2], bare || chr(10) || bare2 FROM sized WHERE w + w2 >= 50
    UNION ALL
    SELECT doc_id, i, [pos, pos2, pos3], bare || chr(10) || bare2 || chr(10) || bare3 FROM sized WHERE pos3 IS NOT NULL
), first AS (
    SELECT *, first_value((doc_id, i)) OVER (PARTITION BY body ORDER BY doc_id, i) AS f, first_value(pos) OVER (PARTITION BY body ORDER BY doc_id, i) AS fpos FROM win
), gone AS (
    SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(pos) AS p, f, fpos, i FROM first WHERE (doc_id, i) > f) g
    WHERE doc_id <> f[1] OR p > fpos[-1]
), cut AS (
    SELECT doc_id, list(p) AS del FROM gone GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(del), 0)::BIGINT AS n_removed,
       CASE WHEN del IS NULL THEN text ELSE coalesce(array_to_string([ls[p + 1] FOR p IN range(len(ls)) IF NOT list_contains(del, p)], chr(10)), '') END AS text
FROM doc LEFT JOIN cut USING (doc_id)
""",
    "op11_fill_in_middle": """
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
    SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM doc
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
""",
    "op13_source_divergence": r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), occ AS (
    SELECT r, lang, source, unnest(ts) AS term FROM doc
), kept AS (
    SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), counted AS (
    SELECT lang, source, term, count(*) AS c FROM occ GROUP BY ALL
), cell AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c FROM (SELECT DISTINCT lang, source FROM doc) g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), size AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), own AS (
    SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS p FROM cell JOIN (SELECT lang, source, sum(c) AS n FROM cell GROUP BY ALL) USING (lang, source) JOIN size USING (lang)
), whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS q FROM (SELECT lang, term, sum(c) AS c FROM cell GROUP BY ALL) JOIN (SELECT lang, sum(c) AS n FROM cell GROUP BY ALL) USING (lang) JOIN size USING (lang)
), other AS (
    SELECT a.lang, a.source, b.source AS item FROM (SELECT DISTINCT lang, source FROM doc) a JOIN (SELECT DISTINCT lang, source FROM doc) b ON a.lang = b.lang AND a.source <> b.source
), summed AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM other LEFT JOIN summed USING (lang, source, item)
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM own JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found) WHERE part = 'pair' OR rank <= 200
""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e)
       AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
    SELECT vec_id AS id, vec_id AS got FROM v
    UNION
    SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.got
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id)::BIGINT AS n_links,
       c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT id, min(got) AS component_id FROM reach GROUP BY id) c ON c.id = v.vec_id
""",
}
