"""DuckDB SQL for the queries that SQL can express in full."""

from __future__ import annotations

from hushlake.llm import secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
    FROM w),
n AS (SELECT doc_id, cast(len(sh) AS bigint) AS size FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * c >= 80 * (na.size + nb.size - c)),
l AS (SELECT a AS f, b AS t FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT l.t, r.m FROM r JOIN l ON l.f = r.doc_id WHERE r.m < l.t)
SELECT n.doc_id, n.size AS n_shingles, min(r.m) AS component_id, n.doc_id = min(r.m) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.size
"""


#: CRC-32 of a decimal number, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(cast({0} AS varchar), ''),
    lambda c: cast(ascii(c) AS bigint))), lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

PREFIX_TRIE = f"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS p, dg, size
    FROM (
        SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS dg,
            strlen(coalesce(text, '')) AS size
        FROM conversations WHERE conv_id IS NOT NULL) s),
c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS src, {_CRC32.format("conv_id")} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t) i),
r AS (
    SELECT c.conv_id, 0 AS own, t.p, t.dg, t.size FROM c JOIN t ON t.conv_id = c.src AND t.p <= c.h
    UNION ALL SELECT c.conv_id, 1, t.p, t.dg, t.size FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
k AS (
    SELECT conv_id, cast(row_number() OVER w AS bigint) AS d, string_agg(dg, '') OVER w AS node, cast(size AS bigint) AS size
    FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, p ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM k GROUP BY d, node),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
pairs AS (SELECT DISTINCT a.node AS top, b.node AS node FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
    SELECT p.top AS node, cast(sum(n.saved) AS bigint) AS saved_tokens, count(*) FILTER (WHERE kids.node IS NULL) AS n_leaves
    FROM pairs p JOIN n ON n.node = p.node LEFT JOIN kids ON kids.node = p.node GROUP BY p.top),
tips AS (
    SELECT node, string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, arg_max(node, d) AS node FROM k GROUP BY conv_id) e GROUP BY node)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children,
    sums.n_leaves, sums.saved_tokens, sha256(coalesce(tips.ids, '')) AS ends_sha256
FROM n JOIN sums ON sums.node = n.node LEFT JOIN kids ON kids.node = n.node LEFT JOIN tips ON tips.node = n.node
    LEFT JOIN n up ON n.d > 0 AND up.node = left(n.node, length(n.node) - 32)
"""

FILTER_AUDIT = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
l AS (SELECT doc_id, max(cast(quality = 1 AS int)) AS good, max(cast(toxic = 1 AS int)) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, cast(len(ws) < 100 AS int) + 2 * cast(100 * len(list_distinct(ws)) < 80 * len(ws) AS int)
        + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS int)
        + 8 * cast(regexp_matches(t, '[#$%&*|]') AS int)
        + 16 * cast(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS int) AS mask,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
    SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) x),
y AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & cast(before + bit AS int) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & cast(before AS int) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & cast(before AS int) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & cast(before AS int) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & cast(before AS int) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed,
    cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost,
    cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley
FROM y
"""


def _either_case(pattern: str) -> str:
    """A pattern of ``(?i:...)`` parts with its letters in brackets: RE2 folds more than A-Z."""
    head, _, rest = pattern.partition("(?i:")
    if not rest:
        return pattern
    depth, end = 1, 0
    while depth:
        depth += {"(": 1, ")": -1}.get(rest[end], 0)
        end += 1
    folded = "".join(f"[{c}{c.upper()}]" if c in LOWER else c for c in rest[: end - 1])
    return f"{head}(?:{folded}){rest[end:]}"


def secret_scan_sql() -> str:
    """The scan over ``documents``: owners and repositories are sources."""
    found, spans = [], []
    for rank, (kind, _, pattern, group, least) in enumerate(secrets.KINDS):
        quoted = _either_case(pattern).replace(r"\"", '"').replace("'", "''")
        found.append(
            f"regexp_extract_all(t, '{quoted}') AS {kind}_h, regexp_extract_all(t, '{quoted}', {group}) AS {kind}_v, "
            f"string_split_regex(t, '{quoted}') AS {kind}_g"
        )
        start = (
            f"list_sum(list_transform({kind}_g[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform({kind}_h[1:i - 1], lambda x: length(x))), 0)"
        )
        spans.append(
            f"list_filter(list_transform(range(1, len({kind}_h) + 1), lambda i: {{'s': cast({start} AS bigint), 'r': {rank}, "
            f"'e': cast({start} + length({kind}_h[i]) AS bigint), 'k': '{kind}', 'v': {kind}_v[i]}}), "
            f"lambda y: length(y.v) >= {least}) AS {kind}_s"
        )
    listed = "array_to_string(list_transform({}, lambda y: concat(y.k, ':', y.s, ':', y.e)), ',')"
    count = "cast(len(list_filter(base, lambda y: y.k = '{0}')) AS bigint) AS n_{0}"
    return f"""
WITH f AS (SELECT doc_id, source, {", ".join(found)} FROM (SELECT *, coalesce(text, '') AS t FROM documents) d),
g AS (SELECT doc_id, source, {", ".join(spans)} FROM f),
b AS (SELECT doc_id, source, list_sort(list_concat(list_concat(assign_s, access_s), hex_s)) AS base, owned_s FROM g),
c AS (
    SELECT doc_id, source, base, list_filter(owned_s, lambda o: regexp_matches(o.v, '[0-9]') AND regexp_matches(o.v, '[A-Za-z]')
        AND len(list_filter(base, lambda y: y.s < o.e AND o.s < y.e)) = 0) AS own FROM b),
x AS (SELECT doc_id, source, unnest(list_concat(base, own)) AS sp FROM c),
judged AS (
    SELECT sp.v AS v, count(DISTINCT source) AS owners, count(DISTINCT source) < {secrets.EXAMPLE_OWNERS}
        AND len(list_distinct(string_split(sp.v, ''))) >= {secrets.LIVE_CHARACTERS} AS live
    FROM x GROUP BY sp.v),
per AS (
    SELECT doc_id, list(sp) FILTER (WHERE sp.k = 'owned' AND live) AS owned, count(*) FILTER (WHERE live) AS n_live,
        count(*) FILTER (WHERE NOT live) AS n_example, max(owners) AS max_owners
    FROM x JOIN judged ON judged.v = x.sp.v GROUP BY doc_id)
SELECT c.doc_id, {", ".join(count.format(k) for k in ("assign", "access", "hex"))},
    sha256({listed.format("base")}) AS base_sha256,
    {listed.format("list_sort(list_concat(base, coalesce(owned, [])))")} AS spans,
    cast(coalesce(len(owned), 0) AS bigint) AS n_owned, cast(coalesce(n_live, 0) AS bigint) AS n_live,
    cast(coalesce(n_example, 0) AS bigint) AS n_example, cast(coalesce(max_owners, 0) AS bigint) AS max_owners
FROM c LEFT JOIN per ON per.doc_id = c.doc_id
"""
