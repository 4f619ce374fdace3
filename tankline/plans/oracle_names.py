"""SQL of the queries on string similarity: ratios by a table of the longest common subsequence, no bound but that of lengths."""

from __future__ import annotations

from ..sources.adapters import with_sql

_NAMES = "names AS (SELECT DISTINCT md5(manufacturer || '|' || model || ' ' || lower(description)) AS car_id, manufacturer AS brand, model || ' ' || lower(description) AS name FROM cars)"
#: Names and page names of a brand that share a word, with the share of common words.
_PAIRED = f"""{_NAMES}, asked AS (SELECT car_id, brand, name, list_distinct(string_split(lower(name), ' ')) AS w FROM names),
    paged AS (SELECT DISTINCT brand_name AS brand, wiki_name AS tag, list_distinct(string_split(lower(car_name), ' ')) AS pw FROM wiki),
    paired AS (SELECT car_id, a.brand, name, tag, 2 * len(list_intersect(w, pw)) / (len(w) + len(pw)) AS score FROM asked a JOIN paged p ON a.brand = p.brand AND list_has_any(w, pw))"""


def _words(s: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({s}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def _joined(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


_BARE = r"trim(replace(regexp_replace({}, '[(\[].*?[)\]]', '', 'g'), '-', ' '))"
_NUMBERS = "list_transform(string_split({}, ''), lambda c: [unicode(c)])"
#: The rows of a table of common subsequences, one for each character of x, each worked out along y.
_COMMON = f"""list_last(list_reduce({_NUMBERS.format('x')}, lambda above, c: list_reduce({_NUMBERS.format('y')},
    lambda row, d: list_append(row, CASE WHEN c[1] = d[1] THEN above[len(row)] + 1 ELSE greatest(above[len(row) + 1], row[len(row)]) END), [0]), list_resize([0], len(y) + 1, 0)))"""


def _alike(pairs: str) -> str:
    """alike(l, r): the pairs of names (l, r) of the relation pairs that are alike."""
    sides = " UNION ALL ".join(f"SELECT l, r, {_words(a)} AS s, {_words(b)} AS t FROM plain" for a, b in (("a", "b"), ("ca", "cb")))
    only = lambda own, other: f"list_filter(list_distinct({own}), lambda w: NOT list_contains({other}, w))"
    return f"""pairs AS (SELECT DISTINCT l, r FROM ({pairs})),
    dated AS (SELECT l, r, coalesce(replace(l, list_max(list_filter(range(1980, 2031), lambda y: contains(l, y::VARCHAR)))::VARCHAR, ' '), l) AS n FROM pairs),
    plain AS (SELECT * FROM (SELECT l, r, lower(trim(replace(n, '-', ' '))) AS a, lower(trim(replace(r, '-', ' '))) AS b, {_BARE.format('n')} AS ca, {_BARE.format('r')} AS cb FROM dated)
        WHERE least(len({_words('a')}), len({_words('b')}), len({_words('ca')}), len({_words('cb')})) > 1),
    sets AS (SELECT l, r, {_joined('s')} AS x, {_joined('t')} AS y, {_joined('list_intersect(list_distinct(s), list_distinct(t))')} AS shared, {_joined(only('s', 't'))} AS one, {_joined(only('t', 's'))} AS other FROM ({sides})),
    sides AS (SELECT *, trim(shared || ' ' || one) AS one_side, trim(shared || ' ' || other) AS other_side FROM sets),
    compared AS (SELECT l, r, a AS x, b AS y, 90 AS above FROM plain UNION SELECT l, r, ca, cb, 93 FROM plain UNION SELECT l, r, x, y, 93 FROM sides UNION SELECT l, r, one_side, other_side, 93 FROM sides
        UNION SELECT l, r, shared, one_side, 93 FROM sides WHERE shared <> '' UNION SELECT l, r, shared, other_side, 93 FROM sides WHERE shared <> ''),
    ratios AS (SELECT x, y, above, 200.0::DOUBLE * {_COMMON} / (len(x) + len(y)) AS ratio FROM (SELECT DISTINCT x, y, above FROM compared) WHERE 200 * least(len(x), len(y)) > above * (len(x) + len(y))),
    alike AS (SELECT DISTINCT l, r FROM compared JOIN ratios USING (x, y, above) WHERE round_even(ratio, 0) > above)"""


_LIST_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda w: w <> '')"
_RULES = f"""judged AS (SELECT *, CASE WHEN score >= 0.8 THEN 1 WHEN score >= 0.8::DOUBLE - 0.06::DOUBLE AND list_has_all({_LIST_WORDS.format("brand || ' ' || name")}, {_LIST_WORDS.format('tag')}) THEN 2 END AS rule,
        score >= 0.8::DOUBLE - 0.06::DOUBLE AS in_band, replace(name, brand || ' ', '') AS own, replace(tag, brand || ' ', '') AS bare, 'B' || substr(brand, 7) AS alias FROM paired),
    forms AS (SELECT car_id, tag, 3 AS rule, unnest([brand || ' ' || name, own, brand || ' ' || own]) AS l, unnest([tag, bare, tag]) AS r FROM judged WHERE rule IS NULL AND NOT in_band
        UNION ALL SELECT car_id, tag, 5, unnest([alias || ' ' || brand || ' ' || name, alias || ' ' || replace(name, alias, '')]), unnest([tag, replace(tag, alias, '')]) FROM judged WHERE rule IS NULL),
    {_alike('SELECT l, r FROM forms')},
    told AS (SELECT car_id, tag, rule FROM judged WHERE rule IS NOT NULL UNION ALL SELECT car_id, tag, rule FROM forms JOIN alike USING (l, r)),
    first_told AS (SELECT car_id, hash_id, min(rule) AS rule FROM told JOIN wiki ON wiki_name = tag GROUP BY ALL)"""

ORACLE_SQL = {
    "name_similarity": with_sql(
        "wiki cars",
        "SELECT brand, name, tag AS page, a.l IS NOT NULL AS alike FROM paired p LEFT JOIN alike a ON a.l = brand || ' ' || name AND a.r = tag",
        f"{_PAIRED}, {_alike('SELECT brand || chr(32) || name AS l, tag AS r FROM paired')}",
    ),
    "accepted_matches": with_sql("wiki cars", "SELECT car_id, rule, count(*) AS pages FROM first_told GROUP BY ALL", f"{_PAIRED}, {_RULES}"),
}

_EVENTS = "CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END"
ORACLE_SQL |= {
    "network_scores": "SELECT DISTINCT p_brand || ' ' || p_name AS car_id, p_brand AS brand, p_name AS text, p_brand || ' ' || p_name AS tag, true AS sure FROM part",
    "stored_changes": with_sql("prices", """SELECT country, date::VARCHAR AS date, round(euro_ttc + CASE month(date) WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END, 3) AS euro_ttc
        FROM prices WHERE month(date) <> 2 OR year(date) > 1995"""),
    "stored_once": f"""WITH e AS (SELECT event_id, {_EVENTS} AS phenomenon FROM events), nameless AS (SELECT DISTINCT phenomenon FROM e WHERE event_id % 500 = 1),
        stored AS (SELECT event_id, phenomenon FROM e UNION ALL SELECT NULL, phenomenon FROM nameless)
        SELECT phenomenon, count(*) AS n, count(event_id) AS named, count(DISTINCT event_id) AS ids, count(*) FILTER (WHERE event_id % 10 = 3) AS undated FROM stored GROUP BY 1""",
    "corrected_measurements": f"""WITH e AS (SELECT CASE WHEN event_id % 7 = 0 AND event_id % 3 = 0 THEN '1' ELSE user_id::VARCHAR END AS sensor_id, {_EVENTS} AS phenomenon,
            value + CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 10 ELSE 0 END AS v FROM events WHERE event_id % 11 <> 0)
        SELECT sensor_id, phenomenon, round(max(v), 3) AS max, round(sum(v), 3) AS sum, round(min(v), 3) AS min, count(v) AS n FROM e WHERE v IS NOT NULL GROUP BY 1, 2""",
    "contained_pages": with_sql(
        "wiki cars",
        "SELECT car_id, brand, count(*) AS pages, min(tag) AS first_page, max(tag) AS last_page FROM met GROUP BY ALL",
        f"""{_NAMES}, long_names AS (SELECT car_id, brand, lower(name || ' ' || string_split(name, ' ')[-1] || ' ' || name) AS n FROM names),
        met AS (SELECT DISTINCT car_id, n.brand, wiki_name AS tag FROM long_names n JOIN wiki w ON w.brand_name = n.brand AND regexp_matches(n, '(^| )' || array_to_string(string_split(lower(car_name), ' '), '( .*)? ') || '( |$)'))""",
    ),
}
