"""SQL of the queries on page texts: every run of words held against every name, by joins of places."""

from __future__ import annotations

from ..sources.adapters import with_sql

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_BARE = f"list_filter({_WORDS.format('car_name')}, lambda w: NOT list_contains({_WORDS.format('brand_name')}, w))"
#: The places (no, place) of words in names of brands and of other cars of a page's brand; spoken has all words.
_NAMED = f"""lists AS (SELECT doc_id, brand, tag, regexp_split_to_array(page_text, '[.!?][ \\t\\n\\r\\f]+|[\\n\\r]+') AS s FROM page_texts),
    split AS (SELECT doc_id, brand, tag, unnest(s) AS s, generate_subscripts(s, 1) AS no FROM lists),
    sents AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS nth FROM (SELECT doc_id, brand, tag, no, {_WORDS.format('s')} AS w FROM split) WHERE len(w) > 0),
    starts AS (SELECT *, sum(len(w) + 1) OVER (PARTITION BY doc_id ORDER BY no) - len(w) - 1 AS begin FROM sents),
    brand_phrases AS (SELECT DISTINCT array_to_string({_WORDS.format('name')}, ' ') AS phrase FROM (SELECT unnest([p_brand, 'B' || substr(p_brand, 7)]) AS name FROM part)),
    car_phrases AS (SELECT DISTINCT array_to_string({_BARE}, ' ') AS phrase, brand_name AS brand, wiki_name AS named FROM wiki),
    lengths AS (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM (SELECT phrase FROM brand_phrases UNION SELECT phrase FROM car_phrases)),
    spots AS (SELECT doc_id, brand, tag, no, begin, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM starts, lengths),
    runs AS (SELECT doc_id, brand, tag, no, begin, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM spots),
    hits AS (SELECT doc_id, no, begin, i, n FROM runs JOIN brand_phrases USING (phrase) UNION SELECT doc_id, no, begin, i, n FROM runs JOIN car_phrases USING (phrase, brand) WHERE named <> tag),
    places AS (SELECT DISTINCT doc_id, no, begin, i + k AS place FROM (SELECT *, unnest(range(0, n)) AS k FROM hits))"""
_LEFT = f"""{_NAMED}, owned AS (SELECT *, list_filter({_WORDS.format('tag')}, lambda x: NOT list_contains({_WORDS.format('brand')}, x)) AS own FROM starts),
    spoken AS (SELECT doc_id, no, own, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM owned),
    gone AS (SELECT s.*, p.place IS NOT NULL AND NOT list_contains(own, word) AS gone FROM spoken s LEFT JOIN places p ON p.doc_id = s.doc_id AND p.no = s.no AND p.place = s.place),
    told AS (SELECT doc_id, no, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS rest,
        bool_or((NOT gone AND (list_contains(own, word) OR word IN ('model', 'type', 'typ', 'generation'))) OR regexp_matches(word, '[0-9]')) AS relevant FROM gone GROUP BY ALL)"""

ORACLE_SQL = {
    "page_names": with_sql("wiki page_texts", "SELECT doc_id, brand, count(*) AS named_words, md5(string_agg((begin + place - 1)::BIGINT::VARCHAR, ',' ORDER BY begin + place)) AS places_md5 FROM places JOIN page_texts USING (doc_id) GROUP BY ALL", _NAMED),
    "page_sentences": with_sql(
        "wiki page_texts",
        """SELECT doc_id, lang, count(no) AS sentences, count(no) FILTER (relevant) AS relevant, md5(coalesce(string_agg(rest, '|' ORDER BY no) FILTER (relevant), '')) AS left_md5
        FROM page_texts LEFT JOIN told USING (doc_id) GROUP BY doc_id, lang""",
        _LEFT,
    ),
    "page_patterns": with_sql(
        "wiki page_texts",
        """SELECT brand, tag, count(*) AS n, min(pattern) AS first_pattern, max(pattern) AS last_pattern FROM (
            SELECT brand_name AS brand, wiki_name AS tag, unnest([wiki_name, car_name, lower(car_name), upper(car_name), array_to_string(list_transform(string_split(car_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')]) AS pattern FROM wiki
            UNION SELECT brand, tag, rest FROM told JOIN page_texts USING (doc_id) WHERE relevant AND rest <> '') GROUP BY ALL""",
        _LEFT,
    ),
}
