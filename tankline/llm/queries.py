"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, langid, licenses, packing, secrets
from .collocations import INSIDE, LONGEST, MIN_COUNT, SCALE, TOP, collocations
from .common import table
from .decontaminate import CONTAINMENT, WORDS, contaminated
from .divergence import MIN_DOCS, TOP_TERMS, audit
from .exact_dedup import exact_dedup
from .line_dedup import dedup_lines
from .simhash import near_dedup
from .url_filter import filter_urls

#: The rules that op1 judges by: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LINE_MIN_DOCS = 10
RANK_FILE, TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=LINE_MIN_DOCS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def coded(docs: DataFrame) -> DataFrame:
    """docs with the token ids of their texts, their digest and the bytes decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path(RANK_FILE)
    return bpe.decode(bpe.with_id_digest(bpe.encode(docs, path, public_tokenizers.PATTERN)), path)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.inline_outer("licenses")).filter("license is not null")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return judged.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER_FILE))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_ALL = (
    op1_url_filter, op2_line_dedup, op3_decontamination, op4_simhash_near_dedup, op5_byte_bpe, op6_secret_scan, op7_license_scan,
    op8_exact_dedup, op9_language_id, op10_html_extraction, op11_source_divergence, op12_best_fit_packing, op13_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}

_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_url_filter": f"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
        parts AS (
            SELECT page_id, {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        fits AS (
            SELECT page_id, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
            FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
            GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
    "op2_line_dedup": f"""
        WITH cut AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        lines AS (SELECT *, {_LOWER.format(f"trim(line, {_WS})")} AS k FROM cut),
        often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {LINE_MIN_DOCS})
        SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN often ON lines.k = often.k GROUP BY doc_id""",
    "op3_decontamination": rf"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM benchmark),
        k AS (SELECT DISTINCT least({WORDS}, len(words)) AS k FROM b WHERE len(words) > 0),
        d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS s FROM w, k),
        q AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS s FROM b JOIN k ON k.k = least({WORDS}, len(words))),
        n AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
        FROM d JOIN q USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {CONTAINMENT} * any_value(n_shingles) - 1e-9""",
    "op8_exact_dedup": f"""
        WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), {_WS}, '') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
        FROM bare WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        t AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
        v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {MIN_DOCS}),
        sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
        full_c AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS n_lang FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        totals AS (SELECT lang, source, sum(n) AS n FROM full_c GROUP BY lang, source),
        p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 2)) // (x.n + 2 * s.v)::HUGEINT AS p,
                     1 + (1000000000::HUGEINT * (f.n_lang + 2)) // (s.n + 2 * s.v)::HUGEINT AS q
              FROM full_c f JOIN totals x USING (lang, source) JOIN sizes s USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s.value), 0) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) s
                  ON s.lang = a.lang AND s.x = a.source AND s.y = b.source GROUP BY a.lang, a.source, b.source),
        told AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
                 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told
        QUALIFY part = 'pair' OR rank <= {TOP_TERMS}""",
    "op13_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS ws FROM p),
        totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {LONGEST} + 1)) AS k)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}),
        cut AS (SELECT lang, phrase, k, a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
        scored AS (SELECT c.lang, c.phrase, c.k, c.a, x.a AS l, y.a AS r, c.j, ({SCALE}::HUGEINT * c.a) // (x.a + y.a)::HUGEINT AS score FROM cut c
                   JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ') AND x.k = j
                   JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:], ' ') AND y.k = c.k - j),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, j) = 1),
        parts AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))))) AS phrase FROM f WHERE k > 2),
        longer AS (SELECT lang, phrase, max(a) AS a FROM parts GROUP BY lang, phrase)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM best b JOIN totals USING (lang) LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
        WHERE o.a IS NULL OR 100 * o.a < {INSIDE} * b.a
        QUALIFY rank <= {TOP}""",
}
