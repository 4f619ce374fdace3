"""Clashing columns, odd and hostile rows, memory bounds and hot groups of the operators."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankline.llm import bpe, common, decontaminate, exact_dedup, html_extract, langid, licenses, line_dedup, secrets, simhash, url_filter

from .brute import brute_contained, brute_lines, brute_tokenizer

DOCS = "doc_id long, text string"
CLASHING = "short blocks r_plen salt _row _host host_ t1 _gone _lines lines own row hash h id n body words at fp root judged lang_ size keep u v node key bucket mask".split()


@pytest.fixture(scope="module")
def wide(spark):
    """Rows with a column for each name that an operator may use itself."""
    rows = [(i, f"line {i % 3}\nThe house and the garden number {i}.", *[f"{c}{i}" for c in CLASHING]) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def same_columns(out):
    return all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASHING)


@pytest.mark.parametrize("bound", [1000, 0])
def test_urls_with_clashing_columns(spark, wide, bound):
    rules = spark.createDataFrame([("b.org", "/", "block")], "host string, path string, verdict string")
    out = url_filter.filter_urls(wide.withColumn("url", F.concat(F.lit("http://a.b.org/"), "doc_id")), rules, broadcast_rules=bound)
    assert same_columns(out) and {r.verdict for r in out.collect()} == {"block"}


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_lines_with_clashing_columns(wide, bytes_):
    out = line_dedup.dedup_lines(wide, min_docs=2, broadcast_bytes=bytes_)
    assert out.columns[:-2] == wide.columns and same_columns(out) and {r.n_dropped for r in out.collect()} == {1}


def test_other_operators_with_clashing_columns(spark, wide):
    assert same_columns(langid.identify(wide, {"en": b" the house and the garden", "de": b" das haus und der garten"}))
    assert same_columns(licenses.scan(wide)) and same_columns(secrets.scan(wide, secrets.train(wide)))
    assert same_columns(bpe.decode(bpe.encode(wide, *tokenizer()), tokenizer()[0]))
    assert same_columns(html_extract.extract(wide.withColumn("html", F.lit("<p>x</p>")), html_extract.Chain(np.zeros((html_extract.SPACE, 2)), np.zeros((2, 2)))).withColumnRenamed("text", "t"))
    assert exact_dedup.exact_dedup(wide).count() == simhash.near_dedup(wide).count() == simhash.similar_dedup(wide).count() == 6
    items = spark.createDataFrame([(1, "the house and the garden number 4", "x")], "item_id long, text string, h string")
    assert [r.doc_id for r in decontaminate.contaminated(wide, items).collect()] == [4]


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_long_hosts_and_hosts_of_many_labels(spark):
    long = "a" * 70_000 + ".org"
    urls = spark.createDataFrame([(1, f"http://{long}/x"), (2, "http://" + "a." * 30_000 + "org/x"), (3, "http://ORG/x")], "id long, url string")
    rules = spark.createDataFrame([(long, "/", "block"), ("Org", "/x", "allow")], "host string, path string, verdict string")
    got = {r.id: (r.verdict, r.rule) for r in url_filter.filter_urls(urls, rules).collect()}
    assert got == {1: ("block", long + "/"), 2: ("allow", "org/x"), 3: ("allow", "org/x")}


def test_line_counts_beyond_32_bits_are_clipped():
    one = np.array([1, 2], np.uint64)
    index = line_dedup.PerfectHash(one, one, np.array([(1 << 32) + 3, 5]))
    assert index.count(one, one).tolist() == [line_dedup.MOST, 5]


def test_index_holds_all_lines(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nshared") for i in range(20)], DOCS)
    index, shards = line_dedup.build_index(line_dedup.line_counts(docs, "text"), 4)
    assert shards == 6 and sum(r.lines for r in index.collect()) == 40


def test_a_text_in_a_third_of_all_rows(spark):
    texts = [f"l{i % 7}\nx{i}\nsame" for i in range(80)] + ["hot\nsame\nl1"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for bytes_ in (1 << 20, 0):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=12, broadcast_bytes=bytes_, shard_keys=20).collect()}
        assert [got[i] for i in range(120)] == brute_lines(texts, 12)


def test_benchmark_in_slices(spark):
    draw = random.Random(8)
    text = lambda n: " ".join("".join(draw.choices("abcd", k=2)) for _ in range(n))
    items = [(i, text(draw.randrange(5, 30))) for i in range(12)]
    docs = [(d, f"{text(9)} {items[d % 12][1]} {text(400 if d == 3 else 5)}") for d in range(30)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=60)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == brute_contained(docs, items)


def test_exact_copies_in_a_hot_group_and_colliding_hashes(spark):
    docs = spark.createDataFrame([(i, ("a" * (1 + i % 2) + " ") if i % 3 else f"u{i}") for i in range(300)], DOCS)
    for bound in (1_000_000, 0):
        rows = exact_dedup.exact_dedup(docs, broadcast_rows=bound).collect()
        assert len(rows) == 300 and sorted({r.group_size for r in rows}) == [1, 100] and sum(r.kept for r in rows) == 102


def test_a_large_bucket_is_dealt_a_bounded_number_of_times(spark):
    draw = np.random.default_rng(3)
    prints = np.unique(draw.integers(0, 1 << 48, 200_000, dtype=np.int64))  # all agree in 16 bits
    near = prints[::200].copy()
    for _ in range(3):
        near ^= np.int64(1) << draw.integers(0, 48, len(near))
    df = spark.createDataFrame(np.unique(np.r_[prints, near])[:, None].tolist(), "fp long")
    n = df.count()
    dealt = simhash.bucketed(df)
    copies = dealt.groupBy("fp").count().agg(F.max("count")).first()[0]
    assert copies <= 8 and dealt.groupBy("key").count().agg(F.max("count")).first()[0] <= simhash.PART
    links = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.near_links(df).collect()}
    assert n > 200_000 and all((a ^ b).bit_count() <= 3 for a, b in links)
    roots = {r.node: r.root for r in common.components(spark.createDataFrame(sorted(links), "u long, v long")).collect()}
    together = [(int(a), int(b)) for a, b in zip(prints[::200], near) if a != b and (int(a) ^ int(b)).bit_count() <= 3]
    assert len(together) > 900 and all(roots[a] == roots[b] for a, b in together)
    assert {a for a, b in links} | {b for a, b in links} == set(roots)


def test_tables_of_each_round_are_deleted(spark, tmp_path):
    import os

    folder = common.shared_dir(spark).removeprefix("file:")
    common.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")).collect()
    assert not [f for f in os.listdir(folder) if f.startswith("large-star-")]


def test_bpe_of_code_and_chinese_keeps_a_bounded_memory():
    import public_tokenizers

    path, pattern = tokenizer()
    encoder, library, draw = bpe.Encoder(bpe.vocabulary(open(path, "rb").read(), pattern)), brute_tokenizer(), random.Random(1)
    assert encoder.shortcuts and pattern == public_tokenizers.PATTERN
    for block in range(3):
        code = ["\n".join("    " * draw.randrange(5) + f"x{draw.randrange(10**6)} = call(a,  b)  # {draw.random()}" for _ in range(300)) for _ in range(5)]
        chinese = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(3000)) + "。 "]
        texts = [*code, *chinese, " \n  lead", "tail  ", "a  b c", "x  y z"]
        assert [r.tolist() for r in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert all(len(p) <= bpe.MEMORY_CHARS for p in [*encoder.pieces, *encoder.heads])
        assert len(encoder.offsets) == len(encoder.pieces) + len(encoder.heads) + 1
    small = bpe.MEMORY_PIECES
    try:
        bpe.MEMORY_PIECES = 50
        for _ in range(3):
            texts = [" ".join(f"w{draw.randrange(400)}" for _ in range(200)) for _ in range(4)]
            assert [r.tolist() for r in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
            assert len(encoder.pieces) <= 50
    finally:
        bpe.MEMORY_PIECES = small


def test_bpe_with_a_pattern_that_splits_at_case():
    import regex

    path, _ = tokenizer()
    pattern = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\s+|[^\s\p{L}]+"
    vocabulary = bpe.vocabulary(open(path, "rb").read(), pattern)
    text = "HelloWorld camelCase and  XYZ."
    want = [i for w in regex.findall(pattern, text) for i in vocabulary.one(w.encode())]
    assert bpe.Encoder(vocabulary).encode([text])[0].tolist() == want


def test_secrets_in_linear_time():
    model = secrets.Markov(np.ones((2, 128, 128)))
    began = time.time()
    spans = secrets.scan_text("token=abcdef0123 qwertyuiopasdfghjklzxcv " * 60_000, model, -1)
    assert len(spans) == 120_000 and time.time() - began < 20


def test_secrets_on_shapes_that_were_not_trained_on(spark):
    import base64
    import string

    model, draw = secrets.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), random.Random(77)
    letters = string.ascii_letters + string.digits
    of = lambda a, k: "".join(draw.choices(a, k=k))
    shapes = [lambda: "ghp_" + of(letters, 36), lambda: "sk-" + of(letters, 48), lambda: of(letters + "+/", 40), lambda: f"xoxb-{of(string.digits, 12)}-{of(letters, 24)}", lambda: base64.b64encode(draw.randbytes(30)).decode(), lambda: draw.randbytes(20).hex().upper(), lambda: "AIza" + of(letters + "-_", 35), lambda: of(letters, 20)]
    for shape in shapes:
        assert np.mean([bool(secrets.scan_text(f"see {shape()} now", model)) for _ in range(200)]) >= 0.98
    ordinary = """__________________________ 20240115_103000_20240116_093000 2024-01-15T10-22-33-000-backup-v2 XMLHttpRequestUpgradeExecutorFactory2 /usr/local/lib/python3/site-packages/numpy
        https//www/example/org/index/html/2024/01/15 SOCK_STREAM_NONBLOCK_CLOEXEC us-east-1-prod-web-server-0042 test_parse_iso8601_datetime_with_timezone ================================ 1234567890123456789012
        00000000000000000000000000 IMG_20230704_142311_HDR_PORTRAIT JUnit4ClassRunnerWithParameters ISO-8859-1-to-UTF-8-converter Donaudampfschifffahrtsgesellschaft python3-dist-packages-setuptools org/apache/hadoop/hdfs/server/namenode""".split()
    assert not [x for x in ordinary if any(s[2] == "random" for s in secrets.scan_text(x, model))]


def test_license_notices_are_told_apart():
    known = licenses.Templates(licenses.NOTICES)
    for name, text in licenses.NOTICES.items():
        assert [x[0] for x in known.find(f"Some words stand before it. {text} And more come after.", {})] == [name]
    both = known.find(f"{licenses.NOTICES['mit']} and {licenses.NOTICES['bsd-3-clause']} and again {licenses.NOTICES['mit']}", {})
    assert [x[0] for x in both] == ["mit", "bsd-3-clause", "mit"]


def test_language_sample_is_bounded_by_rows(spark):
    texts = [(1, "the house and the garden " * 40, "en")] * 500 + [(i, f"das haus {i} und der garten", "de") for i in range(2, 400)] + [(901, "le jardin " * 5_000, "fr")]
    model = langid.learn(spark.createDataFrame(texts, "doc_id long, text string, lang string"), rows=5)
    assert model["en"] == langid.bare("the house and the garden " * 40) and model["de"].count(b"haus") == 5
    assert model["fr"] == langid.bare("le jardin " * 5_000)  # whole, as there is no shorter one


def test_pages_lose_no_text():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts("<p>start</p><canvas>fallback<p>x</p><p>rest of the article</p>") == ["start", "fallback", "x", "rest of the article"]
    for tag in ("svg", "object", "template", "noscript", "math", "select"):
        assert texts(f"<p>a</p><{tag}>b<p>rest</p>")[-1] == "rest" and texts(f"<p>a</p><{tag}><i>no</i></{tag}><p>rest</p>") == ["a", "rest"]
    assert texts("<p>a</p><script>if (x < 1) {<p>no") == ["a"]
    assert texts("&#" + "9" * 5_000 + "; &#x" + "f" * 9 + "; &#0000000065; &amp;#66;") == ["� � A &#66;"]
    assert texts("<p title='>'>a</p> <b x=\"un closed>c") == ["a", "c"]


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<div class='a b'>x" * 20_000, "<b><div>" + "<i>" * 20_000 + "x</b>" * 20_000, "<svg>x" * 20_000, "<a b='" * 20_000 + ">", "x < y " * 40_000 + ">"):
        html_extract.features(html_extract.blocks(page))
    assert time.time() - began < 20


def test_very_long_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "<article>" + "<p>some words of a long text here.</p>" * 20_000 + "</article>"), (2, "<article><p>short one, of some words.</p></article>"), (2, "<article><p>short one, of some words.</p></article>")], "page_id long, html string")
    out = html_extract.extract(pages, html_extract.train(pages)).collect()
    assert len(out) == 3 and len(out[0].text) == 20_000 * 33 - 2 + 0 * len(out) or out[0].text.count("some words") == 20_000
    assert out[1].text == out[2].text


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_sessions_own_batch_settings_are_respected(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "7")
    common.small_batches(spark)
    assert spark.conf.get(name) == "7"
    spark.conf.set(name, before) if before else spark.conf.unset(name)
