"""The pipeline: each stage's decisions take effect, and the registered query gives the last stage's rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tankline.llm import langid, queries
from tankline.llm.decontaminate import contaminated
from tankline.llm.simhash import similar_dedup

from .brute import brute_contained, brute_lines, brute_tokenizer

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns
        if name == "language_id":
            assert not langid.identify(out, langid.learn(docs)).filter("rejected").count()
        elif name == "line_dedup":
            assert out.count() == docs.count() and not out.filter("n_chars <> length(text)").count()
        elif name == "near_dedup":
            assert out.count() == similar_dedup(docs).select("component_id").distinct().count() == out.select("doc_id").distinct().count()
        else:
            assert out.count() == docs.count() - contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().count()
        docs = out
    assert 0 < docs.count() < n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(last.collect()) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (None, "The house and the garden.", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_are_judged_by_their_own_texts(spark):
    word = "alder birch cedar daisy elm fern gorse hazel iris juniper kale larch maple nettle oak pine quince rose sage thyme".split()
    one, two, three = (" ".join(word[i % 20] + str(i * k) for i in range(60)) for k in (3, 7, 11))
    docs = spark.createDataFrame([(3, one), (5, one), (5, two), (None, three), (None, three), (None, one), (7, None), (None, "")], "doc_id long, text string")
    out = sorted((tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()), key=str)
    assert out == sorted([(3, one), (5, two), (None, three), (7, None)], key=str)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, leak), (1, two), (None, leak), (None, one), (None, None)], "doc_id long, text string")
    out = sorted((tuple(r) for r in corpus_pipeline.decontamination(spark, docs, SF).collect()), key=str)
    assert out == sorted([(1, two), (None, one), (None, None)], key=str)


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def cosine(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (words_of(a), words_of(b)))
    return sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def test_each_stage_against_brute_force(spark):
    """Every stage on the one before, held against plain Python over the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    model = tuple(sorted(langid.learn(docs).items()))
    judge = lambda t: langid.judge(t, langid._compressors(model, langid.LEVEL))
    known = {i for i, r in before.items() if (j := judge(r.text))[0] != "und" and j[2] >= langid.MIN_MARGIN}
    docs = stages["language_id"](spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == known

    rows = sorted(docs.collect())
    docs = stages["line_dedup"](spark, docs, SF).cache()
    texts = {r.doc_id: t for r, (t, _, _) in zip(rows, brute_lines([r.text for r in rows], queries.LINE_MIN_DOCS))}
    assert {r.doc_id: r.text for r in docs.collect()} == texts

    kept = stages["near_dedup"](spark, docs, SF).cache()
    stay = {r.doc_id for r in kept.collect()}
    groups = {r.doc_id: r.component_id for r in similar_dedup(docs).collect()}
    assert stay == set(groups.values()) and all(groups[i] == i for i in stay)
    ids = sorted(texts)
    near, missed = 0, 0
    for k, i in enumerate(ids):
        for j in ids[:k]:
            c = cosine(texts[i], texts[j])
            if c >= 0.88:
                near, missed = near + 1, missed + (groups[i] != groups[j])
    assert near and missed <= 0.05 * near
    for i in set(texts) - stay:  # what goes is close to another document of its group
        assert max(cosine(texts[i], texts[j]) for j in texts if j != i and groups[j] == groups[i]) > 0.7

    clean = stages["decontamination"](spark, kept, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in brute_contained([(i, texts[i]) for i in stay], items)}
    assert leaks and {r.doc_id for r in clean.collect()} == stay - leaks

    coded = {r.doc_id: r for r in stages["byte_bpe"](spark, clean, SF).collect()}
    library = brute_tokenizer()
    for i in stay - leaks:
        ids_ = library.encode_ordinary(texts[i])
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids_), sha(np.array(ids_, "<u4").tobytes()), sha(texts[i].encode()))


def test_users_columns_come_back(spark):
    names = "score margin rejected lang_pred n_lines n_dropped row own text_ id digest lines".split()
    one = "The boats lay on the sand and the river was low, and nobody came to the landing that day."
    docs = spark.createDataFrame([(7, one, "en", *names), (8, "Die Boote lagen auf dem Sand, und der Fluss war niedrig an diesem Tag.", "de", *names)], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(tuple(r[3:]) == tuple(names) for r in out.collect())


def test_near_copies_go_and_clean_documents_stay(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghiklmnoprstuvw", k=draw.randrange(2, 9)))
    texts, family = [], []
    for g in range(40):
        base = [word() for _ in range(draw.randrange(60, 400))]
        for copy in range(draw.choice((1, 1, 3, 6))):
            w = [word() if copy and draw.random() < 0.025 else x for x in base]
            texts.append(" ".join(w))
            family.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in similar_dedup(docs).collect()}
    assert all(family[i] == family[g] for i, g in groups.items())
    first = {g: family.index(g) for g in family}
    near = [i for i, g in enumerate(family) if i != first[g] and cosine(texts[i], texts[first[g]]) >= 0.84]
    assert len(near) > 20 and sum(groups[i] == first[family[i]] for i in near) >= 0.95 * len(near)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
