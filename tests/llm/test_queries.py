"""The ten registered queries, held against their contracts in plain Python over the same tables."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from tankline.llm import decontaminate, langid, licenses, queries, secrets

from .brute import brute_base, brute_classes, brute_contained, brute_lines, brute_print, brute_tokenizer

SF = "/root/testdata/sf0.001"
sha = lambda data: hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, key):
    rows = queries.QUERIES[name](spark, SF).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark):
    out = run(spark, "op1_url_filter", "page_id")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = sorted((h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        best = max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")
        assert tuple(out[r.page_id])[:5] == (r.page_id, host, path, *best)


def test_op2(spark, docs):
    out = run(spark, "op2_line_dedup", "doc_id")
    ids = sorted(docs)
    for i, (text, n, gone) in zip(ids, brute_lines([docs[i].text for i in ids], 10)):
        assert tuple(out[i])[:4] == (i, n, gone, sha(text.encode()))


def test_op3(spark, docs):
    rows = queries.QUERIES["op3_decontamination"](spark, SF).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in rows} == brute_contained([(i, d.text) for i, d in docs.items()], items)


def test_op4(spark, docs):
    out = run(spark, "op4_simhash_near_dedup", "doc_id")
    ids = sorted(docs)
    prints = [brute_print(docs[i].text) for i in ids]
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute_classes(prints))}


def test_op5(spark, docs):
    out, library = run(spark, "op5_byte_bpe", "doc_id"), brute_tokenizer()
    assert set(out) == set(docs)
    for i, r in out.items():
        ids = library.encode_ordinary(docs[i].text or "")
        assert tuple(r)[:4] == (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((docs[i].text or "").encode()))


def test_op6(spark, docs):
    out = run(spark, "op6_secret_scan", "doc_id")
    model = secrets.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    assert set(out) == set(docs)
    for i, r in out.items():
        text = docs[i].text or ""
        base = brute_base(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, _, k in base) for kind in ("assign", "access", "hex"))
        more = [(m.start(), m.end(), "random") for m in re.finditer(secrets.CANDIDATE, text) if not any(a < m.end() and m.start() < b for a, b, _ in base) and model.ratio(m[0]) >= secrets.MIN_RATIO]
        assert r.base_sha256 == sha(told(base).encode()) and r.spans == told(sorted(base + more, key=lambda s: (s[0], secrets.KINDS.index(s[2]))))


def test_op7(spark, docs):
    found = {}
    for r in queries.QUERIES["op7_license_scan"](spark, SF).collect():
        found.setdefault(r.doc_id, set()).add((r.license, r.containment))
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    named = {k: (split(v), min(5, len(split(v)))) for k, v in licenses.NOTICES.items()}
    assert found
    for i, d in docs.items():
        words = split(d.text or "")
        there = {k: len(runs(w, n) & runs(words, n)) / len(runs(w, n)) for k, (w, n) in named.items()}
        assert {k for k, _ in found.get(i, ())} <= {k for k, c in there.items() if c >= 0.8}
        assert {k for k, c in there.items() if c == 1} <= {k for k, _ in found.get(i, ())}


def test_op8(spark, docs):
    out, groups = run(spark, "op8_exact_dedup", "doc_id"), {}
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, d in docs.items():
        groups.setdefault(bare(d.text), []).append((-len(d.text or ""), i))
    for text, rows in groups.items():
        for _, i in rows:
            assert tuple(out[i])[:5] == (i, min(rows)[1], len(rows), i == min(rows)[1], sha(text.encode()))


def test_op9(spark, docs):
    out = run(spark, "op9_language_id", "doc_id")
    model = tuple(sorted(langid.learn(spark.read.parquet(f"{SF}/documents.parquet")).items()))
    compressors = langid._compressors(model, langid.LEVEL)
    assert set(out) == set(docs) and {k for k, _ in model} == {d.lang for d in docs.values() if d.lang}
    for i, r in out.items():
        name, score, _ = langid.judge(docs[i].text, compressors)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and (r.lang_pred, r.score) == (name, score) and 0 <= r.score <= 1
    told = [out[i].lang_pred == d.lang for i, d in docs.items() if d.lang and out[i].held_out]
    assert np.mean(told) > 0.95


def test_op10(spark):
    out = run(spark, "op10_html_extraction", "page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert set(out) == {p.page_id for p in pages}
    for p in pages:
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split("</?(?:p|h1)>", article)]
        text = "\n\n".join(x for x in parts if x)
        assert tuple(out[p.page_id])[:4] == (p.page_id, p.url, text, len(text))


def test_native_plans_run_no_python(spark):
    for name in ("op3_decontamination", "op8_exact_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert decontaminate.WORDS == 5 and decontaminate.CONTAINMENT == 0.8
