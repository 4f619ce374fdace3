"""Source divergence, best-fit packing and collocations, against plain Python."""

import bisect
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tankline.llm import collocations, divergence, packing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_audit(docs, least, top):
    groups, seen, out = {}, {}, []
    for text, lang, source in docs:
        terms = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        seen.setdefault(lang or "", Counter()).update(set(terms))
    for lang in seen:
        kept = sorted(t for t, d in seen[lang].items() if d >= least)
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        priced = lambda c: {t: 1 + (10**9 * (n + 2)) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        f = lambda p, q: int(Fraction((p - q) ** 2, p + q).__floor__())
        prices, whole = {s: priced(c) for s, c in own.items()}, priced({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = [(o, sum(f(prices[s][t], prices[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(prices[s][t], whole[t])) for t in kept if own[s][t] and prices[s][t] > whole[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


def test_divergence_is_that_of_plain_python(spark):
    draw = random.Random(1)
    words = ["ab", "Ab", "éé", "x", "yy", "z1z", "ÄÖ", "日本"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([0, 3, 40]))), draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", None])) for i in range(300)]
    docs += [(1, None, "en", "empty"), (1, "", "fr", "one"), (2, "only here", "fr", "two"), (3, "7 8 9", "it", "a"), (None, "ab ab", "en", "a"), (None, "ab ab", "en", "a")]
    df = spark.createDataFrame(docs, DOCS)
    for least, top in ((10, 10), (1, 3), (2, 100)):
        assert audited(df, min_docs=least, top=top) == brute_audit([d[1:] for d in docs], least, top)
    assert audited(df.limit(0)) == []


def test_divergence_with_many_blocks_and_portions(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdef", k=4)) for _ in range(900)]
    docs = [(i, " ".join(draw.choices(words[: 900 if i % 3 else 40], k=60)), "en", f"s{i % 3}") for i in range(120)]
    assert audited(spark.createDataFrame(docs, DOCS), min_docs=2) == brute_audit([d[1:] for d in docs], 2, 10)
    batch = next(spark.createDataFrame(docs, DOCS).selectExpr("lang", "source", "cast(text as binary) text").mapInArrow(lambda b: b, "lang string, source string, text binary").toArrow().to_batches().__iter__())
    monkeypatch.setattr(divergence, "COUNTED", 10)
    portions, total = [b.to_pydict() for b in divergence._counted([batch.slice(i, 5) for i in range(0, len(batch), 5)])], Counter()
    for p in portions:
        for t, n in zip(p["term"], p["n"]):
            total[t] += n
    assert len(portions) > 5 and {t: n for t, n in total.items() if t} == dict(Counter(w for d in docs[: len(batch)] for w in d[1].split()))


def test_gallop_and_prices():
    draw = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 10_000), (700, 800), (3000, 40_000)):
        a, b = (np.unique(draw.integers(0, 50_000, k)) for k in (n, m))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()
    for total, terms, counts in ((0, 1, [0]), (10**6, 10, [0, 7, 10**6]), (10**17, 10**6, [0, 10**16 + 3, 10**17])):
        assert divergence.prices(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]


def encoded(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    return public_tokenizers.path("byte_bpe_50k.json"), [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_are_the_library_s():
    draw = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\n ", "\t", " ", "a", "Word", "word,", "don't", "'s", "'", "1,000", "é", "日本", "՘", "\U00031350", "²", "½x", "🙂", "<|endoftext|>", "\x00", "_", "it's.", "x!?", "—", " ", "\x85", "\x1c"]
    texts = ["", " ", "\n", " a", "a ", "a  b", "a \n b", "a\n \nb"] + ["".join(draw.choices(bits, k=draw.randrange(1, 12))) for _ in range(6000)]
    path, ids = encoded(texts)
    tokens = packing.Tokens(path)
    assert tokens.ranks is not None
    for text, own in zip(texts, ids):
        for _ in range(2):  # once remembered, the same
            assert np.frombuffer(tokens.encode(text), "<u4").tolist() == own, repr(text)


def test_characters_that_are_told_apart_by_libraries_are_encoded_as_a_whole():
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    assert packing.SPLIT == public_tokenizers.PATTERN
    split, pattern = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer, regex.compile(packing.SPLIT)
    for c in map(chr, range(0x2100)):
        if not packing._OTHER.search(c):
            assert [o for _, o in split.pre_tokenize_str(f"a{c}1")] == [m.span() for m in pattern.finditer(f"a{c}1")]


def best_fit(lengths, capacity):
    gaps, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        bins, gap = (bins, gaps.pop(i)) if i < len(gaps) else (bins + 1, capacity)
        bisect.insort(gaps, gap - n)
    return bins


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["uniform", "tiny", "equal", "thirds", "mixed", "one"])
def test_packing_is_as_full_as_sequential_best_fit(spark, kind):
    draw = random.Random(4)
    n = 3000
    lengths = {
        "uniform": [draw.randint(1, 100) for _ in range(n)], "tiny": [draw.randint(1, 4) for _ in range(n)], "equal": [7] * n, "thirds": [34] * n,
        "mixed": [draw.choice([100, 99, 60, 51, 50, 49, 33, 26, 2]) for _ in range(n)], "one": [5],
    }[kind]
    df = spark.createDataFrame([(i // 2, x) for i, x in enumerate(lengths)], "item long, length long")  # names and ids that clash
    for per_task in (200_000, 300):
        rows = packing.pack(df, 100, rows_per_task=per_task).collect()
        assert sorted((r.item, r.length) for r in rows) == sorted((i // 2, x) for i, x in enumerate(lengths))
        assert check_packed(rows, 100) <= 1.01 * best_fit(lengths, 100) + 1
    assert kind != "thirds" or check_packed(rows, 100) == n // 2


def test_places_from_counts_are_those_of_sequential_best_fit():
    draw = random.Random(5)
    for _ in range(300):
        capacity, n = draw.randint(1, 60), draw.randint(0, 200)
        sizes = draw.sample(range(1, capacity + 1), draw.randint(1, capacity))
        lengths = sorted((draw.choice(sizes) for _ in range(n)), reverse=True)
        plan, places = packing.best_fit(Counter(lengths), capacity), []
        for (first, each, place, size), end in zip(plan, [*(x[0] for x in plan[1:]), n]):
            assert lengths[first:end] == [size] * (end - first) != []
            places += [place + i // each * capacity + i % each * size for i in range(end - first)]
        at = {}
        for place, size in sorted(zip(places, lengths, strict=True)):
            assert place % capacity == at.get(place // capacity, 0)
            at[place // capacity] = place % capacity + size
        assert all(used <= capacity for used in at.values()) and len(at) == best_fit(lengths, capacity)


def test_packing_takes_no_more_jobs_with_more_tasks(spark):
    draw = random.Random(6)
    lengths = [draw.choice([1, 2, 3, 5, 8, 13, 21, 34, 40, 45, 55, 70]) for _ in range(2000)]
    df, jobs = spark.createDataFrame([(x,) for x in lengths], "length long").repartition(8), []
    for per_task in (200_000, 20):
        spark.sparkContext.setJobGroup(f"pack {per_task}", "")
        rows = packing.pack(df, 100, rows_per_task=per_task).collect()
        spark.sparkContext.setJobGroup("", "")
        assert check_packed(rows, 100) == best_fit(lengths, 100)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pack {per_task}")))
    assert 0 < jobs[1] <= jobs[0] + 2  # rounds, of several jobs each, grew with the tasks


def test_packing_of_documents(spark):
    texts = ["a b c", None, "", "long words here " * 400, "x", "x", "y" * 3000, "Zweiter Text, für alle.\n" * 90]
    docs = [(None if i == 4 else i // 2, t, {"k": i}) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, piece map<string,int>").withColumnRenamed("piece", "tags")
    path, ids = encoded([t or "" for t in texts])
    pieces = packing.tokenized(df, path, 256)
    packed = packing.pack(pieces, 256)
    rows = packed.collect()
    check_packed(rows, 256)
    found = {}
    for r in rows:
        assert r.length == len(r.tokens) // 4 and zlib.crc32(r.tokens) >= 0
        found.setdefault(r.tags["k"], []).append((r.piece, r.start, np.frombuffer(r.tokens, "<u4").tolist()))
    for k, own in enumerate(ids):
        own = [*own, 2]
        first = (len(own) - 1) % 256 + 1 if len(own) > 256 else len(own)
        starts = [0, *range(first, len(own), 256)]
        assert sorted(found[k]) == sorted([(i, a, own[a : [*starts, len(own)][i + 1]]) for i, a in enumerate(starts)] * 2)
    whole = {r.sequence_id: r.tokens for r in packing.sequences(packed).collect()}
    assert all(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.tokens for r in rows)
    assert packing.pack(pieces.limit(0), 256).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"), 10)


def test_op12_as_its_contract_has_it(spark):
    rows = queries.QUERIES["op12_best_fit_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    _, ids = encoded([d.text or "" for d in docs])
    n = check_packed(rows, 1024)
    assert n <= 1.01 * best_fit([r.length for r in rows], 1024) + 1
    told = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    for d, own in zip(docs, ids):
        own = np.array([*own, 2], "<u4")
        first = (len(own) - 1) % 1024 + 1 if len(own) > 1024 else len(own)
        for i, a in enumerate([0, *range(first, len(own), 1024)]):
            part = own[a : first if i == 0 else a + 1024]
            assert told.pop((d.doc_id, i)) == (a, len(part), zlib.crc32(part.tobytes()))
    assert not told


def brute_phrases(docs, least):
    counts, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= least}
        rows = []
        for p, a in often.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, left, right, n[lang], score))
        out += [(lang, i, *r[3:]) for i, r in enumerate(sorted(rows)[:2000], 1)]
    return sorted(out)


def mined(df, least):
    return sorted(tuple(r) for r in collocations.collocations(df, min_count=least).collect())


def test_collocations_are_those_of_plain_python(spark):
    draw = random.Random(5)
    words = ["a", "b", "A", "the", "of", "x\x00y", "é", "|", "-", "'s", "日本"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " ?"]
    docs = [(i, "".join(w + draw.choices(ends, [20, 2, 2, 1, 1, 1, 1, 1, 1, 1])[0] for w in draw.choices(words, k=draw.choice([0, 1, 30, 80]))), draw.choice(["en", "de", None, ""]), None) for i in range(150)]
    docs += [(1, "x x x x x x x " * 30, "it", "s"), (2, None, "fr", "s"), (3, "same same", "en", "s"), (3, "same same", "en", "s"), (None, "a b c d e " * 40, "es", "s")]
    df = spark.createDataFrame(docs, DOCS)
    expected = brute_phrases([d[1:3] for d in docs], 30)
    assert expected and mined(df, 30) == expected and mined(df, 3) == brute_phrases([d[1:3] for d in docs], 3)
    assert mined(df.limit(0), 30) == [] and mined(df.filter("text is null"), 1) == []


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    from tankline.llm import common

    text = b"ab cd  ef\n" * 50
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(common, "WORD_BYTES", size)
        assert [w for part in common.byte_words(text) for w in part] == text.split()
        broken = text.replace(b"\n", b" \n ")
        assert [w for part in common.byte_words(broken, keep_breaks=True) for w in part] == [w for w in broken.split(b" ") if w]
