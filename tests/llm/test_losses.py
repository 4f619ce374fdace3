"""Cases in which rows, spans or places were once lost."""

import random
import re

import pytest

from tankline.llm import decontaminate, exact_dedup, html_extract, licenses, secrets

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("ids", ["same", "none", "own"])
def test_secrets_are_learned_whatever_the_ids(spark, ids):
    draw = random.Random(1)
    words = "the quick brown engine measures fuel and roads between some countries".split()
    key = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    rows = [({"same": 4, "none": None, "own": i}[ids], " ".join(draw.choices(words, k=12)) + f" {i}") for i in range(2000)]
    df = spark.createDataFrame([*rows, (7, f"see {key} here"), (8, f"see {key} here")], DOCS)
    found = {(r.text, s.kind, r.text[s.start : s.end]) for r in secrets.scan(df, secrets.train(df, rows=500)).collect() for s in r.secrets}
    assert found == {(f"see {key} here", "random", key)}


@pytest.mark.parametrize("name", sorted(licenses.NOTICES))
def test_adjacent_notices_are_each_told_at_their_own_words(name):
    words = re.findall(r"[^\W_]+", licenses.NOTICES[name].lower())
    templates = licenses.Templates(licenses.NOTICES)
    for n in (1, 2, 10, 60):
        for between in ([], ["also"], "some other words that part the two of them".split()):
            text = (words + between) * n
            step = len(words) + len(between)
            assert [f[:3] for f in templates.find(" ".join(text), {})] == [(name, i * step, i * step + len(words)) for i in range(n)]


def test_different_notices_end_to_end_are_told_apart():
    split = {k: re.findall(r"[^\W_]+", v.lower()) for k, v in licenses.NOTICES.items()}
    draw, templates = random.Random(2), licenses.Templates(licenses.NOTICES)
    for _ in range(30):
        names, at, text, expected = draw.choices(sorted(split), k=6), 0, [], []
        for name in names:
            expected.append((name, at, at + len(split[name])))
            text += split[name]
            at += len(split[name])
        assert [f[:3] for f in templates.find(" ".join(text), {})] == expected


def test_a_changed_copy_next_to_a_whole_one():
    words = re.findall(r"[^\W_]+", licenses.NOTICES["gpl-3.0"].lower())
    changed = [*words[:20], "xx", *words[21:]]
    found = licenses.Templates(licenses.NOTICES).find(" ".join(changed + words), {})
    assert [f[:3] for f in found] == [("gpl-3.0", 0, len(words)), ("gpl-3.0", len(words), 2 * len(words))] and found[0][3] < 1 == found[1][3]


def test_the_page_goes_on_after_odd_end_tags():
    text = lambda page: [b.text for b in html_extract.blocks(page)]
    for end in ("</script foo>", "</script >", "</SCRIPT\n x='1'>", "</script/>"):
        assert text(f"<article><p>a</p></article><script>x{end}<p>after</p>") == ["a", "after"] and text(f"<script>x{end}<p>a</p>") == ["a"]
    assert text("<script>x</scripty><p>a</p></script><p>b</p>") == ["b"]


def test_short_items_are_found(spark):
    items = spark.createDataFrame([(1, "zebra quantum marmalade telescope"), (2, "Alone!"), (3, "two words"), (4, ""), (5, None), (6, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a zebra, quantum marmalade telescope it is"), (2, "zebra quantum marmalade"), (3, "he is alone"), (4, "two\nwords and one two three four five six"), (5, None), (6, "words two")], DOCS)
    pairs = lambda **kw: sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, **kw).collect())
    assert pairs() == [(1, 1), (3, 2), (4, 3), (4, 6)]
    assert pairs(least_words=4) == [(1, 1), (4, 6)] and pairs(least_words=5) == [(4, 6)]
    assert pairs(least_words=9) == []


def test_exact_dedup_keeps_one_row_where_ids_repeat(spark):
    rows = [(1, "a b"), (1, "a   b"), (2, "ab"), (3, "q"), (3, "q"), (3, "q"), (None, "z"), (None, "z"), (4, "z "), (5, "own"), (5, "other")]
    for bound in (1_000_000, 0):
        out = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), broadcast_rows=bound).collect()
        kept = sorted((r.keep_id, r.doc_id, r.group_size) for r in out if r.kept)
        assert len(out) == len(rows) and kept == [(1, 1, 3), (3, 3, 3), (4, 4, 3), (5, 5, 1), (5, 5, 1)]
