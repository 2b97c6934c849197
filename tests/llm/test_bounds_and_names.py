"""Bounds of memory, odd names and nulls of the operators for language, token counts and licences."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sluicework.llm.queries")

from sluicework.llm import langid, licenses, tokens  # noqa: E402

HAN = [chr(0x4E00 + i) for i in range(3000)]


def held(a):
    return sum(t.flat.nbytes if t.flat is not None else t.keys.nbytes + t.to.nbytes for t in a.tables) + sum(t.column.nbytes for t in a.tables)


def test_automata_of_many_symbols_are_bounded():
    r = random.Random(1)
    text = lambda n: "".join(r.choice(HAN) for _ in range(n))
    sample = [("ja", text(40_000)), ("zh", text(40_000)), ("en", "the of and ing " * 2500)]
    a = langid.Automata(sample)
    assert held(a) < 20 << 20 and [t.flat is None for t in a.tables] == [True, True, False]
    assert a.predict([sample[0][1][500:900], sample[1][1][:300], "the of", "", None])[0] == ["ja", "zh", "en", "und", "und"]


def test_both_forms_of_automata_parse_alike(monkeypatch):
    r = random.Random(2)
    words = ["the", "of", "é", "北京", "shard", "ing"]
    sample = [(lang, " ".join(r.choice(words[k:]) for _ in range(300))) for k, lang in enumerate(("a", "b", "c"))]
    texts = [" ".join(r.choice([*words, "zzz", "ж"]) for _ in range(r.randint(0, 900))) for _ in range(40)] + ["", None, "ж" * 2000]
    got = []
    for most in (0, 1 << 40):
        monkeypatch.setattr(langid, "DENSE_BYTES", most)
        got.append(langid.Automata(sample).predict(texts))
    assert got[0] == got[1]


def test_language_with_long_texts_alone_is_learned(spark):
    long = " ".join(f"ogham{i % 97}" for i in range(9000))
    rows = [(1, long, "xx"), (2, "plain words of a short text", "en"), (3, "of words", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(d)
    assert [lang for lang, _ in sample] == ["en", "xx"] and len(sample[1][1]) == langid.SAMPLE_CHARS and sample[1][1] in long
    assert sample == langid.training_sample(d.repartition(3))


def test_long_words_are_counted_without_a_trie(spark):
    r = random.Random(3)
    parts = tokens.load_scores(tokens.default_vocabulary())
    for _ in range(100):
        w = tokens.MARK + "".join(r.choice(["the", "ing", "é", "北", "zq", "a", tokens.MARK]) for _ in range(r.randint(1, 50)))
        assert tokens.windowed(w, *parts) == tokens.Trie(*parts[:3]).insert(w)
    word = "".join(r.choice("abcdeth") for _ in range(3 * tokens.LONG))
    d = spark.createDataFrame([(1, f"x {word} y {word}"), (2, word), (3, "x y")], "n_words long, text string")
    got = {x["id"]: (x["n_words"], x["n_tokens"]) for x in tokens.token_counts(d, id_col="n_words").collect()}
    one = tokens.Trie(*parts[:3]).insert(tokens.MARK + word)
    assert got[2] == (1, one) and got[1] == (4, 2 * one + got[3][1])


def test_five_million_characters_in_one_word():
    import tracemalloc

    parts = tokens.load_scores(tokens.default_vocabulary())
    tracemalloc.start()
    few = tokens.windowed("A9bz" * 50_000, *parts)
    assert tracemalloc.get_traced_memory()[1] < 1 << 19  # the word itself was there before
    tracemalloc.stop()
    assert tokens.windowed("A9bz" * 1_250_000, *parts) == 25 * few


NOTICE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."


def test_licences_with_odd_columns_and_null_paths(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    rows = [
        ("/a/LICENSE", mit, 1, "t", "d", 5, {"k": 1}), ("/a/b/x", "nothing here", 2, "t", "d", 6, None), ("/a/b/x", "nothing here", 3, "t", "d", 6, None), (None, mit, 4, None, None, None, None),
        (None, None, 5, None, None, None, None), ("/c/y", "// SPDX-License-Identifier: (Unknown-1.0 OR MIT AND Apache-2.0)\n// SPDX-License-Identifier: GPL-3.0-or-later", 6, "", "", 0, None), ("/c/z", "", 7, "", "", 0, None),
    ]
    d = spark.createDataFrame(rows, "path string, text string, n long, _text string, dir string, th int, extra map<string,int>").repartition(2)
    out = licenses.scan(d)
    assert out.columns == ["n", "_text", "dir", "th", "extra", "path", "own_licence", "score", "own_licences", "inherited_licence", "inherited_from", "licence"]
    got = {r["n"]: r for r in out.collect()}
    assert len(got) == 7 and {k: r["licence"] for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: "Apache-2.0", 7: None}
    assert got[2]["inherited_from"] == "/a" and got[2]["own_licence"] is None and got[4]["inherited_licence"] is None and got[4]["own_licence"] == "MIT"
    assert got[6]["own_licences"] == ["Apache-2.0", "GPL-3.0", "MIT"] and got[6]["score"] == 1.0 and (got[1]["dir"], got[1]["th"], got[1]["extra"]) == ("d", 5, {"k": 1})
    assert licenses.scan(d.where("false")).count() == 0


def test_notices_equal_a_cosine_by_hand(spark):
    """Sentences of templates, mixed with other words, against term weights computed here from the definition."""
    r = random.Random(4)
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    bags = [(n, Counter(split(t))) for n, t in licenses.TEMPLATES]
    df = Counter(w for _, b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1

    def cosine(a, b):
        dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
        return dot / math.sqrt(sum((n * idf(w)) ** 2 for w, n in a.items()) * sum((n * idf(w)) ** 2 for w, n in b.items()))

    rows = []
    for i in range(60):
        w = split(r.choice(licenses.TEMPLATES)[1])
        w = [x for x in w if r.random() < 0.9] + [f"other{r.randint(0, 9)}" for _ in range(r.randint(0, 8))]
        r.shuffle(w)
        rows.append((f"/f{i}", " ".join(w)))
    got = {x["path"]: x for x in licenses.template_matches(spark.createDataFrame(rows, "path string, text string").withColumn("th", F.lit(0))).collect()}
    near = 0
    for path, text in rows:
        best = max(cosine(Counter(split(text)), b) for _, b in bags)
        if best >= licenses.THRESHOLD + 1e-6:
            near += 1
            assert got[path]["score"] >= best - 1e-6
            if got[path]["licence"] != "Proprietary" and abs(got[path]["score"] - best) < 1e-6:
                assert cosine(Counter(split(text)), dict(bags)[got[path]["licence"]]) == pytest.approx(best, abs=1e-6)
    assert near > 10
