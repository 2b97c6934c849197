"""What the n-gram join moves grows with its input: copies, frequent shingles and passages that many sets share add no large groups."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sluicework.llm.queries")

from sluicework.llm import common, ngram_join  # noqa: E402


def joined(pairs):
    """Sorted classes of the ends of pairs."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    classes = {}
    for x in list(root):
        classes.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, classes.values()))


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2)])
def test_sets_of_a_frequent_shingle_are_linked_within_the_bound_only(num, den):
    r = np.random.default_rng(den + num)
    alone = 0
    for many in (ngram_join.FEW + 1, 12, 40, 300):
        for most in (20, 200, 3000):
            n = r.integers(1, most, many)
            place = (r.random(many) * ngram_join.prefix(n, num, den)).astype(np.int64)
            a = np.sort(r.choice(10**6, many, replace=False))
            left = n - place
            ok = np.minimum.outer(left, left) * (num + den) >= np.add.outer(n, n) * num
            want = joined((a[x], a[y]) for x in range(many) for y in range(x) if ok[x, y])
            key = np.full(many, -5)
            p, q = ngram_join._meet(key, a, n, place, num, den)
            assert joined(zip(p.tolist(), q.tolist(), strict=True)) == want
            rows, x, y = ngram_join._merged(key, a, n, place, num, den)
            p, q = ngram_join._meet(*rows, num, den)
            assert joined(zip([*p.tolist(), *x.tolist()], [*q.tolist(), *y.tolist()], strict=True)) == want
            alone += many - sum(map(len, want))
    assert alone > 20


def test_all_frequent_shingles_are_marked(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    lines = [" ".join(word() for _ in range(7)) for _ in range(60)]
    texts = [f"{word()} {line} {word()}" for line in lines for _ in range(ngram_join.FEW + 3)] + [" ".join(word() for _ in range(9)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(5)
    marks = ngram_join.frequent_shingles(docs, 3, 1, 100)
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    times = Counter(s for x in sets for s in x)
    found = {}
    for t, s in zip(texts, sets, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        h, at = ngram_join.shingle_sets(data, np.array([0, len(data)]), 3)
        assert len(h) == len(s)
        late = ngram_join.marked(h, marks)
        assert len(late) >= sum(times[x] > ngram_join.FEW for x in s)
        found |= {x: x in set(late.tolist()) for x in h.tolist()}
    rare = sum(c <= ngram_join.FEW for c in times.values())
    assert sum(found.values()) - (len(times) - rare) <= 0.1 * rare
    assert not ngram_join.frequent_shingles(docs.limit(3), 3, 1, 100).any()


def test_one_of_equal_texts_goes_on(spark, monkeypatch):
    """Twelve copies of a corpus have the candidates of one; ids of several texts keep all that stand for a text."""
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 60))) for _ in range(40)]
    base += [f"{t} x" for t in base[:10]]
    rows = [(100 * k + i, t) for k in range(12) for i, t in enumerate(base)] + [(7, base[20]), (7, "a text of its own"), (7, base[7]), (2007, "a text of its own"), (None, base[0]), (5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent, links = [], ngram_join.candidate_links
    monkeypatch.setattr(ngram_join, "candidate_links", lambda d, *a: sent.append(d.count()) or links(d, *a))
    got = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in ngram_join.similar_groups(docs, 2, 85, 100).collect()}
    assert sent[0] <= len(base) + 3
    one = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_groups(spark.createDataFrame([*enumerate(base), (7, base[20]), (7, "a text of its own")], "doc_id long, text string"), 2, 85, 100).collect()}
    for (i, _), c in got.items():
        if i is not None and i != 5000:
            assert c == one[7 if i == 2007 else i % 100]


def test_shuffles_leave_with_the_result_that_they_led_to(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().mkString("|").count("shuffle_")
    df = spark.range(20_000).groupBy((F.xxhash64("id") % 5000).alias("x")).agg(F.sum("id").alias("s")).repartition(7, "s")
    before = files()
    got = common.released(df)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert got.count() == df.count()
