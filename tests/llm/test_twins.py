"""Sharding and the pipeline's stages against twins that handle one row after the other, on tables with nulls, repeats and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sluicework.llm.queries")

from sluicework.llm import decontam, langid, mixing, sharding  # noqa: E402
from sluicework.llm.common import bucket_count  # noqa: E402


def key60(*parts):
    return int(hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:15], 16)


def shards(rows, n, seed=42):
    """(id: shard, slot) of rows (id, source) with ids of their own."""
    strata = defaultdict(list)
    for i, source in rows:
        strata["-" if source is None else f"={source}"].append(i)
    line = []
    for g, ids in strata.items():
        u, size, b = key60(seed, g) % sharding.STEPS, len(ids), bucket_count(len(rows))
        for rank, i in enumerate(sorted(ids, key=lambda i: (key60(seed, i) % b, key60(seed, i)))):
            line.append(((sharding.STEPS * rank + u) / size, g, rank, i))
    out = {}
    for pos, (_, _, _, i) in enumerate(sorted(line)):
        s = pos * n // len(rows)
        out[i] = (s, pos - -(-s * len(rows) // n))
    return out


@pytest.mark.parametrize("n", [1, 4, 16])
def test_every_row_has_its_place(spark, n):
    r = random.Random(n)
    rows = [(i, "hot" if r.random() < 0.6 else r.choice((None, "", "a", "b", "ü"))) for i in range(700)] + [(None, "a")]
    d = spark.createDataFrame([(i, s, -1, "x", 2) for i, s in rows], "doc_id long, source string, slot int, pos string, bucket int").repartition(3)
    got = {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.assign_shards(d, n).collect()}
    assert got == shards(rows, n)


def near(a, b):
    return 100 * len(a & b) >= 80 * len(a | b) if a and b else False


def shingled(text):
    w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "").translate({c: c + 32 for c in range(65, 91)})).split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def substring_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[:], i
        for j, b in enumerate(text, 1):
            row[j] = min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    """A few given documents, near copies, planted items, nulls, repeated rows and columns that operators use themselves."""
    r = random.Random(11)
    base = [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 300 and 900").orderBy("doc_id").limit(25).collect()]
    item = "which of the following towers stood in the harbour before the great fire"
    rows = []
    for k in range(70):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 0, 1, 8))):
            w[r.randrange(len(w))] = r.choice(base).split()[0]
        if k % 9 == 0:
            x = list(item)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = "e"
            w.insert(7, "".join(x))
        rows.append((k, " ".join(w), "en" if k % 2 else None, r.choice(("hot", "hot", "a", None)), 1, "row", 3, "g"))
    rows += [(100, None, "en", "a", None, None, None, None), (101, "", "en", "a", 0, "", 0, ""), (102, "... 12", "en", None, 0, "", 0, ""), rows[3], rows[3]]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, size int, g string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, item


def test_each_stage_equals_its_twin(spark, corpus):
    """Each stage on its own input: the rows that it keeps, with all columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    root, item = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    take = lambda df: Counter(tuple(x[c] for c in columns) for x in df.collect())
    i, t, s = (columns.index(c) for c in ("doc_id", "text", "source"))

    kept = stages["language ID"](spark, docs, root)
    assert kept.columns == columns
    rows = take(docs)
    assert take(kept) == Counter({x: n for x, n in rows.items() if any(map(str.isalpha, x[t] or ""))})

    one = stages["n-gram Jaccard join"](spark, kept, root)
    rows, sets = take(kept), {}
    for x in rows:
        sets[x[i]] = shingled(x[t])
    least = {k: k for k in sets}
    for _ in sets:
        least = {k: min([least[k], *(least[j] for j in sets if near(sets[k], sets[j]))]) for k in sets}
    assert one.columns == columns and {x[i] for x in take(one)} == set(least.values()) and all(x in rows for x in take(one))
    assert all(n == 1 for n in take(one).values())

    clean = stages["benchmark decontamination"](spark, one, root)
    x = decontam.normalised(item)
    leaks = lambda text: substring_distance(x, decontam.normalised(text or "")) <= int(decontam.RATE * len(x))
    assert clean.columns == columns and take(clean) == Counter({r: n for r, n in take(one).items() if not leaks(r[t])})
    assert clean.count() < one.count()

    mixed = stages["mixing sources to target weights"](spark, clean, root)
    assert mixed.columns == columns
    shares = {r["row"]["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(clean).collect()}
    words = {k: len(shingled_words) for k, shingled_words in ((r[i], (r[t] or "").split()) for r in take(clean))}
    assert all(size == words[k] and 0 <= taken <= 3 * size for k, (taken, size) in shares.items())
    for r, n in take(mixed).items():
        taken, size = shares[r[i]]
        assert taken // size <= n <= -(-taken // size)

    final = stages["sharding"](spark, mixed, root)
    assert take(final) == take(mixed)
    sizes = Counter(r["shard"] for r in final.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    per = defaultdict(Counter)
    for r in final.collect():
        per[r["source"]][r["shard"]] += 1
    assert all(max(c[k] for k in sizes) - min(c[k] for k in sizes) <= 2 for c in per.values())


def test_stages_of_nothing(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, corpus[0]).count() == 0


def test_mix_of_very_many_sources(spark):
    """A source a row: all words are taken, and no source is off its target by more than a word."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), (F.col("id") % 40).alias("size"))
    m = mixing.mix(d, size_col="size").collect()
    assert sum(r["taken"] for r in m) == sum(r["size"] for r in m) and max(abs(r["taken"] - r["target"]) for r in m) <= 1.5


def test_languages_of_given_documents_stay(spark, sf):
    """Clean documents of the learned languages aren't foreign."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.identify_language(spark, docs, sf)
    some = docs.where("lang is not null and n_chars > 100")
    assert some.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.02 * some.count()
    assert langid.UNDETERMINED not in {r[0] for r in langid.identify(kept, langid.training_sample(docs)).select("lang_pred").distinct().collect()}


def test_the_limit_of_foreign_texts_comes_from_all_labelled_documents(spark, monkeypatch):
    """Documents beyond the sample raise the limit if more of them cost more than the quantile leaves out; what taught doesn't count."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 4)
    plain = [(k, "en", f"the cat sat on the mat and the dog ran to the house number {'abcdefgh'[k % 8]} " * 9) for k in range(40)]
    odd = [(1000 + k, "en", "zqxj vkwp qqzz xxjk wvzq pkqj " * 9) for k in range(40)]
    schema = "doc_id long, lang string, text string"
    rows = langid.labelled_sample(spark.createDataFrame(plain, schema))
    low, _ = langid.foreign_limit(spark.createDataFrame(plain, schema), rows)
    high, extra = langid.foreign_limit(spark.createDataFrame(plain + odd, schema), rows)
    known = langid.Automata(langid.joined(rows[::2]))
    _, _, bits, size = known.predict([odd[0][2]])
    assert low < high and abs(high / langid.MARGIN - max(bits[0] - extra / size[0], 0)) <= 1 / langid.STEPS
    assert langid.foreign_limit(spark.createDataFrame([(0, "en", t) for _, t in rows[::2]], schema), rows) == (float("inf"), 0.0)
