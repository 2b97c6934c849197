"""The operators of ``llm`` against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sluicework.llm.queries")

from sluicework.llm import decontam, langid, licenses, line_dedup, media, mixing, ngram_join, sharding, suffix_dedup, tokens  # noqa: E402
from sluicework.llm.suffix_sort import deep_shallow  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, shard string, h string"
WORDS = ["the", "of", "é", "ingest", "and", "shard", "wide", "nt", "a", "Über"]


def corpus(n=120, seed=1):
    """Rows with a hot source, copies, near copies, nulls, clashing extra columns and repeated rows."""
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(r.randint(20, 120))) for _ in range(10)]
    rows = []
    for i in range(n):
        t = r.choice(base)
        if r.random() < 0.5:
            w = t.split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = f"edit{i}"
            t = " ".join(w)
        rows.append((i, t, "en", "hot" if i % 3 else f"s{i % 7}", "x", "y"))
    rows += [(n, None, None, None, None, None), (n + 1, "", "en", "hot", None, None), (n + 2, "a" * 3000, "en", None, "", ""), (n + 3, "one two", "en", "hot", "", ""), (n + 4, "One  two", "en", "", "", "")]
    return rows + [rows[3], (None, "no id", "en", "hot", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_even_and_match_the_mixture(docs):
    got = sharding.assign_shards(docs, 4).collect()
    assert len(got) == len(corpus())
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    for source, n in Counter(r["source"] for r in got).items():
        per = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(per[s] for s in sizes) - min(per[s] for s in sizes) <= 2, (source, n, per)
    assert {r["h"] for r in got} >= {"y"}


def test_shards_of_nothing(empty):
    assert sharding.assign_shards(empty, 4).count() == 0


def test_mix_meets_its_targets(docs):
    m = mixing.mix(docs).collect()
    assert len(m) == len(corpus())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r["size"] == words(r["row"]["text"]) for r in m)
    total, by = sum(r["size"] for r in m), {}
    for r in m:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by.setdefault(r["row"]["source"], [0, r["target"], r["source_size"], 0])
        x[0] += r["taken"]
        x[3] += r["size"]
    # targets by brute-force filling
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, open_ = {}, set(names)
    while open_:
        level = (total - sum(full.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * by[s][3] <= level * weight[s] + 1e-9}
        if not over:
            break
        full |= {s: 3 * by[s][3] for s in over}
        open_ -= over
    for s in names:
        want = full.get(s, level * weight[s])
        assert by[s][2] == by[s][3] and by[s][1] == pytest.approx(want)
        assert abs(by[s][0] - want) <= max(4, 0.02 * want), (s, by[s], want)
    again = sorted((str(r["row"]), r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert sorted((str(r["row"]), r["taken"]) for r in m) == again


def test_mix_keeps_tiny_sources_near_their_targets(spark):
    """Sources from 1 word up beside one of 80 million and one of 5 million, whose blocks are larger than most."""
    sizes = {"a": [400], "b": [1000, 1], "c": [3000] * 3, "d": [1], "e": [10_000_000] * 8, "f": [5] * 2000, "g": [7, 0, 5_000_000], "h": [2441], "i": [2443]}
    rows = [(f"{s}{i}", s, n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, words long")
    m = mixing.mix(docs, size_col="words").collect()
    assert len(m) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in m)
    for s, ns in sizes.items():
        mine = [r for r in m if r["row"]["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1 + len(sizes) / 2, s
    assert sum(r["taken"] for r in m) == sum(map(sum, sizes.values()))
    kept = Counter(r["source"] for r in mixing.mixed_documents(docs, size_col="words").collect())
    assert set(kept) == set(sizes) and kept["d"] == 3 and kept["a"] == 3


def test_seat_quotas_are_those_of_ranking_all_seats(spark):
    for sizes in ([1, 2, 3, 50, 400], [7], [1] * 30 + [100], [0, 10, 10]):
        t = mixing.source_targets(spark.createDataFrame([(f"={i:02}", f"{i:02}", n) for i, n in enumerate(sizes)], "g string, source string, size long"))
        rows = t.collect()
        seats = sorted((-r["target"] / (2 * k + 1), r["place"], r["g"]) for r in rows for k in range(3 * r["size"]))[: sum(sizes)]
        per = -(-sum(sizes) // 16)
        want = Counter((g, i // per) for i, (_, _, g) in enumerate(seats))
        assert {(r["g"], r["shard"]): r["quota"] for r in mixing.seat_quotas(t).collect()} == want


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


def test_media_round_trip_and_clips(spark, docs):
    for text in ("", "a", "x" * 192, "é" * 5000, None):
        n, payload, sha, tail, size, media_sha, feature = media.digest(text)
        raw = (text or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        avi = media.write_avi(raw)
        assert (n, payload, sha, tail) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (size, media_sha) == (len(avi), hashlib.sha256(avi).hexdigest())
    cut = media.clips(media.write_avi(b"a" * 192 * 30 + bytes(range(192)) * 30))[1]
    assert [c[0] for c in cut] == [0, 30] and cut[1][2] == 30 * 1000 // 25
    assert media.media_digests(docs).count() == len(corpus())
    assert media.clip_rows(media.media_column(docs)).count() >= len(corpus())
    with pytest.raises(ValueError):
        media.riff_index(b"nothing")


def plain_cuts(frames):
    """The shot rule once more, frame by frame."""
    hist = [[sum(int(x) >> 4 == k for x in f.ravel()) for k in range(16)] for f in frames]
    d = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) for a, b in zip(hist, hist[1:], strict=False)]
    cuts = []
    for i, x in enumerate(d):
        near = [d[j] for j in range(max(0, i - 8), min(len(d), i + 9)) if j != i]
        if not near:
            continue
        mean = sum(near) / len(near)
        spread = (sum((y - mean) ** 2 for y in near) / len(near)) ** 0.5
        if x >= 0.25 * frames[0].size and x > mean + 2 * spread and (i == 0 or x >= d[i - 1]) and (i + 1 == len(d) or x > d[i + 1]):
            cuts.append(i + 1)
    return cuts


def test_shots_equal_the_rule_frame_by_frame():
    r = np.random.default_rng(4)
    for _ in range(30):
        frames = []
        for _ in range(r.integers(1, 6)):
            base, noise = r.integers(0, 256), r.integers(1, 90)
            frames += [np.clip(base + r.integers(-noise, noise, (12, 16)), 0, 255).astype(np.uint8) for _ in range(r.integers(1, 15))]
        got = media.find_cuts(media.histograms(np.stack(frames)))
        assert got == plain_cuts(frames)


def segment(marker, body):
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def coded(values):
    """Bits of (code, length) pairs as entropy-coded data."""
    bits = "".join(f"{v:0{n}b}" for v, n in values if n)
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


# one code of eight bits for each of these symbols, in order
SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0x11, 0x12, 0x21, 0xF0, 0x13, 0x31]
PLAIN = bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8) + bytes(SYMBOLS)


def number(v):
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1)


def put(out, run, v):
    n, extra = number(v)
    out += [(SYMBOLS.index(run << 4 | n), 8), (extra, n)]


def baseline(blocks, wide, high, restart=0, tables=True, colour=False):
    """A baseline frame of 8 x 8 blocks of (dc, [(run, value)]) in rows; ``colour`` adds two quarter-size components, all zero."""
    quant = bytes(range(1, 65))
    parts = bytes([1, 0x22 if colour else 0x11, 0]) + (bytes([2, 0x11, 0, 3, 0x11, 0]) if colour else b"")
    head = b"\xff\xd8" + segment(0xDB, b"\0" + quant) + (segment(0xC4, b"\x00" + PLAIN) + segment(0xC4, b"\x10" + PLAIN) if tables else b"")
    head += (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"") + segment(0xC0, bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(parts) // 3]) + parts)
    head += segment(0xDA, bytes([len(parts) // 3]) + (b"\1\0\2\0\3\0" if colour else b"\1\0") + b"\0\x3f\0")
    runs, out, before = [], [], 0
    per = 4 if colour else 1
    for k, (dc, ac) in enumerate(blocks):
        if restart and k and k % restart == 0:
            runs.append(coded(out))
            out, before = [], 0
        put(out, 0, dc - before)
        before = dc
        for run, v in ac:
            put(out, run, v)
        out.append((SYMBOLS.index(0), 8))
        if colour and k % per == per - 1:
            out += [(SYMBOLS.index(0), 8)] * 4  # dc 0 and end of block, twice
    runs.append(coded(out))
    body = runs[0] + b"".join(bytes([255, 0xD0 + k % 8]) + x for k, x in enumerate(runs[1:]))
    return head + body + b"\xff\xd9"


def plain_block(dc, ac):
    """Samples of a block by the definition of the transform."""
    order = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)]
    f, i = {(0, 0): dc * 1}, 0
    for run, v in ac:
        i += run + 1
        f[order[i]] = v * (i + 1)
    c = lambda u: 0.5**0.5 if u == 0 else 1.0
    return np.array([[128 + sum(c(u) * c(v) / 4 * x * np.cos((2 * j + 1) * v * np.pi / 16) * np.cos((2 * i + 1) * u * np.pi / 16) for (u, v), x in f.items()) for j in range(8)] for i in range(8)])


def as_avi(frames, fps=10):
    """An AVI of given frames, its index counted from the beginning of the file."""
    movi, index, at = b"movi", b"", 12 + 8 + 4 + 8 + 56 + 8
    for f in frames:
        index += b"00dc" + (16).to_bytes(4, "little") + (at + len(movi)).to_bytes(4, "little") + len(f).to_bytes(4, "little")
        movi += media._chunk(b"00dc", f)
    head = media._list(b"hdrl", media._chunk(b"avih", (1_000_000 // fps).to_bytes(4, "little") + bytes(52)))
    return media._chunk(b"RIFF", b"AVI " + head + media._chunk(b"LIST", movi) + media._chunk(b"idx1", index))


def test_baseline_frames(spark):
    r = random.Random(8)
    some = lambda: (r.randint(-500, 500), [(r.choice((0, 0, 1)), r.choice((-3, -2, -1, 1, 2, 3))) for _ in range(r.randint(0, 4))])
    for wide, high, restart in ((16, 8, 0), (24, 16, 2), (13, 11, 1)):
        across, down = -(-wide // 8), -(-high // 8)
        blocks = [some() for _ in range(across * down)]
        want = np.block([[plain_block(*blocks[y * across + x]) for x in range(across)] for y in range(down)])[:high, :wide]
        got = next(media.read_frames(frame := baseline(blocks, wide, high, restart), [(0, len(frame))]))[0]
        assert got.shape == (high, wide) and np.abs(got - np.clip(want, 0, 255)).max() <= 0.51
    blocks = [some() for _ in range(8)]  # two units of four luma blocks
    frame = baseline(blocks, 32, 16, colour=True)
    want = np.block([[plain_block(*blocks[0]), plain_block(*blocks[1]), plain_block(*blocks[4]), plain_block(*blocks[5])], [plain_block(*blocks[2]), plain_block(*blocks[3]), plain_block(*blocks[6]), plain_block(*blocks[7])]])
    assert np.abs(next(media.read_frames(frame, [(0, len(frame))]))[0] - np.clip(want, 0, 255)).max() <= 0.51
    dark, light = baseline([(-800, [])] * 2, 16, 8), baseline([(800, [])] * 2, 16, 8)
    film = as_avi([dark] * 20 + [light] * 15)
    bare = as_avi([baseline([(-800, [])] * 2, 16, 8, tables=False)])
    tables = segment(0xC4, b"\x00" + PLAIN) + segment(0xC4, b"\x10" + PLAIN)
    good = media.write_avi(b"abc" * 300)
    rows = [(1, film), (2, None), (3, b""), (4, b"RIFF nonsense"), (5, good[:-40]), (6, bare), (7, as_avi([dark, baseline([(0, [])], 8, 8)])), (8, as_avi([])), (9, good), (10, as_avi([b"\xff\xd8\xff\xd9"]))]
    got = {}
    for x in media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(x["doc_id"], []).append(x)
    assert [(x["first_frame"], x["end_frame"], x["start_ms"], x["end_ms"]) for x in got[1]] == [(0, 20, 0, 2000), (20, 35, 2000, 3500)]
    assert set(got) == {1, 3, 4, 5, 6, 7, 9, 10} and all(got[k][0]["error"] and got[k][0]["clip"] is None for k in (3, 4, 5, 6, 7, 10)) and got[9][0]["error"] is None
    assert media.clip_rows(spark.createDataFrame([(6, bare)], "doc_id long, media binary"), tables=tables).first()["error"] is None


def test_lossless_frames_with_any_table():
    """The same samples by a table of eight-bit codes, bit by bit."""
    r = np.random.default_rng(3)
    x = r.integers(0, 256, (5, 7)).astype(np.int64)
    out, counts = [], bytes([0] * 7 + [9] + [0] * 8) + bytes(range(9))
    for i in range(5):
        for j in range(7):
            d = int(x[i, j] - (x[i, j - 1] if j else x[i - 1, 0] if i else 128))
            n, extra = number(d)
            out += [(n, 8), (extra, n)]
    frame = b"\xff\xd8" + segment(0xC4, b"\0" + counts) + segment(0xC3, bytes([8, 0, 5, 0, 7, 1, 1, 0x11, 0])) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + coded(out) + b"\xff\xd9"
    assert (next(media.read_frames(frame, [(0, len(frame))]))[0] == x).all()


def test_token_counts(docs):
    pieces, octets, ends, longest = tokens.load_scores(tokens.default_vocabulary())

    def brute(w):
        best = [(0, 0)] + [None] * len(w)
        for d in range(1, len(w) + 1):
            raw = w[d - 1].encode()
            options = [] if w[d - 1] in pieces else [(best[d - 1][0] + sum(octets[b] for b in raw), -best[d - 1][1] - len(raw))]
            options += [(best[a][0] + pieces[w[a:d]], -best[a][1] - 1) for a in range(max(0, d - longest), d) if w[a:d] in pieces]
            s, c = max(options)
            best[d] = (s, -c)
        return best[-1][1]

    want = {i: sum(brute(tokens.MARK + w) for w in t.split()) for i, t, *_ in corpus() if t is not None and i is not None}
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs).collect()}
    assert {i: n for i, n in got.items() if i in want} == want
    assert got[120] is None and got[121] == 0
    # another table of scores, with a trie that begins anew for every word
    table = {tokens.MARK: -5, **{c: -3 for c in "abcdefghijklmnopqrstuvwxyz0123456789"}, "in": -4, "edit": -7, "gest": -6, tokens.MARK + "the": -4}
    pieces, octets, ends, longest = tokens.scored(table)
    want = {i: sum(brute(tokens.MARK + w) for w in t.split()) for i, t, *_ in corpus() if t is not None and i is not None}
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, scores=table).collect()}
    assert {i: n for i, n in got.items() if i in want} == want
    one, many = tokens.Trie(pieces, octets, ends), ["ingest", "in", "inge", "", "édit", "edited"] * 2
    assert [one.insert(w) for w in many] == [tokens.Trie(pieces, octets, ends).insert(w) for w in many]
    assert len(one.best) == 1 + len({w[:k] for w in many for k in range(1, len(w) + 1)})


def test_deep_shallow_sorts():
    r = random.Random(2)
    s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) for _ in range(300)] + [b"a" * n for n in (100, 100, 64, 99)]
    for shallow in (0, 8, 48):
        assert [s[i] for i in deep_shallow(s, shallow)] == sorted(s)


@pytest.mark.parametrize(("width", "large"), [(200, 50_000), (80, 50_000), (80, 2)])
def test_suffix_dedup(spark, width, large):
    rows = [(i, t) for i, t, *_ in corpus()] + [(500, "ab" * 300), (501, "abcdefg" * 60 + "Q" + "abcdefg" * 60)]
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p : p + width] for p in range(len(b) - width + 1))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width, large=large)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(3)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(k, line(8)) for k in range(6)] + [(6, None), (7, "  "), (8, "tiny")]
    rows = []
    for i in range(60):
        t = line(30)
        if i % 3 == 0:
            x = list(items[i % 6][1])
            for _ in range(r.randint(0, 6)):
                x[r.randrange(len(x))] = r.choice("abcdefgh ")
            t = t[:50] + " " + "".join(x).upper() + "\n" + t[50:]
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, "a TINY one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for i, t in rows:
        for k, x in items:
            x = decontam.normalised(x or "")
            if x and t and (d := edit_distance_in(x, decontam.normalised(t))) <= int(0.1 * len(x)):
                want.add((i, k, d))
    assert {(m["doc_id"], m["item_id"], m["distance"]) for m in decontam.matches(docs, bench).collect()} == want
    kept = {x["doc_id"] for x in decontam.without_matches(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {w[0] for w in want}


def test_licenses(spark):
    rows = [("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.py", "def f(): pass"), ("/a/b/COPYING", "prose.\nThis work is licensed under the GNU General Public License, version 3."), ("/a/b/c/y.py", "nothing"), ("/z/q.py", "Some text. Licensed under the Apache License, Version 2.0. More."), ("/z/r.py", None), (None, "x"), ("/z/r.py", "the work of this and that version is public")]
    got = {(r["path"], r["licence"], r["inherited_from"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("/a/LICENSE", "MIT", "/a"), ("/a/b/x.py", "GPL-3.0", "/a/b"), ("/a/b/COPYING", "GPL-3.0", "/a/b"), ("/a/b/c/y.py", "GPL-3.0", "/a/b"), ("/z/q.py", "Apache-2.0", None), ("/z/r.py", None, None), (None, None, None)}


def test_licences_by_header_full_text_and_spdx_line(spark):
    gpl = """/* frob.c
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY.
 */

int main(void) { return 0; }
"""
    rows = [(f"/{p.stem}/LICENSE", f"Copyright (c) 2021 Jane Doe\n\n{p.read_text()}", p.stem) for p in sorted(licenses.TEXTS.glob("*.txt"))]
    rows += [("/s/frob.c", gpl, "GPL-3.0"), ("/s/two.c", gpl.replace("version 3", "version 2"), "GPL-2.0"), ("/s/a.c", gpl.replace("GNU General", "GNU Affero General"), "AGPL-3.0"), ("/s/x.py", "# SPDX-License-Identifier: MIT\nimport os\n", "MIT"), ("/s/y.py", "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0")]
    rows += [("/s/z.py", "Distributed under the MIT license, see the file LICENSE for details.", "MIT"), ("/s/n.txt", "A work of fiction.\n\nThe program covers the use of software and the copyright of songs.", None)]
    got = {r["path"]: r["own_licence"] for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert got == {p: n for p, _, n in rows}


def test_lines(spark, empty):
    long_ = "the quick brown fox jumps over the lazy dog and runs away from the farm at night"
    rows = [(1, f"{long_}\nunique line here of its own\n\nshort"), (2, f"{long_.upper()}\nanother thing altogether, not alike"), (3, long_.replace("night", "nighx")), (4, None), (5, "short"), (6, "")]
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 3, ""), 2: (2, 1, "0"), 3: (1, 0, "0"), 4: (0, 0, ""), 5: (1, 0, "0"), 6: (0, 0, "")}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_differ_in_white_space_only(spark):
    rows = [(1, "short\nTo be  or not\n\n a b"), (2, "short\r\n\r\nto be or not\r\n\t\r\nother\r\n"), (3, "\tto\tbe or \x0b not \nA\tB\n \f "), (4, "\r\n \r\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], r["dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (3, 3, ""), 2: (3, 1, "0,2"), 3: (2, 0, "0,1"), 4: (0, 0, "")}
    text = {r["doc_id"]: r["text"] for r in line_dedup.without_dropped_lines(docs).collect()}
    assert text == {1: rows[0][1], 2: "\r\n\t\r\nother\r\n", 3: " \f ", 4: "\r\n \r\n"}


def test_similar_lines_that_share_a_template(spark):
    """1,200 lines of one template, alike in pairs only: recall against brute force."""
    r = random.Random(11)
    rnd = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    template, rows = "the following page of this site was last changed by the user whose name and address are given: ", []
    for _ in range(600):
        own = rnd(40)
        rows += [template + own, template + own[:20] + rnd(2) + own[22:]]
    sets = [{t[p : p + 8] for p in range(len(t) - 7)} for t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) >= 590
    narrow, links = line_dedup.line_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))
    name = {x["doc_id"]: x["class"] for x in narrow.collect()}
    found = sum(name[a] == name[b] for a, b in alike)
    print("recall", found, "of", len(alike))
    assert found >= 0.995 * len(alike)
    assert len(set(name.values())) >= len(rows) - len(alike)
    assert links.where("jaccard < 0.8").count() == 0


@pytest.mark.parametrize("two_blocks", [False, True])
def test_links_between_blocks_join_what_all_links_join(two_blocks):
    """Short, repeated and edited lines, some in one class before: components against brute force."""
    for seed in range(12):
        r = random.Random(seed)
        base = ["".join(r.choice("abcd é") for _ in range(r.randint(1, 60))) for _ in range(6)]
        texts = []
        for _ in range(60):
            t = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice("abcdxyz")
            texts.append("".join(t))
        m = len(texts)
        sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
        jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])  # noqa: B023, E731
        side = np.array([r.randint(0, 1) if two_blocks else 2 for _ in texts])
        c = np.array([r.randint(0, m) for _ in texts])
        got = line_dedup.class_links(np.arange(m), c, side, texts)
        assert all(abs(jaccard(a, b) - j) < 1e-12 and j >= 0.8 for a, b, j in got)

        def joined(pairs):
            name = c.copy()  # noqa: B023
            for a, b in pairs:
                name[name == name[a]] = name[b]
            return {frozenset(np.flatnonzero(name == k).tolist()) for k in set(name.tolist())}

        every = [(a, b) for a in range(m) for b in range(a) if (side[a] != side[b] or not two_blocks) and jaccard(a, b) >= 0.8]
        assert joined(every) == joined([(a, b) for a, b, _ in got])


def test_long_lines_extra_columns_and_repeated_ids(spark):
    """One line of 40,000 characters and its near copy; columns named like the operator's own; two rows of one id."""
    r = random.Random(5)
    long_ = "".join(r.choice("abcdefgh ") for _ in range(40_000)).strip()
    rows = [(1, long_, 1, "x", 0), (2, long_[:20_000] + "zz" + long_[20_000:], 2, "y", 1), (3, "short", 3, "z", 2), (3, "other\nshort", 4, "z", 2), (None, "no id", 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, line string, `at` long")
    got = {x["doc_id"]: (x["n_lines"], x["n_kept"]) for x in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 0), 3: (3, 2), None: (1, 1)}


def test_language(spark, sf):
    from sluicework.llm import queries

    docs = queries.table(spark, sf, "documents")
    got = queries.op9_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    sample = [("b", "zzz zzq qqz"), ("a", "one two three")]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "two one")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, sample).collect()} == {1: "und", 2: "und", 3: "und", 4: "a"}


def phrases(text, sample):
    n = at = 0
    while at < len(text):
        z = at
        while z < len(text) and text[at : z + 1] in sample:
            z += 1
        n, at = n + 1, max(z, at + 1)
    return n


def test_cross_parsing_equals_brute_force():
    r = random.Random(5)
    sample = [("x", "".join(r.choice("abc ") for _ in range(300)).strip()), ("y", "".join(r.choice("cde ") for _ in range(300)).strip())]
    known = langid.Automata(sample)
    plain = ["".join(map(chr, langid.normalised(t))) for _, t in sample]
    texts = ["".join(r.choice("abcde ") for _ in range(n)).strip() for n in (1, 7, 60, 200, 1023, 1024, 1025, 2500, 10_000)]
    texts += [sample[0][1], sample[0][1] * 9, "z" * 3000, plain[0][:1] + plain[1] * 12]
    got = known.phrases([langid.normalised(t) for t in texts])
    assert got[-4].tolist()[0] == 1
    for t, row in zip(texts, got.tolist(), strict=True):
        t = "".join(map(chr, langid.normalised(t)))
        assert row == [phrases(t, s) for s in plain]


@pytest.mark.parametrize(("n", "num", "den", "block"), [(4, 85, 100, 4 << 20), (5, 80, 100, 3)])
def test_ngram_join(spark, docs, empty, n, num, den, block):
    sets = {}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join.similar_groups(docs, n, num, den, block=block).collect()
    assert len(got) == len(corpus())
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in root} | {None: None}
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs, n, num, den).collect()]
    assert sorted(kept, key=str) == sorted({find(i) for i in root} | {None}, key=str)
    assert ngram_join.similar_groups(empty, n, num, den).count() == 0


def brute_components(sets, num, den):
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in root]


@pytest.mark.parametrize(("n", "num", "den", "block"), [(4, 85, 100, 4 << 20), (5, 80, 100, 4 << 20), (5, 80, 100, 20_000)])
def test_ngram_join_finds_all_of_large_sets_and_chains(spark, n, num, den, block):
    """Sets of 1 to 900 shingles: families around the threshold, chains, one passage shared by most, a large group of near copies."""
    r = random.Random(num + block)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage, texts = [word() for _ in range(50)], []
    for size in [3, 5, 8, 20, 60, 70, 130, 260, 900]:
        base = [word() for _ in range(size)]
        for _ in range(14):  # each edits as many words as move it about to the threshold
            w = list(base)
            for _ in range(r.randint(0, max(1, size * (den - num) // den // n))):
                w[r.randrange(len(w))] = word()
            texts.append(w)
        chain = list(base)  # each link is similar to its neighbours, not to the whole chain
        for _ in range(12):
            for _ in range(max(1, size * (den - num) // den // n // 2)):
                chain[r.randrange(len(chain))] = word()
            texts.append(list(chain))
    for _ in range(150):
        own = [word() for _ in range(r.randint(30, 120))]
        texts.append(own[:20] + passage + own[20:])
    base = [word() for _ in range(200)]
    for _ in range(120):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = word()
        texts.append(w)
    texts += texts[:30]
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} for w in texts]
    want = brute_components(sets, num, den)
    assert max(Counter(want).values()) > 60
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs, n, num, den, block=block).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2)])
def test_similar_sets_meet_in_their_prefixes(num, den):
    """Pairs exactly at the threshold, whatever shingles count as frequent, and through batches of any size."""
    r = np.random.default_rng(7)
    for size in [*range(1, 70), 128, 700]:
        pool = r.integers(0, 2**63, 3 * size + 3).astype(np.uint64)
        common = -(-2 * size * num // (num + den))
        sets = [np.sort(pool[:size]), np.sort(pool[: -(-size * num // den)]), np.sort(np.concatenate((pool[:common], pool[2 * size : 3 * size - common])))]
        h, at = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        for frequent in (np.zeros(0, np.uint64), np.sort(pool[: size // 2]), np.sort(pool)):
            key, who, place = ngram_join.prefixes(h, at, frequent, num, den)
            for x in range(3):
                ranked = sorted(sets[x].tolist(), key=lambda s: (s in set(frequent.tolist()), s))
                mine = who == x
                assert key[mine][np.argsort(place[mine])].tolist() == ranked[: mine.sum()]
            o = np.lexsort((who, key))
            p, q = ngram_join._meet(key[o].view(np.int64), who[o], np.diff(at)[who][o], place[o], num, den)
            assert {(0, 1), (0, 2)} <= {(min(x, y), max(x, y)) for x, y in zip(p.tolist(), q.tolist(), strict=True)}


def test_empty_tables(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert tokens.token_counts(empty).count() == 0
    assert media.media_digests(empty).count() == 0
    assert langid.training_sample(empty) == []


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now and now <= kept
        kept = now
    leaks = decontam.matches(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert leaks.count() == 0
    assert docs.select(F.max("shard")).first()[0] == 15
