import heapq
import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import fingerprints as P
from orrery.llm import langid as L
from orrery.llm import licenses as X
from orrery.llm import mixing as M
from orrery.llm import packing as K
from orrery.llm import queries
from orrery.llm import sharding as S

# Licenses


def sellers(pattern, text):
    """The least edits of the pattern against any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_scan_equals_brute_force(prose):
    rng = random.Random(2)
    scanner = X.Scanner(X.NOTICES)
    for trial in range(60):
        name = rng.choice(list(X.NOTICES))
        notice = list(X.NOTICES[name])
        for _ in range(rng.randint(0, X.bound(X.NOTICES[name]) + 2)):
            at, what = rng.randrange(len(notice)), rng.choice("srd")
            notice[at : at + (what != "r")] = [] if what == "d" else [rng.choice("abcxyz")]
        text = prose(12) + " " + "".join(notice).replace(" ", "\n" if trial % 3 == 0 else " ") + "\t" + prose(12)
        found = scanner.scan(text)
        for key, pattern in zip(scanner.names, scanner.texts, strict=True):
            best = sellers(pattern, X.normalised(text))
            mine = [f for f in found if f[0] == key]
            assert bool(mine) == (best <= X.bound(pattern)), (key, best)
            if mine:
                assert min(f[3] for f in mine) == best
            for _, a, b, e in mine:
                assert edit(pattern, X.normalised(text)[a:b]) == e


def test_scan_finds_each_of_many_in_a_long_text(documents, odd, nothing, prose):
    text = " ".join(itertools.chain.from_iterable((prose(50), X.NOTICES["mit"]) for _ in range(500)))
    got = X.license_scan(documents([(1, text, "en", "s", 1), (2, "İ " + X.NOTICES["mit"], "en", "s", 1)])).collect()
    assert Counter(r.doc_id for r in got) == {1: 500, 2: 1}
    assert all(text[r.start : r.end] == X.NOTICES["mit"] and r.edits == 0 for r in got if r.doc_id == 1)
    assert X.license_scan(odd).count() == 0 == X.license_scan(nothing).count()


def test_every_license_line_of_the_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.lower("text").contains("licen"))
    lines = {(r.doc_id, m.strip()) for r in docs.select("doc_id", "text").collect() for m in r.text.split("\n") if "licen" in m.lower()}
    found = {r.doc_id: set() for r in docs.select("doc_id").collect()}
    for r in X.license_scan(docs).collect():
        found[r.doc_id].add(r.notice)
    assert len(lines) > 200 and all(found.values())
    by_nc = {i for i, m in lines if "CC BY-NC 4.0" in m}
    assert by_nc and by_nc == {i for i, names in found.items() if "cc-by-nc-4.0-code" in names}


def test_short_license_codes_are_told_apart():
    scanner = X.Scanner(X.NOTICES)
    for name, code in X.NOTICES.items():
        if name.startswith("cc-") and name.endswith(("-code", "-spdx")):
            text = f"Licensed under {code}."
            assert scanner.scan(text) == [(name, 15, len(text) - 1, 0)]
    assert scanner.scan("Traffic grew by 4.0 percent, public by 3.0.") == []


# Mixing


def test_mix_hits_its_numbers_and_odds(documents):
    docs = documents([(i, "t", "en", "abc"[i % 3 if i % 2 else 0], 100 + i % 900) for i in range(3000)])
    got = M.plan(docs, weights={"a": 0.2, "b": 0.5, "c": 0.3, "none": 0.0}, total=2000).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.copies
    assert by == {"a": 400, "b": 1000, "c": 600}
    # Expected copies of b: above one for the longer rows, so all of those are in.
    rows = [r for r in docs.collect() if r.source == "b"]
    total = sum(r.n_chars for r in rows)
    copies = {r.doc_id: r.copies for r in got if r.source == "b"}
    for r in rows:
        e = 1000 * r.n_chars / total
        assert int(e) <= copies.get(r.doc_id, 0) <= int(e) + 1


def test_inclusion_is_near_its_odds(documents):
    docs = documents([(i, "t", "en", "a", 100 if i % 2 else 300) for i in range(400)], False)
    seen = Counter()
    for seed in range(12):
        for r in M.plan(docs, total=100, seed=f"s{seed}").collect():
            seen[r.doc_id % 2] += r.copies
    assert seen[0] + seen[1] == 1200
    assert 0.70 < seen[0] / 1200 < 0.80  # three quarters


def test_mix_on_odd_rows(odd, nothing):
    got = M.plan(odd)
    assert {r.source for r in got.collect()} <= {"a", "b", "c", M.NULL_SOURCE}
    assert M.mixed(odd).columns == odd.columns
    assert M.plan(nothing).count() == 0 == M.mixed(nothing).count()


def test_a_very_long_document_weighs_as_it_is_long(documents):
    docs = documents([(i, "t", "en", "a", 100) for i in range(99)] + [(99, "t", "en", "a", 1_000_000)], False)
    copies = {r.doc_id: r.copies for r in M.plan(docs, total=1000).collect()}
    assert copies[99] in (990, 991) and sum(copies.values()) == 1000


def test_samples_keep_their_size_whatever_repeats(documents):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, None, 10 + i]), f"t{rng.randint(0, 3)}", "en", "abc"[i % 3], rng.choice([None, 0, 50, 50, 50, 900])) for i in range(240)]
    docs = documents(rows)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[3] for r in rows], "n_chars": pa.array([r[4] for r in rows], pa.int64())}))
    want = Counter(con.execute(M.SQL).fetchall())
    got = M.plan(docs)
    assert Counter((r.doc_id, r.source, r.copies) for r in got.collect()) == want
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns
    by = Counter(r.source for r in mixed.collect())
    assert by == {"a": 80, "b": 80, "c": 80}
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, M.mixed(docs.repartition(7)).collect()))


# Packing


def brute_bounds(lengths, counts, buckets):
    best = None
    for k in range(1, min(buckets, len(lengths)) + 1):
        for cut in itertools.combinations(range(len(lengths) - 1), k - 1):
            ends = [*cut, len(lengths) - 1]
            cost, at = 0, 0
            for e in ends:
                cost += lengths[e] * sum(counts[at : e + 1])
                at = e + 1
            best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        m = int(rng.integers(1, 11))
        lengths = np.sort(rng.choice(60, m, replace=False)).astype(np.int64)
        counts = rng.integers(1, 9, m).astype(np.int64)
        for buckets in (1, 2, 3, 4):
            upper = K.bounds(lengths, counts, buckets)
            assert upper[-1] == lengths[-1] and len(upper) == min(buckets, m)
            cost = sum(int(upper[np.searchsorted(upper, x)]) * int(c) for x, c in zip(lengths, counts, strict=True))
            assert cost == brute_bounds(lengths.tolist(), counts.tolist(), buckets)


def test_word_counts(prose):
    texts = ["a b", " a\t\nb ", "", None, "x" * 10, prose(300_000), " ", "y"]
    assert K.word_counts(pa.array(texts)).tolist() == [len((t or "").split()) for t in texts]


def test_pack(documents, odd, nothing, prose):
    rng = random.Random(1)
    docs = documents([(i, prose(rng.randint(1, 90)), "en", "s", 1) for i in range(400)])
    rows = K.pack(docs, buckets=4, budget=256).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    groups = Counter((r.bucket, r.batch) for r in rows)
    for r in rows:
        assert r.n_tokens <= r.bucket_length
        assert groups[r.bucket, r.batch] <= max(1, 256 // r.bucket_length)
    for b in {r.bucket for r in rows}:
        sizes = [groups[b, k] for k in range(max(x.batch for x in rows if x.bucket == b) + 1)]
        assert min(sizes) >= 1 and len(set(sizes[:-1])) <= 1
    assert K.pack(odd).count() == odd.count()
    assert K.pack(nothing).count() == 0


# Sharding


def one_by_one(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for s in sorted(sizes, reverse=True):
        x, i = heapq.heappop(heap)
        heapq.heappush(heap, (x + s, i))
    return sorted(heap, key=lambda x: x[1])


def test_schedule_equals_one_by_one():
    rng = np.random.default_rng(9)
    for _ in range(40):
        sizes = np.sort(rng.choice(50, 6, replace=False))[::-1].astype(np.int64)
        counts = rng.integers(1, 120, 6).astype(np.int64)
        plan, load = S.schedule(sizes, counts, 5)
        assert (np.bincount(plan[:, 0], weights=plan[:, 2]) == counts).all()
        want = one_by_one(np.repeat(sizes, counts).tolist(), 5)
        assert load.tolist() == [x for x, _ in want]


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_shards_keep_groups_together(monkeypatch, documents, odd, nothing, hot):
    monkeypatch.setattr(S, "HOT", hot)
    docs = documents([(i, f"text {i % 40}" * (i % 7 + 1), "en", "s", 1) for i in range(300)])
    rows = S.shard(docs, F.md5("text"), F.length("text"), 4).collect()
    assert len(rows) == 300
    assert len({(r.group_key, r.shard) for r in rows}) == len({r.group_key for r in rows})
    size = {r.doc_id: len(r.text) for r in docs.collect()}
    groups, load = Counter(), Counter()
    for r in rows:
        groups[r.group_key] += size[r.doc_id]
        load[r.shard] += size[r.doc_id]
    assert [load[i] for i in range(4)] == [x for x, _ in one_by_one(groups.values(), 4)]
    assert S.shard(odd, F.md5("text"), F.length("text")).count() == odd.count()
    assert S.shard(nothing, F.md5("text"), F.length("text")).count() == 0


# Fingerprints


def test_fingerprints_ignore_order_and_count_repeats(documents, odd, nothing):
    docs = documents([(1, "a b\n c\r\nd", "en", "s", 1), (2, "d\nc\n\na b", "en", "s", 1), (3, "d\nc\na b\nc", "en", "s", 1)])
    got = {r.doc_id: r.fingerprint for r in P.document_fingerprints(docs).collect()}
    assert got[1] == got[2] != got[3]
    rows = P.document_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {"0" * 4 * P.LANES}
    assert P.document_fingerprints(nothing).count() == 0


def test_fingerprints_change_without_the_text(spark, documents):
    old = P.document_fingerprints(documents([(1, "a\nb", "en", "s", 1), (2, "x", "en", "s", 1)]))
    changes = spark.createDataFrame([(1, "c", 1), (1, "a", -1), (2, None, 1), (9, "n", 1)], "doc_id long, paragraph string, sign int")
    got = {r.doc_id: r.fingerprint for r in P.revise(old, changes).collect()}
    want = {1: "b\nc", 2: "x", 9: "n"}
    assert got == {i: P.to_hex(P.fingerprint(t)) for i, t in want.items()}


# Language ID


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.filter("doc_id % 2 = 0"))
    rows = L.identify(docs.filter("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.language == r.lang for r in rows) / len(rows)
    assert right > 0.97, right
    assert not any(r.rejected for r in rows if r.language == r.lang)


def scored(model, text):
    """Language, gap and rejection of a text by plain loops over its bytes."""
    raw, mask = (text or "").encode(), (1 << 64) - 1
    letter = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 0 for b in raw]
    counts = Counter()
    for n in (1, 2, 3):
        for at in range(len(letter) - n + 1):
            part = letter[at : at + n]
            if part[1] if n == 3 else part[0] or part[-1]:
                g = 0
                for x in part:
                    g = (g * 257 + x + 1) & mask
                g = (g + (n << 40)) & mask
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    g = ((g ^ (g >> shift)) * factor) & mask
                counts[(g ^ (g >> 31)) >> 52] += 1
    if not counts:
        return None, 0.0, True
    size = sum(math.log1p(c) ** 2 for c in counts.values()) ** 0.5
    margins = [float(b) + sum(math.log1p(c) / size * float(model.weights[k, j]) for k, c in counts.items()) for j, b in enumerate(model.bias)]
    loss = {name: sum(math.log1p(math.exp(-m * bit)) for m, bit in zip(margins, word, strict=True)) / len(margins) for name, word in zip(model.languages, model.code.tolist(), strict=True)}
    first, second = sorted(loss.values())[:2]
    return min(loss, key=loss.get), second - first, second - first < L.GAP


def test_the_query_scores_as_plain_loops_do(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs)
    got = {r.doc_id: r for r in queries.op6_language_id(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        language, gap, rejected = scored(model, text)
        assert (got[i].language, got[i].rejected) == (language, rejected) and got[i].gap == pytest.approx(gap, abs=1e-4), i


def test_a_text_of_two_languages_is_ambiguous(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs)
    part = {r.lang: r.text for r in docs.filter("n_chars between 2000 and 4000").collect()}
    gaps = []
    for k in range(0, 2001, 50):
        text = part["en"][:k] + " " + part["fr"][: 2000 - k]
        counts = next(iter(L.features(pa.array([text]))))[2]
        gaps.append(float(L._decide(model, counts)[1][0]))
    assert min(gaps) < 0.25 * min(gaps[0], gaps[-1])
    assert L.identify(documents([(1, part["en"], "en", "s", 1)]), model, gap=99.0).first().rejected


def test_a_flipped_bit_is_corrected():
    code = L.codewords(4)
    assert code.shape == (4, 7) and all((a != b).sum() == 4 for a, b in itertools.combinations(code, 2))
    model = L.Model(list("abcd"), code, np.zeros((L.BINS, 7)), np.zeros(7))
    for k, bit in itertools.product(range(4), range(7)):
        word = code[k].copy() * 3
        word[bit] *= -0.9
        model.bias = word
        assert np.argmin(model.losses(np.ones((1, L.BINS)))) == k


def test_pieces_of_a_long_text_count_once(prose):
    text = prose(200_000)
    assert len(text) > L.textops.SLICE_BYTES
    total = np.concatenate([c for _, _, c in L.features(pa.array([text]))]).sum()
    letters = len(text) - text.count(" ")
    # Single letters, pairs with a letter, and triples around a letter.
    assert total == letters + (len(text) - 1) + (letters - 2)


def test_language_of_odd_rows(odd, nothing, documents):
    got = {r.doc_id: r for r in L.identify(odd).collect()}
    assert all(got[i].rejected and got[i].language is None for i in (3, 4, 5, 9))
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns and {3, 4, 5, 9}.isdisjoint({r.doc_id for r in kept.select("doc_id").collect()})
    assert L.identify(nothing).count() == 0 == L.keep_identified(nothing).count()
    bare = documents([(1, "some words", None, "s", 1), (2, "", None, "s", 1)])
    assert [(r.language, r.rejected) for r in L.identify(bare).orderBy("doc_id").collect()] == [(None, False), (None, True)]
    one = documents([(1, "some words", "en", "s", 1)])
    assert L.identify(one).first().language == "en"


def test_the_fit_is_on_a_bounded_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(L.fit(docs, sample=60).languages) == sorted({r.lang for r in docs.select("lang").distinct().collect()})


def test_a_rare_language_is_learnt_at_any_size(documents):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    kinds = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}
    rows = [(i, text(kinds[y]), y, "s", 1) for i, y in enumerate(["aa"] * 3000 + ["bb"] * 900 + ["cc"] * 3)]
    docs = documents(rows, False)
    for sample in (100, 1000, 5000):
        part, counts = L._training(docs, sample, "lang", "doc_id", "text")
        assert counts == {"aa": 3000, "bb": 900, "cc": 3} and part.num_rows <= sample
        assert set(part["y"].to_pylist()) == set(kinds)
        model = L.fit(docs, sample=sample)
        new = documents([(k, text(kinds[y]), None, "s", 1) for k, y in enumerate(sorted(kinds) * 4)], False)
        got = L.identify(new, model).orderBy("doc_id").collect()
        assert [(r.language, r.rejected) for r in got] == [(y, False) for y in sorted(kinds) * 4]


def test_quotas():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(1, 10 ** rng.integers(1, 9), rng.integers(1, 30))
        q = L.quotas(counts, 3000)
        assert (q >= 1).all() and (q <= counts).all() and q.sum() <= 3000
        assert q.sum() >= min(counts.sum(), 3000) - 2 * len(counts)


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_codewords_differ(n):
    assert len(np.unique(L.codewords(n), axis=0)) == n
