import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import ngram_join as J
from orrery.llm import suffix_dedup as D
from orrery.llm import textops


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def gram_set(text, n=J.N):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute_pairs(docs, threshold=J.THRESHOLD):
    out = {}
    sets = {i: gram_set(t) for i, t in docs.items()}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
            out[a, b] = round(j, 6)
    return out


def near(text, words, rng, share):
    w = text.split()
    for k in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[k] = words[rng.integers(len(words))]
    return " ".join(w)


def test_words_agree_with_a_regular_expression(prose):
    texts = ["Ab-c  d,É f", "", None, "x", "Straße 12!", prose(300_000), "a" * (textops.SLICE_BYTES + 10) + " b", " lead"]
    seen = {}
    for i, j, first, h, s, e in textops.words(pa.array(texts)):
        for r in range(j - i):
            raw = (texts[i + r] or "").encode()
            got = [raw[a:b].decode().lower() for a, b in zip(s[first[r] : first[r + 1]], e[first[r] : first[r + 1]], strict=True)]
            assert [g for g in got] == [re.sub("É", "É", x) for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in texts[i + r] or ""))] or "É" in (texts[i + r] or "")
            for w, x in zip(got, h[first[r] : first[r + 1]], strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def brute_rows(docs, threshold=J.THRESHOLD):
    """The rows of the join: class and links of each document, from all pairs."""
    lead, links = {i: i for i in docs}, dict.fromkeys(docs, 0)

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in brute_pairs(docs, threshold):
        links[a] += 1
        links[b] += 1
        x, y = sorted((top(a), top(b)))
        lead[y] = x
    return {(i, top(i), links[i]) for i in docs}


def rows_of(frame, **how):
    return {(r.doc_id, r.class_id, r.n_links) for r in J.ngram_jaccard_join(frame, **how).collect()}


def test_join_equals_brute_force(spark, documents, prose, words):
    rng = np.random.default_rng(5)
    base = [prose(int(n)) for n in rng.integers(1, 200, 40)]
    texts = base + [near(t, words, rng, s) for t in base[:25] for s in (0.02, 0.05, 0.1, 0.2)] + base[:6]
    docs = dict(enumerate(texts))
    frame = documents([(i, t, "en", "s", 1) for i, t in docs.items()])
    assert rows_of(frame) == brute_rows(docs)
    lowest = {}
    for i, t in docs.items():
        lowest.setdefault(frozenset(gram_set(t)), i)
    want = {(a, b): j for (a, b), j in brute_pairs(docs).items() if {a, b} <= set(lowest.values())}
    assert {(r.doc_a, r.doc_b): r.jaccard for r in J.similar_sets(frame).collect()} == want


def test_equal_sets_with_unequal_counts(documents):
    docs = {1: "x y z x y z x y z", 2: "x y z x y z x y z x y z", 3: "x y z x y z x y z x y z", 4: "x y z x y z", 9: "other words here"}
    assert rows_of(documents([(i, t, "en", "s", 1) for i, t in docs.items()])) == brute_rows(docs)


def test_other_gram_sizes_and_thresholds(documents, prose, words):
    rng = np.random.default_rng(6)
    base = [prose(60) for _ in range(10)]
    docs = dict(enumerate(base + [near(t, words, rng, 0.1) for t in base]))
    for threshold in (0.3, 1.0):
        assert rows_of(documents([(i, t, "en", "s", 1) for i, t in docs.items()]), threshold=threshold) == brute_rows(docs, threshold)


def test_a_large_group_of_near_copies(documents, prose, words):
    rng = np.random.default_rng(7)
    t = prose(100)
    docs = {i: near(t, words, rng, 0.03) for i in range(300)}
    assert rows_of(documents([(i, x, "en", "s", 1) for i, x in docs.items()], False)) == brute_rows(docs)


def test_tiles_parts_and_hot_sets_change_nothing(monkeypatch, documents, prose, words):
    for name, value in (("TILE", 16), ("BLOCK", 20), ("BLOCK_GRAMS", 3000), ("HOT", 3), ("_SEEN", 5)):
        monkeypatch.setattr(J, name, value)
    rng = np.random.default_rng(9)
    t = prose(60)
    docs = dict(enumerate([near(t, words, rng, 0.04) for _ in range(150)] + [t] * 30 + [prose(30) for _ in range(20)]))
    frame = documents([(i, x, "en", "s", 1) for i, x in docs.items()], False)
    assert rows_of(frame) == brute_rows(docs)


def test_a_hot_gram_goes_to_blocks_of_bounded_size(spark):
    """One gram in 200,000 sets: rows for blocks of two tiles, over several tasks."""
    m = 200_000
    index = spark.range(m).selectExpr("7L as gram", "xxhash64(id) as sig", "int(3 + id % 3000) as size", "2 as rest")
    blocks = J._blocks(spark, index.union(spark.range(40).selectExpr("id + 100 as gram", "xxhash64(id div 2) as sig", "5 as size", "1 as rest")))
    size = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    tiles = 256
    assert max(size.values()) < 4 * J.TILE and len(size) == tiles * (tiles + 1) // 2
    assert sum(size.values()) == m * tiles


def test_hot_runs_pair_as_short_ones(monkeypatch, spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(s), int(n), int(rng.integers(0, 9))) for s in range(90) for n in [rng.integers(3, 30)] for g in rng.choice(6, 4, replace=False)]
    index = spark.createDataFrame(rows + rows[:50], "gram long, sig long, size int, rest int")
    got = []
    for tile in (1024, 4):
        monkeypatch.setattr(J, "TILE", tile)
        got.append({tuple(r) for r in J.candidates(index).collect()})
    assert got[0] == got[1] and len(got[0]) > 20


def test_join_on_odd_rows(odd, nothing):
    assert {r for r in rows_of(odd) if r[2]} == {(1, 1, 1), (2, 1, 1), (7, 7, 1), (8, 7, 1)}
    assert {r[0] for r in rows_of(odd)} == set(range(1, 10))
    kept = J.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 1, 3, 4, 5, 6, 7, 9]
    assert kept.filter("doc_id is null").count() == 1
    assert J.ngram_jaccard_join(nothing).count() == 0
    assert J.drop_near_copies(nothing).count() == 0
    assert J.similar_sets(nothing).count() == 0


def test_ids_may_be_strings_and_come_with_several_texts(documents, prose, words):
    rng = np.random.default_rng(12)
    a, b = prose(90), prose(90)
    texts = [(1, a), (2, near(a, words, rng, 0.02)), (3, a), (3, b), (4, b), (4, b), (5, prose(40))]
    frame = documents([(i, t, "en", "s", 1) for i, t in texts], False).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert rows_of(frame) == {("d1", "d1", 2), ("d2", "d1", 2), ("d3", "d1", 3), ("d4", "d1", 1), ("d5", "d5", 0)}
    assert sorted(r.doc_id for r in J.drop_near_copies(frame).collect()) == ["d1", "d5"]


def test_groups_follow_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(1, 40)] + [(100, 101, 0.9)], "doc_a long, doc_b long, jaccard double")
    got = {r.doc_id: r.keeper for r in J.groups(pairs).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def brute_repeats(docs, length):
    where = {}
    for i in sorted(docs):
        w = tokens(docs[i])
        for q in range(len(w) - length + 1):
            where.setdefault(tuple(w[q : q + length]), []).append((i, q))
    hit, later = {}, {}
    for places in where.values():
        if len(places) > 1:
            for n, (i, q) in enumerate(sorted(places)):
                hit.setdefault(i, set()).add(q)
                if n:
                    later.setdefault(i, set()).update(range(q, q + length))
    out = set()
    for i, starts in hit.items():
        run = None
        for q in sorted(starts):
            if run and q <= run[1]:
                run[1] = q + length
            else:
                if run:
                    out.add((i, *run))
                run = [q, q + length]
        out.add((i, *run))
    return {(i, a, b, len([x for x in later.get(i, ()) if a <= x < b])) for i, a, b in out}, later


@pytest.mark.parametrize("hot", [D.HOT, 3])
def test_repeats_equal_brute_force(monkeypatch, documents, prose, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rng = np.random.default_rng(8)
    parts = [prose(int(n)) for n in rng.integers(8, 60, 12)]
    for length, k in ((12, 4), (20, 5), (10, 10)) if hot > 3 else ((12, 4),):
        docs = {i: " ".join(x for p in rng.choice(12, 4) for x in (prose(int(rng.integers(0, 9))), parts[p])) for i in range(40)}
        frame = documents([(i, t, "en", "s", 1) for i, t in docs.items()])
        want, later = brute_repeats(docs, length)
        got = D.repeated_passages(frame, length, k)
        assert {tuple(r) for r in got.select("doc_id", "word_start", "word_end", "later_words").collect()} == want
        kept = {r.doc_id: tokens(r.text) for r in D.drop_repeats(frame, length, k).collect()}
        for i, t in docs.items():
            left = [w for n, w in enumerate(tokens(t)) if n not in later.get(i, ())]
            assert kept.get(i, []) == left


def test_three_copies_that_share_different_sides(documents, prose):
    left, mid, right, other = prose(8), prose(6), prose(12), prose(8)
    docs = {1: f"{left} {mid} {right}", 2: f"{other} {mid} {right}", 3: f"{left} {mid} {prose(12)}", 4: f"{left} {mid} {prose(12)}"}
    got = D.repeated_passages(documents([(i, t, "en", "s", 1) for i, t in docs.items()]), 12, 4)
    assert {tuple(r) for r in got.select("doc_id", "word_start", "word_end", "later_words").collect()} == brute_repeats(docs, 12)[0]


def test_repeats_on_odd_rows(odd, nothing):
    got = D.repeated_passages(odd)
    assert {r.doc_id for r in got.collect()} == {1, 2, 7, 8}
    kept = D.drop_repeats(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert kept.filter("doc_id = 8").first().text.strip() == "start"
    assert kept.filter("doc_id = 8").first().n_chars == 6
    assert D.repeated_passages(nothing).count() == 0
    assert D.drop_repeats(nothing).count() == 0


def test_blank_remains_and_string_ids(documents, prose):
    shared = prose(60)
    texts = {1: shared, 2: f"\n\t{shared}", 3: "\n\t", 4: f"{shared} \n", 5: f"{shared} more", 10: prose(60)}
    frame = documents([(i, t, "en", "s", 1) for i, t in texts.items()], False).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in D.repeated_passages(frame).collect()} == {"d1", "d2", "d4", "d5"}
    kept = {r.doc_id: r.text for r in D.drop_repeats(frame).collect()}
    assert kept.keys() == {"d1", "d3", "d5", "d10"} and kept["d5"] == "more" and kept["d1"] == shared


@pytest.mark.parametrize("hot", [D.HOT, 1])
def test_rows_that_repeat_id_and_text_keep_it(monkeypatch, documents, prose, hot):
    monkeypatch.setattr(D, "HOT", hot)
    twice, shared = prose(80), prose(70)
    texts = [(1, twice), (1, twice), (2, shared + " " + prose(60)), (2, shared + " " + prose(60)), (3, prose(55))]
    for rows in (texts[:2], texts, texts[2:4]):
        frame = documents([(i, t, "en", "s", len(t)) for i, t in rows])
        assert D.repeated_passages(frame).count() == 0
        assert sorted((r.doc_id, r.text) for r in D.drop_repeats(frame).select("doc_id", "text").collect()) == sorted(rows)
    # A third copy under another id goes, whichever of them is read first.
    for other in (0, 5):
        frame = documents([(i, t, "en", "s", len(t)) for i, t in [*texts[:2], (other, twice), (other, twice)]])
        kept = sorted((r.doc_id, r.text) for r in D.drop_repeats(frame).select("doc_id", "text").collect())
        assert kept == [(min(1, other), twice)] * 2
        assert {tuple(r) for r in D.repeated_passages(frame).select("doc_id", "word_start", "word_end", "later_words").collect()} == {(min(1, other), 0, 80, 0), (max(1, other), 0, 80, 80)}
