import re
import subprocess
import sys
from collections import Counter
from itertools import combinations

import duckdb
import pytest

import corpus_pipeline
from orrery.llm import langid, ngram_join, packing, queries
from orrery.llm.common import cut, table

TABLES = "documents pages conversations".split()


@pytest.fixture(scope="module")
def staged(spark, sf):
    """What each stage keeps, as the next one reads it."""
    docs, out = table(spark, sf, "documents"), []
    out.append(docs)
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = cut(spark, f(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return out


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def test_each_stage_gives_the_columns_of_documents(staged):
    for df in staged[1:]:
        assert df.columns == staged[0].columns and [f.dataType for f in df.schema] == [f.dataType for f in staged[0].schema]


def test_language_stage_keeps_what_has_a_language(staged):
    before, after = ({r.doc_id: r for r in df.collect()} for df in staged[:2])
    judged = {r.doc_id: r for r in langid.identify(staged[0]).collect()}
    assert before.keys() - after.keys() == {i for i, r in judged.items() if r.ambiguous}
    assert len(after) > 0.99 * len(before)
    assert sum(after[i].lang == before[i].lang for i in after) > 0.97 * len(after)


def test_near_copies_stage_against_brute_force(staged):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in staged[1:3])
    n = ngram_join.N
    sets = {i: {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if (w := words(t)) else set() for i, t in before.items()}
    lead = {i: i for i in sets}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= ngram_join.THRESHOLD:
            x, y = sorted((top(a), top(b)))
            lead[y] = x
    assert set(after) == {i for i in sets if top(i) == i}
    assert all(after[i] == before[i] for i in after)


def test_repeats_stage_against_brute_force(staged):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in staged[2:4])
    seen, gone = set(), {}
    for i in sorted(before):
        w = words(before[i])
        for q in range(len(w) - 49):
            window = tuple(w[q : q + 50])
            if window in seen:
                gone.setdefault(i, set()).update(range(q, q + 50))
            seen.add(window)
    for i, t in before.items():
        left = [x for k, x in enumerate(words(t)) if k not in gone.get(i, ())]
        assert words(after.get(i, "")) == left
        if i not in gone:
            assert after[i] == t


def test_mix_stage_brings_sources_to_equal_weights(staged):
    before, after = staged[3], staged[4]
    by = Counter(r.source for r in after.select("source").collect())
    assert sum(by.values()) == before.count() and max(by.values()) - min(by.values()) <= 1
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_the_whole_run(spark, sf, staged):
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == Counter(map(tuple, packing.pack(staged[4]).collect()))
    assert sum(got.values()) == staged[4].count()


def test_stages_on_an_empty_table_and_on_odd_rows(spark, sf, odd, nothing):
    for docs in (nothing, odd):
        for _, f in corpus_pipeline.STAGES:
            docs = cut(spark, f(spark, docs, sf), "test-odd")
        assert docs.columns == ["doc_id", "n_tokens", "bucket", "bucket_length", "batch"]
    assert docs.count() > 0


def test_repeated_rows_pass_the_stages_whole(spark, sf, documents, prose):
    text = prose(80)
    docs = documents([(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, prose(70), "en", "a", 70)], False)
    for name, f in corpus_pipeline.STAGES[:3]:
        docs = cut(spark, f(spark, docs, sf), "test-repeated")
        assert [r.text for r in docs.filter("doc_id = 1").collect()] == [text, text], name


def test_tables_are_cut_in_the_folder_of_the_setting(tmp_path):
    """In a session of its own, as the setting is fixed when a session starts."""
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from orrery.llm.common import cut, release, shared_dir
assert shared_dir(s) == "file://{tmp_path}"
assert cut(s, s.range(3), "x").count() == 3
from pathlib import Path
assert list(Path("{tmp_path}").rglob("*.parquet"))
release(s)
assert not list(Path("{tmp_path}").rglob("*.parquet"))
"""
    subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0], check=True)


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE[name]).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda t: sorted((tuple(map(plain, r)) for r in t[columns].itertuples(index=False)), key=str)
    assert rows(a) == rows(b)


def test_language_query_covers_every_document(spark, sf):
    assert queries.op6_language_id(spark, sf).count() == table(spark, sf, "documents").count()
    assert langid.SAMPLE == 3000
