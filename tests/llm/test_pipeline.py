"""The pipeline against brute force, and the registered queries against SQL."""

import os
import random
import tempfile

import duckdb
import pytest
from helpers import docs, rows
from test_exact_shard_decon import brute_decon
from test_repeats_near import brute_near, edited

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark):
    """Copies, near copies, benchmark passages and texts without letters, in a folder like the given ones."""
    rng = random.Random(21)
    en, de = ("the of and that with thing er ing cat dog".split(), "der die und mit ein sch ung heit katze hund".split())
    texts, langs = [], []
    for lang, vocab in (("en", en), ("de", de)):
        for _ in range(15):
            words = [rng.choice(vocab) + rng.choice(vocab) for _ in range(60)]
            texts += [" ".join(words), edited(rng, words, 1), " ".join(words)]
            langs += [lang] * 3
    items = [(i, " ".join(rng.choice(en) + rng.choice(en) + "q" for _ in range(12))) for i in range(4)]
    texts += [f"{texts[0][:80]} and {items[1][1]} so", None, "", "12 34 !!", items[2][1][:30], texts[4]]
    langs += ["en", None, None, "en", None, "en"]
    ids = rng.sample(range(1000), len(texts))
    d = tempfile.mkdtemp(prefix="vigil-pipe-", dir="/tmp")
    docs(spark, texts, ids, langs).drop("kept", "_id").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(zip(ids, texts)), items


def brute(texts, items):
    """Ids after each stage but the last."""
    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    out = [set(left)]
    newest = {}
    for i, t in left.items():
        newest[t] = max(i, newest.get(t, i))
    left = {i: t for i, t in left.items() if newest[t] == i}
    out.append(set(left))
    ids = list(left)
    kept = {r[0] for r in brute_near([left[i] for i in ids], 5, 80, ids) if r[3]}
    left = {i: t for i, t in left.items() if i in kept}
    out.append(set(left))
    ids = list(left)
    dirty = {ids[r[0]] for r in brute_decon([left[i] for i in ids], items, 10) if r[5]}
    out.append(set(left) - dirty)
    return out


def test_stages(spark, small):
    d, texts, items = small
    frame = spark.read.parquet(f"{d}/documents.parquet")
    want = brute(texts, items)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        frame = stage(spark, before, d)
        if k < 4:
            assert frame.columns == COLUMNS, name
            assert {r.doc_id for r in frame.collect()} == want[k], name
            assert rows(frame, *COLUMNS) == rows(before.where(before.doc_id.isin(list(want[k]))), *COLUMNS)
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 0
    got = frame.collect()
    assert {r.doc_id for r in got} == want[3] and all(r.decodes and r.n_ids == len(r.ids) > 0 for r in got)


def test_run(spark, small):
    d, texts, items = small
    got = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in got.collect()} == brute(texts, items)[3]


def test_repeated_ids_and_empty_table(spark, small):
    d, _, items = small
    text = "the cat and the dog with that thing of the cat " * 3
    frame = docs(spark, [text, text, "", None, text + "x"], [5, 5, 5, None, None], ["en"] * 5).drop("kept", "_id")
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, d)
    assert frame.count() == 1  # one of the group of copies and near copies
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, d)
    assert empty.count() == 0


@pytest.mark.parametrize("langs", [[None] * 5, ["en", "en", "und", "und", "en"], ["und"] * 5])
def test_language_stage_drops_only_letterless_texts(spark, langs):
    texts = ["the cat and the dog " * 20, "日本語", "12 34 !! " * 40, None, "é"]
    frame = docs(spark, texts, langs=langs).drop("kept", "_id")
    assert rows(corpus_pipeline.language_stage(spark, frame, ""), *COLUMNS) == rows(frame.where("doc_id in (0, 1, 4)"), *COLUMNS)


def test_stages_leave_columns_with_inner_names_alone(spark, small):
    d, texts, _ = small
    frame = spark.read.parquet(f"{d}/documents.parquet").selectExpr(
        "*", "'mine' as _gone", "'mine' as _lang_pred", "'mine' as _lang_score", "'mine' as _has_letter", "'mine' as n",
        "'mine' as _row")
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, d)
        assert frame.columns[5:] == ["_gone", "_lang_pred", "_lang_score", "_has_letter", "n", "_row"], name
        got = frame.collect()
        assert got and {x for r in got for x in r[5:]} == {"mine"}, name


# -- registered queries -----------------------------------------------------------------

def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_warc", "op3_decontaminate", "op6_exact_dedup", "op7_near_dedup"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert rows(got, *cols) == sorted(cur.fetchall(), key=repr)


CONTRACT = {
    "op2_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_sentencepiece": {"doc_id", "ids", "n_ids", "round_trip"},
    "op9_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op10_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_one_row_per_document(spark, name):
    got = entry.queries()[name](spark, SF)
    assert CONTRACT[name] <= set(got.columns)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.count() == n == got.select("doc_id").distinct().count()
    if name == "op8_sentencepiece":
        assert got.where("not round_trip").count() == 0


def test_suffix_dedup_on_the_table(spark):
    from test_repeats_near import COLS, brute_repeats

    table = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = rows(entry.queries()["op2_suffix_dedup"](spark, SF), *COLS)
    want = brute_repeats([r.text for r in table], 100)
    assert got == sorted(((table[w[0]].doc_id, *w[1:]) for w in want), key=repr)
