"""Language ID, toxicity and personal data: brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import docs, rows
from pyspark.sql import functions as F

from vigil.llm import language, toxicity
from vigil.llm import personal_data as personal
from vigil.llm.personal_data import HEAD, KINDS, PIECE, TAIL, as_text, matches, personal_data

SF = "/root/testdata/sf0.01"


# -- language ID ------------------------------------------------------------------------

def brute_phrases(sample, text):
    """Greedy cross parsing with ``in``: phrases end at separators of nothing but the longest match."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_cross_parsing(monkeypatch):
    rng = random.Random(1)
    samples = {x: "".join(rng.choices("abcd ", weights=w, k=300)) for x, w in (("x", (5, 1, 1, 2, 1)), ("y", (1, 5, 2, 1, 1)))}
    m = language.fit(samples)
    texts = ["".join(rng.choices("abcdé ", k=rng.randrange(1, 200))) for _ in range(30)] + ["a", "é", "   ", "zz zz"]
    coded = [language.encode(m.letters, t) for t in texts]
    text_of = lambda c: "".join(chr(200 + int(v)) for v in c)
    got = language.phrases(m, coded)
    for i, lang in enumerate(m.langs):
        sample = text_of(language.encode(m.letters, samples[lang])[:language.SAMPLE_CHARS])
        assert got[i].tolist() == [brute_phrases(sample, text_of(c)) for c in coded]
    monkeypatch.setattr(language, "SEGMENT", 7)
    got = language.phrases(m, coded)
    for i, lang in enumerate(m.langs):
        sample = text_of(language.encode(m.letters, samples[lang]))
        assert got[i].tolist() == [sum(brute_phrases(sample, text_of(c)[s:s + 7]) for s in range(0, len(c), 7)) for c in coded]


def test_language_rules(spark):
    en, de = "the cat and the dog with that thing " * 10, "der hund und die katze mit dem schönen ding " * 10
    texts = [en, de, en, de, None, "", "12 !?", "the thing", "schönen", "日本語", en * 400]
    langs = ["en", "de", "en", "de", "en", None, "de", None, None, None, None]
    got = {r.doc_id: r for r in language.language_id(docs(spark, texts, langs=langs)).collect()}
    assert [got[i].lang_pred for i in range(9)] == ["en", "de", "en", "de", "und", "und", "und", "en", "de"]
    assert got[10].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert got[4].score == 0 and got[9].lang_pred in ("en", "de")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert rows(language.language_id(docs(spark, ["a"])), "lang_pred", "score") == [("und", 0.0)]
    assert language.language_id(docs(spark, [])).count() == 0
    # Ids, sources and labels of the scored rows don't matter.
    other = language.identify(docs(spark, texts, ids=[None] * 11), language.fit({"en": en, "de": de}))
    assert {r.text: r.lang_pred for r in other.collect()}[de] == "de"


def test_small_samples_win_nothing(spark):
    """A rare label with one short row, a row without letters or the label 'und' takes no texts of the others."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    texts, langs = [r.text for r in d], [r.lang for r in d]
    samples = {la: " ".join(t for t, x in zip(texts, langs) if x == la and t) for la in set(langs) - {None}}
    odd = {"aa": "ok", "bb": "e", "cc": "12 -- 34 " * 50, "dd": "the quick brown fox jumps over the lazy dog", "und": "le chat et la maison"}
    assert not set(language.fit(samples | odd).langs) & {"cc", "und"}
    got, _ = language.classify(language.fit(samples | odd), texts)
    assert got == language.classify(language.fit(samples), texts)[0] and not set(got) & set(odd)
    # Rows without a letter don't use up a label's rows, whatever their hash.
    rare = docs(spark, ["12 34 " * 50 + str(i) for i in range(200)] + ["ok then"], langs=["xx"] * 201)
    assert language.sample(rare, "lang", "text") == {"xx": "ok then"}


def test_scripts_with_many_letters():
    """Three scripts of 900 letters each: all letters of the samples stay apart."""
    rng = random.Random(4)
    scripts = {"a": 0x4E00, "b": 0x6000, "c": 0xAC00}
    letters = {k: [chr(at + i) for i in range(900)] for k, at in scripts.items()}
    made = lambda own, n: " ".join("".join(rng.choice(own) for _ in range(3)) for _ in range(n))
    model = language.fit({k: made(own, 2500) for k, own in letters.items()})
    assert model.letters.width < language.SPELT
    for k, own in letters.items():
        assert language.classify(model, [made(own[300:], 12) for _ in range(100)])[0] == [k] * 100
    coded = {language.encode(model.letters, c).tobytes() for own in letters.values() for c in own}
    assert len(coded) == 2700


def test_repeated_labelled_ids_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 5)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 7)
    d = docs(spark, [f"text {i}" for i in range(300)], ids=[3] * 100 + [4] * 100 + list(range(5, 105)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 90)], "doc_id long, toxic int")
    texts, marks = toxicity.labelled_sample(d, labels, "doc_id", "text", "toxic", 5, 99)
    assert len(texts) == 12 and sum(marks) == 5


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 250 and right > 0.97


# -- toxicity ---------------------------------------------------------------------------

def test_toxicity_accuracy(spark):
    """Held-out rows: every English text that holds a marked word of the labelled kind is found."""
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in got if r.toxic == 0]
    assert len(clean) > 40 and np.mean([r.predicted for r in clean]) < 0.05
    bad = [r.score for r in got if r.toxic == 1]
    pairs = [(b > c.score) + 0.5 * (b == c.score) for b in bad for c in clean]
    assert np.mean(pairs) > 0.6


def test_toxicity_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(30)) + (" idiot" if i % 4 == 0 else "") for i in range(200)]
    d = docs(spark, [*texts, None, "", "you idiot", "IDIOTS!"])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(200)] + [(999, 1, "x"), (None, 1, "x"), (3, None, "x")],
                                   "doc_id long, toxic int, score string")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert got[202].predicted == got[203].predicted == 1 and got[200].score == got[201].score < 0.5
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    one = toxicity.toxicity(d, labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(one) == 1 and 0 < one[0].score < 0.5
    assert toxicity.toxicity(d, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


def test_labels_of_the_held_out_fold_are_unused(spark):
    texts = [f"word{i} idiot" if i % 2 else f"word{i} fine" for i in range(60)]
    marks = [(i, i % 2) for i in range(60)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    a, b = (rows(toxicity.toxicity(docs(spark, texts), spark.createDataFrame(m, "doc_id long, toxic int")), "doc_id", "score")
            for m in (marks, turned))
    assert a == b


# -- personal data ----------------------------------------------------------------------

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(d):
    v = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(v)) % 10 == 0


def fine(kind, s):
    d = re.sub(r"\D", "", s, flags=re.A)
    return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else 0,
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute_base(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in BASE[k].finditer(text or "") if fine(k, m[0])]


def check_base(spark, texts):
    got = personal_data(docs(spark, texts)).withColumn("b", as_text(F.col("base"))).withColumn("f", as_text(F.col("found"))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert r.b == ",".join(f"{k}:{a}:{b}" for k, a, b in want), (texts[r.doc_id], r.b)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS]
        assert set(r.b.split(",")) - {""} <= set(r.f.split(","))
    return {r.doc_id: r for r in got}


def test_base_patterns(spark):
    texts = ["a@b.com+x@y.org", "é a.b%c@x-y.co.uk. z", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1", "1.2.3", None, "",
             "4111 1111 1111 1111 and 4111-1111-1111-1111.", "4111111111111111 4111111111111111", "4111 1111 1111 1112",
             "+1 (017) 555-7713 +49.30-12345 +1+2", "😀 x@y.zz 😀 +123456789", "a@b.c@d.e", "@.@", "+1", "..a@b.c-", "1.2.3.4@5.6",
             "9" * 19, "9" * 20_000, "a" * 20_000 + "@b.c", "+1" + " " * 5_000, "x@y.z " * 2_000]
    check_base(spark, texts)
    rng = random.Random(12)
    check_base(spark, ["".join(rng.choices("a1.@+- (é\n0", k=rng.randrange(60))) for _ in range(400)])


def test_base_on_the_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in d}
    got = personal_data(spark.read.parquet(f"{SF}/documents.parquet")).withColumn("b", as_text(F.col("base"))).collect()
    for r in got:
        assert r.b == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(texts[r.doc_id]))


def test_bootstrap(spark):
    """'my mail is' comes with enough emails to vouch for a masked one; 'order no' comes with anything."""
    texts = [f"hello my mail is user{i}@host{i}.org thanks" for i in range(8)]
    texts += ["hello my mail is jane(at)host7 thanks", "the order no 12345-77 thanks", "the order no 1.2.3.4 x", "the order no 777888 x"]
    got = check_base(spark, texts)
    assert got[8].f == "email:17:29" and texts[8][17:29] == "jane(at)host" or got[8].f.startswith("email:17:")
    assert got[9].f == "" and got[11].f == ""
    # Copies of one sentence are one instance: no support.
    got = check_base(spark, ["say my mail is a@b.cc now"] * 9 + ["say my mail is x9(at)b now"])
    assert got[9].f == ""


def test_bootstrap_beside_other_identifiers(spark):
    """Words of a context that hold digits are context like any other, for base spans and for tokens."""
    texts = [f"contact 24x7 user{i}@host{i}.org" for i in range(9)]
    texts += ["contact 24x7 jane7(at)host7", f"{'reach ' * 9}contact   24x7\n jane8(at)host8"]
    got = check_base(spark, texts)
    assert got[9].f == "email:13:27" and texts[9][13:27] == "jane7(at)host7"
    assert texts[10].index("jane8") == int(got[10].f.split(":")[1])
    # Listed and grouped: the part behind another part, with brackets.
    texts = [f"mails a1 (user{i}@host{i}.org) x2" for i in range(9)] + ["mails a1 (jane7[at]host7) x2 b3", "no a1 jane7[at]host7 x2"]
    got = check_base(spark, texts)
    assert texts[9][10:24] == "jane7[at]host7" and got[9].f == "email:10:24" and got[10].f == ""


def test_slots_hold_any_characters(spark):
    """Accepted patterns find words without digits, spaced numbers and long keys; a context of prose finds nothing."""
    texts = [f"é hello my mail is user{i}@host{i}.org thanks" for i in range(12)]
    texts += [f"please call on +49 30 {5550000 + i} today" for i in range(12)]
    texts += [f"she wrote to user{i}@host{i}.net" for i in range(4)] + [f"she wrote to {w}" for w in "him her them mother us me".split()]
    key = "k1" + "x" * 90
    want = {"é hello my mail is   jane(at)host.org, thanks": "email:jane(at)host.org", "hello my mail is jane[at]host.org thanks": "email:jane[at]host.org",
            f"hello my mail is {key} thanks": f"email:{key}", "please call on 030 (555) 1234x today": "phone:030 (555) 1234x"}
    first = len(texts)
    got = check_base(spark, texts + list(want))
    for i, (text, span) in enumerate(want.items(), first):
        kind, a, b = got[i].f.split(":")
        assert f"{kind}:{text[int(a):int(b)]}" == span
    assert all(got[i].f == got[i].b for i in range(first))


def test_slots_across_pieces(spark):
    """A slot is found wherever the cuts between pieces of a text fall, whatever white space lies there."""
    texts = [f"please call on +49 30 {5550000 + i} today" for i in range(12)]
    first, rng = len(texts), random.Random(3)
    for n in range(PIECE - 7, PIECE + 3):
        gaps = rng.choices([" ", "  ", "\n", "\t \n" * 40], k=2 * n + 20)
        words = [f"é{'abcdefghij'[i % 10]}" for i in range(n)] + "please call on 030 (555) 1234x today".split()
        words += [f"w{'abcdefghij'[i % 10]}" for i in range(n)]
        texts.append(gaps[0] + "".join(w + g for w, g in zip(words, gaps[1:])))
    got = check_base(spark, texts)
    for i in range(first, len(texts)):
        kind, a, b = got[i].f.split(":")
        assert kind == "phone" and re.sub(r"\s+", " ", texts[i][int(a):int(b)]) == "030 (555) 1234x"
    assert all(got[i].f == got[i].b for i in range(first))


def test_context_of_matches(spark):
    """Tail and head are the text at a match's ends, whitespace runs as one."""
    rng = random.Random(8)
    texts = ["".join(rng.choices(["12 ", "a", "x@y.zz ", "\n \t", "é", "1.2.3.4", "+491234567", " ", "7"], k=60)) for _ in range(40)]
    flat = lambda t: re.sub(r"\s+", " ", t)
    for r in matches(docs(spark, texts).selectExpr("doc_id AS _k", "text AS _text")).collect():
        t = texts[r._k]
        assert t[r.start:r.end] == r.value
        assert r.tail == flat(t[:r.start])[-len(r.tail):] and len(r.tail) == min(TAIL, len(flat(t[:r.start])))
        assert r.head == flat(t[r.end:])[:HEAD]


def test_texts_are_scanned_once(spark, monkeypatch):
    """Each pattern, also the one that cuts pieces, goes over a text once: no filter finds its matches anew."""
    plans, cut = {}, personal.Scratch.cut

    def noted(self, df, what, *folders):
        plans[what] = df._jdf.queryExecution().optimizedPlan().toString()
        return cut(self, df, what, *folders)

    monkeypatch.setattr(personal.Scratch, "cut", noted)
    texts = [f"please call on +49 30 {5550000 + i} today" for i in range(12)] + ["please call on 030 (555) 1234x today"]
    assert check_base(spark, texts)[12].f == "phone:15:30"
    assert plans["spans"].count("regexp_extract_all(") == len(personal.PATTERNS) + 1
    assert plans["hits"].count(f"{{1,{PIECE}}}+") == 1


def test_personal_data_odd_tables(spark):
    assert personal_data(docs(spark, [])).count() == 0
    got = rows(personal_data(docs(spark, ["a@b.cc", "a@b.cc", None], [1, 1, None])), "doc_id", "n_email")
    assert got == sorted([(1, 1), (1, 1), (None, 0)], key=repr)
    plan = personal_data(docs(spark, ["a@b.cc"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text,want", [("", hashlib.sha256(b"").hexdigest())])
def test_digest_of_nothing(spark, text, want):
    got = personal_data(docs(spark, [text])).select(F.sha2(as_text(F.col("base")), 256).alias("s")).first().s
    assert got == want
