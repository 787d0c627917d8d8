"""Property tests (hypothesis) for scorers, dedup, throttle and vocabulary."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigil import rules
from vigil.functions import scalars as S
from vigil.operators import features as M
from vigil.operators import sets as X
from vigil.operators.throttle import throttle_batch

FAST = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
words = st.sampled_from(rules.THREAT_KEYWORDS + ["ls", "echo", " ", "x"])


@FAST
@given(st.lists(st.lists(words, max_size=6), min_size=1, max_size=8),
       st.floats(0, 100), st.floats(0, 100))
def test_threat_score_bounded_and_monotone(spark, cmds, cpu, mem):
    rows = [(" ".join(c), cpu, mem) for c in cmds]
    rows += [(" ".join(c) + " wget", cpu, mem) for c in cmds]  # one more keyword
    df = spark.createDataFrame(rows, "command string, cpu double, memory double")
    scores = [r[0] for r in df.select(S.threat_score(df)).collect()]
    assert all(0 <= s <= 100 for s in scores)
    n = len(cmds)
    assert all(scores[n + i] >= scores[i] for i in range(n))


@FAST
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=30))
def test_dedup_first_idempotent_and_keeps_min_id(spark, pairs):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "id long, k int, v int")
    once = X.dedup_first(df, ["k"], ["id"])
    twice = X.dedup_first(once, ["k"], ["id"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    first = {}
    for i, (k, _) in enumerate(pairs):
        first.setdefault(k, i)
    assert sorted(r.id for r in once.collect()) == sorted(first.values())


@FAST
@given(st.lists(st.integers(0, 72 * 60), min_size=1, max_size=40))
def test_throttle_subset_with_gaps(spark, minutes):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)],
                               "id long, timestamp timestamp")
    got = sorted((r.timestamp, r.id) for r in throttle_batch(df).collect())
    assert got, "the first alert always passes"
    assert got[0][0] == t0 + dt.timedelta(minutes=min(minutes))
    assert all(b[0] - a[0] >= dt.timedelta(hours=4) for a, b in zip(got, got[1:]))
    assert {i for _, i in got} <= set(range(len(minutes)))


@FAST
@given(st.lists(st.text(alphabet="abcxyz ", min_size=0, max_size=5), min_size=1, max_size=25))
def test_vocab_round_trip(spark, labels):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(labels)], "id long, command string")
    vocab = M.fit_vocab(df, ["command"])
    codes = {r.label: r.code for r in vocab.collect()}
    assert sorted(codes.values()) == list(range(len(set(labels))))
    assert [lab for lab, _ in sorted(codes.items(), key=lambda kv: kv[1])] == sorted(set(labels))
    enc = {r.id: r.command_encoded for r in M.encode(df, vocab, ["command"]).collect()}
    assert all(enc[i] == codes[s] for i, s in enumerate(labels))
