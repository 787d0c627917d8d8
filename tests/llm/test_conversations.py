"""Conversation repair against a plain search over all edits, and its parts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import rows

from vigil.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, _c string, _row int, _d int, _k string"
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in data], SCHEMA)


def plain_damage(data):
    out = []
    for c, t, role, text in data:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        d, role, text = zlib.crc32(key.encode()) % 20, role if role is not None else " ", text if text is not None else " "
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def plain_faults(seq):
    seen, out = set(), []
    for role, text in seq:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(seq, found):
    """Least (cost, audit) and its lines: all states with whole audits, insertions anywhere."""
    states = {"": (0, "", ())}  # keyed by the last initial

    def more(out, key, cost, text, line):
        if key not in out or (cost, text) < out[key][:2]:
            out[key] = (cost, text, line)

    def inserted(states):
        for _ in range(4):
            for k, (c, w, t) in list(states.items()):
                role = "assistant" if k == "u" else "user"
                more(states, role[0], c + 3, w + "I", (*t, role + ":"))
        return states

    for (role, text), fault in zip(seq, found):
        nxt = {}
        for k, (c, w, t) in inserted(states).items():
            more(nxt, k, c + 4, w + "D", t)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            want = "assistant" if k == "u" else "user"
            more(nxt, want[0], c + 3 + extra, w + "R", (*t, f"{want}:{text}"))
            if role[:1] == want[0] or (k == "" and role[:1] == "s"):
                more(nxt, role[0], c + extra, w + "K", (*t, f"{role}:{text}"))
        states = nxt
    return min(v for k, v in inserted(states).items() if k in ("", "a"))


def brute(data, keep):
    out = []
    for c in {r[0] for r in keep}:
        own = [r[1:] for r in data if r[0] == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seq = [r[1:] for r in own]
        found = plain_faults(seq)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(seq))
        cost, audit, lines = plain_repair(seq, found)
        out.append((c, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs=60, longest=14):
    """Turns are unique within a conversation, but for null ones in some."""
    rng, data = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            if rng.random() < 0.6:
                role = ["user", "assistant"][t % 2]
            text = rng.choice(["Yes.", "Yes.", "so what", "Well!\n ", "", " \t", None, f"text {t}?", f"cut {t}"])
            data.append((c, None if t == 0 and c % 7 == 0 else t * rng.choice([1, 1, 2]) * 20 + t, role, text))
    return data


@pytest.mark.parametrize("seed, size", [(1, 100_000), (2, 9), (3, 2)])
def test_against_all_edits(spark, monkeypatch, seed, size):
    monkeypatch.setattr(conv, "PIECE_ROWS", size)
    data = made(seed) + [(None, 1, "assistant", "Hi."), (None, 2, "user", "Ho.")]
    got = conv.audit(conv.damage(frame(spark, data).repartition(4)), frame(spark, data))
    assert got.columns == COLS
    assert rows(got, *COLS) == brute(plain_damage(data), data)


def test_undamaged_long_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(conv, "PIECE_ROWS", 7)
    rng = random.Random(5)
    data = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"a {t}.", f"b {t}", "", "same."])) for t in range(200)]
    data += [(2, t, "user", "same.") for t in range(60)]  # one text: all but one row must go
    data += [(3, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(30)]
    got = conv.audit(frame(spark, data), frame(spark, data))
    assert rows(got, *COLS) == brute(data, data)


@pytest.mark.parametrize("seed", range(6))
def test_survivors(seed):
    """The search alone: its audit is the least, and what it holds stays small."""
    rng, held = random.Random(seed), 0
    for _ in range(150):
        seq = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b"])) for _ in range(rng.randint(1, 25))]
        found = ["truncated" if text == "b" else "" for _, text in seq]
        search, out = conv.Survivors(), []
        for k, ((role, _), fault) in enumerate(zip(seq, found)):
            out += search.step(k, role[0], fault == "truncated")
        cost, end, rest = search.finish(conv.END_COSTS)
        out += rest
        assert [r for r, _, _ in out] == list(range(len(seq)))
        want = plain_repair(seq, found)
        assert (cost + conv.END[end][0], "".join(w for _, _, w in out) + conv.END[end][1]) == want[:2]
        state, lines = conv.START, []
        for (k, before, word), (role, text) in zip(out, seq):
            assert before == state
            lead, new = conv.lines(state, word)
            lines += lead.split("\n")[:-1] + ([f"{new or role}:{text}"] if word != "D" else [])
            for c in word:
                state = {"s": conv.S, "u": conv.U, "a": conv.A}[role[0]] if c == "K" else conv.NEXT[state] if c in "IR" else state
        assert state == end and tuple(lines + conv.lines(end, conv.END[end][1])[0].split("\n")[:-1]) == want[2]


def nodes(search):
    found, todo = 0, [search.root]
    while todo:
        found += 1
        todo += todo.pop().kids
    return found


def test_memory_stays_bounded():
    search, most, out = conv.Survivors(), 0, 0
    for k in range(20_000):
        out += len(list(search.step(k, "ua"[k % 2], k % 5 == 0)))
        most = max(most, nodes(search))
    assert most < 60 and out > 19_900


@pytest.mark.parametrize("roles", ["x", "u", "a", "s", "uuaa", "xua"])
def test_long_runs(roles):
    """Survivors that tie to the end are kept, also over long runs."""
    search, n, out = conv.Survivors(), 3_001, []
    for k in range(n):
        out += search.step(k, roles[k % len(roles)], False)
    cost, end, rest = search.finish(conv.END_COSTS)
    word = "".join(w for _, _, w in [*out, *rest]) + conv.END[end][1]
    names = {"u": "user", "a": "assistant", "s": "system", "x": "x"}
    short = [(names[roles[k % len(roles)]], "t.") for k in range(61)]
    want = plain_repair(short, [""] * 61)
    search = conv.Survivors()
    less = [e for k, (role, _) in enumerate(short) for e in search.step(k, role[0], False)]
    c, e, rest = search.finish(conv.END_COSTS)
    assert (c + conv.END[e][0], "".join(w for _, _, w in [*less, *rest]) + conv.END[e][1]) == want[:2]
    assert len(word.replace("I", "")) == n


def test_ranks_order_whole_suffixes():
    rng = random.Random(11)
    for _ in range(300):
        search = conv.Survivors(rng.randrange(4))
        for k in range(rng.randint(1, 15)):
            list(search.step(k, rng.choice("suax"), rng.random() < 0.3))
            for (_, a, i), (_, b, j) in itertools.permutations(search.alive.values(), 2):
                assert conv.earlier(a, b) == (i < j)


def test_costs_of_a_run_equal_the_search():
    rng = random.Random(9)
    for _ in range(200):
        seq = [(rng.choice("suax"), rng.random() < 0.3) for _ in range(rng.randint(1, 12))]
        table, after = conv.costs(iter(seq)), conv.costs((rng.choice("suax"), False) for _ in range(rng.randint(0, 6)))
        after = [min(after[4 * p + q] + conv.END_COSTS[q] for q in range(4)) for p in range(4)]
        for p in range(4):
            search = conv.Survivors(p)
            for k, (first, cut) in enumerate(seq):
                list(search.step(k, first, cut))
            assert all(c == table[4 * p + q] for q, (c, _, _) in search.alive.items())
            # No survivor that was given up could have won or tied.
            least = min(table[4 * p + q] + after[q] for q in range(4))
            assert {q for q in range(4) if table[4 * p + q] + after[q] == least} <= set(search.alive)


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(conv, "PIECE_ROWS", 3)
    data = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Ho."), (2, 0, "system", "Be."), (2, 1, "user", "x."), (2, 2, "user", ""),
            (2, 3, "assistant", "y."), (3, 0, "user", ""), (None, None, "user", "z.")]
    got = conv.repair(frame(spark, data))
    by = {}
    for c, k, role, text in rows(got, "conv_id", "position", "role", "text"):
        by.setdefault(c, []).append((k, f"{role}:{text}"))
    for c in (1, 2, None):
        seq = [r[2:] for r in data if r[0] == c]
        assert tuple(line for _, line in sorted(by[c])) == plain_repair(seq, plain_faults(seq))[2]
        assert [k for k, _ in sorted(by[c])] == list(range(len(by[c])))
    assert 3 not in by


def test_repeated_rows_ties_and_empty_table(spark):
    data = [(1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "assistant", "Ho."), (1, None, "user", "A.")]
    one = rows(conv.audit(frame(spark, data), frame(spark, data)), *COLS)
    assert one == rows(conv.audit(frame(spark, data[::-1]), frame(spark, data)), *COLS)
    assert one[0][1:6] == (0, 0, 1, 0, 1)  # null turn first, then assistant, user, user
    assert conv.audit(frame(spark, []), frame(spark, [])).count() == 0
    gone = rows(conv.audit(frame(spark, []), frame(spark, data)), *COLS)
    assert gone == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_text(spark):
    text = "word " * 400_000 + "."
    data = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", text)]
    got = conv.audit(frame(spark, data), frame(spark, data))
    assert rows(got, *COLS) == brute(data, data)


def test_registered_query_equals_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    cur = con.execute(entry.oracle_sql()["op11_conversation_repair"])
    assert [c[0] for c in cur.description] == COLS
    got = entry.queries()["op11_conversation_repair"](spark, sf)
    want = sorted(cur.fetchall(), key=repr)
    assert rows(got, *COLS) == want
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert want == brute(plain_damage(data), data)
