import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sparkvane.llm import ordered, prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie by dictionaries, from the contract's words."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def below(k):
        todo, leaves, saved = [k], 0, 0
        while todo:
            x = todo.pop()
            todo += kids[x]
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * len(x[-1][1]) if x else 0
        return leaves, saved

    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return prefixtrie.prefix_trie(*prefixtrie.paths(prefixtrie.turns_of(df)))


def results(out):
    return sorted(map(tuple, out.drop("enter_at", "leave_at").collect()), key=repr)


def planted(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 130), 250, 251, 260, *range(1000, 1020)]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "ünï", "go on", "x" * 9])))
    rows += [(7, None, None, None), (7, None, "user", "first"), (None, 1, "user", "lost"), (8, 0, "user", "again"), (8, 0, "user", "again"), (-105, 0, "user", "hi"), (-100, 0, "user", "base")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = planted(seed)
    assert results(run(spark, rows)) == brute(rows)


def test_long_conversation_hot_first_turn_and_identical_copies(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK_IDS", 3)
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]
    rows += [(c, 0, "user", "same") for c in range(300, 330)] + [(c, 1, "user", f"{c}") for c in range(300, 330)]
    assert results(run(spark, rows)) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    taken = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = [(c, 0, "user", "only") for c in taken]  # conversation 100 is absent
    got = results(run(spark, rows))
    assert got == brute(rows) == [(taken[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, taken)).encode()).hexdigest())]


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [], SCHEMA).count() == 0
    rows = planted(3)
    wide = [(*x, 1, "p", 2, 3.0) for x in rows]
    assert results(run(spark, wide, SCHEMA + ", depth int, parent string, id int, h double")) == brute(rows)


def test_tour_positions_nest(spark):
    """A node's arcs enclose those of its subtree, and all positions are taken once."""
    out = run(spark, planted(4)).collect()
    places = sorted(x for r in out for x in (r.enter_at, r.leave_at))
    assert places == list(range(2 * len(out)))
    for a in out:
        inside = [b for b in out if a.enter_at <= b.enter_at and b.leave_at <= a.leave_at]
        assert sum(b.n_children == 0 for b in inside) == a.n_leaves


@pytest.fixture
def many_parts(spark):
    """Ranges stay as they are dealt, however small."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def test_trie_over_many_parts(spark, many_parts):
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(300)] + [(c, t, "user", "same") for c in range(200, 230) for t in range(3)]
    assert results(run(spark, rows)) == brute(rows)


def test_scans_carry_over_boundaries(spark, many_parts):
    """One group over many ranges: numbers, running sums and next rows equal those of one list."""
    r = random.Random(5)
    rows = [("hot", i, r.getrandbits(62)) for i in range(400)] + [(f"g{i % 9}", i, r.getrandbits(62)) for i in range(60)]
    df = ordered.dealt(spark.createDataFrame(rows, "g string, i long, x long"), "t", ["g"], ["i"])
    assert df.where("g = 'hot'").select(ordered.PART).distinct().count() > 1
    got = ordered.followed(ordered.xored(ordered.counted(df, ["g"], ["i"], "pos"), ["g"], ["i"], "x"), ["g"], "i", ordered.F.col("i"), "after")
    want, state = [], {}
    for g, i, x in sorted(rows):
        n, acc = state.get(g, (0, 0))
        state[g] = n + 1, acc ^ x
        want.append((g, i, state[g][1], n + 1))
    assert sorted((a.g, a.i, a.x, a.pos) for a in got.collect()) == want
    by = defaultdict(list)
    for g, i, _ in sorted(rows):
        by[g].append(i)
    assert {(a.g, a.i): a.after for a in got.collect()} == {(g, i): n for g, v in by.items() for i, n in zip(v, [*v[1:], None], strict=True)}
