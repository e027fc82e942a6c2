import random
import re

import numpy as np
import xxhash

from sparkvane.llm import components, simhash


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)] or [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_groups_equal_brute_force(docs_of, sample):
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.groups(docs_of(sample)).collect()}
    fps = [brute_fp(t) for t in sample]
    assert [got[i][0] for i in range(len(sample))] == fps
    assert [got[i][1] for i in range(len(sample))] == brute_groups(fps)


def test_forest_finds_all_links_and_cut_shards_lose_none(spark, monkeypatch):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = list({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(15)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    forest = simhash.Forest(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    assert {p for a, b in forest.links(3) for p in zip(a.tolist(), b.tolist())} == want
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    label = list(range(len(fps)))
    for _ in fps:
        for i, j in want:
            label[i] = label[j] = min(label[i], label[j])
    for rows in (simhash.SHARD_ROWS, 4):
        monkeypatch.setattr(simhash, "SHARD_ROWS", rows)
        got = {r["node"]: r["component"] for r in components.components(simhash.links(nodes)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(label))


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert components.components(chain.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(docs_of, sample):
    fps = brute_groups([brute_fp(t) for t in sample])
    got = {r["doc_id"] for r in simhash.deduplicate(docs_of(sample)).collect()}
    assert got == {i for i, g in enumerate(fps) if i == g}
    assert simhash.groups(docs_of(["a"]).limit(0)).count() == 0


def test_repeated_rows(spark):
    d = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (9, "x y z w")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.groups(d).collect()) == [(3, 3), (5, 3), (5, 3), (9, 9)]
