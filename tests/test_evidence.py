"""Acceptance in order against a loop, and the evidence inbox against a row-by-row run."""

import random

import pytest

from sparkvane.operators import accept
from sparkvane.plans import evidence, network


def loop(rows):
    """(rank, asks, gives) one after the other."""
    known, taken = [set(), set()], []
    for rank, asks, gives in sorted(rows):
        if not any(a is not None and a in k for a, k in zip(asks, known, strict=True)):
            taken.append(rank)
            for g, k in zip(gives, known, strict=True):
                k.add(g)
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_loop(spark, seed):
    r = random.Random(seed)
    n = 120
    key = lambda: r.choice([None, *range(r.choice([4, 30, 90]))])
    rows = []
    for i in r.sample(range(1000), n):
        asks = (key(), key())
        rows.append((i, asks, asks if seed % 2 else (key(), key())))
    df = spark.createDataFrame([(i, *a, *g) for i, a, g in rows], "i int, a0 int, a1 int, g0 int, g1 int")
    got = accept.accepted(df, "i", ["a0", "a1"], ["g0", "g1"])
    assert sorted(x.i for x in got.collect()) == loop(rows)


def test_a_chain_and_a_hot_key(spark):
    chain = [(i, (i // 2, (i + 1) // 2), (i // 2, (i + 1) // 2)) for i in range(14)]
    hot = [(100 + i, (7777, 100 + i), (7777, 100 + i)) for i in range(60)]
    rows = chain + hot
    df = spark.createDataFrame([(i, *a) for i, a, _ in rows], "i int, a int, b int")
    assert sorted(x.i for x in accept.accepted(df, "i", ["a", "b"]).collect()) == loop(rows)
    assert accept.accepted(df.limit(0), "i", ["a", "b"]).count() == 0


OWNER = evidence.Owner("Net", ("net.com",))
MARKET = network.Market(own=r"\bown bank\b", competitors="(rival bank)", home="(anatolia)")
COLUMNS = "position intake_id institution_name official_url proposed_title proposed_publication_date copied_official_text uploaded_evidence_path evidence_capture_method official_domain_verified analyst_date_verified analyst_body_verified proposed_network_signal_type intake_status".split()
SCHEMA = ", ".join(f"{c} {'int' if c == 'position' else 'string'}" for c in COLUMNS)


def row(position, **changed):
    base = {
        "position": position, "intake_id": f"I{position}", "institution_name": "Net", "official_url": f"https://www.net.com/us/en/newsroom/item-{position}", "proposed_title": f"Token credential controls {position}",
        "proposed_publication_date": "2026-06-01", "copied_official_text": "Net launches token credential controls for issuers and merchants. " * 15, "uploaded_evidence_path": "",
        "evidence_capture_method": "analyst_copy_from_official_page", "official_domain_verified": "True", "analyst_date_verified": "True", "analyst_body_verified": "True", "proposed_network_signal_type": "", "intake_status": "New",
    }
    return tuple({**base, **changed}[c] for c in COLUMNS)


def judged(spark, rows, verified=(), recent=()):
    v = spark.createDataFrame(list(verified), "intake_id string, canonical_url string, title string")
    i = spark.createDataFrame(list(recent), "item_url string, item_title string")
    out = evidence.validate_inbox(spark.createDataFrame(rows, SCHEMA), v, i, OWNER, MARKET)
    return {x.position: (x.intake_status, x.validation_error) for x in out.collect()}, out


def test_reasons_in_order(spark):
    cases = [
        ({}, ""),
        ({"institution_name": "Other"}, "institution_not_owner"),
        ({"official_url": "https://example.com/net-token-controls", "official_domain_verified": "False"}, "not_official_domain"),
        ({"official_domain_verified": "no"}, "official_domain_not_analyst_verified"),
        ({"proposed_title": " "}, "missing_title"),
        ({"official_url": "https://www.net.com/search?q=token"}, "not_item_level_recent_url"),
        ({"proposed_publication_date": ""}, "missing_publication_date"),
        ({"proposed_publication_date": "2026-04-30"}, "pre_cutoff"),
        ({"analyst_date_verified": ""}, "date_not_analyst_verified"),
        ({"analyst_body_verified": ""}, "body_not_analyst_verified"),
        ({"copied_official_text": "", "evidence_capture_method": "official_url"}, "insufficient_official_evidence"),
        ({"copied_official_text": "x" * 899, "evidence_capture_method": "official_screenshot"}, "insufficient_official_evidence"),
        ({"copied_official_text": "token " * 20}, "body_too_short"),
        ({"copied_official_text": "nothing here " * 60, "proposed_title": "Plain words"}, "no_strategic_relevance_signal"),
        ({"copied_official_text": "nothing here " * 60, "proposed_title": "Plain words again", "proposed_network_signal_type": "x"}, ""),
    ]
    got, out = judged(spark, [row(i, **c) for i, (c, _) in enumerate(cases)])
    assert {i: r for i, (_, r) in got.items()} == {i: r for i, (_, r) in enumerate(cases)}
    assert all((s == "Verified") == (r == "") for s, r in got.values())
    assert sorted(x.intake_id for x in evidence.verified_rows(out).collect()) == ["I0", "I14"]


def test_accepted_rows_become_known_in_order(spark):
    dup = "duplicate_manual_or_recent_item"
    same = "https://net.com/us/en/newsroom/one"
    rows = [
        row(0, analyst_date_verified="", official_url=same),  # refused, so it makes nothing known
        row(1, official_url=same),
        row(2, official_url=same + "/?utm_source=x"),
        row(3, proposed_title="Plain title of tokens"),
        row(4, proposed_title="PLAIN  title of tokens!"),  # the key of the title is known
        row(5, proposed_title="Token: controls, again"),
        row(6, proposed_title="Token: controls, again"),  # punctuation: the folded title is added, the key is asked
        row(7, official_url=same, proposed_publication_date=""),  # known before its date is looked at
        row(8, official_url="https://net.com/us/en/newsroom/old"),
        row(9, proposed_title="Recent item of tokens"),
        row(10, intake_status="Closed", official_url=same),
    ]
    got, out = judged(spark, rows, verified=[("V1", "https://www.net.com/us/en/newsroom/old", "x")], recent=[("https://a.com/1", "Recent ITEM of tokens.")])
    assert {k: v[1] for k, v in got.items()} == {0: "date_not_analyst_verified", 1: "", 2: dup, 3: "", 4: dup, 5: "", 6: "", 7: dup, 8: dup, 9: dup}
    v = spark.createDataFrame([("I1", "old", "old title"), ("V1", "u", "t")], "intake_id string, canonical_url string, title string")
    merged = {x.intake_id: x.title for x in evidence.merge_verified(v, evidence.verified_rows(out).select("intake_id", "canonical_url", "title")).collect()}
    assert merged == {"I1": "Token credential controls 1", "V1": "t", "I3": "Plain title of tokens", "I5": "Token: controls, again", "I6": "Token: controls, again"}
