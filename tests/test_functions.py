"""Literal cases of the scalar functions."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkvane.functions import arrays, dates, ids, money, text, translate, urls

D = dt.date


def val(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def on(spark, f, value):
    return val(spark, f("x"), x=value)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.clean, "  a b\t", "a b"),
        (text.clean, None, ""),
        (text.squeeze, " a\n b  c ", "a b c"),
        (text.ascii_key, "İŞ Bankası – A.Ş.", "is bankasi a s"),
        (text.slug, "Türk Ticaret", "turk_ticaret"),
        (text.normal_title, "Yapı Kredi’den Yeni KOBİ Müşterilerine 48.000 TL!", "yapi kredi den yeni kobi müşterilerine 48 000 tl"),
        (text.dedup_title, "Yeni  Kampanya – Mayıs | Banka", "yeni kampanya - mayıs"),
        (text.truthy, " TRUE ", True),
        (text.truthy, "evet", False),
        (lambda c: text.truthy(c, ("evet",)), "Evet", True),
        (lambda c: text.contains_any(c, ["iş birliği"]), "Yeni İş Birliği", False),
        (lambda c: text.contains_any(c, ["kobi"]), "KOBİ", True),
        (lambda c: text.occurrences(c, "aa"), "aaaaa", 2),
        (text.tokens, "Yeni kart, KART ve kartlar 2026", ["2026", "kart", "kartlar", "yeni"]),
        (lambda c: text.first_sentences(c, 2), "Bir. İki!  Üç? Dört", "Bir. İki!"),
        (lambda c: text.shorten(c, 10), "abc defg hijkl", "abc defg…"),
        (lambda c: text.compact(c, 20, 5), "Uzun bir cümle burada. İkinci.", "Uzun bir cümle..."),
        (text.title_from_slug, "https://x/haber/yeni-kart-lansmani.html?x=1", "Yeni Kart Lansmani"),
        (lambda c: text.display_title(c, F.lit("QNB")), "QNB Yeni kart", "Yeni kart"),
        (lambda c: text.display_title(c, F.lit("QNB")), "QNB'den yeni kart", "QNB'den yeni kart"),
        (lambda c: text.tag(c, "confidence"), "a:b;confidence:Yüksek;", "Yüksek"),
        (money.amount, "1.250,50 TL", 1250.5),
        (money.amount, "%2,49", None),
        (money.amount, "Ücretsiz", None),
        (money.percentage, "yıllık %2,49", 2.49),
        (money.is_free, "250 TL", False),
        (money.is_free, "0 TL", True),
        (money.is_free, "ücretsiz", True),
        (money.whole, "14.0", 14),
        (money.whole, "x", 0),
        (dates.turkish, "Kampanya 12 Mayıs 2026 tarihinde", D(2026, 5, 12)),
        (dates.turkish, "12 MAYIS 2026 veya 1.2.2026", D(2026, 5, 12)),
        (dates.turkish, "1/2/2026", D(2026, 2, 1)),
        (dates.turkish, "2026-6-7", D(2026, 6, 7)),
        (dates.turkish, "31.02.2026", None),
        (dates.turkish, "2026 ilk çeyrek", None),
        (dates.english, "May 12, 2026", D(2026, 5, 12)),
        (dates.english, "12 June 2026", D(2026, 6, 12)),
        (dates.slashed, "05/31/2026", D(2026, 5, 31)),
        (dates.slashed, "05/06/2026", D(2026, 6, 5)),
        (lambda c: dates.slashed(c, True), "05/06/2026", D(2026, 5, 6)),
        (dates.any_format, "2026-06-07", D(2026, 6, 7)),
        (dates.any_format, "20.05.2026", D(2026, 5, 20)),
        (urls.dated, "https://x/2026/05/12/haber", D(2026, 5, 12)),
        (urls.dated, "https://x/2026/13/12/haber", None),
        (urls.canonical, "HTTPS://WWW.X.com//a//b/?utm_source=1&b=2&a=1#f", "https://www.x.com/a/b?a=1&b=2"),
        (urls.canonical, "https://x.com", "https://x.com/"),
        (urls.plain, "https://www.x.com/a/?utm_x=1&b=2", "https://x.com/a?b=2"),
        (urls.public_target, "http://10.0.0.1/x", False),
        (urls.public_target, "https://x.com:8080/", False),
        (urls.public_target, "https://x.com/", True),
        (lambda c: urls.allowed(c, ["x.com"]), "https://u@x.com/", False),
        (lambda c: urls.allowed(c, ["x.com"]), "https://a.x.com:443/", True),
        (urls.kind, "https://x.com/ara?q=1", "search"),
        (urls.kind, "https://x.com/a/b/c", "item"),
        (arrays.json_list, '["a", "b"]', ["a", "b"]),
        (arrays.json_list, "tek", ["tek"]),
        (arrays.json_list, None, []),
        (arrays.id_list, "[RI-1, 'RI-2']", ["RI-1", "RI-2"]),
        (arrays.object_text, '```json\n{"findings": []}\n``` and prose', '{"findings": []}'),
        (lambda c: arrays.coerce_value(c, ["Orta", "Yüksek"], "Düşük"), "sanırım yüksek", "Yüksek"),
        (lambda c: arrays.coerce_value(c, ["Orta", "Yüksek"], "Düşük"), "x; orta", "Orta"),
        (lambda c: arrays.coerce_value(c, ["Orta", "Yüksek"], "Düşük"), "?", "Düşük"),
        (translate.word_stem, "bankaların", "banka"),
    ],
)
def test_values(spark, f, value, want):
    assert on(spark, f, value) == want


def test_ranges(spark):
    got = on(spark, dates.ranges, "1-15 Mayıs 2026, 1.6.2026 - 30.06.2026 ve 20 Aralık - 5 Ocak 2026; 3.3.2026-31.2.2026")
    assert [tuple(r) for r in got] == [(D(2026, 6, 1), D(2026, 6, 30)), (D(2026, 5, 1), D(2026, 5, 15)), (D(2026, 12, 20), D(2026, 1, 5))]


def test_best_date_order(spark):
    b = dates.best("v", "u", "l", "m", "i")
    assert tuple(val(spark, b, v="", u="https://x/2026/05/12/a", l="1.1.2026", m="", i="")) == (D(2026, 5, 12), "url_date", "Orta")
    assert tuple(val(spark, b, v="", u="", l="", m="", i="")) == (None, "missing", "Yok")


@pytest.mark.parametrize(
    ("href", "want"),
    [("/a", "https://x.com/a"), ("b", "https://x.com/d/b"), ("../c", "https://x.com/c"), ("//y.com/z", "https://y.com/z"), ("?q=1", "https://x.com/d/e?q=1"), ("#t", "https://x.com/d/e#t"), ("http://z/", "http://z/"), ("", "https://x.com/d/e")],
)
def test_absolute_links(spark, href, want):
    assert val(spark, urls.absolute("h", "b"), h=href, b="https://x.com/d/e") == want


def test_identifiers(spark):
    sha1 = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert val(spark, ids.identifier("summary", "a", "b"), a="x", b="y") == "SUM-" + sha1("x:y")[:12]
    assert val(spark, ids.identifier("review", "a"), a="x") == "REV-" + sha1("x")[:10]
    assert val(spark, ids.words_fingerprint("a", "b"), a=" x ", b="") == sha1("x")
    assert val(spark, ids.blob_hash("a"), a="é") == hashlib.sha1(b"blob 2\0\xc3\xa9").hexdigest()
    f = ids.content_fingerprint("o", "u", "t", "d")
    assert val(spark, f, o="qnb", u="", t="t", d="2026") == hashlib.sha256(b"qnb|t|2026").hexdigest()
    assert val(spark, f, o="qnb", u="u", t="t", d="2026") == hashlib.sha256(b"qnb|u|t").hexdigest()
    groups = {"qnb": "alias", "enpara": "alias"}
    assert val(spark, ids.owner_key("o", groups), o="QNB") == val(spark, ids.owner_key("o", groups), o=" Enpara ") == "alias"
    assert val(spark, ids.row_key("i", "a"), i=" ", a="x") == "combo:x"


def test_tags_and_repeats(spark):
    assert on(spark, arrays.tags, "a:1; b:2 ;a:3;x") == {"b": "2", "a": "3"}
    assert val(spark, text.repeats(F.col("a"), F.col("b")), a="Yeni kart", b="Banka yeni kart çıkardı") is True
    assert val(spark, text.repeats(F.col("a"), F.col("b")), a="bir iki üç dört beş", b="altı yedi sekiz dokuz on") is False


def test_glossary(spark):
    g = translate.Glossary({"High": "Yüksek", "low": "Düşük", "high risk": "Riskli"}, {"as of": "itibarıyla"}, {"hgih": "high"})
    d = spark.createDataFrame([("HIGH",), ("the flows are low",), ("high risk; low",), ("hgih",), (None,)], "x string")
    assert [r[0] for r in d.select(translate.translated("x", g)).collect()] == ["Yüksek", "the flows are Düşük", "Riskli; Düşük", "Yüksek", ""]


def test_offer_dates(spark):
    today = F.lit("2026-06-29").cast("date")
    s = lambda status, until: val(spark, dates.offer_status(F.lit(status), F.lit(until).cast("date"), today))
    assert (s("Aktif", "2026-06-28"), s("Süresi doldu", "2026-07-01"), s("", None), s("Aktif", "2026-06-29")) == ("Süresi doldu", "Aktif", "Belirsiz", "Aktif")
    due = lambda d: val(spark, dates.due(F.lit(d).cast("date"), today))
    assert (due("2026-07-29"), due("2026-06-01"), due(None)) == (False, True, True)
