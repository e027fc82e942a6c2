"""What an item is: development type, quality, content role, pricing and initiative buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.functions.text import contains_any, contains_plain, fold, literal_words, matches, plain, text
from sparkvane.functions.urls import path
from sparkvane.plans.cascade import bound, first_match, first_reason

# fixed values: signals of the development types
STATIC = (
    r"(login|giriş|sube|şube|atm|yardim|yardım|iletisim|iletişim|hesaplama|hesapla|urun-ve-hizmet-ucretleri|ürün-ve-hizmet-ücretleri|"
    r"kvkk|gizlilik|cerez|çerez|site-haritasi|site haritası|parola|başvuru merkezi|basvuru merkezi)"
)
STATIC_PATH = r"/(?:bireysel-bankacilik|kobi|ticari|kurumsal)/(?:odemeler-ve-hizmetler|mevduat|krediler|kartlar|yatirim|sigorta|dijital-bankacilik)(?:/|$)"
CAMPAIGN = r"(kampanya|fırsat|avantaj|puan|hoş geldin|maxipuan|promosyon)"
PARTNERSHIP = r"(iş birliği|is birligi|partner|ortaklık|mutabakat|anlaşma|entegrasyon)"
PRODUCT = r"(lansman|yeni ürün|yeni hizmet|özellik|api|open banking|açık bankacılık|ödeme iste|tahsilat|pos|softpos|sanal pos|fast|nakit yönetimi)"
REGULATION = r"(regülasyon|yönetmelik|karar|tebliğ|tcmb|bddk|bkm|resmi gazete)"
REPORT = r"(rapor|araştırma|endeks|barometre|pazar araştırması)"
AWARD = r"(ödül|ödülleri|ranking|sıralama|en iyi|global finance|başarı)"
GREEN_FINANCE = r"(sürdürülebilir.*(finans|kredi|leasing|tahvil|swap)|yeşil.*(kredi|finans|tahvil))"
#: Words of which a pattern with gaps needs one.
ASKED = {GREEN_FINANCE: ("sürdürülebilir", "yeşil")}
SOCIAL = r"(kültür|sanat|sergi|sponsorluk|öğrenci|eğitim desteği|sosyal sorumluluk|konser|festival)"
SMALL_BUSINESS = r"(kobi|kobİ|esnaf|ticari|işletme|üye işyeri|uye isyeri|merchant|firma|kurumsal müşteri)"
BAD_TITLE = r"(tekil gelişme kontrol|fallback|source page|communication / press releases için)"


# fixed values: the kinds of developments in the order in which they are decided, whether they are one, and why
KINDS = (
    ("static", False, "Statik Ürün Sayfası", "Statik ürün, yardım, giriş veya navigasyon içeriği gibi görünüyor."),
    ("social", False, "Sosyal Sorumluluk / PR", "KOBİ stratejisine doğrudan bağlanmayan kültür, sanat veya sosyal sorumluluk PR içeriği."),
    ("campaign", True, "Kampanya", "Kampanya veya müşteri teklifi sinyali içeriyor."),
    ("partnership", True, "İş Birliği", "İş birliği, mutabakat veya entegrasyon duyurusu içeriyor."),
    ("product", True, "Ürün / Özellik Gelişmesi", "Ürün, API, POS, ödeme, tahsilat veya dijital özellik gelişmesi sinyali içeriyor."),
    ("regulation", True, "Regülasyon", "Regülasyon veya resmi karar sinyali içeriyor."),
    ("green", True, "Ürün / Özellik Gelişmesi", "Sürdürülebilir finansman, kredi, leasing veya sermaye piyasası işlemi içeriyor."),
    ("report", True, "Rapor / Araştırma", "Bankacılık veya pazar araştırması niteliğinde rapor/analiz sinyali içeriyor."),
    ("award", True, "Ödül / İtibar Sinyali", "Dated, credible award/ranking or management-positioning signal olarak değerlendirilebilir."),
    ("press", True, "Basın Bülteni", "Basın/haber kaynağından gelen tekil ve tarihli duyuru adayı."),
    ("news", True, "Haber", "Tekil haber veya duyuru adayı."),
)
UNCLEAR = ("Belirsiz", "Yeni kampanya, ürün, iş birliği, regülasyon, rapor veya yönetim sinyali net değil.")
#: Signals that are one pattern over the whole blob.
PATTERNS = {"campaign": CAMPAIGN, "partnership": PARTNERSHIP, "product": PRODUCT, "regulation": REGULATION, "green": GREEN_FINANCE, "report": REPORT, "award": AWARD}


def development(title: str, body: str, url: str, source_type: str) -> Column:
    """struct(is_actual_development, development_candidate_type, actual_development_reason) by ``KINDS``."""
    blob = F.concat_ws("\n", text(title), F.substring(text(body), 1, 5000), text(url), text(source_type))
    meta = F.concat_ws("\n", text(title), text(url), text(source_type))
    read = {"blob": blob, "plain": plain(blob), "meta": meta, "path": path(url), "source": fold(source_type)}

    def decided(s: dict[str, Column]) -> Column:
        # each signal is sought when a kind asks for it: words in the plain text, the pattern where only it tells
        def has(pattern: str) -> Column:
            if words := literal_words(pattern):
                return contains_plain(s["plain"], words)
            return contains_plain(s["plain"], ASKED[pattern]) & matches(s["blob"], pattern)

        s |= {k: has(p) for k, p in PATTERNS.items()}
        from_press = s["source"].contains("basın") | s["source"].contains("press")
        static_path = matches(s["path"], STATIC_PATH)
        s["static"] = (matches(s["meta"], STATIC) & ~(s["path"].contains("/kurumsal-iletisim/") | from_press)) | (static_path & ~s["campaign"] & ~s["product"])
        s["social"] = has(SOCIAL) & ~has(SMALL_BUSINESS) & ~(s["award"] | s["report"] | s["green"])
        s["press"] = from_press | s["source"].contains("haber")
        s["news"] = contains_plain(s["plain"], ("duyuru", "haber"))
        value = lambda actual, name, why: {"is_actual_development": actual, "development_candidate_type": name, "actual_development_reason": why}
        return first_match([(s[k], value(*rest)) for k, *rest in KINDS], value(False, *UNCLEAR))

    return bound(read, decided)


def quality(title: Column | str, body: Column | str, item_url: Column | str, source_url: Column | str, method: Column | str, allow_fallback: bool = False) -> Column:
    """struct(item_quality, quality_reason): Poor by the first defect, Good for long texts, else Medium."""
    t, b = text(title), text(body)
    grade = lambda q, r: {"item_quality": q, "quality_reason": r}
    return first_match(
        [
            (F.length(t) < 20, grade("Poor", "title_too_short")),
            (matches(t, BAD_TITLE), grade("Poor", "bad_fallback_title")),
            ((text(item_url) == text(source_url)) & F.lit(not allow_fallback), grade("Poor", "item_url_equals_source_url")),
            ((text(method) == "detail_page_fetch") & (F.length(b) < 300), grade("Poor", "detail_text_too_short")),
            (F.length(b) >= 900, grade("Good", "detail_text_rich")),
        ],
        grade("Medium", "acceptable"),
    )


def rejection_reason(quality_col: Column, quality_reason: Column, recent: Column, recency_reason: Column, actual: Column, actual_reason: Column) -> Column:
    """Why a candidate is not saved: quality, then recency, then no actual development; empty if it is."""
    return first_reason([(~quality_col.isin("Good", "Medium"), quality_reason), (~recent, recency_reason), (~actual, actual_reason)])


def basis_type(source: Column | str, event: Column | str) -> Column:
    s, e = F.trim(text(source)), F.trim(text(event))
    return (
        F.when((s == "publication_date") | (e == "Yayın Tarihi"), "publication_date")
        .when((s == "campaign_start_date") | (e == "Kampanya Başlangıç Tarihi"), "campaign_start_date")
        .when((s == "announcement_date") | (e == "Duyuru Tarihi"), "publication_date")
        .when(s.isin("material_revision_date", "event_date"), s)
        .otherwise("unknown")
    )


# fixed values: words of the fee families, then of free text, in the order in which they decide
FEE_FAMILY = (
    ("POS", ("pos", "üye işyeri", "merchant", "acquiring")),
    ("Kartlar", ("kart", "card")),
    ("Paket / Kredi", ("kredi", "paket", "lending", "overdraft", "account", "package")),
    ("Yurt dışı / SWIFT", ("swift", "yurt dış", "yabancı para", "uluslararası", "döviz", "international", "wire", "cross-border", "fx", "telegraphic")),
    ("Yurt içi transfer", ("havale", "eft", "fast", "ach", "paynow", "faster payment", "domestic transfer")),
)
FEE_TEXT = (
    ("POS", ("pos", "üye işyeri", "merchant", "acquiring", "card-present", "card payment")),
    ("Paket / Kredi", ("paket", "kredi tahsis", "taksitli ticari kredi", "faizsiz", "business account", "checking", "overdraft", "lending", "package")),
    ("Yurt dışı / SWIFT", ("swift", "yurt dış", "uluslararası", "döviz", "yabancı para", "international", "wire", "cross-border", "fx", "telegraphic")),
    ("Yurt içi transfer", ("havale", "transfer", "eft", "ach", "paynow", "faster payment", "domestic")),
    ("Paket / Kredi", ("maaş",)),
)


def keyword_bucket(steps, default: str) -> Column:
    """The name of the first (column, names with words) step with a hit, else the default."""
    rules = [(contains_any(c, words), {"b": name}) for c, table in steps for name, words in table]
    return first_match(rules, {"b": default})["b"]


def fee_bucket(family: Column | str, free_text: Column | str) -> Column:
    return keyword_bucket([(family, FEE_FAMILY), (free_text, FEE_TEXT)], "Kartlar")


# fixed values: the place of a fee within its bucket by the words of its texts, tried in order; last the place of all others
FEE_PLACES = {
    "Kartlar": ((2, ("banka kart", "paracard")), (1, ("aidatsız", "free", "0 tl")), (0, ("yıllık ücret",)), (3, ("nakit avans",)), (4, ())),
    "Yurt içi transfer": ((2, ("pahalı kanal", "atm", "şube", "branch", "müşteri iletişim", "çözüm merkezi")), (1, ("havale", "paynow", "faster payment", "ach")), (0, ())),
    "Yurt dışı / SWIFT": (
        (9, ("gelen",)),
        (8, ("şube", "branch", "pahalı kanal")),
        (0, ("visa",)),
        (1, ("yurt dışı fast", "fast uluslararası")),
        (2, ("0-10.000", "0-10 bin", "0-12.000", "0-12 bin", "15 bin tl ve alt", "15.000 tl ve alt", "30 bin tl alt")),
        (3, ("12.000,01-40.000", "12-40 bin")),
        (4, ("40.000,01-80.000", "40-80 bin")),
        (5, ("80.000,01", "80 bin", "10.000 tl üzeri", "10 bin+", "15 bin tl+", "15.000,01", "30 bin tl üst")),
        (2, ("same-day", "aynı gün")),
        (3, ("1 gün",)),
        (4, ("ileri gün",)),
        (6, ()),
    ),
    "Paket / Kredi": (
        (0, ("hoş geldin", "yeni müşteri", "faizsiz", "account", "checking")),
        (1, ("nakit akışınla kazan",)),
        (2, ("dış ticaret paketi", "ithalat paket", "ihracat paket", "karma dış ticaret", "kota", "swift paketi", "swift paketleri")),
        (3, ("genç kobi", "genciz kobi", "kadın kobi", "kadın girişimci")),
        (4, ("çek", "senet")),
        (5, ("kgf", "kobi ihtiyaç", "anında ticari", "ticari kredili")),
        (6, ("pos'una kredi", "posuna kredi")),
        (7, ()),
    ),
    "POS": ((0, ("kampanya", "hoş geldin", "yeni kazanım", "pos'um cepte")), (1, ("peşin", "azami", "standart")), (2, ("taksit",)), (3, ())),
}


def fee_place(bucket: Column, texts: Column) -> Column:
    """Where a fee stands within its bucket; null for another bucket, whose fees keep their order."""
    out = None
    for name, places in FEE_PLACES.items():
        *rules, (_, _) = places
        place = first_match([(contains_any(texts, words), {"p": p}) for p, words in rules], {"p": places[-1][0]})["p"]
        out = F.when(bucket == name, place) if out is None else out.when(bucket == name, place)
    return out


def fees_in_order(fees: DataFrame, bucket: str, order: str, *within: str) -> DataFrame:
    """Fees with ``place`` and ``position``: the order of their bucket (of each of ``within``), by place and then by ``order``."""
    words = F.concat_ws(" ", *[text(c) for c in ("fee_family", "fee_item", "product_or_channel", "fee_basis")])
    placed = fees.withColumn("place", fee_place(F.col(bucket), words))
    return placed.withColumn("position", F.row_number().over(W.partitionBy(*within, bucket).orderBy(F.coalesce("place", F.lit(0)), order)))
