"""Which lane an item goes to: management awareness, analyst review, or archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import clean, contains_any, truthy
from sparkvane.plans.cascade import all_reasons, first_match, first_reason

REVIEW, ARCHIVE, RESEARCH, AWARENESS = "İncelemeye Gönder", "Düşük Öncelik / Arşiv", "Ek Araştırma Gerekli", "Yönetici Bilgilendirme"

# fixed values: actions and themes that call for review, and words that weigh
REVIEW_ACTIONS = (
    "Yanıt Geliştir",
    "İş Birliği Fırsatını İncele",
    "Uyarlama Fırsatını Değerlendir",
    "Yönetime Eskale Et",
    "BD Konuşma Notlarına Ekle",
    "Yönetici Bilgilendirme Notuna Ekle",
)
REVIEW_THEMES = (
    "KOBİ Mevduat",
    "Gömülü Finans",
    "Ödemeler ve POS",
    "Dijital KOBİ Yolculuğu",
    "KOBİ Kredileri",
    "Nakit Yönetimi",
    "Ekosistem İş Birlikleri",
    "Kampanyalar",
    "Regülasyon",
    "Kurumsal Konumlandırma",
)
REPUTATION = (
    "türkiye’nin en iyi bankası",
    "türkiye'nin en iyi bankası",
    "en iyi banka",
    "global finance",
    "euromoney",
    "the banker",
    "brand finance",
    "lider",
    "birinci",
    "en güçlü banka",
    "ödül",
    "ranking",
    "sıralama",
)
LOW_PRIORITY = (
    "ödül",
    "award",
    "öğrenci",
    "finansal okuryazarlık",
    "sosyal sorumluluk",
    "kültür",
    "sanat",
    "sponsorluk",
    "genel görünüm",
    "yatırım bankası ödülü",
    "kurumsal hafıza",
    "kurumsal tarih",
    "müze",
)
STRONG = (
    "kobi",
    "esnaf",
    "pos",
    "üye işyeri",
    "odeme",
    "ödeme",
    "tahsilat",
    "api",
    "açık bankacılık",
    "mevduat",
    "ticari kredi",
    "nakit yönetimi",
    "kampanya",
    "iş birliği",
    "regülasyon",
    "tcmb",
    "bddk",
    "rekabet kurumu",
)
RAISED = ("Orta", "Yüksek")


def joined(*columns: str) -> Column:
    return F.concat_ws(" ", *[clean(c) for c in columns])


def awareness_reason() -> Column:
    """Why management should know, else empty."""
    words = joined("headline", "item_title", "summary", "core_assessment")
    reputation = contains_any(words, REPUTATION)
    weak = contains_any(words, LOW_PRIORITY) & ~reputation
    return first_reason(
        [
            ((clean("content_role") == AWARENESS) & (clean("relevance_status") != "İlgisiz"), "Gelişme doğrudan BD aksiyonu değil; yönetici farkındalığı için izlenmeli."),
            (weak, ""),
            (clean("recommended_action") == "Yönetici Bilgilendirme Notuna Ekle", "Aksiyon önerisi yönetici bilgilendirme notuna ekleme."),
            ((clean("strategic_theme") == "Kurumsal Konumlandırma") & clean("importance_level").isin(*RAISED), "Kurumsal konumlandırma sinyali orta/yüksek önem taşıyor."),
            (reputation, "Majör ödül, ranking veya itibar sinyali yönetici farkındalığı gerektiriyor."),
        ]
    )


def lane() -> Column:
    """struct(triage_status, triage_reason, to_review, to_awareness) of a summary row."""
    relevance = F.when(clean("relevance_status") == "", "Belirsiz").otherwise(clean("relevance_status"))
    impact, importance, action, theme = (clean(c) for c in ("impact_on_us", "importance_level", "recommended_action", "strategic_theme"))
    words = joined("headline", "item_title", "summary")
    aware = awareness_reason()
    review = all_reasons(
        [
            (relevance == "İlgili", "LLM gelişmeyi ilgili işaretledi"),
            (impact.isin(*RAISED), F.concat(F.lit("Etki seviyesi "), impact)),
            (importance.isin(*RAISED), F.concat(F.lit("Önem seviyesi "), importance)),
            (action.isin(*REVIEW_ACTIONS), F.concat(F.lit("Aksiyon önerisi: "), action)),
            (theme.isin(*REVIEW_THEMES) & (impact != "Düşük"), F.concat(theme, F.lit(" teması düşük olmayan etkiyle geldi"))),
            ((theme == "Kurumsal Konumlandırma") & importance.isin(*RAISED), "Kurumsal konumlandırma sinyali orta/yüksek önem taşıyor"),
            (contains_any(words, REPUTATION) & importance.isin(*RAISED), "Majör itibar/rakip konumlandırma sinyali"),
        ]
    )
    low = (impact == "Düşük") & (importance == "Düşük") & (relevance.isin("İlgisiz", "Belirsiz") | (clean("development_type") == "İlgili Gelişme Yok"))
    archive = all_reasons(
        [
            (low, "Düşük etki/önem ve ilgisiz-belirsiz gelişme"),
            (contains_any(words, LOW_PRIORITY) & ~contains_any(words, STRONG), "Düşük öncelikli PR anahtar kelimeleri içeriyor"),
        ]
    )
    unsure = F.when(clean("confidence_level") == "Düşük", "Güven seviyesi düşük; analist kontrolü gerekli").otherwise("Triage kuralları net karar veremedi")

    def to(status: str, reason: Column, review_lane: bool, awareness_lane: bool) -> dict:
        return {"triage_status": status, "triage_reason": reason, "to_review": review_lane, "to_awareness": awareness_lane}

    return first_match(
        [
            (aware != "", to(AWARENESS, aware, False, True)),
            (F.size(review) > 0, to(REVIEW, F.array_join(review, "; "), True, False)),
            (F.size(archive) > 0, to(ARCHIVE, F.array_join(archive, "; "), False, False)),
        ],
        to(RESEARCH, unsure, True, False),
    )


def suppressed(escalations, suppress_actions, high_signals, tactical_words) -> Column:
    """Whether a tactical item is left to its cluster."""
    blob = joined("item_title", "headline", "summary", "strategic_theme", "product_area", "development_type")
    tactical_text = contains_any(blob, tactical_words)
    tactical = (clean("development_type") == "Kampanya") | (clean("strategic_theme") == "Kampanyalar") | tactical_text
    return (
        truthy("covered_by_cluster", ("evet",))
        & clean("cluster_status").isin("Küme İncelemede", "Küme Yayınlandı")
        & (clean("impact_on_us") != "Yüksek")
        & (clean("importance_level") != "Yüksek")
        & ~clean("recommended_action").isin(*escalations)
        & ~(contains_any(blob, high_signals) & ~tactical_text)
        & tactical
        & clean("recommended_action").isin(*suppress_actions)
        & clean("impact_on_us").isin("Düşük", "Orta")
    )


def route(decided: tuple[str, ...] = ("Arşivlendi", "Reddedildi")) -> Column:
    """The one lane of each summary: archive for decided rows, none for suppressed ones, else by triage.

    Needs ``suppress`` (boolean) beside the summary columns.
    """
    t = lane()
    return (
        F.when(clean("review_status").isin(*decided), "archive")
        .when(F.coalesce(F.col("suppress"), F.lit(False)), "none")
        .when(t["to_awareness"], "awareness")
        .when(t["to_review"], "review")
        .otherwise("archive")
    )


def intended_destination() -> Column:
    """The lane that a summary's own fields ask for."""
    role, action = clean("content_role"), clean("recommended_action")
    return (
        F.when(role.isin("Benchmark Fact", "Benchmark Bilgisi"), "Benchmark")
        .when(role.isin("Bağlamsal Veri", "Tarihsel Bağlam"), "Bağlamsal Veri")
        .when((role == AWARENESS) | (action == "Yönetici Bilgilendirme Notuna Ekle"), AWARENESS)
        .when((clean("relevance_status") == "İlgisiz") | ((clean("impact_on_us") == "Düşük") & (clean("importance_level") == "Düşük")), ARCHIVE)
        .otherwise("Analist Onay Kuyruğu")
    )
