"""Health of sources, coverage of institutions, status of items and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvane.functions.text import fold
from sparkvane.plans.cascade import all_reasons, first_match

HEALTHY, WARNING, ERROR, STALE, MANUAL = "Sağlıklı", "Uyarı", "Hatalı", "Uzun Süredir Güncellenmedi", "Manuel Kontrol Gerekli"
COMPLETE, PARTIAL, NO_COVERAGE = "Tam Kapsama", "Kısmi Kapsama", "Kapsama Yok"
#: HTTP codes that are failures of the source.
BAD_CODES = (403, 404, 500, 502, 503, 504)


def source_health(
    *, status: Column, code: Column, length: Column, candidates: Column, failures: Column, last_seen: Column, method: Column, mode: Column, now: Column, stale_days: int = 120
) -> Column:
    """struct(status, reason). Null candidates: not counted. last_seen: last change, else last success."""
    s, m, x = F.trim(fold(status)), F.trim(fold(method)), F.trim(fold(mode))
    f, c = F.coalesce(failures, F.lit(0)), F.coalesce(code, F.lit(0))
    age = F.datediff(now, last_seen)
    hard = F.when(f >= 2, ERROR).otherwise(WARNING)
    say = lambda status, reason: {"status": status, "reason": reason}
    number = lambda n: n.cast("int").cast("string")
    return first_match(
        [
            (m.isin("manual", "browser", "browser_required", "js") | x.contains("manual"), say(MANUAL, "Kaynak manuel veya tarayıcı tabanlı kontrol gerektiriyor.")),
            (f >= 3, say(ERROR, F.concat(number(f), F.lit(" ardışık başarısız kontrol var.")))),
            (c.isin(*BAD_CODES), say(hard, F.concat(F.lit("HTTP "), number(c), F.lit(" döndü.")))),
            (s == "error", say(hard, "Son kontrol hata ile sonuçlandı.")),
            ((s == "fetched") & (F.coalesce(length, F.lit(0)) <= 50), say(ERROR, "Çıkarılan içerik boş veya çok kısa.")),
            (f.isin(1, 2), say(WARNING, F.concat(number(f), F.lit(" ardışık başarısız kontrol var.")))),
            ((s == "fetched") & (candidates == 0) & x.isin("weekly_development", "both"), say(WARNING, "Haftalık gelişme kaynağından aday link çıkmadı.")),
            (age >= stale_days, say(STALE, F.concat(number(age), F.lit(" gündür değişiklik görülmedi.")))),
            ((s == "fetched") & (c >= 200) & (c < 400), say(HEALTHY, "Son kontrol başarılı.")),
            (s == "fetched", say(WARNING, "Kaynak çekildi ancak HTTP durumu doğrulanamadı.")),
        ],
        say(WARNING, "Kaynak için yeterli sağlık sinyali yok."),
    )


def coverage(*, active: Column, weekly: Column, benchmark: Column, browser: Column, manual: Column) -> Column:
    """The best coverage that an institution's source counts give."""
    return F.when(active > 0, COMPLETE).when((weekly > 0) | (benchmark > 0), PARTIAL).when((browser > 0) | (manual > 0), MANUAL).otherwise(NO_COVERAGE)


def item_status(published: Column, queued: Column, aware: Column, archived: Column, summarised: Column) -> Column:
    """Status of the feed: the first lane that holds the item."""
    return (
        F.when(published, "Yayınlandı").when(queued, "İncelemede").when(aware, "Yönetici Bilgilendirme").when(archived, "Düşük Öncelik / Arşiv").when(summarised, "Özetlendi").otherwise("Henüz Özetlenmedi")
    )


def seen_status(published: Column, archived: Column, rejected: Column, queue_status: Column, awareness_status: Column, summarised: Column, default: str = "Keşfedildi") -> Column:
    """Status of the seen index, whose order differs from the feed's: archive and rejection come before the queue."""
    named = lambda c, otherwise: F.when(F.trim(c) == "", otherwise).otherwise(c)
    return (
        F.when(published, "Yayınlandı")
        .when(archived, "Arşivlendi")
        .when(rejected, "Reddedildi")
        .when(queue_status.isNotNull(), named(queue_status, "İncelemede"))
        .when(awareness_status.isNotNull(), named(awareness_status, "Yönetici Bilgilendirme"))
        .when(summarised, "Özetlendi")
        .otherwise(default)
    )


def clean_noop(m: dict[str, Column]) -> Column:
    """Whether a run checked all sources, found them unchanged, and added nothing."""
    zero = ("stage_failures", "sources_failed", "changed_sources", "new_items", "summaries", "review_additions", "awareness_additions", "archive_additions", "cluster_additions")
    out = (m["sources_checked"] > 0) & (m["unchanged_sources"] == m["sources_checked"])
    for z in zero:
        out = out & (m[z] == 0)
    return out


def alerts(m: dict[str, Column], mean: dict[str, Column]) -> Column:
    """Names of the anomalies of a run against the means of the runs before it."""
    routed = m["review_additions"] + m["awareness_additions"] + m["archive_additions"]
    return all_reasons(
        [
            ((mean["candidates"] > 0) & (m["candidates"] > mean["candidates"] * 3), "candidate_volume"),
            ((mean["candidates"] > 0) & (m["candidates"] == 0) & (m["changed_sources"] > 0), "no_candidates"),
            ((m["candidates"] > 0) & (m["duplicates"] / F.greatest(m["candidates"], F.lit(1)) > 0.60), "duplicate_share"),
            ((routed > 0) & (m["archive_additions"] / F.greatest(routed, F.lit(1)) > 0.90), "archive_share"),
            ((mean["review_additions"] > 0) & (m["review_additions"] > mean["review_additions"] * 3), "review_volume"),
            ((mean["model_calls"] > 0) & (m["model_calls"] > mean["model_calls"] * 3), "model_volume"),
            (m["sources_succeeded"] == 0, "no_success"),
        ]
    )


def final_status(m: dict[str, Column], dry_run: Column, fatal: Column, has_alerts: Column) -> Column:
    activity = m["new_items"] + m["summaries"] + m["review_additions"] + m["awareness_additions"] + m["cluster_additions"]
    return (
        F.when(dry_run, "Dry Run")
        .when(fatal & (m["sources_succeeded"] == 0), "Başarısız")
        .when(clean_noop(m) & ~fatal, "Başarılı — Değişiklik Yok")
        .when((m["stage_failures"] > 0) | has_alerts | (m["sources_failed"] > 0), "Kısmi Başarılı")
        .when(activity == 0, "Başarılı — Değişiklik Yok")
        .otherwise("Başarılı")
    )
