"""Which date counts for an item, and whether the item is recent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import dates
from sparkvane.functions.text import clean, matches, text
from sparkvane.plans.cascade import first_match

DEFAULT_START = "2026-05-01"

# fixed values: the columns that may hold the date that counts, in order, and the reason for each
BASIS = (
    ("publication_date", "Yayın tarihi bulundu; recency için kullanıldı."),
    ("announcement_date", "Duyuru/basın tarihi bulundu; recency için kullanıldı."),
    ("campaign_start_date", "Kampanya başlangıç tarihi bulundu; recency için kullanıldı."),
    ("recency_basis_date", "Recency baz tarihi kullanıldı."),
    ("normalized_item_date", "Normalize edilmiş tarih kullanıldı."),
)

# fixed values: contexts of campaign dates
CAMPAIGN = r"(kampanya|maxipuan|maximum|ticari kart|bankamatik|son kat[ıi]l[ıi]m tarihi|son kullan[ıi]m tarihi|puan kullan[ıi]m tarihi)"
CAMPAIGN_END = (
    r"(tarihine kadar|['’]?(?:ya|ye|a|e)\s+kadar|kadar ge[çc]erlidir|son kat[ıi]l[ıi]m tarihi|son ba[şs]vuru tarihi|son kullan[ıi]m tarihi|"
    r"kampanya biti[şs] tarihi|kampanya son tarihi|ge[çc]erlilik biti[şs] tarihi|puan kullan[ıi]m (?:son )?tarihi|son tarih|son g[üu]n|biti[şs] tarihi)"
)


def effective_start(permanent: Column | str, requested: Column, today: Column, days: int = 45) -> Column:
    """The later of the permanent cutoff and the requested one (or ``days`` before today)."""
    fixed = F.lit(permanent).cast("date") if isinstance(permanent, str) else permanent
    return F.greatest(fixed, F.coalesce(requested, F.date_sub(today, days)))


def add_date_semantics(df: DataFrame, visible: str, url: str, listing: str, metadata: str, inferred: str, source_type: str, name: str = "dates") -> DataFrame:
    """What the dates of an item mean: struct of publication, campaign start and end, type, basis, confidence, source.

    A range decides for campaigns; else the first place with a date does: visible text,
    listing, url, metadata, inferred text. Computed in stages, so that each pattern runs once a row.
    """
    combined = F.substring(F.concat_ws("\n", text(visible), text(listing), text(metadata), text(inferred)), 1, 6000)
    blob = F.concat_ws(" ", text(source_type), text(url), text(listing), text(visible))
    places = (
        (dates.turkish(visible), "Yüksek"),
        (dates.turkish(listing), "Orta"),
        (dates.dated(url), "Orta"),
        (dates.turkish(metadata), "Orta"),
        (dates.turkish(inferred), "Düşük"),
    )
    found = df.withColumns({"_d_text": combined, "_d_blob": blob, "_d_places": F.array(*[d for d, _ in places])})
    found = found.withColumn("_d_campaign", matches("_d_blob", CAMPAIGN) | matches("_d_text", CAMPAIGN))
    at = F.array_position(F.transform("_d_places", lambda d: d.isNotNull()), True).cast("int")
    found = found.withColumns({"_d_at": at, "_d_ranges": F.when(F.col("_d_campaign"), dates.ranges("_d_text")), "_d_ends": F.col("_d_campaign") & matches("_d_text", CAMPAIGN_END)})
    span = F.try_element_at("_d_ranges", F.lit(1))
    one = F.when(F.col("_d_at") > 0, F.try_element_at("_d_places", F.col("_d_at")))
    sure = F.when(F.col("_d_at") > 0, F.try_element_at(F.array(*[F.lit(c) for _, c in places]), F.col("_d_at")))
    found = found.withColumns({"_d_span": span, "_d_one": one, "_d_sure": sure})
    one, span, campaign, ends = F.col("_d_one"), F.col("_d_span"), F.col("_d_campaign"), F.col("_d_ends")
    alone = span.isNull() & campaign & one.isNotNull()
    found = found.withColumns(
        {
            "_d_start": F.coalesce(span["start"], F.when(alone & ~ends, one)),
            "_d_end": F.coalesce(span["end"], F.when(alone & ends, one)),
            "_d_published": F.when(~campaign, one),
        }
    )
    start, end, published = F.col("_d_start"), F.col("_d_end"), F.col("_d_published")
    kind = first_match(
        [
            (published.isNotNull(), {"event": "Yayın Tarihi", "basis": published, "source": "publication_date"}),
            (start.isNotNull(), {"event": "Kampanya Başlangıç Tarihi", "basis": start, "source": "campaign_start_date"}),
            (end.isNotNull(), {"event": "Kampanya Bitiş Tarihi", "basis": end, "source": "campaign_end_date"}),
        ],
        {"event": "Belirsiz", "basis": F.lit(None).cast("date"), "source": "missing"},
    )
    out = found.withColumn("_d_kind", kind)
    value = F.struct(
        published.alias("publication_date"),
        start.alias("campaign_start_date"),
        end.alias("campaign_end_date"),
        F.col("_d_kind.event").alias("event_date_type"),
        F.col("_d_kind.basis").alias("recency_basis_date"),
        F.col("_d_kind.source").alias("date_source"),
        F.coalesce(F.when(span.isNotNull(), F.lit("Yüksek")), F.col("_d_sure"), F.lit("Yok")).alias("date_confidence"),
    )
    return out.withColumn(name, value).select(*df.columns, name)


def _parts() -> dict[str, Column]:
    """What the verdict looks at: the date that counts, whether it is only a campaign's end, the confidence."""
    end = clean("campaign_end_date")
    values = [clean(c) for c, _ in BASIS]
    basis = F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))
    only_end = (end != "") & ((basis == "") | ((basis == end) & (values[0] == "") & (values[1] == "") & (values[2] == "")))
    value = F.when(basis == "", end).otherwise(basis)
    return {
        "value": value,
        "day": F.substring(value, 1, 10).try_cast("date"),
        "end": end,
        "end_day": F.substring(end, 1, 10).try_cast("date"),
        "only_end": only_end,
        "confidence": F.when(clean("date_confidence") == "", "Yok").otherwise(clean("date_confidence")),
    }


def _verdict(p: dict[str, Column], cutoff: Column | str, allow_undated: bool, allow_low_confidence: bool, allow_end_date: bool) -> Column:
    limit = F.coalesce((F.lit(cutoff) if isinstance(cutoff, str) else cutoff).try_cast("date"), F.lit(DEFAULT_START).cast("date"))
    day, none = p["day"], F.lit(None).cast("date")
    shown = F.date_format(day, "yyyy-MM-dd")

    def verdict(recent: bool, reason, basis_day: Column, active) -> dict:
        return {"is_recent": recent, "recency_reason": reason, "recency_basis_date": basis_day, "is_active_campaign": active}

    return first_match(
        [
            (p["value"] == "", verdict(True, "Tarih yok; manuel izinle geçirildi", none, False) if allow_undated else verdict(False, "Tarih yok; varsayılan kapıdan geçmedi", none, False)),
            (day.isNull(), verdict(False, "Tarih ayrıştırılamadı", none, False)),
            (~p["confidence"].isin("Yüksek", "Orta") & F.lit(not allow_low_confidence), verdict(False, F.concat(F.lit("Düşük tarih güveni: "), p["confidence"]), day, False)),
            (p["only_end"] & F.lit(not allow_end_date), verdict(False, "Sadece kampanya bitiş tarihi bulundu; yeni gelişme kanıtı değil", day, day >= limit)),
            (day < limit, verdict(False, F.concat(F.lit("Kesim tarihinden eski: "), shown, F.lit(" < "), F.date_format(limit, "yyyy-MM-dd")), day, F.coalesce(p["end_day"] >= limit, F.lit(False)))),
            (p["only_end"], verdict(True, "Sadece kampanya bitiş tarihi bulundu; manuel izinle geçirildi", day, True)),
        ],
        verdict(True, F.concat(F.lit("Kesim tarihi ve tarih güveni uygun: "), shown), day, p["end"] != ""),
    )


def evaluate(cutoff: Column | str = DEFAULT_START, allow_undated: bool = False, allow_low_confidence: bool = False, allow_end_date: bool = False) -> Column:
    """struct(is_recent, recency_reason, recency_basis_date, is_active_campaign) from the item's date columns.

    Expects text columns: those of ``BASIS``, campaign_end_date and date_confidence.
    """
    return _verdict(_parts(), cutoff, allow_undated, allow_low_confidence, allow_end_date)


def add_recency(df: DataFrame, cutoff: Column | str = DEFAULT_START, name: str = "recency", allow_undated: bool = False, allow_low_confidence: bool = False, allow_end_date: bool = False) -> DataFrame:
    """``evaluate`` as a column, in two projections: what the verdict looks at is computed once a row."""
    staged = {f"_recency_{k}": v for k, v in _parts().items()}
    p = {k: F.col(f"_recency_{k}") for k in _parts()}
    return df.withColumns(staged).withColumn(name, _verdict(p, cutoff, allow_undated, allow_low_confidence, allow_end_date)).drop(*staged)
