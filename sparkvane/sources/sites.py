"""Site adapters: which anchors of a site's listing pages are items, as rows of one rule table.

``selectors.anchors`` parses a page once for all rules. A page takes the first rule whose source ids,
host or path it has; the rule says which anchors count, what the title is, which words must and
must not occur, where the date stands and what the item scores. Pages without a rule, and pages
whose rule finds nothing, take the general candidates of ``html.candidates``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvane.functions import dates, urls
from sparkvane.functions.text import matches, matches_plain, plain, plain_pattern, squeeze, text, title_from_slug
from sparkvane.operators.rows import once, spread
from sparkvane.plans import roles
from sparkvane.plans.cascade import bound
from sparkvane.sources import html, selectors
from sparkvane.sources.tables import staged

#: Programs that rules name; the texts of the second table's elements are needed.
SCOPES = {"main": "main", "content": ".content", "press result": "#pressReleaseResultContent", "reports": ".content-reports", "detail link": ".content-box--press-bulletin a.content-box__detail-link[href]"}
CARDS = {"campaign card": ".new-campaign-card", "reports li": ".content-reports li", "li": "li", "bulletin box": ".content-box--press-bulletin", "item": ".item", "line": "div.line"}


@dataclass(frozen=True)
class Rule:
    """One adapter. Patterns are empty where nothing is asked; lists of names are separated by ``|``."""

    name: str
    sources: str = ""  # source ids
    host: str = ""  # pattern of the page's host, where the rule goes by it
    page: str = ""  # pattern of the page's path
    scope: str = ""  # programs around the anchor; the first that is on the page counts
    card: str = ""  # program of the card; the first of those around the anchor
    card_needed: bool = False
    first_in_card: bool = False
    path: str = ""  # pattern of the link's path
    not_path: str = ""
    href: str = ""  # pattern of the address as written
    same_site: bool = False
    title: str = "anchor"  # anchor, heading, lead, parent, card, strong
    title_cut: str = ""  # pattern that is dropped from the title
    title_to_date: bool = False  # the title ends where the first date begins
    undated_title: bool = False  # dates are dropped from the title
    blob: str = "title|path"  # title, parent, path, card, href, anchor, url
    positive: str = ""  # on the blob
    or_dated: bool = False
    negative: str = ""
    unless: str = ""  # on ``unless_on``: what outweighs ``negative``
    unless_on: str = "blob"
    gate: bool = False  # the gate of small-business relevance
    gate_not_on: str = ""  # paths that need no gate
    negative_link: bool = False
    date: str = ""  # blob, card, title|path, assets, english, texts
    date_needed: bool = False
    shortest: int = 1
    longest: int = 0  # titles over 180 characters are cut
    score: int = 0
    dated: int = 0  # added where there is a date
    more: str = ""  # pattern on the blob that adds ``more_points``
    more_points: int = 0
    yet_more: str = ""
    yet_more_points: int = 0
    award: bool = False  # the reason says so where the title names an award
    keep: str = "last"  # of one url: last, grow (better or longer), all
    publisher: str = ""  # checks of publishers' news: plain, external, partners, council
    k: int = 0


# fixed values: the patterns of each site, and the path of a publisher's articles by source
_SELLER = r"(small business|sme|merchant|seller|pos|checkout|commercial|working capital|treasury)"
_FUTURE = r"(stablecoin|agentic|openai|chatgpt|claude|embedded|api|reconciliation)"
PUBLISHERS = {
    "REG-041": (r"/newsroom/news/[^/]+/?$", "plain"),
    "REG-232": (r"/inside/[^/]+/?$", "plain"),
    "REG-233": (r"/us/en/press/[^/]+/?$", "plain"),
    "REG-234": (r"/20\d{2}-[^/]+/?$", "council"),
    "REG-235": (r"/news/[^/]+/?$", "plain"),
    "REG-236": (r"/global/newsroom/[^/]+/?$", "plain"),
    "REG-238": (r"/newsroom/[^/]+/?$", "plain"),
    "REG-239": (r"/en-[^/]+/\d+-[^/]+/?$", "partners"),
    "REG-240": (r"/newsarticle/\d+/[^/]+/?$", "external"),
    "REG-241": (r"/news/[^/]+/\d+/?$", "external"),
    "REG-242": (r"/[^/]+/news/[^/]+/?$", "external"),
    "REG-243": (r"/news/b2b-payments/20\d{2}/[^/]+/?$", "external"),
    "REG-244": (r"/news/[^/]+/\d+/?$", "external"),
}
#: Publishers whose date stands on the article only.
DATED_LATER = ("REG-240", "REG-241", "REG-243", "REG-244")
LIMITS = {"REG-238": 25, **dict.fromkeys(("REG-240", "REG-241", "REG-242", "REG-243", "REG-244"), 20)}
PUBLISHER_RELEVANT = (
    r"(small business|sme|merchant|seller|business ownership|businesses|commercial|commerce|"
    r"payments?|checkout|pos|point of sale|acquiring|card|stablecoin|agentic|ai agent|"
    r"openai|chatgpt|claude|embedded finance|banking|cash flow|working capital|treasury|"
    r"accounts payable|accounts receivable|reconciliation|global payments?|cross-border|"
    r"digital commerce|retail operation|commerce platform|b2b|smb|middle market|"
    r"virtual card|commercial card|supplier payments?|procurement|invoice|billing|"
    r"disbursements?|payment infrastructure|acceptance|freight payments?|swift|wero|fednow|rtp)"
)
PUBLISHER_NOISE = (
    r"(investor day|quarter results|annual letter|tender offer|board of directors|chief revenue officer|"
    r"chief financial officer|appointment|appointed|conference|stock|football|soccer|seahawks|arsenal|"
    r"jersey|sponsorship|climate|child safety|teen advisory|ipo|valuation|funding round|"
    r"podcasts?|consumer fraud|chip-enabled ebt|personal wallet|personal account|"
    r"raises? \$|raises? usd|series [abc]|funding|digital bank service|discontinue)"
)
PUBLISHER_STRONG = (
    r"(small business|sme|smb|merchant|seller|commercial|b2b|middle market|treasury|"
    r"cash flow|working capital|accounts payable|accounts receivable|reconciliation|"
    r"cross-border|global payments?|stablecoin|embedded|api|open banking|payment infrastructure|"
    r"virtual card|commercial card|supplier payments?|procurement|invoice|billing|"
    r"acceptance|acquiring|pos|freight payments?|swift|wero|fednow|rtp)"
)
_RAISES, _RAISED_FOR = r"(raises? \$|raises? usd|series [abc]|funding)", r"(payments?|cross-border|stablecoin|treasury|merchant|sme|smb|commercial|working capital)"
_LISTED, _PARTNER = r"(nasdaq|listing|stock|investor|consumer help|personal account)", r"(wise platform|partner|partnership|bank|payments canada|payment infrastructure|international payments?|business|businesses|api|embedded|cross-border)"
_NOISE_BUT = r"(seller|merchant|small business|sme|payment|checkout|commerce|stablecoin|agentic|pos|working capital|treasury)"
_CONSUMER, _BUSINESS = r"(consumer|wallet|retail payments?)", r"(merchant|business|commercial|b2b|sme|smb|supplier|treasury|acceptance|acquiring|pos|ecommerce|online payments?)"
DATE = r"(\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s+(?:Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)\s+\d{4}\b)"
LOCAL_SIGNAL = (
    r"(kobi|kobİ|ticari|işletme|isletme|esnaf|pos|ticari kart|bankamatik|tahsilat|"
    r"nakit yönetimi|nakit yonetimi|kredi|mevduat|dış ticaret|dis ticaret|ödeme|odeme|"
    r"üye işyeri|uye isyeri|merchant|commercial|kampanya|duyuru|basın|basin|haber)"
)
CARD_POSITIVE = (
    r"(kobi|ticari|ticari kart|qnb kobi|pos|üye işyeri|uye isyeri|sanal pos|link pos|ceppos|"
    r"yazar kasa|kobi rahat|işim için|isim icin|kredi|kampanya|parapuan|taksit|aidat|"
    r"dijital kanal|e-fatura|efatura|e-arşiv|e-arsiv|e-dönüşüm|e-donusum|tahsilat|ödeme|odeme)"
)
CARD_NEGATIVE = (
    r"(qnb first|qnb private|bireysel|ihtiyaç kredisi|ihtiyac kredisi|konut|taşıt|tasit|"
    r"miles|doktor|emekli|öğrenci|ogrenci|tatil|restoran|giyim|market|akaryakıt|"
    r"akaryakit|kozmetik|sinema|konser|çekiliş|cekilis|kişisel kredi kartı|kisisel kredi karti)"
)
_CARD_BUT = r"(kobi|ticari|pos|üye işyeri|uye isyeri|kobi rahat)"
NETWORK_RELEVANT = (
    r"(small business|sme|merchant|acquiring|pos|commercial|commercial card|business card|"
    r"accounts receivable|virtual card|payable|supplier|issuer|b2b|embedded|openai|"
    r"ai commerce|agentic|programmable commerce|stablecoin|token|settlement|identity|"
    r"\btap\b|digital commerce|payment|payments)"
)
NETWORK_NOISE = (
    r"(investor|conference|common stock|exchange offer|class b|press releases listing|"
    r"see all press releases|fifa|soccer|football|fan-powered|fan powered|sudeikis|"
    r"men in blazers|olympic|paralympic)"
)
RULES = (
    Rule("tbank_local_news_link", host=r"tbank\.com\.tr", page=r"/haberler/|/duyurular/", path=r"/haberler/detay/|/hakkimizda/duyuru-detay/", title="parent", title_cut=r"\bDevamı\b", undated_title=True, date="title|path", or_dated=True, score=16, dated=8,
         positive=r"(tüzel|tuzel|ticari|kurumsal|kobi|nakit|kredi|döviz pozisyon|doviz pozisyon|şube|sube|sendikasyon|finansman|nakit yönetimi|dış ticaret|dis ticaret)"),
    Rule("turkishbank_news_link", host=r"turkishbank\.com", page=r"/hakkimizda/bizden-haberler", path=r"/hakkimizda/bizden-haberler/", not_path=r"^/hakkimizda/bizden-haberler/*$", date="title|path", score=18, dated=6,
         positive=r"(ticari|kurumsal|teknoloji bankacılığı|teknoloji bankaciligi|t-gate|api|açık bankacılık|acik bankacilik|finansal kurumlar|ödeme|odeme|tahsilat|rapor|faaliyet|finansal tablo|turkishbank)",
         negative=r"(tiyatro|kokteyl|yeni yıl|vergi söyleşisi|ekonomi sohbetleri|açık yatırım|acik yatirim)", unless=r"(ticari|kurumsal|teknoloji|api|ödeme|odeme)"),
    Rule("turk_ticaret_export_news", host=r"turkticaretbankasi\.com\.tr", page=r"^/icerikler/", path=r"^/icerik/", not_path=r"^/icerik/(?:duyurular|nakit-yonetimi|subeler|urun-ve-hizmet-ucretleri)$", title="lead", title_cut=r"\bDetaylı Bilgi\b", blob="title|anchor|path", date="assets", score=24, dated=10, keep="grow",
         positive=r"(ihracat|ihracatçı|ihracatci|dış ticaret|dis ticaret|finansman|kredi|işletme sermayesi|isletme sermayesi|teminat|akreditif|şube|sube|nakdi|gayrinakdi|tim|eximbank|ige|reeskont|reel sektör|reel sektor)",
         negative=r"(siber güvenlik|siber guvenlik|salkım hesap|salkim hesap|sigorta|faaliyet raporu)", unless=r"(ihracat|şube|sube|finansman)", unless_on="title|path"),
    Rule("visa_relevant", sources="REG-034|REG-070", same_site=True, path=r"press-releases\.releaseId\.", positive=NETWORK_RELEVANT, negative=NETWORK_NOISE, negative_link=True, date="title|path", score=6, keep="grow"),
    Rule("sekerbank_next_announcement", sources="REG-140", scope=selectors.DATA_SCRIPT, gate=True, gate_not_on=r"/basin-bultenlerimiz/", score=28, award=True),
    Rule("fibabanka_campaign_card", sources="REG-148", card="campaign card", card_needed=True, path=r"/kampanyalar/", undated_title=True, longest=180, gate=True, date="card", score=24, dated=6, keep="grow"),
    Rule("anadolubank_press_archive", sources="REG-153", card="reports li|li", card_needed=True, first_in_card=True, path=r"/basin-bultenleri-ve-roportajlar/", title="card", title_cut=r"\bGörüntüle\b", gate=True, score=24),
    Rule("odeabank_press_archive", sources="REG-096", scope="detail link", card="bulletin box", gate=True, score=24, award=True),
    Rule("alternatif_bank_press_card", sources="REG-118", card="item", card_needed=True, first_in_card=True, title="card", title_cut=r"\bDetaylı Bilgi Al\b", title_to_date=True, blob="title|url", date="card", score=18, dated=10, keep="all",
         positive=r"(kobi|ticari|kurumsal|bonus business|pos|sanal pos|yazarkasa pos|üye işyeri|uye isyeri|tahsilat|nakit yönetimi|nakit yonetimi|dış ticaret|dis ticaret|vov tüzel|vov tuzel|işletme|isletme|kgf|ihracat|iş birliği|is birligi|api|dijital ticari|masrafsız bankacılık|masrafsiz bankacilik)",
         negative=r"(restoran|kozmetik|giyim|sevgililer günü|sevgililer gunu|okul alışverişi|okul alisverisi|kişisel kart|kisisel kart|bireysel|akaryakıt|akaryakit|tatil|sinema|çekiliş|cekilis|ihtiyaç kredisi|ihtiyac kredisi)"),
    Rule("ing_press_pdf_card", sources="REG-083", card="line", href=r"\.pdf", title="strong", title_cut=r"^\d{1,2}[./]\d{1,2}[./]\d{4}", blob="title|href|card", date="card", score=18, dated=12, keep="all",
         positive=r"(kobi|kobilere|ticari|ing business|pos|üye işyeri|uye isyeri|şirket kredi kartı|sirket kredi karti|dijital ticari|nakit yönetimi|nakit yonetimi|tahsilat|açık bankacılık|acik bankacilik|api|e-fatura|dış ticaret|dis ticaret|leasing|kobi finansmanı|ödeme|odeme)",
         negative=r"(emekli|bireysel ihtiyaç|bireysel ihtiyac|turuncu hesap|konut|taşıt|tasit|bireysel kart|çalışan|calisan|spor|sponsor|tasarruf araştırması|tasarruf arastirmasi|practica|yetenek programı|yetenek programi|anaokulu|kampüs|kampus|kadınlar günü|kadinlar gunu|üst düzey atama|ust duzey atama|finansal sonuç|finansal sonuc|aktif büyüklüğü|aktif buyuklugu)"),
    Rule("burgan_press_pdf", sources="REG-098", path=r"\.pdf$", undated_title=True, blob="title|parent|path", date="blob", score=22, dated=8,
         positive=r"(kobi|ticari|kurumsal|faktoring|ebrd|sendikasyon|finansman|nakit|dış ticaret|dis ticaret|ihracat|ithalat|proje finansmanı|teminat|akreditif|ticari müşteri|ticari musteri)",
         negative=r"(on dijital|on plus|alışveriş|alisveris|vatan|biletinial|kripto|tatil|restoran|sinema|istanbul modern|pati|great place|çalışan|calisan|employer|sponsor|yatırım fonu|eurobond)",
         unless=r"(kobi|ticari|kurumsal|faktoring|ebrd|sendikasyon|finansman|nakit|dış ticaret|dis ticaret|ihracat|ithalat|proje finansmanı|teminat|akreditif|ticari müşteri|ticari musteri)", unless_on="title"),
    Rule("enpara_sirketim_campaign_link", sources="REG-101", path=r"/sirketim/kampanyalar/", not_path=r"/sirketim/kampanyalar/*$", blob="title|parent|path", score=26,
         positive=r"(sirketim|şirketim|işletme|isletme|şirket|sirket|ticari|pos|sgk|maaş|maas|ödeme|odeme|kredi kartı|kredi karti|günlük hesap|gunluk hesap|tavsiye|ücret|ucret|komisyon)"),
    Rule("is_bankasi_duyuru_detail", sources="REG-006", same_site=True, undated_title=True, blob="title|parent|path", positive=LOCAL_SIGNAL, negative_link=True, unless=LOCAL_SIGNAL, unless_on="title", date="blob", shortest=12, score=18, dated=8, more=html.COMMERCE, more_points=8, yet_more=r"\.pdf$", yet_more_points=2,
         path=r"(/duyurular/.+|/kampanyalar/.+|/bankamizi-taniyin/is-bankasindan-haberler/.+|/contentmanagement/documents/.+|/documents/.+)",
         not_path=r"^/(is-ticari|krediler|kartlar|genel-bilgi|mevduat-ve-yatirim|dijital-bankacilik|sigorta-ve-emeklilik|odemeler-ve-para-transferi|bankamizi-taniyin|guvenlik|urun-ve-hizmet-ucretleri|duyurular|kampanyalar)/?$"),
    Rule("bddk_duyuru_detail", sources="REG-052", same_site=True, path=r"/Duyuru/Detay/\d+$", title_cut=r"^\d{1,2}\.\d{1,2}\.\d{4}\s+", date="anchor start", date_needed=True, shortest=12, score=28),
    *(Rule(f"global_payments_news_card {source}", sources=source, same_site=True, path=path, title="heading", blob="anchor|parent|path", date="english", date_needed=source not in DATED_LATER, shortest=12, longest=180, score=30, more=_SELLER, more_points=8, yet_more=_FUTURE, yet_more_points=5, keep="grow", publisher=kind, k=LIMITS.get(source, 0))
      for source, (path, kind) in PUBLISHERS.items()),
    Rule("yapi_kredi_campaign_detail", sources="REG-011", scope="main|content|", path=r"/kampanyalar/detay/\d+", score=16, more=r"^.{20,180}$", more_points=4, blob="title", keep="grow"),
    Rule("yapi_kredi_press_download", sources="REG-012", scope="press result", path=r"/medium/file/.+/download/?$", date="texts", score=22, keep="texts"),
    Rule("qnbcard_kobi_campaign_detail", sources="REG-061|REG-062|REG-063|REG-064|REG-065|REG-066|REG-067|REG-068", path=r"/qnb-kobi-ticari-kredi-karti-kampanyalari/.+", blob="title|url", positive=CARD_POSITIVE, negative=CARD_NEGATIVE, unless=_CARD_BUT, score=22, keep="grow"),
)
_KINDS = {"str": "string", "int": "int", "bool": "boolean"}


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules as rows, in their order."""
    names = [f.name for f in fields(Rule)]
    schema = ", ".join(f"rule_{f.name} {_KINDS[f.type]}" for f in fields(Rule)) + ", rule_order int"
    return spark.createDataFrame([(*(getattr(r, n) for n in names), i) for i, r in enumerate(rules)], schema)


def _found(c: Column, p: Column) -> Column:
    """Whether a pattern that is a column is found, without case; an empty pattern is found nowhere."""
    return (p != "") & F.coalesce(F.rlike(c, F.concat(F.lit("(?iuU)"), F.when(p == "", "$^").otherwise(p))), F.lit(False))


def _has(c: Column, pattern: str) -> Column:
    """Whether the rule's pattern is found."""
    return _found(c, F.col(f"rule_{pattern}"))


def _in_blob(pattern: str) -> Column:
    """Whether the rule's pattern is found in the blob, by its plain reading where it has one."""
    p, read = F.col(f"rule_{pattern}"), F.col(f"plain_{pattern}")
    return (p != "") & F.when(read.isNull(), _has(F.col("blob"), pattern)).otherwise(F.coalesce(F.rlike("plain_blob", read), F.lit(False)))


def _relevant(title: Column, url: Column, body: Column) -> Column:
    """The gate of small-business relevance on the path, the title and the first 700 characters around it."""
    blob = squeeze(F.concat_ws(" ", F.translate(urls.path(url), "-", " "), title, F.substring(body, 1, 700)))
    return matches(blob, roles.SMALL_BUSINESS)


def worth_publishing(kind: Column, title: Column, blob: Column) -> Column:
    """Whether a publisher's article concerns payments of businesses; blob: its title, context and path."""
    return bound({"title": title, "blob": blob, "read": plain(blob)}, lambda b: _worth(kind, **b))


def _worth(kind: Column, title: Column, blob: Column, read: Column) -> Column:
    raised = matches(title, _RAISES) & ~matches(title, _RAISED_FOR)
    external = kind == "external"
    common = ~(matches_plain(read, PUBLISHER_NOISE) & ~matches_plain(read, _NOISE_BUT)) & ~(matches_plain(read, _CONSUMER) & ~matches_plain(read, _BUSINESS))
    return (
        F.when(~matches_plain(read, PUBLISHER_RELEVANT), False)
        .when(external & (~matches_plain(read, PUBLISHER_STRONG) | raised), False)
        .when(kind == "partners", ~matches_plain(read, _LISTED) & matches_plain(read, _PARTNER))
        .when((kind == "council") & F.lower(blob).contains("european payments council"), True)
        .otherwise(common)
    )


def _english_title(c: Column) -> Column:
    """A publisher's title without dates, reading times, sections and calls to read on."""
    months = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t)?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
    out = c
    for p in (
        rf"\b(?:{months})\s+\d{{1,2}},\s*20\d{{2}}\b",
        rf"\b\d{{1,2}}\s+(?:{months})\s+20\d{{2}}\b",
        r"\b20\d{2}-\d{2}-\d{2}\b",
        r"\s*/\s*\d+\s*min\s*read\b",
        r"\s*/\s*(?:news|fintech|payments?|b2b payments?|expert views)\b",
        r"\b(?:read article|read more|learn more)\b",
    ):
        out = F.regexp_replace(out, "(?i)" + p, "")
    out = F.regexp_replace(squeeze(out), r"^[ \-–|]+|[ \-–|]+$", "")
    return squeeze(F.regexp_replace(out, r"(?i)^(?:product|corporate|company|pov|insights|press releases?)\s+", ""))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages (page_id, url, source_id, ...) that have a rule, with the order of the first they have.

    The rules go along as one row, so a page is judged where it is read and nothing is joined by page.
    """
    asked = rules.agg(F.array_sort(F.collect_list(F.struct("rule_order", "rule_host", "rule_page", F.split("rule_sources", r"\|").alias("sources")))).alias("_rules"))
    known = pages.withColumns({"_host": urls.netloc("url"), "_path": urls.path("url"), "_source": F.coalesce(F.col("source_id").cast("string"), F.lit(""))})
    by_host = lambda r: (r["rule_host"] != "") & _found(F.col("_host"), r["rule_host"]) & _found(F.col("_path"), r["rule_page"])
    first = F.get(F.filter("_rules", lambda r: by_host(r) | ((F.col("_source") != "") & F.array_contains(r["sources"], F.col("_source")))), F.lit(0))["rule_order"]
    return once(known.crossJoin(F.broadcast(asked)).withColumn("rule_order", first).drop("_rules", "_host", "_path", "_source")).where(F.col("page_id").isNotNull() & F.col("rule_order").isNotNull())


def adapted(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, url, title, score, reason, date: the items of pages (page_id, url, html, source_id) by the rules of their sites."""
    rules = rules if rules is not None else rule_table(pages.sparkSession)
    found = selectors.anchors(ruled(pages, rules), SCOPES | CARDS, frozenset(CARDS), also=("rule_order",))
    read = rules.withColumns({f"plain_{c}": plain_pattern(F.col(f"rule_{c}")) for c in ("positive", "negative", "unless", "more", "yet_more")})
    rows = found.join(F.broadcast(read), "rule_order")
    split = lambda c: F.split(c, r"\|")
    around = F.transform("cards", lambda c: c["name"])
    # the first of the rule's scopes that the page has; an empty name is the whole page
    wanted = F.get(F.filter(split("rule_scope"), lambda s: (s == "") | F.array_contains(F.concat("on_page", around), s)), F.lit(0))
    in_scope = (F.col("rule_scope") == "") | (wanted == "") | F.coalesce(F.array_contains(around, wanted), F.lit(False))
    card = F.get(F.filter(F.flatten(F.transform(split("rule_card"), lambda n: F.filter("cards", lambda c: c["name"] == n))), lambda c: c.isNotNull()), F.lit(0))
    rows = rows.where(in_scope).withColumn("card", card).where((~F.col("rule_card_needed") | F.col("card").isNotNull()) & (~F.col("rule_first_in_card") | F.coalesce("card.first", F.lit(True))))
    rows = once(rows.withColumns({"around": F.coalesce("card.text", "parent"), "link": urls.absolute("href", "base")}))
    rows = once(rows.withColumn("link_path", urls.path("link")))
    path = F.col("link_path")
    rows = rows.where(urls.scheme("link").isin("http", "https") & (~F.col("rule_same_site") | urls.below("base", "link")))
    rows = rows.where(((F.col("rule_path") == "") | _has(path, "path")) & ~_has(path, "not_path") & ((F.col("rule_href") == "") | _has(F.col("href"), "href")))

    publisher = F.col("rule_publisher") != ""
    heading = F.when(F.col("heading") != "", F.col("heading")).when(F.col("attribute") != "", F.col("attribute")).otherwise(F.col("anchor"))
    rows = once(rows.withColumn("shown", heading))
    rows = once(rows.withColumn("short", F.when(publisher, _english_title(F.col("shown")))).withColumn("context", F.when(publisher, F.concat_ws(" ", "shown", "parent", F.translate(path, "-", " ")))))
    short = F.col("short")
    filled = lambda c, otherwise: F.when(F.col(c) != "", F.col(c)).otherwise(otherwise)
    named = (
        F.when(publisher, F.when((short == "") | F.lower(short).isin("product", "corporate", "company", "pov", "insights", "press releases"), _english_title(F.col("parent"))).otherwise(short))
        .when(F.col("rule_title") == "lead", filled("lead", F.col("anchor")))
        .when(F.col("rule_title") == "parent", F.col("parent"))
        .when(F.col("rule_title") == "card", F.col("around"))
        .when(F.col("rule_title") == "strong", F.coalesce("card.strong", F.lit("")))
        .otherwise(F.when(matches(F.trim("anchor"), html.GENERIC_TITLE), "").otherwise(F.col("anchor")))
    )
    cut = F.when(F.col("rule_title_cut") == "", F.col("named")).otherwise(F.regexp_replace("named", F.concat(F.lit("(?iuU)"), F.col("rule_title_cut")), ""))
    first_date = lambda c: F.regexp_extract(c, "(?iuU)" + DATE, 1)
    told_date = first_date(F.col("dated_title"))
    to_date = F.when(F.col("rule_title_to_date") & (told_date != ""), F.call_function("substring_index", "dated_title", told_date, F.lit(1))).otherwise(F.col("dated_title"))
    undated = F.when(F.col("rule_undated_title"), F.regexp_replace(F.regexp_replace(to_date, "(?iuU)" + DATE, ""), r"^[ \-–|]+|[ \-–|]+$", "")).otherwise(to_date)
    rows = once(rows.withColumn("named", named))
    rows = once(rows.withColumn("dated_title", squeeze(cut)))
    rows = once(rows.withColumn("title", squeeze(undated)))
    rows = once(rows.withColumn("title", F.when((F.col("title") == "") & ~publisher, F.when(matches(path, r"\.pdf$"), urls.file_title("link")).otherwise(title_from_slug("link"))).otherwise(F.col("title"))))
    rows = rows.withColumn("title", F.when((F.col("rule_longest") > 0) & (F.length("title") > 180), F.when(publisher, F.concat(F.regexp_replace(F.trim(F.substring("title", 1, 177)), r"[ ,.;:]+$", ""), F.lit("..."))).otherwise(F.trim(F.substring("title", 1, 180)))).otherwise(F.col("title")))

    places = {"title": F.col("title"), "parent": F.col("parent"), "path": F.translate(path, "-", " "), "card": F.substring("around", 1, 300), "href": F.col("href"), "anchor": F.col("anchor"), "url": F.translate("link", "-", " ")}
    joined = lambda names: squeeze(F.concat_ws(" ", *[F.when(F.array_contains(split(names), n), c) for n, c in places.items()]))
    rows = once(rows.withColumn("blob", joined("rule_blob")))
    spoken = F.when(F.col("rule_date") == "card", F.col("around")).when(F.col("rule_date") == "title|path", F.concat_ws(" ", "dated_title", F.translate(path, "-", " "))).otherwise(F.concat_ws(" ", "dated_title", "blob"))
    # a date is looked for where the rule asks for one
    asked = F.col("rule_date").isin("blob", "card", "title|path") | F.col("rule_or_dated")
    rows = once(rows.withColumn("written", F.when(asked, first_date(spoken)).otherwise("")).withColumn("pictured", F.array_join("images", " ")).withColumn("plain_blob", plain("blob")))
    six, month = r"([0-3]\d)([01]\d)(2[0-9])", r"/(20\d{2})/([01]\d)/"
    assets = F.col("pictured")
    asset = F.when(F.regexp_extract(assets, six, 1) != "", dates.date_of(F.concat(F.lit("20"), F.regexp_extract(assets, six, 3)), F.regexp_extract(assets, six, 2), F.regexp_extract(assets, six, 1))).otherwise(dates.date_of(F.regexp_extract(assets, month, 1), F.regexp_extract(assets, month, 2), F.lit("1")))
    how = F.col("rule_date")
    local = F.when(how.isin("blob", "card", "title|path"), F.col("written")).when(how == "anchor start", F.regexp_extract("anchor", r"^(\d{1,2}\.\d{1,2}\.\d{4})\s+.+$", 1)).when(how == "texts", F.col("anchor"))
    rows = once(rows.withColumn("local_date", local))
    day = F.when(how == "assets", asset).when(how == "english", F.coalesce(dates.english("context"), dates.dated_slug("link"))).otherwise(dates.turkish("local_date"))
    rows = once(rows.withColumn("date", day))
    wanted_word = (F.col("rule_positive") == "") | _in_blob("positive") | (F.col("rule_or_dated") & (F.col("written") != ""))
    excused = F.when(F.col("rule_unless_on") == "title", _has(F.col("title"), "unless")).when(F.col("rule_unless_on") == "title|path", _has(F.concat_ws(" ", "title", F.translate(path, "-", " ")), "unless")).otherwise(_in_blob("unless"))
    unwanted = (_in_blob("negative") | (F.col("rule_negative_link") & html.negative_link(F.col("title"), F.col("link")))) & ~excused
    gated = F.col("rule_gate") & ~_has(path, "gate_not_on") & ~_relevant(F.col("title"), F.col("link"), F.coalesce("card.text", F.lit("")))
    rows = rows.where(wanted_word & ~unwanted & ~gated & (F.length("title") >= F.col("rule_shortest")))
    points = F.col("rule_score") + F.when(F.col("date").isNotNull(), F.col("rule_dated")).otherwise(0) + F.when(_in_blob("more"), F.col("rule_more_points")).otherwise(0) + F.when(_in_blob("yet_more") | _has(path, "yet_more"), F.col("rule_yet_more_points")).otherwise(0)
    points = points + F.when(F.substring_index("rule_name", " ", 1) == "visa_relevant", html.link_score(F.col("title"), F.col("link"))["score"]).otherwise(0)
    rows = once(rows.withColumn("score", points))

    # the anchors of one url on one page, in their order
    kind = F.struct("position", "score", "title", "date", "context")
    url = F.when(publisher, urls.canonical("link")).otherwise(F.col("link"))
    each = rows.groupBy("page_id", "rule_order", url.alias("url"), F.when(F.col("rule_keep") == "all", F.col("position")).alias("one")).agg(F.array_sort(F.collect_list(kind)).alias("all"))
    rule = rules.select("rule_order", *[F.col(f"rule_{c}") for c in ("name", "keep", "award", "publisher", "date_needed", "k")])
    each = each.join(F.broadcast(rule), "rule_order")
    grown = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.when((b["score"] > a["score"]) | (F.length(b["title"]) > F.length(a["title"])), b).otherwise(a))
    first_day = F.get(F.filter(F.transform("all", lambda x: x["date"]), lambda d: d.isNotNull()), F.lit(0))
    # a download's texts: the one that is a date gives the date, the first other of 20 to 180 characters the title
    told = F.get(F.filter("all", lambda x: x["date"].isNull() & F.length(x["title"]).between(20, 180)), F.lit(0))
    one = F.when(F.col("rule_keep") == "grow", grown).otherwise(F.element_at("all", -1))
    each = once(each.withColumn("one", one)).withColumn("day", F.when((F.col("rule_publisher") != "") | (F.col("rule_keep") == "texts"), first_day).otherwise(F.col("one.date")))
    title = F.when(F.col("rule_keep") == "texts", F.coalesce(told["title"], title_from_slug("url"))).otherwise(F.col("one.title"))
    context = F.substring(F.array_join(F.transform("all", lambda x: x["context"]), " "), 1, 1400)
    each = once(each.withColumn("title", title))
    each = once(each.withColumn("blob", F.when(F.col("rule_publisher") != "", squeeze(F.concat_ws(" ", "title", context, F.translate(urls.path("url"), "-", " "))))))
    each = each.where((~F.col("rule_date_needed") | F.col("day").isNotNull()) & ((F.col("rule_publisher") == "") | worth_publishing(F.col("rule_publisher"), F.col("title"), F.col("blob"))))
    reason = F.concat(F.substring_index("rule_name", " ", 1), F.when(F.col("rule_award") & matches("title", roles.AWARD), ",award_candidate").otherwise(""))
    reason = F.when(F.col("rule_name") == "visa_relevant", F.concat(F.lit("visa_relevant,"), html.link_score(F.col("title"), F.col("url"))["reason"])).otherwise(reason)
    out = each.select("page_id", "url", "title", F.col("one.score").alias("score"), reason.alias("reason"), F.col("day").alias("date"), "rule_k")
    placed = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc_nulls_last("date"), F.desc("score"), "url"))
    return out.withColumn("_place", placed).where((F.col("rule_k") == 0) | (F.col("_place") <= F.col("rule_k"))).drop("_place", "rule_k")


def items(pages: DataFrame, k: int = 50) -> DataFrame:
    """The items of stored pages: by the rules of their sites, else the general candidates.

    The rules' items are written first, so that only the pages without any are parsed for general candidates.
    """
    own = staged(adapted(spread(pages)), "site-items")
    rest = pages.join(own.select(F.col("page_id").alias("_own")).distinct(), F.col("page_id").cast("long") == F.col("_own"), "left_anti")
    general = html.candidates(html.links(spread(rest)), k)
    # the pages of two sources list campaigns and downloads only
    listed = rest.where(F.col("source_id").isin("REG-011", "REG-012")).select(F.col("page_id").cast("long").alias("page_id"), F.lit(True).alias("_listed")).distinct()
    kept = general.join(listed, "page_id", "left")
    kept = kept.where(F.col("_listed").isNull() | matches(urls.path("url"), r"/kampanyalar/detay/\d+|/medium/file/.+/download/?$"))
    return own.unionByName(kept.select(*own.columns))


def api_campaigns(responses: DataFrame, body: str = "body", base: str = "https://www.qnb.com.tr/kampanyalar/") -> DataFrame:
    """Campaigns out of stored JSON responses (response_id, body): title, url, score, reason, date.

    The start date counts, else the end date; a campaign without an address of its own has an external one.
    """
    items_ = F.from_json(body, "struct<Items array<struct<Title string, CampaignUrl string, ExternalUrl string, StartDate string, EndDate string>>>")["Items"]
    rows = responses.select("response_id", F.explode(items_).alias("i")).select("response_id", squeeze("i.Title").alias("title"), squeeze("i.CampaignUrl").alias("own"), squeeze("i.ExternalUrl").alias("other"), "i.StartDate", "i.EndDate")
    rows = rows.withColumn("url", F.when(F.col("own") != "", urls.absolute("own", F.lit(base))).otherwise(F.col("other"))).where((F.col("title") != "") & (F.col("url") != ""))
    blob = F.translate(F.concat_ws(" ", "title", "url"), "-", " ")
    rows = rows.where(matches(blob, CARD_POSITIVE) & ~(matches(blob, CARD_NEGATIVE) & ~matches(blob, _CARD_BUT)))
    day = lambda c: F.try_to_date(F.regexp_extract(text(c), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    rows = rows.withColumns({"start": day("StartDate"), "end": day("EndDate")})
    suffix = F.when(F.col("start").isNotNull(), ",api_start_date").when(F.col("end").isNotNull(), ",api_end_date").otherwise("")
    return rows.select("response_id", "url", "title", F.when(F.col("start").isNotNull(), 24).otherwise(18).alias("score"), F.concat(F.lit("qnb_campaign_api"), suffix).alias("reason"), F.coalesce("start", "end").alias("date"))
