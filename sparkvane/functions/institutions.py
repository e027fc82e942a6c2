"""Institutions by any of their names: identifier, display name, group and market."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.text import ascii_key, clean, text

# fixed values: identifier and display name of each institution, and the keys of its other names
INSTITUTIONS = {
    "garanti_bbva": ("Garanti BBVA", ("garanti bbva", "garanti")),
    "is_bankasi": ("İş Bankası", ("is bankasi", "turkiye is bankasi")),
    "yapi_kredi": ("Yapı Kredi", ("yapi kredi",)),
    "qnb_finansbank": ("QNB", ("qnb finansbank", "qnb bank", "qnb")),
    "alternatif_bank": ("Alternatif Bank", ("alternatif bank", "alternatifbank")),
    "denizbank": ("DenizBank", ("denizbank", "deniz bank")),
    "ing": ("ING", ("ing",)),
    "teb": ("TEB", ("teb", "turk ekonomi bankasi")),
    "sekerbank": ("Şekerbank", ("sekerbank", "seker bank")),
    "fibabanka": ("Fibabanka", ("fibabanka", "fiba banka")),
    "anadolubank": ("Anadolubank", ("anadolubank", "anadolu bank")),
    "odeabank": ("Odeabank", ("odeabank", "odea bank")),
    "burgan_bank": ("Burgan Bank", ("burgan bank", "burgan")),
    "hsbc": ("HSBC", ("hsbc", "hsbc bank", "hsbc turkiye")),
    "enpara": ("Enpara", ("enpara", "enpara com", "enpara com sirketim", "enpara sirketim", "enpara bank", "enpara bank a s")),
    "t_bank": ("T-Bank", ("t bank", "tbank", "turkland bank", "turkland bank a s")),
    "turkish_bank": ("TurkishBank", ("turkish bank", "turkishbank", "turkish bank a s")),
    "turk_ticaret_bankasi": ("Türk Ticaret Bankası", ("turk ticaret bankasi", "turk ticaret", "turk ticaret bankasi a s")),
    "colendi_bank": ("Colendi Bank", ("colendi bank",)),
    "fups_bank": ("FUPS Bank", ("fups bank",)),
    "icbc_turkey": ("ICBC Turkey", ("icbc turkey", "icbc")),
    "arap_turk_bankasi": ("Arap Türk Bankası", ("arap turk bankasi",)),
    "bank_of_china_turkey": ("Bank of China Turkey", ("bank of china turkey",)),
    "citibank": ("Citibank", ("citibank",)),
    "deutsche_bank": ("Deutsche Bank", ("deutsche bank",)),
    "jpmorgan_chase_bank": ("JPMorgan Chase Bank", ("jpmorgan chase bank", "jpmorgan")),
    "mufg_bank_turkey": ("MUFG Bank Turkey", ("mufg bank turkey",)),
    "intesa_sanpaolo": ("Intesa Sanpaolo", ("intesa sanpaolo",)),
    "rabobank": ("Rabobank", ("rabobank",)),
    "societe_generale": ("Société Générale", ("societe generale", "société générale")),
    "bank_mellat": ("Bank Mellat", ("bank mellat",)),
    "visa": ("Visa", ("visa",)),
    "mastercard": ("Mastercard", ("mastercard",)),
    "bkm": ("BKM", ("bkm",)),
    "troy": ("TROY", ("troy",)),
}
GROUPS = {
    "Büyük Ölçekli Bankalar": ("garanti_bbva", "is_bankasi", "yapi_kredi", "qnb_finansbank", "denizbank"),
    "Orta/Küçük Ölçekli Özel Bankalar": ("teb", "alternatif_bank", "ing", "sekerbank", "fibabanka", "anadolubank", "odeabank", "burgan_bank", "hsbc", "t_bank", "turkish_bank", "turk_ticaret_bankasi"),
    "Dijital/Gelişen Oyuncular": ("enpara", "colendi_bank", "fups_bank"),
    "Global Ödeme Ağları": ("visa", "mastercard"),
    "Sektör / Altyapı": ("bkm", "troy"),
}
OTHER_GROUP = "Diğer"
GLOBAL = (
    "adyen", "airwallex", "bank_of_america", "barclays", "checkout_com", "dbs", "jpmorgan_chase_bank", "klarna", "mastercard", "payments_dive", "paypal", "plaid", "revolut", "shopify", "square", "stripe",
    "the_paypers", "visa", "wells_fargo", "wise", "worldpay",
)
SCOPES = ("Global Gelişmeler", "Türkiye Bankacılığı")
#: Names that are one institution where duplicates are looked for.
SAME_FOR_DUPLICATES = ("enpara_qnb_alias_group", ("enpara", "enpara.com", "enpara bank", "enpara bank a.ş.", "qnb finansbank", "qnb bank", "qnb"))


def _table(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_BY_KEY = {key: i for i, (_, keys) in INSTITUTIONS.items() for key in keys}


def institution_id(name: Column | str) -> Column:
    """The identifier of a name: by its key, by its key without spaces, else the key itself as an identifier."""
    key = ascii_key(name)
    known = F.coalesce(F.try_element_at(_table(_BY_KEY), key), F.try_element_at(_table(_BY_KEY), F.replace(key, F.lit(" "), F.lit(""))))
    return F.coalesce(known, F.translate(key, " ", "_"))


def institution_name(name: Column | str) -> Column:
    """The display name of the institution; an unknown one keeps its name."""
    return F.coalesce(F.try_element_at(_table({i: shown for i, (shown, _) in INSTITUTIONS.items()}), institution_id(name)), clean(name))


def group(name: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_table({i: g for g, ids in GROUPS.items() for i in ids}), institution_id(name)), F.lit(OTHER_GROUP))


def market_scope(name: Column | str) -> Column:
    """Whether a development is told as one of the home market or of the world."""
    return F.when(institution_id(name).isin(*GLOBAL), SCOPES[0]).otherwise(SCOPES[1])


def duplicate_owner(name: Column | str) -> Column:
    """The owner under which duplicates are looked for: the folded name, or the group of names that are one."""
    from sparkvane.functions.ids import owner_key

    one, names = SAME_FOR_DUPLICATES
    return owner_key(name, {n: one for n in names})


def alias_join(left: DataFrame, right: DataFrame, name: str, right_name: str | None = None, how: str = "left") -> DataFrame:
    """Join on institutions by whatever names both sides have for them; the right side's name is dropped."""
    side = right.withColumn("_institution", institution_id(right_name or name)).drop(right_name or name)
    joined = left.withColumn("_institution", F.when(text(name) != "", institution_id(name))).join(side, "_institution", how)
    return joined.drop("_institution")
