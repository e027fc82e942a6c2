"""Glossaries: ordered replacements of words and phrases, and word normalisation.

The order of replacements is part of the result, so a glossary is applied as one vectorised
function over a column; glossaries are parameters of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.functions.text import text


class Glossary:
    """Repairs first, then the whole text, then phrases, then single terms, the longest first."""

    def __init__(self, terms: Mapping[str, str], phrases: Mapping[str, str] | None = None, repairs: Mapping[str, str] | None = None) -> None:
        self.repairs, self.phrases = dict(repairs or {}), dict(phrases or {})
        self.whole = {k.casefold(): v for k, v in terms.items()}
        longest = sorted(terms, key=len, reverse=True)
        self.terms = [(re.compile(rf"(?<!\w){re.escape(t)}(?!\w)" if re.fullmatch(r"[\w /&.-]+", t) else re.escape(t), re.IGNORECASE), terms[t]) for t in longest]

    def one(self, value: str | None) -> str:
        t = " ".join((value or "").split())
        for old, new in self.repairs.items():
            t = t.replace(old, new)
        if t.casefold() in self.whole:
            return self.whole[t.casefold()]
        for old, new in self.phrases.items():
            t = t.replace(old, new)
        for pattern, new in self.terms:
            t = pattern.sub(lambda _, n=new: n, t)
        return t

    def translate(self, value: str | None) -> str:
        """Lists are translated part by part: at semicolons, or at commas in short texts."""
        v = value or ""
        for sep in (";", ","):
            if sep in v and (sep == ";" or len(v) < 200):
                return f"{sep} ".join(self.one(p) for p in v.split(sep))
        return self.one(v)


def translated(c: Column | str, glossary: Glossary) -> Column:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        done = {v: glossary.translate(v) for v in values.unique()}
        return values.map(done)

    return run(text(c))


def translate_table(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Every text column of a table translated."""
    kinds = dict(df.dtypes)
    return df.select(*[translated(c, glossary).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns])


def rewrite(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered pattern rewrites, case ignored."""
    out = text(c)
    for pattern, new in rules:
        out = F.regexp_replace(out, "(?iuU)" + pattern, new)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# fixed values: endings that word counts drop, in the order in which they are tried
ENDINGS = ("lerinin", "larının", "lere", "lara", "leri", "ları", "lerden", "lardan", "den", "dan", "ten", "tan", "yle", "yla", "ye", "ya", "ler", "lar")
# fixed values: genitive and copula endings
GENITIVE = "(nin|nın|nun|nün|in|ın|un|ün)$"
COPULA = "(dir|dır|dur|dür|tir|tır|tur|tür)$"
# fixed values: words that are counted as another one, and phrases that are counted as one word
CONCEPTS = {
    "kobiler": "kobi", "kobiye": "kobi", "kobinin": "kobi", "kobilere": "kobi", "kobi'lere": "kobi", "kobilerin": "kobi",
    "müşteriler": "müşteri", "müşterilere": "müşteri", "müşterilerinin": "müşteri", "ödemeler": "ödeme", "ödemeyi": "ödeme",
    "tahsilatı": "tahsilat", "tahsilatta": "tahsilat", "finansmanı": "finansman", "finansmana": "finansman",
    "dijitalleşme": "dijital", "dijitalleşmeyi": "dijital", "dönüşümü": "dönüşüm", "dönüşüme": "dönüşüm", "işbirliği": "iş birliği",
    "entegrasyonu": "entegrasyon", "entegrasyonları": "entegrasyon", "kartları": "kart", "kartı": "kart",
    "ödülleri": "ödül", "ödülü": "ödül", "ödüller": "ödül", "nakdi": "nakit", "nakdin": "nakit", "yönetimi": "yönetim",
    "müşteri": "müşteri", "musteri": "müşteri", "kobİ": "kobi", "kobı": "kobi", "pos": "pos",
}
PHRASES = {
    "iş birliği": "işbirliği", "iş birlikleri": "işbirliği", "üye işyeri": "üyeişyeri", "üye işyerleri": "üyeişyeri",
    "açık bankacılık": "açıkbankacılık", "gömülü finans": "gömülüfinans",
}
DISPLAY = {"işbirliği": "iş birliği", "üyeişyeri": "üye işyeri", "açıkbankacılık": "açık bankacılık", "gömülüfinans": "gömülü finans"}


def named(word: Column, names: Mapping[str, str]) -> Column:
    """A word by its name in a table, itself where the table has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), word)


# fixed values: words that are not counted
STOP_WORDS = (
    "acaba", "ama", "ancak", "artık", "aslında", "alternatif", "arasında", "ayrıca", "aynı", "bazı", "belki", "ben", "benzer", "bile", "bir", "biraz", "birçok", "biri", "biz", "bu", "buna", "bunda",
    "bundan", "bunu", "dair", "çok", "çünkü", "da", "dan", "daha", "de", "den", "defa", "değil", "diye", "dış", "edecek", "eden", "ederek", "edilen", "ediliyor", "etti", "ettiği", "en", "finance",
    "genel", "gibi", "göre", "hem", "haber", "her", "için", "ilgili", "ilişkin", "ile", "ilk", "in", "ise", "kadar", "kapsamında", "karşı", "kurum", "kurumsal", "olarak", "olan", "önce", "oldu",
    "olduğu", "olmak", "olması", "olduğunu", "sahip", "seçildi", "sonra", "sonuç", "şu", "tarafın", "tarafında", "tarafından", "türki", "türkiye", "üzerinden", "ve", "veya", "yönelik", "ya", "yani",
    "yeni", "nin", "nın", "nun", "nün", "dir", "dır", "dur", "dür", "tir", "tır", "tur", "tür", "banka", "bank", "bankası", "banker", "gelişme", "madde", "içerik", "yönetici", "gönderilen", "global",
    "awards", "award", "akbank", "garanti", "bbva", "yapı", "qnb", "finansbank", "aldı", "düzenlenen", "itibarını", "platform", "platformu", "pratik", "önemi", "sinyali", "şekerbank", "the", "türk",
    "üretmiyor",
)


def word_stem(c: Column | str, concepts: Mapping[str, str] = CONCEPTS) -> Column:
    """A word without genitive and copula, and without the first plural or case ending that leaves over three
    letters; before and after the ending it is counted as its concept.

    Of two endings that fit one word the longer comes first in ``ENDINGS``, which is also what a pattern finds
    first, so all of them are one pattern and the plan stays small.
    """
    w = F.regexp_replace(F.trim(F.lower(text(c))), "^['’`-]+|['’`-]+$", "")
    w = named(F.regexp_replace(F.regexp_replace(w, GENITIVE, ""), COPULA, ""), concepts)
    return named(F.regexp_replace(w, f"(?<=.{{4}})(?:{'|'.join(ENDINGS)})$", ""), concepts)


def word_frequencies(df: DataFrame, column: str, stop: Sequence[str] = STOP_WORDS, shortest: int = 3) -> DataFrame:
    """(word, n): words without markup, urls and digits, by stem; phrases of ``PHRASES`` are one word."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text(column)), "<[^>]+>", " "), r"https?://\S+|www\.\S+", " ")
    for phrase, word in PHRASES.items():
        t = F.replace(t, F.lit(phrase), F.lit(word))
    words = df.select(F.explode(F.split(F.regexp_replace(t, r"[^a-zçğıöşü\s]", " "), r"\s+")).alias("w"))
    # each distinct word is stemmed once, after the counts of a task are combined; what is asked of a stem is an
    # aggregate, as a plain filter would be pushed below the counts, where it stems every word of every text
    counted = words.groupBy("w").agg(F.count("*").alias("n")).select(word_stem("w").alias("word"), "n")
    skipped = F.max((F.length("word") < shortest) | (F.col("word").isin(*stop) if stop else F.lit(False))).alias("skipped")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"), skipped).where("NOT skipped")
    return counted.groupBy(named(F.col("word"), DISPLAY).alias("word")).agg(F.sum("n").alias("n"))
