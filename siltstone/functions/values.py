"""Functions over prices, durations, dates, product names and request fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transliterated hints for query words, and words for days from today.
CYRILLIC_HINTS = {"vitamin": "витамин", "d3": "д3", "magnesium": "магни", "omega": "омега", "calcium": "кальц"}
DAY_WORDS = {"bugun": 0, "ertaga": 1, "indinga": 2, "indin": 2}
NO_PRICE = "narx mavjud emas"
_DOSAGE = "(?iu)([0-9]+[.,]?[0-9]*\\s?(?:mg|mcg|mkg|iu|мг|мкг|ме|g|г))"
_PACK = "(?iu)№\\s?([0-9]+)|([0-9]+)\\s?(?:tab|caps|kaps|шт|таб|капс)"


def price_label(amount: Column, currency: Column) -> Column:
    return F.when(amount.isNull(), NO_PRICE).otherwise(F.concat(F.format_number(amount, 2), F.lit(" "), currency))


def spaced_price(amount: Column, currency: str = "UZS") -> Column:
    """Thousands parted by spaces, no decimals."""
    return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(" ")), F.lit(f" {currency}"))


def duration_label(minutes: Column) -> Column:
    return F.format_string("%dh %dm", F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)).cast("long"))


def size_label(n_bytes: Column) -> Column:
    """Bytes up to GB, one decimal."""
    out, value = None, n_bytes.cast("double")
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        label = F.concat(F.format_number(value / (1024.0**i), 1), F.lit(f" {unit}"))
        test = value < 1024.0 ** (i + 1)
        out = F.when(test, label) if out is None else (out.when(test, label) if unit != "GB" else out.otherwise(label))
    return F.replace(out, F.lit(","), F.lit(""))


def iso_minutes(duration: Column) -> Column:
    """Minutes of durations like PT3H25M: hours and minutes alone."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(duration, f"([0-9]+){unit}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return part("H") * 60 + part("M")


def relative_days(text: Column, today: Column) -> Column:
    """Day words get their date behind them, whole words in either case."""
    for word, days in DAY_WORDS.items():
        date = F.date_format(F.date_add(today, days), "yyyy-MM-dd")
        text = F.regexp_replace(text, F.lit(f"(?iu)(?<![\\p{{L}}\\p{{N}}_])({word})(?![\\p{{L}}\\p{{N}}_])"), F.concat(F.lit("$1 ("), date, F.lit(")")))
    return text


def parse_price(text: Column) -> Column:
    """The digits of a text as a number, whatever stands between them; null without any."""
    return F.nullif(F.regexp_replace(text, "[^\\p{Nd}]", ""), F.lit("")).cast("double")


def dosage(name: Column, given: Column | None = None) -> Column:
    found = F.nullif(F.regexp_extract(name, _DOSAGE, 1), F.lit(""))
    return F.coalesce(F.nullif(given, F.lit("")), found) if given is not None else found


def pack_size(name: Column, given: Column | None = None) -> Column:
    found = F.coalesce(*[F.nullif(F.regexp_extract(name, _PACK, i), F.lit("")) for i in (1, 2)])
    return F.coalesce(F.nullif(given, F.lit("")), found) if given is not None else found


def query_tokens(query: Column) -> Column:
    """Words of a product query and their transliterated hints."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-zA-Zа-яА-ЯёЁ0-9]+"), F.lit(0))
    hints = F.create_map(*[F.lit(x) for kv in CYRILLIC_HINTS.items() for x in kv])
    return F.array_union(words, F.filter(F.transform(words, lambda w: F.try_element_at(hints, w)), lambda h: h.isNotNull()))


def name_matches(name: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(name), w))


def code3(value: Column) -> tuple[Column, Column]:
    """A three-letter code in upper case, and why it was refused."""
    fine = F.coalesce(F.trim(value).rlike("^[A-Za-z]{3}$"), F.lit(False))
    return F.when(fine, F.upper(F.trim(value))), F.when(~fine, "not three letters")


def travel_date(value: Column, today: Column) -> tuple[Column, Column]:
    """An ISO date from today on, and why it was refused."""
    shaped = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value)
    parsed = F.try_to_date(shaped, "yyyy-MM-dd")
    return F.when(parsed >= today, parsed), F.when(parsed.isNull(), "not a date").when(parsed < today, "in the past")


def passengers(adults: Column, children: Column, most: int = 9) -> Column:
    """Why a party was refused, or null."""
    return F.when(adults < 1, "no adult").when(children < 0, "negative children").when(adults + children > most, "too many")


def offer_key(name: Column, store: Column, price: Column) -> Column:
    return F.concat_ws("|", name, store, price.cast("string"))


def shuffled(key: Column, seed: int = 42) -> Column:
    """A hash by which rows are put in an order without meaning: the same on any engine, in any partitioning."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def shuffled_place(key: Column, digits: int, seed: int = 42) -> Column:
    """The first hexadecimal digits of shuffled() as a number: cells in the order of the hash."""
    return F.conv(F.substring(shuffled(key, seed), 1, digits), 16, 10).cast("long")
