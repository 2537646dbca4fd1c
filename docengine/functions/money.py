"""Korean amounts: parsing, formatting and keyword spellings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: numerals and units
DIGITS = {c: i % 10 for i, c in enumerate("영일이삼사오육칠팔구")} | {"공": 0}
SMALL = {"십": 10, "백": 100, "천": 1000}
LARGE = {"만": 10**4, "억": 10**8, "조": 10**12}
UNITS = {"억원": 10**8, "천만원": 10**7, "백만원": 10**6, "만원": 10**4, "천원": 10**3, "원": 1}
HANGUL = "".join([*DIGITS, *SMALL, *LARGE])
AMOUNT = re.compile(rf"(?:(\d[\d,]*)|([{HANGUL}]+))\s*({'|'.join(UNITS)})(?=\D|$)")


def korean_number(text: str | None) -> int | None:
    """The value of a number in Hangul numerals, None for anything else."""
    value, group, digit = 0, 0, None
    text = re.sub(r"\s+", "", text or "")
    if not text or set(text) - set(HANGUL):
        return None
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in SMALL:
            group, digit = group + (digit or 1) * SMALL[c], None
        else:
            value, group, digit = value + ((group + (digit or 0)) or 1) * LARGE[c], 0, None
    return value + group + (digit or 0)


def spell_amounts(text: str | None, hangul: bool = True) -> str:
    """Amounts with a unit, as won. hangul also reads Hangul numerals, which rewrites words that end in 원."""

    def won(m: re.Match) -> str:
        number = int(m[1].replace(",", "")) if m[1] else korean_number(m[2])
        return f"{number * UNITS[m[3]]}원"

    text = re.sub(rf"(\d[\d,]*)()\s*({'|'.join(UNITS)})(?=\D|$)", won, text or "")
    return re.sub(rf"()([{HANGUL}]+)\s*({'|'.join(UNITS)})(?=\D|$)", won, text) if hangul else text


@F.pandas_udf(T.LongType())
def parse_korean_number(s: pd.Series) -> pd.Series:
    return s.map(korean_number).astype("Int64")


@F.pandas_udf(T.StringType())
def normalize_amounts(s: pd.Series) -> pd.Series:
    return s.map(spell_amounts)


def won(amount: Column) -> Column:
    return F.concat(amount.cast("long").cast("string"), F.lit("원"))


def won_with_commas(amount: Column) -> Column:
    return F.concat(F.format_number(amount.cast("long"), 0), F.lit("원"))


def short_won(amount: Column) -> Column:
    """1억3천만원 and the like, by digits of 억 and 만."""
    a = amount.cast("long")
    part = lambda size, mod: F.floor(a / size).cast("long") % mod
    eok = F.floor(a / 10**8).cast("long")
    man = F.floor(a / 10**4).cast("long") % 10**4
    text = F.concat(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("") for n, unit in ((eok, "억"), (part(10**7, 10), "천"), (part(10**6, 10), "백"), (part(10**5, 10), "십"), (part(10**4, 10), ""))))
    return F.when(a == 0, "0원").otherwise(F.concat(text, F.when(man > 0, "만원").otherwise("")))


def amount_of_keywords(groups: Column) -> Column:
    """Digits of the first keyword that has any."""
    digits = F.filter(F.transform(F.flatten(groups), lambda k: F.regexp_replace(k, "[^0-9]", "")), lambda d: d != "")
    return F.when(F.size(digits) > 0, F.element_at(digits, 1)).try_cast("long")


def amount_of_text(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("long")


def budget_keywords(amount: Column) -> Column:
    """One group of the distinct spellings of an amount."""
    return F.array(F.array_distinct(F.array(won_with_commas(amount), won(amount), short_won(amount))))
