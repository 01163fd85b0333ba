"""Numbers in text: tokens by value whatever the locale, and numbers in words."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

CORE = "[0-9]+(?:[.,][0-9]+)*"

# The words, signs and factors that numbers are written with, and the units that belong to them.
UNDER_TWENTY = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "ten twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {
    "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60,
    "seventieth": 70, "eightieth": 80, "ninetieth": 90,
}
HAN_DIGITS = "零一二三四五六七八九"
FACTORS = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "万": 10**4, "亿": 10**8, "亿万": 10**8}
UNITS = "% °C °F mm cm km kg mg MPa kPa Pa Hz kHz MHz".split()
#: Units of one capital: right behind the number, or as the last word before a stop.
LETTER_UNITS = "VAW"


def core_tokens(text: Column) -> Column:
    """Digit groups of a text, separators kept."""
    return F.regexp_extract_all(text, F.lit(CORE), F.lit(0))


def _spellings() -> dict[int, list[str]]:
    """Every number below 100 in words, English and Chinese."""
    out = {n: [word] for n, word in enumerate(UNDER_TWENTY)}
    for n, word in enumerate(TENS[1:], 2):
        out[n * 10] = [word]
        for k, unit in enumerate(UNDER_TWENTY[1:10], 1):
            out[n * 10 + k] = [f"{word}-{unit}", f"{word} {unit}"]
    out[1].append("first")
    out[2] += ["second", "两"]
    for n, sign in enumerate(HAN_DIGITS):
        out[n].append(sign)
        for k, unit in enumerate(["", *HAN_DIGITS[1:]]) if n else ():
            out[n * 10 + k].append((sign if n > 1 else "") + "十" + unit)
    return out


SPELLINGS = _spellings()


def spelled_table(spark: SparkSession) -> DataFrame:
    """``value, form, latin`` for 0 to 99."""
    return spark.createDataFrame([(n, form, form.isascii()) for n, forms in SPELLINGS.items() for form in forms], "value int, form string, latin boolean")


def _any(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True))


_WIDE = {0xFF10 + i: str(i) for i in range(10)} | {0xFF0E: ".", 0xFF05: "%"}
# One alternative for each way a number stands in a text.
_SCAN = re.compile(
    rf"""(?P<stamp>[\w.-]+\.(?:qxd|indd)\s+\d+/\d+/\d+\s+\d+:\d\d\s+[AP]M(?:\s+Page\s+\S+)?)
    |\b1[89](?P<decade>\d\d)s\b
    |\b(?P<ordinal>{_any(ORDINALS)})\b
    |(?P<year>[〇{HAN_DIGITS}]{{4}})(?=\s*年)
    |(?<![a-zA-Z0-9_.])(?P<number>[-+]?\d+(?:[.,]\d+)*)
     (?:\s*(?:(?P<word>{_any(w for w in FACTORS if w.isascii())})\b|(?P<sign>{_any(w for w in FACTORS if not w.isascii())})))?
     (?P<unit>[ \t]*per[-\s]*cent\b|\s?(?:{_any(UNITS)})(?![a-zA-Z])|(?-i:[{LETTER_UNITS}])(?![a-zA-Z])|\s(?-i:[{LETTER_UNITS}])(?=\s*(?:[.,;:)]|$)))?
    """,
    re.I | re.X,
)


def _value(digits: str, factor: int) -> str:
    if factor == 1:
        return digits.replace(",", "")
    value = Decimal(digits.replace(",", "")) * factor
    return str(int(value)) if value == int(value) else format(value.normalize(), "f")


def canonical_tokens(text: str) -> list[str]:
    """The numbers of ``text`` by value with their units, whatever the notation: 10 million, 1,000万 and 10,000,000 are one."""
    out = []
    for m in _SCAN.finditer(text.translate(_WIDE)):
        kind = m.lastgroup if m.lastgroup in ("stamp", "decade", "ordinal", "year") else "number"
        found = m.group(kind)
        if kind == "decade":
            out += ["20", found]
        elif kind == "ordinal":
            out.append(str(ORDINALS[found.lower()]))
        elif kind == "year":
            out.append("".join("0" if c == "〇" else str(HAN_DIGITS.index(c)) for c in found))
        elif kind == "number":
            factor = FACTORS[(m.group("word") or m.group("sign")).lower()] if m.group("word") or m.group("sign") else 1
            if factor > 1 and found.count(".") > 1:  # several points are no decimal number
                factor = 1
            unit = m.group("unit") or ""
            out.append(_value(found, factor) + ("%" if "cent" in unit.lower() else unit))
    return out


@F.pandas_udf(ArrayType(StringType()))
def canonical_tokens_udf(texts: pd.Series) -> pd.Series:
    """Tokens by value of each text; arithmetic inside a match is beyond the built-in functions."""
    return texts.map(lambda t: canonical_tokens(t) if t else [])


def measure_of(token: Column) -> Column:
    """The unit of a token by value, in small letters; empty where it has none."""
    return F.lower(F.regexp_extract(token, f"(?i)({_any([*UNITS, *LETTER_UNITS])})$", 1))


def is_small(token: Column) -> Column:
    return token.rlike("^[0-9]{1,2}$")


def roman(value: int) -> str:
    out = ""
    for n, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while value >= n:
            out, value = out + s, value - n
    return out


def folio_table(spark: SparkSession) -> DataFrame:
    """``text, system, value`` of page numbers: roman below 200; arabic ones are read from their digits."""
    return spark.createDataFrame([(roman(n), "roman", n) for n in range(1, 200)], "text string, system string, value int")
