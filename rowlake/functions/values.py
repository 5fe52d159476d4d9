"""The value rules that every operator shares, as Columns: text, numbers, missing, truth, dates and rounding.

A cell is text for keys and equality (null is ""), a number for arithmetic (text goes through a bilingual money
grammar), missing if null or blank. All builders stay inside Catalyst; nothing throws under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: The spellings of numbers, units and directions that the money grammar knows.
DASHES = "‐‑‒–—―−－"
OUTFLOW = "借|支出|付款"
UNITS = [("billion|亿", 1e8), ("million", 1e6), ("thousand|千", 1e3), ("万", 1e4)]
ENGLISH_UNITS = "billion|million|thousand"
STRIP = r"人民币|usd|cny|rmb|hkd|eur|gbp|jpy|debit|credit|dr|cr|[¥￥$€£,，元圆块万亿千]|借方|贷方|借|贷|支出|收入|付款|收款|\s"
PLAIN_NUMBER = r"^[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?$|^[0-9]+\.$"
TRUE, FALSE = ["1", "true", "yes", "on"], ["0", "false", "no", "off"]
MAX_KEY = 9223372036854775807


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def vts(c: Column) -> Column:
    """The text of a value; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def once(x: Column, f) -> Column:
    """f(x) with x computed once, also where f uses it inside of lambdas, which would else compute it for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def miss(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def money(text: Column, english_units: bool = False) -> Column:
    """A number by the money grammar, or null: (1,200.50), 12-, ¥3万, 借 5. english_units also reads "3 million". Plain numbers skip the grammar."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?[0-9]*\.?[0-9]+$"), bare.try_cast("double")).otherwise(F.get(F.transform(F.array(text), lambda x: _money(x, english_units)), F.lit(0)))


def _money(text: Column, english_units: bool) -> Column:
    """Patterns over the text itself, in any case and with any dash. money calls it within an array of one: there it is one call, however
    often the number is used, where its code written out makes methods too long for the JVM to compile."""
    dash, blank = f"[-{DASHES}]", "[ 　]*"
    end = rf"\R?{blank}\z"
    negative = text.rlike(rf"(?i)^{blank}(?:[(（].*[)）]{end}|{dash}|debit|dr)|{dash}{blank}\z|{OUTFLOW}")
    scale = F.lit(1.0)
    for pattern, factor in reversed(UNITS):
        scale = F.when(text.rlike(f"(?i){pattern}"), F.lit(factor)).otherwise(scale)
    bare = F.regexp_replace(text, rf"(?i)^{blank}[(（]|[)）]{end}|　|" + STRIP + (f"|{ENGLISH_UNITS}" if english_units else ""), "")
    bare = F.regexp_replace(bare, rf"^[-+{DASHES}]+|{dash}+\z", "")
    value = F.when(bare.rlike(f"(?i){PLAIN_NUMBER}"), bare).try_cast("double")
    return value * scale * F.when(negative, -1.0).otherwise(1.0)


def num(c: Column, kind: T.DataType | None = None) -> Column:
    """The number of a value: numeric columns as they are, text by the money grammar, anything else null."""
    if isinstance(kind, NUMERIC):
        return c.cast("double")
    if isinstance(kind, (T.BooleanType, T.NullType, T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("double")
    return money(c.cast("string"))


def number(df: DataFrame, name: str) -> Column:
    """num of a column; null where the table has no such column."""
    return num(col(name), kind_of(df, name)) if name in df.columns else F.lit(None).cast("double")


def plain_number(c: Column) -> Column:
    """A number without the money grammar, or null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(?:[0-9]*\.?[0-9]+|[0-9]+\.)(?:[eE][+-]?[0-9]+)?$"), text).try_cast("double")


def truncated(x: Column) -> Column:
    """Toward zero; null where a long can't hold it. One use of x, as it may be a long expression."""
    return x.try_cast("long")


def cast_to(c: Column, kind: T.DataType, to: str, strict: bool = False) -> Column:
    """string, int, float or bool of a value, null where it has none; any other name leaves it.

    strict reads texts as plain numbers, commas left out, without currencies, units or signs behind; whole ones for int.
    """
    to = to.lower()
    if strict and isinstance(kind, T.StringType) and to in ("int", "integer", "float", "double", "number"):
        text = F.replace(F.trim(c), F.lit(","), F.lit(""))
        if to.startswith("int"):
            return F.when(text.rlike(r"^[+-]?[0-9]{1,19}$"), text).try_cast("long")
        return F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text).try_cast("double")
    if to in ("string", "str"):
        return c.cast("string")
    if to in ("int", "integer"):
        return c.cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else truncated(num(c, kind))
    if to in ("float", "double", "number"):
        return num(c, kind)
    if to in ("bool", "boolean"):
        text = F.lower(F.trim(c.cast("string")))
        return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)
    return c


def truthy(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, NUMERIC):
        return F.coalesce(c != 0, F.lit(False))
    return ~miss(c)


def round_half_away(x: Column, digits: int = 2) -> Column:
    """Half away from zero on the binary double."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def ymd(c: Column) -> Column:
    """(y, m, d) of a date, year first, or null: 2024-01-02, 2024/1/2, 2024.1.2, 2024年1月2日, 20240102."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    bare = F.regexp_replace(F.regexp_replace(F.translate(text, "年月/.", "----"), "日", ""), r"\s*-\s*", "-")
    parts = F.transform(F.filter(F.array(bare), lambda x: x.rlike(r"^\d{1,9}-\d{1,9}-\d{1,9}(?:-.*)?$")), lambda x: F.transform(F.slice(F.split(x, "-"), 1, 3), lambda y: y.try_cast("int")))
    # the array of one lets the parts be computed once
    found = F.transform(parts, lambda p: F.when(p[1].between(1, 12) & p[2].between(1, 31), F.struct(p[0].alias("y"), p[1].alias("m"), p[2].alias("d"))))
    return F.try_element_at(found, F.lit(1))


def iso_date(c: Column) -> Column:
    p = ymd(c)
    return F.when(p.isNotNull(), F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]))


#: The date and time formats of an ordering key.
STAMPS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm"]
DATES = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd/MM/yyyy", "MM/dd/yyyy"]


def time_key(c: Column, kind: T.DataType | None = None) -> Column:
    """An ordering key: integers as they are, dates and times in epoch seconds, 2024-01 as its first day, else the largest."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_seconds(c.cast("timestamp")), F.lit(MAX_KEY))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_seconds(c.cast("timestamp")), F.lit(MAX_KEY))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(c.cast("long"), F.lit(MAX_KEY))
    text = F.trim(vts(c))
    whole = F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text).try_cast("long")
    stamps = [F.unix_seconds(F.try_to_timestamp(text, F.lit(f))) for f in [*STAMPS, *DATES]]
    month = F.unix_seconds(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))), F.lit("yyyy-MM-dd")))
    return F.coalesce(whole, *stamps, month, F.lit(MAX_KEY))
