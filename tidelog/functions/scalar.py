"""Operators and scalar functions of the shell as column expressions, JVM-side but for character sets that the JVM side doesn't offer (Arrow batches)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET_BITS = 44

BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "rem": lambda a, b: a % b,
    "shl": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    "shr": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
    "xor": lambda a, b: a.bitwiseXOR(b),
    "bor": lambda a, b: a.bitwiseOR(b),
    "band": lambda a, b: a.bitwiseAND(b),
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "ge": lambda a, b: a >= b,
    "le": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}
UNARY = {"bnot": F.bitwise_not, "not": lambda a: ~a}


def divide(df: DataFrame, left: str, right: str) -> Column:
    """Whole-number division, truncated, between whole numbers; ordinary division otherwise. Division by zero is null."""
    whole = all(isinstance(df.select(F.expr(e)).schema[0].dataType, T.IntegralType) for e in (left, right))
    return F.expr(f"({left}) div nullif({right}, 0)") if whole else F.try_divide(F.expr(left), F.expr(right))


def binary(df: DataFrame, op: str, left: str, right: str) -> Column:
    """``left op right`` over the columns of ``df``, typed by its operands."""
    return divide(df, left, right) if op == "intdiv" else BINARY[op](F.expr(left), F.expr(right))


def conditional(condition: Column, yes: Column, no: Column) -> Column:
    """condition ? yes : no; an unknown condition takes ``no``."""
    return F.when(condition, yes).otherwise(no)


def concat_strict(*parts: Column) -> Column:
    """CONCAT: null if any part is."""
    return F.concat(*parts)


def concat_ws(separator: str, *parts: Column) -> Column:
    """CONCAT_WS: null parts are skipped."""
    return F.concat_ws(separator, *parts)


def greater(a: Column, b: Column) -> Column:
    """MAX(a, b) of a row; a null is passed over."""
    return F.greatest(a, b)


def lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


def field(value: Column, *among: Column) -> Column:
    """FIELD: the place of ``value`` among the others from 1, 0 if absent or null."""
    return F.coalesce(F.array_position(F.array(*among), value), F.lit(0)).cast("long")


#: The source's names of character sets, as those of the built-in decoder and of Python.
JVM_CHARSETS = {"utf8": "UTF-8", "utf8mb3": "UTF-8", "utf8mb4": "UTF-8", "utf16": "UTF-16BE", "utf16le": "UTF-16LE", "utf32": "UTF-32", "ucs2": "UTF-16BE", "ascii": "US-ASCII", "latin1": "ISO-8859-1"}
OTHER_CHARSETS = {"gbk": "gbk", "gb2312": "gb2312", "gb18030": "gb18030", "big5": "big5", "sjis": "shift_jis", "cp932": "cp932", "ujis": "euc_jp", "euckr": "euc_kr", "cp1250": "cp1250", "cp1251": "cp1251", "koi8r": "koi8_r"}


def decode_charset(value: Column, charset: str) -> Column:
    """The text of bytes in a character set; bytes that are none in it become U+FFFD."""
    name = charset.lower()
    if name not in OTHER_CHARSETS:
        return F.decode(value, JVM_CHARSETS.get(name, charset))
    codec = OTHER_CHARSETS[name]

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(codec, "replace"), na_action="ignore")

    return run(value)


def encode_charset(value: Column, charset: str) -> Column:
    """The bytes of a text in a character set; characters it lacks become ?."""
    name = charset.lower()
    if name not in OTHER_CHARSETS:
        return F.encode(value, JVM_CHARSETS.get(name, charset))
    codec = OTHER_CHARSETS[name]

    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t.encode(codec, "replace"), na_action="ignore")

    return run(value)


def char_length(value: Column, charset: str | None = None) -> Column:
    """Characters of a text, or of bytes in ``charset``."""
    return F.char_length(decode_charset(value, charset) if charset else value)


def compare_text(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """-1, 0 or 1 as ``a`` sorts before, like or behind ``b``; without regard to letter case unless ``case_sensitive``. Null if one is null."""
    order = "UTF8_BINARY" if case_sensitive else "UTF8_LCASE"
    x, y = F.collate(a, order), F.collate(b, order)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def ascii_code(value: Column) -> Column:
    """ASCII: the code of the first character; null for an empty text."""
    return F.when(F.length(value) > 0, F.ascii(value))


def convert_charset(value: Column, source: str, target: str) -> Column:
    """Bytes in one character set as bytes in another."""
    return encode_charset(decode_charset(value, source), target)


def pack_offset(file_number: Column, position: Column) -> Column:
    """A log position: file number and place in the file in one number that sorts like them."""
    return F.shiftleft(file_number.cast("long"), OFFSET_BITS).bitwiseOR(position.cast("long"))


def offset_file(offset: Column) -> Column:
    return F.shiftright(offset, OFFSET_BITS)


def offset_position(offset: Column) -> Column:
    return offset.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


def table_of(meta_id: Column) -> Column:
    return F.shiftright(meta_id, 16)


def version_of(meta_id: Column) -> Column:
    return meta_id.bitwiseAND(F.lit(0xFFFF)).cast("int")


def enum_value(index: Column, values: Column) -> Column:
    """The text of an ENUM by its index from 1; 0 is the empty text, an index outside the list is null."""
    return F.when(index == 0, F.lit("")).when(index.between(1, F.size(values)), F.get(values, index - 1))


def set_values(bits: Column, values: Column) -> Column:
    """The texts of a SET by its bits, in the order of the list."""
    return F.filter(values, lambda v, i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1)) == 1)


def bit_number(value: Column) -> Column:
    """A BIT column's bytes as a number."""
    return F.conv(F.hex(value), 16, 10).cast("decimal(20,0)")


def year_value(stored: Column) -> Column:
    """YEAR as stored in one byte: 0 is year 0, others count from 1900."""
    return F.when(stored == 0, 0).otherwise(stored + 1900).cast("int")


def date_value(packed: Column) -> Column:
    """DATE packed in three bytes (day 5 bits, month 4, year 15); an impossible date is null."""
    return F.try_make_date(F.shiftright(packed, 9), F.shiftright(packed, 5).bitwiseAND(F.lit(15)), packed.bitwiseAND(F.lit(31))) if hasattr(F, "try_make_date") else F.try_to_date(F.format_string("%04d-%02d-%02d", F.shiftright(packed, 9), F.shiftright(packed, 5).bitwiseAND(F.lit(15)), packed.bitwiseAND(F.lit(31))))


def time_micros(hours: Column, minutes: Column, seconds: Column, micros: Column, negative: Column) -> Column:
    """TIME as microseconds, also above a day or below zero."""
    total = ((hours.cast("long") * 60 + minutes) * 60 + seconds) * 1_000_000 + micros
    return F.when(negative, -total).otherwise(total)


def literal_text(value: Column, kind: str) -> Column:
    """A value as a literal of the target's SQL: numbers bare, texts quoted, bytes in hex, times quoted; NULL for null."""
    if kind in ("number", "flag"):
        text = value.cast("string")
    elif kind == "bytes":
        text = F.concat(F.lit("0x"), F.hex(value))
    elif kind == "time":
        text = F.concat(F.lit("'"), F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def bucket(*keys: Column) -> Column:
    """A hash of key columns for spreading work; nulls hash alike."""
    return F.xxhash64(*keys)
