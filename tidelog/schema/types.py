"""Types of logged columns: codes, names and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Codes of column types in records and registries.
CODES = {
    "UNION": 0, "UINT8": 1, "INT8": 2, "UINT16": 3, "INT16": 4, "UINT32": 5, "INT32": 6, "UINT64": 7, "INT64": 8, "BIG_NUMBER": 9, "FLOAT": 10, "DOUBLE": 11,
    "DECIMAL": 12, "TIMESTAMP": 13, "DATETIME": 14, "DATETIME_ZERO_TZ": 15, "DATE": 16, "YEAR": 17, "TIME": 18, "BLOB": 19, "STRING": 20, "JSON": 21, "XML": 22,
    "GEOMETRY": 23, "SET": 24, "ENUM": 25, "BYTE": 26, "BINARY": 27, "TEXT": 28, "BOOL": 29,
}

_FIXED = {
    "UINT8": T.ShortType(), "INT8": T.ByteType(), "UINT16": T.IntegerType(), "INT16": T.ShortType(), "UINT32": T.LongType(), "INT32": T.IntegerType(),
    "UINT64": T.DecimalType(20, 0), "INT64": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(),
    "DATETIME": T.TimestampNTZType(), "DATETIME_ZERO_TZ": T.TimestampNTZType(), "DATE": T.DateType(), "YEAR": T.ShortType(), "TIME": T.LongType(), "BLOB": T.BinaryType(),
    "STRING": T.StringType(), "JSON": T.StringType(), "XML": T.StringType(), "GEOMETRY": T.BinaryType(), "SET": T.ArrayType(T.StringType()), "ENUM": T.StringType(),
    "BYTE": T.BinaryType(), "BINARY": T.BinaryType(), "TEXT": T.StringType(), "BOOL": T.BooleanType(),
}

#: Type names of the source's DDL, by the name of the type they are kept as: (signed, unsigned).
SOURCE = {
    "tinyint": ("INT8", "UINT8"), "smallint": ("INT16", "UINT16"), "mediumint": ("INT32", "UINT32"), "int": ("INT32", "UINT32"), "integer": ("INT32", "UINT32"),
    "bigint": ("INT64", "UINT64"), "float": ("FLOAT", "FLOAT"), "double": ("DOUBLE", "DOUBLE"), "real": ("DOUBLE", "DOUBLE"), "decimal": ("DECIMAL", "DECIMAL"),
    "numeric": ("DECIMAL", "DECIMAL"), "dec": ("DECIMAL", "DECIMAL"), "timestamp": ("TIMESTAMP",) * 2, "datetime": ("DATETIME",) * 2, "date": ("DATE",) * 2,
    "time": ("TIME",) * 2, "year": ("YEAR",) * 2, "char": ("STRING",) * 2, "varchar": ("STRING",) * 2, "binary": ("BINARY",) * 2, "varbinary": ("BINARY",) * 2,
    "tinytext": ("TEXT",) * 2, "text": ("TEXT",) * 2, "mediumtext": ("TEXT",) * 2, "longtext": ("TEXT",) * 2, "tinyblob": ("BLOB",) * 2, "blob": ("BLOB",) * 2,
    "mediumblob": ("BLOB",) * 2, "longblob": ("BLOB",) * 2, "json": ("JSON",) * 2, "geometry": ("GEOMETRY",) * 2, "point": ("GEOMETRY",) * 2, "bit": ("BYTE",) * 2,
    "enum": ("ENUM",) * 2, "set": ("SET",) * 2, "bool": ("INT8",) * 2, "boolean": ("INT8",) * 2,
}

#: Bytes of a character at most, by character set.
CHARACTER_BYTES = {"latin1": 1, "ascii": 1, "binary": 1, "gbk": 2, "gb2312": 2, "big5": 2, "sjis": 2, "ujis": 3, "ucs2": 2, "utf8": 3, "utf8mb3": 3, "utf8mb4": 4, "utf16": 4, "utf16le": 4, "utf32": 4, "gb18030": 4}


def spark_type(name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type that holds a column; exact numbers beyond 38 digits are text."""
    if name in ("DECIMAL", "BIG_NUMBER"):
        if precision is None:
            return T.DecimalType(10, 0) if name == "DECIMAL" else T.StringType()
        return T.DecimalType(precision, scale or 0) if precision <= 38 else T.StringType()
    return _FIXED[name]
