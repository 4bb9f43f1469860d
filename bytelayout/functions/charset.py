"""Lossless Big5 encoding and strict decoding as column expressions.

All expressions here must be built inside `session.charset_flags`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Windows Traditional Chinese with the Hong Kong supplement: of the JVM's Big5
# variants the one nearest to the WHATWG Encoding Standard's "Big5".
BIG5 = "x-MS950-HKSCS"
CP950 = "x-windows-950"

# The four Big5 codes that stand for two code points each, with the
# private-use character the JVM decodes them to.
SEQUENCES = {
    "\u00ca\u0304": "\uf325",
    "\u00ca\u030c": "\uf327",
    "\u00ea\u0304": "\uf344",
    "\u00ea\u030c": "\uf346",
}

PRIVATE_USE = "[\\ue000-\\uf8ff]"
REPLACEMENT = "\ufffd"


def is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(value)


def _join_sequences(value: Column) -> Column:
    for pair, code in SEQUENCES.items():
        value = F.replace(value, F.lit(pair), F.lit(code))
    return value


def _split_sequences(value: Column) -> Column:
    for pair, code in SEQUENCES.items():
        value = F.replace(value, F.lit(code), F.lit(pair))
    return value


def encode_big5(value: Column, charset: str = BIG5) -> Column:
    """Bytes of a text, or NULL when the charset cannot carry it without loss.

    An ASCII text is its own encoding. Anything else has to come back unchanged
    from a round trip, and private-use characters count as unencodable.
    """
    if charset == BIG5:
        combined = F.when(value.rlike("[\\u0304\\u030c]"), _join_sequences(value)).otherwise(value)
    else:
        combined = value
    encoded = F.encode(combined, charset)
    lossless = ~value.rlike(PRIVATE_USE) & (F.decode(encoded, charset) == combined)
    return F.when(is_ascii(value), value.cast("binary")).when(lossless, encoded)


def big5_length(value: Column, charset: str = BIG5) -> Column:
    """Byte length of a text in the charset, NULL when it is not encodable."""
    return F.octet_length(encode_big5(value, charset))


def decode_big5(data: Column, charset: str = BIG5) -> Column:
    """Text of Big5 bytes, or NULL unless re-encoding gives the same bytes."""
    text = F.decode(data, charset)
    strict = (F.encode(text, charset) == data) & ~F.contains(text, F.lit(REPLACEMENT))
    if charset == BIG5:
        text = F.when(text.rlike(PRIVATE_USE), _split_sequences(text)).otherwise(text)
    return F.when(strict & ~text.rlike(PRIVATE_USE), text)


def decode_utf16(data: Column, big_endian: bool) -> Column:
    """Text of UTF-16 bytes, NULL for a lone surrogate or an odd length."""
    charset = "UTF-16BE" if big_endian else "UTF-16LE"
    text = F.decode(data, charset)
    return F.when(F.encode(text, charset) == data, text)


def decode_utf8(data: Column) -> Column:
    """Text of UTF-8 bytes, NULL when they are not valid UTF-8."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)
