"""Percent-encoding as JavaScript has it, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

# Characters that a whole address keeps as they are, and those whose escapes it keeps.
KEPT = ";,/?:@&=+$!~'()#"
RESERVED = "%(3B|2F|3F|3A|40|26|3D|2B|24|2C|23)"


def decode_component(text: Column) -> Column:
    """All escapes decoded as UTF-8; null where one is malformed, also in its bytes."""
    # what isn't UTF-8 comes back as a replacement character that the text itself hasn't
    own = F.replace(text, F.lit("�"), F.lit("%EF%BF%BD"))
    count = lambda t: F.regexp_count(t, F.lit("�"))
    asked = F.regexp_count(own, F.lit("(?i)%EF%BF%BD"))
    return let(F.try_url_decode(F.replace(own, F.lit("+"), F.lit("%2B"))), lambda t: F.when(count(t) == asked, t))


def decode_uri(text: Column) -> Column:
    """As ``decode_component``, but escapes of reserved characters stay."""
    return decode_component(F.regexp_replace(text, f"(?i){RESERVED}", "%25$1"))


def encode_uri(text: Column) -> Column:
    """All but letters, digits and marks of an address escaped as UTF-8."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in KEPT:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def normal_uri(text: Column) -> Column:
    """An address decoded and encoded again; as it is where it is malformed."""
    return F.coalesce(encode_uri(decode_uri(text)), text)
