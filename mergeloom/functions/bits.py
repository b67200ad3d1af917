"""Numbers and values in the binary format's form, as expressions over bits.

LEB128 writes a number in groups of seven bits, the lowest first; all groups but the last have the eighth bit set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def uleb_length(n: Column) -> Column:
    """Bytes of an unsigned number: a seventh of its binary digits."""
    return ((F.length(F.bin(n)) + 6) / 7).cast("int")


def sleb_length(n: Column) -> Column:
    """Bytes of a signed number: the sign needs one more digit."""
    return ((F.length(F.bin(F.when(n < 0, -1 - n).otherwise(n))) + 7) / 7).cast("int")


def _shift(name: str, n: Column, by: Column) -> Column:
    return F.call_function(name, n, by.cast("int"))


def _groups(n: Column, length: Column) -> Column:
    def group(k: Column) -> Column:
        low = _shift("shiftright", n, 7 * k).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(F.when(k < length - 1, low + 128).otherwise(low)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), length - 1), group), ""))


def uleb(n: Column) -> Column:
    """An unsigned number as bytes; null for null and negative ones."""
    n = n.cast("long")
    return F.when(n >= 0, _groups(n, uleb_length(n)))


def sleb(n: Column) -> Column:
    """A signed number as bytes."""
    n = n.cast("long")
    return F.when(n.isNotNull(), _groups(n, sleb_length(n)))


def _byte(b: Column, k: Column) -> Column:
    """Byte number ``k``, from 1."""
    return F.conv(F.hex(F.substring(b, k, F.lit(1))), 16, 10).cast("long")


def uleb_value(b: Column) -> Column:
    """The unsigned number that all of the bytes are; null for none."""
    group = lambda acc, k: acc + _shift("shiftleft", _byte(b, k).bitwiseAND(F.lit(127).cast("long")), 7 * (k - 1))
    return F.when(F.octet_length(b) > 0, F.aggregate(F.sequence(F.lit(1), F.octet_length(b)), F.lit(0).cast("long"), group))


def sleb_value(b: Column) -> Column:
    """The signed number that all of the bytes are; null for none."""
    wide = F.octet_length(b) * 7
    negative = (_byte(b, F.octet_length(b)).bitwiseAND(F.lit(64).cast("long")) != 0) & (wide < 63)
    return uleb_value(b) - F.when(negative, _shift("shiftleft", F.lit(1).cast("long"), wide)).otherwise(0)


#: Numbers of the value types, in the lowest four bits of a tag.
TYPES = {"null": 0, "false": 1, "true": 2, "uint": 3, "int": 4, "float64": 5, "str": 6, "bytes": 7, "counter": 8, "timestamp": 9}


def value_tag(vtype: Column, b: Column, i: Column, s: Column) -> Column:
    """Tag of a value: its type, and above four bits the length of its bytes; null for an unknown type."""
    kind = F.when(vtype == "bool", F.when(b, "true").otherwise("false")).otherwise(vtype)
    length = F.when(vtype == "str", F.octet_length(s)).when(vtype == "uint", uleb_length(i)).when(vtype.isin("int", "counter", "timestamp"), sleb_length(i)).when(vtype == "float64", 8).otherwise(0)
    number = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return (length * 16 + F.element_at(number, kind)).cast("long")


def container_hash(kind: int, body: Column) -> Column:
    """Hash of a container: of its type, the length of what it holds, and that."""
    return F.sha2(F.concat(F.unhex(F.lit(f"{kind:02x}")), uleb(F.octet_length(body)), body), 256)
