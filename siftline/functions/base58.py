"""Base58Check. A base-58 number has up to 59 digits, more than a decimal holds, so it is carried as base-256 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of base 58.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Bytes that 62 digits of base 58 need.
BYTES = 46


def base58check(c: Column) -> Column:
    """The last four bytes of the decoded string are the head of the double SHA-256 of those before."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.array_repeat(F.lit(0), BYTES)

    def digit(number: Column, ch: Column) -> Column:
        """number * 58 + digit; number: bytes, lowest first."""
        first = F.struct((F.instr(F.lit(ALPHABET), ch) - 1).alias("carry"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, b: F.struct(((b * 58 + acc["carry"]) / 256).cast("int").alias("carry"), F.concat(acc["out"], F.array(((b * 58 + acc["carry"]) % 256).cast("int"))).alias("out"))
        return F.aggregate(number, first, step, lambda acc: acc["out"])

    def valid(number: Column) -> Column:
        hexed = F.array_join(F.transform(F.reverse(number), lambda b: F.lpad(F.hex(b), 2, "0")), "")
        body = F.regexp_replace(hexed, "^(?:00)+", "")
        zeros = F.length(c) - F.length(F.regexp_replace(c, "^1+", ""))
        full = F.concat(F.repeat(F.lit("00"), zeros), body)
        payload, check = F.substring(full, F.lit(1), F.length(full) - 8), F.substring(full, F.length(full) - 7, F.lit(8))
        twice = F.sha2(F.unhex(F.sha2(F.unhex(payload), 256)), 256)
        return (F.length(full) >= 10) & (F.upper(F.substring(twice, 1, 8)) == check)

    number = F.aggregate(chars, zero, digit)
    known = c.rlike(f"^[{ALPHABET}]{{1,62}}$")
    return F.when(known, F.element_at(F.transform(F.array(number), valid), 1)).otherwise(F.lit(False))
