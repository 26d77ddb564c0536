"""Unique identifiers: grammar, remapping, generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_ROOT = "2.25"
DEFAULT_SALT = "voxelake"
GRAMMAR = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"
#: 2 ** 64 is `HIGH` * 10 ** 18 + `LOW`.
HIGH, LOW, UNIT = "18", "446744073709551616", "1000000000000000000"


def is_valid_uid(uid: Column) -> Column:
    """1 to 64 characters, ASCII digit components without leading zeros; null is not valid."""
    return F.coalesce((F.length(uid) <= 64) & uid.rlike(GRAMMAR), F.lit(False))


def decimal_of_hex(digits: Column) -> Column:
    """The decimal text of 32 hex digits.

    Of high and low halves h and l, the number is (18 h + c) * 10 ** 18 + r with c and r the quotient and rest of
    h * (2 ** 64 mod 10 ** 18) + l by 10 ** 18. Nothing exceeds 38 digits, and all of it is compiled.
    """
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)")
    number = lambda text, n: F.lit(text).cast(f"decimal({n},0)")
    below = (half(1) * number(LOW, 18)).cast("decimal(38,0)") + half(17)
    head = (half(1) * number(HIGH, 2)).cast("decimal(38,0)") + F.call_function("div", below, number(UNIT, 19)).cast("decimal(20,0)")
    text = F.concat(head.cast("decimal(38,0)").cast("string"), F.lpad((below % number(UNIT, 19)).cast("decimal(18,0)").cast("string"), 18, "0"))
    return F.when(F.length(digits) == 32, F.regexp_replace(text, "^0+(?=.)", ""))


def remap_key(uid: Column, salt: str = DEFAULT_SALT) -> Column:
    """The 16 bytes that decide `remap_uid`: the leading ones of SHA-256(salt NUL uid), none for a blank identifier.
    To group and count by them is to do so by the substitute, which is their decimal text; null stays null."""
    bare = F.trim(uid)
    digest = F.substring(F.unhex(F.sha2(F.concat(F.lit(salt + "\0"), bare), 256)), 1, 16)
    return F.when(bare == "", F.lit(b"")).otherwise(digest)


def uid_of_key(key: Column, root: str = DEFAULT_ROOT) -> Column:
    """The substitute that a key of `remap_key` stands for."""
    root = root.rstrip(".")
    if not root or len(root) > 60:
        raise ValueError("the root must have 1 to 60 characters")
    tail = F.substring(decimal_of_hex(F.hex(key)), 1, 64 - len(root) - 1)
    return F.when(F.octet_length(key) == 0, F.lit("")).otherwise(F.concat(F.lit(root + "."), tail))


def remap_uid(uid: Column, root: str = DEFAULT_ROOT, salt: str = DEFAULT_SALT) -> Column:
    """A stable substitute: ``root.`` and the leading 128 bits of SHA-256(salt NUL uid) in decimal, cut to 64 characters.

    Blank identifiers become empty; null stays null. Equal identifiers are mapped alike in all tables, without a join.
    """
    root = root.rstrip(".")
    if not root or len(root) > 60:
        raise ValueError("the root must have 1 to 60 characters")
    bare = F.trim(uid)
    digest = F.substring(F.sha2(F.concat(F.lit(salt + "\0"), bare), 256), 1, 32)
    tail = F.substring(decimal_of_hex(digest), 1, 64 - len(root) - 1)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(root + "."), tail))


def generate_uid(root: str | None = None) -> Column:
    """A random identifier under ``root`` (2.25 by default), at most 64 characters; not deterministic."""
    root = (root or DEFAULT_ROOT).strip().strip(".")
    if not all(p.isdigit() and (p == "0" or p[0] != "0") for p in root.split(".")) or len(root) > 62:
        raise ValueError(f"not a usable root: {root!r}")
    return F.substring(F.concat(F.lit(root + "."), decimal_of_hex(F.replace(F.uuid(), F.lit("-"), F.lit("")))), 1, 64)


def path_uid(uid: Column) -> Column:
    """The identifier as a url path segment; an error for anything but digits and dots."""
    return F.when(F.coalesce(uid.rlike(r"\A[0-9.]+\z"), F.lit(False)), uid).otherwise(F.raise_error(F.concat(F.lit("not a UID path segment: "), F.coalesce(uid, F.lit("null")))))
