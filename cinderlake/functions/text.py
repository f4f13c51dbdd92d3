"""Text functions: screening, redaction, pseudonyms, addresses, entropy and size estimates, all as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes that count as inside by text, and networks that count as inside by number.
INSIDE_PREFIXES = ["10.", "192.168.", "172.16.", "192.0.2."]
INSIDE_NETWORKS = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8)]
CHARS_PER_TOKEN = 3.5
EMAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"
ADDRESS = r"\b([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\b"


def token_estimate(text: Column) -> Column:
    """ceil(characters / 3.5); null for null."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    term = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - term(c) * F.log2(term(c)))


def first_match(text: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern, in the given order, that the text has; null for none."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()])


def redact(text: Column, patterns: dict[str, str]) -> Column:
    """The text with every match of every pattern, in order, replaced by [REDACTED_<name>]; group 1, if any, stays."""
    return reduce(lambda t, kp: F.regexp_replace(t, kp[1], ("$1" if "(" in kp[1].replace("(?", "") else "") + f"[REDACTED_{kp[0]}]"), patterns.items(), text)


def pseudonyms(rows: DataFrame, key: str, text: str, pattern: str, kind: str) -> DataFrame:
    """(key, value, pseudonym): distinct matches in each row's text, KIND_001 onwards in order of first appearance."""
    found = rows.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("at", "value"))
    return found.select(key, "value", F.format_string(f"{kind}_%03d", F.col("at") + 1).alias("pseudonym"))


def address_number(octets: list[Column]) -> Column:
    """A dotted quad as a whole number; null if an octet exceeds 255."""
    value = reduce(lambda a, o: a * 256 + o, [o.cast("long") for o in octets])
    return F.when(reduce(lambda a, b: a & b, [o.cast("long") <= 255 for o in octets]), value)


def inside_by_prefix(address: Column) -> Column:
    return reduce(lambda a, b: a | b, [address.startswith(p) for p in INSIDE_PREFIXES])


def inside_by_network(number: Column) -> Column:
    def within(net: str, bits: int) -> Column:
        low = sum(int(x) << s for x, s in zip(net.split("."), (24, 16, 8, 0)))
        return number.between(low, low + (1 << (32 - bits)) - 1)

    return reduce(lambda a, b: a | b, [within(*n) for n in INSIDE_NETWORKS])


def hash_split(key: Column, seed: str, share: float) -> Column:
    """'train' or 'test' by the first four bytes of sha256(seed:key)."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.when(head < int(share * (1 << 32)), "train").otherwise("test")


def basename(path: Column) -> Column:
    """Last part of a path with either separator."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
