"""URLs, hosts, and addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host endings of institutions and of organisations.
INSTITUTIONAL = [
    ".go.id", ".ac.id", ".sch.id", ".mil.id", ".desa.id", ".kab.go.id", ".kota.go.id", ".or.id", ".ponpes.id",
    ".gov", ".edu", ".mil", ".int", ".gov.uk", ".ac.uk", ".edu.au", ".gov.au", ".edu.my",
    ".go.th", ".ac.th", ".edu.ph", ".gov.ph", ".edu.sg",
]
NGO = [".org", ".ngo", ".foundation"]


def domain(url: Column) -> Column:
    """Lower-case authority without a leading www. What follows the authority may hold anything, such as a second #."""
    origin = F.regexp_replace(url, r"(?s)^([^:/?#]+://[^/?#]*).*$", "$1")
    return F.regexp_replace(F.lower(F.try_parse_url(origin, F.lit("AUTHORITY"))), r"^www\.", "")


def host_parts(host: Column) -> Column:
    """struct<subdomain, root>: the root is the last two labels, or three where both of the last two are short."""
    labels = F.split(F.lower(F.regexp_replace(host, r"^\.+|\.+$", "")), r"\.")
    n = F.size(labels)
    short = (F.length(F.get(labels, n - 2)) <= 3) & (F.length(F.get(labels, n - 1)) <= 3)
    k = F.when(n <= 2, n).when(short, F.lit(3)).otherwise(F.lit(2))
    root = F.array_join(F.slice(labels, n - k + 1, k), ".")
    sub = F.when(n > k, F.array_join(F.slice(labels, F.lit(1), n - k), ".")).otherwise("")
    return F.struct(sub.alias("subdomain"), root.alias("root"))


def ends_with_any(host: Column, suffixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(F.lower(host), s))


def host_class(host: Column) -> Column:
    return F.when(ends_with_any(host, INSTITUTIONAL), "institutional").when(ends_with_any(host, NGO), "ngo").otherwise("other")


def is_parasite(host: Column, tokens: Column) -> Column:
    """A keyword token is in the subdomain and none is in the root."""
    p = host_parts(host)
    return (p["subdomain"] != "") & F.exists(tokens, lambda t: F.contains(p["subdomain"], t)) & ~F.exists(tokens, lambda t: F.contains(p["root"], t))


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return F.when(F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")), u).otherwise(F.concat(F.lit("https://"), u))


# -- address lists -------------------------------------------------------------


def networks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds struct<base, bits, text>: the 16-byte address, how many bits of it count, and its canonical text; null if it is neither address nor network.

    IPv4 is mapped into IPv6, so both compare as bytes.
    """

    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(x):
            try:
                n = ipaddress.ip_network(str(x).strip(), strict=False)
            except ValueError:
                return None, None, None
            low, more = (0xFFFF << 32, 96) if n.version == 4 else (0, 0)
            alone = n.num_addresses == 1
            return (low + int(n.network_address)).to_bytes(16, "big"), more + n.prefixlen, str(n.network_address if alone else n)

        for s in batches:
            yield pd.DataFrame([one(x) for x in s], columns=["base", "bits", "text"]).astype({"bits": "Int64"})

    return df.withColumn(out, F.pandas_udf(convert, "base binary, bits long, text string")(F.col(value)))


def masked(address: Column, bits: Column) -> Column:
    """The first bits of a 16-byte address as text, the others zero."""
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.lpad(F.conv(F.hex(F.substring(address, i * 2 - 1, F.lit(2))), 16, 2), 16, "0")), "")
    return F.substring(digits, F.lit(1), bits.cast("int"))


def allowed(requests: DataFrame, address: str, entries: DataFrame, value: str, enabled: bool = True) -> DataFrame:
    """Adds ``allowed``: loopback always; everything if the list is off; else membership in an entry.

    Membership is an equality join for each network size in the list (129 at most):
    the address is cut to that many bits and looked up among the networks of that size.
    """
    own = F.col(address)
    loopback = F.coalesce(own.startswith("127.") | (own == "::1"), F.lit(False))
    if not enabled:
        return requests.withColumn("allowed", F.lit(True))
    listed = networks(entries.select(F.col(value).alias("_v")), "_v", "_e").where("_e.base is not null")
    listed = listed.select(F.col("_e.bits").alias("_n"), masked(F.col("_e.base"), F.col("_e.bits")).alias("_m")).distinct()
    sizes = [r[0] for r in listed.select("_n").distinct().collect()]  # 129 at most
    asked = networks(requests.select(own.alias("_a")).distinct(), "_a", "_e").where("_e.base is not null")
    asked = asked.select("_a", F.explode(F.array(*map(F.lit, sizes)).cast("array<bigint>")).alias("_n"), "_e").select("_a", "_n", masked(F.col("_e.base"), F.col("_n")).alias("_m"))
    hits = asked.join(listed, ["_n", "_m"], "left_semi").select(F.col("_a").alias("_hit")).distinct()
    out = requests.join(hits, own == F.col("_hit"), "left")
    return out.withColumn("allowed", loopback | F.col("_hit").isNotNull()).drop("_hit")
