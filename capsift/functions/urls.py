"""Network destinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsift.functions.paths import is_url, trim


def clean_url(text: Column) -> Column:
    """Without white space around it and one quote at each end."""
    return F.regexp_replace(trim(text), r"^['\"`]|['\"`]\z", "")


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal behind a 0, hexadecimal behind a 0x; null for what is none or can't fit 32 bits."""

    def value(digits: Column, base: int, most: int) -> Column:
        bare = F.regexp_replace(digits, "^0+", "")
        return F.when(bare == "", F.lit(0).cast("long")).when(F.length(bare) <= most, F.conv(bare, base, 10).cast("long"))

    return (
        F.when(F.rlike(part, F.lit(r"^0x[0-9a-f]*\z")), value(F.substring(part, 3, 1 << 20), 16, 8))
        .when(F.rlike(part, F.lit(r"^0[0-7]+\z")), value(part, 8, 11))
        .when(F.rlike(part, F.lit(r"^(?:0|[1-9][0-9]*)\z")), value(part, 10, 10))
    )


def _ipv4(parts: Column) -> Column:
    """Dotted form of the parts of an address, the last of which stands for all bytes that are left; null if they make none."""

    def dotted(values: Column) -> Column:
        n = F.size(values)
        whole = F.aggregate(F.transform(F.slice(values, 1, n - 1), lambda v, i: v * F.lit(256.0) ** (3 - i)), F.element_at(values, -1).cast("double"), lambda a, v: a + v).cast("long")
        fits = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, 1, n - 1), lambda v: v <= 255) & (F.element_at(values, -1) < F.lit(256.0) ** (5 - n))
        return F.when(fits, F.concat_ws(".", *(F.shiftright(whole, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0))))

    return _let(F.transform(parts, _number), dotted)


def _ipv6(inside: Column) -> Column:
    """The shortest form of an IPv6 address; null for what is none."""
    # an IPv4 tail becomes two groups
    tail = F.regexp_extract(inside, r":(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\z", 1)
    bytes_ = F.transform(F.split(tail, r"\."), lambda b: F.when(F.rlike(b, F.lit(r"^(?:0|[1-9][0-9]{0,2})\z")), b.cast("int")))
    pair = lambda i: F.lower(F.hex(F.get(bytes_, i) * 256 + F.get(bytes_, i + 1)))
    fits = F.forall(bytes_, lambda b: b.isNotNull() & (b <= 255))
    plain = F.when(tail == "", inside).when(fits, F.concat(F.substring(inside, F.lit(1), F.length(inside) - F.length(tail)), pair(0), F.lit(":"), pair(2)))

    def groups(text: Column) -> Column:
        halves = F.split(text, "::")
        of = lambda i: F.when(F.coalesce(F.get(halves, i), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, i), ":"))
        filled = F.concat(of(0), F.when(F.size(halves) == 2, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(of(0)) - F.size(of(1)), F.lit(0)))).otherwise(F.array().cast("array<string>")), of(1))
        good = (F.size(halves) <= 2) & (F.size(of(0)) + F.size(of(1)) <= F.when(F.size(halves) == 2, 7).otherwise(8))
        return F.when(good & (F.size(filled) == 8) & F.forall(filled, lambda g: F.rlike(g, F.lit(r"^[0-9a-f]{1,4}\z"))), F.transform(filled, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    def shown(eight: Column) -> Column:
        joined = F.concat(F.lit(":"), F.array_join(eight, ":"), F.lit(":"))
        out = F.array_join(eight, ":")
        for n in range(2, 9):  # the longest run of zeros, from two on; of equals the first
            run = ":" + "0:" * n
            at = F.instr(joined, run)
            short = F.concat(F.substring(joined, F.lit(2), F.greatest(at - 2, F.lit(0))), F.lit("::"), F.substring(joined, at + len(run), F.greatest(F.length(joined) - at - len(run), F.lit(0))))
            out = F.when(at > 0, short).otherwise(out)
        return F.concat(F.lit("["), out, F.lit("]"))

    return _let(_let(plain, groups), lambda e: F.when(e.isNotNull(), shown(e)))


def _name(raw: Column) -> Column:
    """A host that is no IPv6 address: decoded, in lower case, without what may not stand in one; numbers as an IPv4 address."""
    decoded = F.lower(F.when(F.contains(raw, F.lit("%")), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw))

    def checked(name: Column) -> Column:
        parts = F.split(name, r"\.")
        parts = F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        numeric = F.rlike(F.element_at(parts, -1), F.lit(r"^(?:[0-9]+|0x[0-9a-f]*)\z"))
        # The characters that no host may have.
        bad = (name == "") | F.rlike(name, F.lit("[\\x00-\\x20#/:<>?@\\[\\\\\\]^|%\\x7F\ufffd]"))
        return F.when(bad, None).when(numeric, _ipv4(parts)).otherwise(name)

    return _let(decoded, checked)


def host(text: Column) -> Column:
    """The host of an address as a parser of URLs gives it; https is assumed where no scheme stands. Null if there is none, or none that may be one.

    Tabs and line ends don't count, the authority ends at a slash of either kind, `?` or `#`, the last `@` ends its user. Number forms of IPv4 addresses become dotted, IPv6 addresses their shortest form. Names
    outside ASCII stay as they are, in lower case."""
    cleaned = clean_url(text)
    full = F.when(is_url(cleaned), cleaned).otherwise(F.concat(F.lit("https://"), cleaned))
    authority = F.regexp_extract(trim(F.regexp_replace(full, r"[\t\n\r]", "")), r"^(?i:https?):[/\\]*([^/\\?#]*)", 1)

    def found(place: Column) -> Column:
        port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[]*):0*([0-9]*)\z", 1)
        port_fits = (F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535"))
        six = F.regexp_extract(place, r"^\[([^\]]*)\](?::[0-9]*)?\z", 1)
        name = F.regexp_extract(place, r"^([^:\[\]]*)(?::[0-9]*)?\z", 1)
        return F.when(port_fits, F.when(F.startswith(place, F.lit("[")), F.when(six != "", _ipv6(F.lower(six)))).otherwise(_name(name)))

    return F.when(F.length(text) > 0, _let(F.substring_index(authority, "@", -1), found))


def destination(host_: Column) -> Column:
    # Loopback names, and prefixes of private networks.
    return (
        F.when(host_.isin("localhost", "127.0.0.1", "::1"), "loopback")
        .when(F.endswith(host_, F.lit(".local")) | F.rlike(host_, F.lit(r"^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.")), "internal")
        .when(host_.isNotNull(), "external")
    )


def repository(url: Column) -> Column:
    """struct(owner, name) of a repository's address with exactly two segments; else null."""
    pattern = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?/?(?:[?#].*)?$"
    owner = F.regexp_extract(url, pattern, 1)
    return F.when(owner != "", F.struct(owner.alias("owner"), F.regexp_extract(url, pattern, 2).alias("name")))
