"""Text codecs: registrations, coordinates, plan tokens, hardware clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# The 24 letters of US registrations and the size of each digit's block of addresses.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
_SUFFIX = 1 + len(LETTERS) * (1 + len(LETTERS))  # none, one or two letters
_B4 = 1 + len(LETTERS) + 10  # a fourth digit: nothing, one letter, or a fifth digit
_B3 = 10 * _B4 + _SUFFIX
_B2 = 10 * _B3 + _SUFFIX
_B1 = 10 * _B2 + _SUFFIX
_FIRST = 0xA00001


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def _suffix(s: Column) -> Column:
    """Rank of up to two letters: none, A, AA, AB, .., B, BA, .."""
    n = len(LETTERS)
    one = F.instr(F.lit(LETTERS), F.substring(s, 1, 1)) - 1
    two = F.instr(F.lit(LETTERS), F.substring(s, 2, 1))
    return F.when(F.length(s) == 0, 0).when(F.length(s) == 1, 1 + one * (n + 1)).otherwise(1 + one * (n + 1) + two)


def n_number_to_icao(number) -> Column:
    """The 24-bit address, as six hex digits, of a US registration; null if it is none."""
    s = col(number)
    pattern = r"^N([1-9])([0-9]?)([0-9]?)([0-9]?)([0-9]?)([A-HJ-NP-Z]{0,2})$"
    ok = s.rlike(pattern) & (F.length(s) <= 6)
    d = [F.regexp_extract(s, pattern, i) for i in range(1, 6)]
    letters = F.regexp_extract(s, pattern, 6)
    digit = lambda i: F.coalesce(d[i].try_cast("int"), F.lit(0))
    count = F.length(F.concat(*d))
    rank = F.lit(_FIRST) + (digit(0) - 1) * _B1
    rank = rank + F.when(count >= 2, _SUFFIX + digit(1) * _B2).otherwise(0)
    rank = rank + F.when(count >= 3, _SUFFIX + digit(2) * _B3).otherwise(0)
    rank = rank + F.when(count >= 4, _SUFFIX + digit(3) * _B4).otherwise(0)
    rank = rank + F.when(count >= 5, 1 + len(LETTERS) + digit(4)).otherwise(0)
    tail = F.when(count <= 3, _suffix(letters)).when(count == 4, F.when(F.length(letters) == 1, F.instr(F.lit(LETTERS), letters)).otherwise(0)).otherwise(0)
    valid = ok & ~((count == 4) & (F.length(letters) > 1)) & ~((count == 5) & (F.length(letters) > 0))
    return F.when(valid, F.lower(F.hex((rank + tail).cast("long"))))


def _letters(r: Column) -> Column:
    """The suffix of a rank."""
    n = len(LETTERS)
    one = F.substring(F.lit(LETTERS), F.floor((r - 1) / (n + 1)).cast("int") + 1, F.lit(1))
    rest = F.pmod(r - 1, F.lit(n + 1))
    two = F.when(rest == 0, F.lit("")).otherwise(F.substring(F.lit(LETTERS), rest.cast("int"), F.lit(1)))
    return F.when(r == 0, F.lit("")).otherwise(F.concat(one, two))


def icao_to_n_number(icao) -> Column:
    """The US registration of a 24-bit address; null outside the US block."""

    def name(r0: Column) -> Column:
        div = lambda x, n: F.floor(x / F.lit(n)).cast("long")
        text = lambda x: x.cast("string")

        def fifth(r: Column) -> Column:
            letter = F.substring(F.lit(LETTERS), r.cast("int"), F.lit(1))
            return F.when(r == 0, F.lit("")).when(r <= len(LETTERS), letter).otherwise(text(r - len(LETTERS) - 1))

        def digit(block: int, then):
            """The digit of a block and what follows it, or a suffix of letters."""
            return lambda r: F.when(r < _SUFFIX, _letters(r)).otherwise(F.concat(text(div(r - _SUFFIX, block)), _once(F.pmod(r - _SUFFIX, F.lit(block)), then)))

        rest = digit(_B2, digit(_B3, digit(_B4, fifth)))
        return F.concat(F.lit("N"), text(div(r0, _B1) + 1), _once(F.pmod(r0, F.lit(_B1)), rest))

    return _once(F.conv(col(icao), 16, 10).cast("long") - _FIRST, lambda r0: F.when((r0 >= 0) & (r0 < 9 * _B1), name(r0)))


def dms_pair(text) -> tuple[Column, Column]:
    """(latitude, longitude) of DDMMSS[NS]DDDMMSS[EW]."""
    p = r"^(\d{2})(\d{2})(\d{2})([NS])(\d{3})(\d{2})(\d{2})([EW])$"
    g = [F.regexp_extract(col(text), p, i) for i in range(1, 9)]
    num = lambda i: g[i].try_cast("double")
    lat = (num(0) + num(1) / 60 + num(2) / 3600) * F.when(g[3] == "S", -1.0).otherwise(1.0)
    lon = (num(4) + num(5) / 60 + num(6) / 3600) * F.when(g[7] == "W", -1.0).otherwise(1.0)
    return lat, lon


def ns_pair(text) -> tuple[Column, Column]:
    """(latitude, longitude) of [NS]DDMM(SS)[EW]DDDMM(SS)."""
    p = r"^([NS])(\d{4,6})\d*([EW])(\d{5,7})\d*$"
    a, b = F.rpad(F.regexp_extract(col(text), p, 2), 6, "0"), F.rpad(F.regexp_extract(col(text), p, 4), 7, "0")
    part = lambda s, at, n: F.substring(s, at, n).try_cast("double")
    lat = part(a, 1, 2) + part(a, 3, 2) / 60 + part(a, 5, 2) / 3600
    lon = part(b, 1, 3) + part(b, 4, 2) / 60 + part(b, 6, 2) / 3600
    sign = lambda i, c: F.when(F.regexp_extract(col(text), p, i) == c, -1.0).otherwise(1.0)
    ok = col(text).rlike(p)
    return F.when(ok, lat * sign(1, "S")), F.when(ok, lon * sign(3, "W"))


SPEED_LEVEL = r"^([KN]\d{4}|M\d{3})([AF]\d{3}|[SM]\d{4})$"
COORDINATE = r"^(\d{2}|\d{4})([NS])(\d{3}|\d{5})([EW])$"


def speed_level(token) -> tuple[Column, Column]:
    """(speed, level) numbers of a plan token such as N0450F340; nulls if it is none."""
    t = col(token)
    get = lambda i: F.substring(F.regexp_extract(t, SPEED_LEVEL, i), 2, 4).try_cast("int")
    return F.when(t.rlike(SPEED_LEVEL), get(1)), F.when(t.rlike(SPEED_LEVEL), get(2))


def coordinate(token) -> tuple[Column, Column]:
    """(latitude, longitude) of a plan token such as 61N070W; four or five digits are hundredths."""
    t = col(token)
    a, b = F.regexp_extract(t, COORDINATE, 1), F.regexp_extract(t, COORDINATE, 3)
    lat = a.try_cast("double") / F.when(F.length(a) == 4, 100.0).otherwise(1.0) * F.when(F.regexp_extract(t, COORDINATE, 2) == "S", -1.0).otherwise(1.0)
    lon = b.try_cast("double") / F.when(F.length(b) == 5, 100.0).otherwise(1.0) * F.when(F.regexp_extract(t, COORDINATE, 4) == "W", -1.0).otherwise(1.0)
    return F.when(t.rlike(COORDINATE), lat), F.when(t.rlike(COORDINATE), lon)


def token_kind(token, before) -> Column:
    """Kind of a route token from the token and the one before it (null for the first)."""
    t, b = col(token), col(before)
    return (
        F.when(t == "DCT", "direct")
        .when(t.isin("VFR", "IFR"), "rule")
        .when(t.rlike(SPEED_LEVEL), "speed_level")
        .when(t.rlike(COORDINATE), "coordinate")
        .when(t.contains("/"), "speed_level_change")
        .when(t.rlike(r"^\w{2,7}$") & (t.rlike(r"\d") | t.startswith("NAT")), F.when(b.isNull(), "sid").otherwise("airway"))
        .when(t.rlike(r"^[^\d\W]{2,5}$"), "point")
    )


def radarcape_seconds(clock) -> Column:
    """Seconds of the day of a 48-bit clock in hex: seconds above 30 bits of nanoseconds."""
    n = F.conv(col(clock), 16, 10).cast("long")
    return F.shiftright(n, 30) + n.bitwiseAND(F.lit(0x3FFFFFFF).cast("long")) / 1e9


def dump1090_seconds(clock) -> Column:
    """Seconds of a 48-bit clock in hex that ticks at 12 MHz."""
    return F.conv(col(clock), 16, 10).cast("long") / 12e6


def beast_line(seconds, message) -> Column:
    """@, twelve hex digits of 12 MHz ticks, and the message."""
    return F.concat(F.lit("@"), F.lpad(F.hex(F.rint(col(seconds) * 12e6).cast("long")), 12, "0"), col(message))
