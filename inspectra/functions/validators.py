"""Checks of what patterns have matched, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(digits: Column, start: int, n: int) -> Column:
    return F.substring(digits, start, n).try_cast("int")


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def luhn(x: Column) -> Column:
    """Thirteen digits or more (blanks and hyphens aside) with a right check digit."""
    d = F.regexp_replace(x, r"[\s-]", "")
    return _sure(d.rlike("^[0-9]{13,}$") & F.call_function("luhn_check", d))


def ssn_area(x: Column) -> Column:
    d = _digits(x)
    area = _number(d, 1, 3)
    return _sure((F.length(d) == 9) & ~area.isin(0, 666) & (area < 900) & (_number(d, 4, 2) != 0) & (_number(d, 6, 4) != 0))


def phone_format(x: Column) -> Column:
    d = F.regexp_replace(_digits(x), "^1([0-9]{10})$", "$1")
    return _sure((F.length(d) == 10) & (_number(d, 1, 3) >= 200) & (_number(d, 4, 3) >= 200))


def email_domain(x: Column) -> Column:
    local, domain = F.regexp_extract(x, "(?s)^(.*)@[^@]*$", 1), F.substring_index(x, "@", -1)
    parts = F.split(domain, r"\.", -1)
    top = F.element_at(parts, -1)
    return _sure(x.contains("@") & (local != "") & (domain != "") & (F.size(parts) >= 2) & F.length(top).between(2, 63))


def iban_mod97(x: Column) -> Column:
    s = F.upper(F.regexp_replace(x, r"\s", ""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    place = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(place(c) > 9, 100).otherwise(10) + place(c)) % 97)
    return _sure(F.length(s).between(5, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]*$") & (rest == 1))


def passport_format(x: Column) -> Column:
    return _sure(F.trim(x).rlike("^[A-Za-z]?[0-9]{8,9}$"))


def drivers_license_format(x: Column) -> Column:
    d = _digits(x)
    return _sure((F.trim(x) != "") & ((d == "") | d.rlike("[1-9]")))


def ipv4_range(x: Column) -> Column:
    parts = F.split(x, r"\.", -1)
    numbers = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]{1,9}$"), p.try_cast("int")))
    inside = F.forall(numbers, lambda n: n.between(0, 255))
    return _sure((F.size(parts) == 4) & inside & ~F.forall(numbers, lambda n: n == 0) & ~F.forall(numbers, lambda n: n == 255))


def date_calendar(x: Column) -> Column:
    """Month/day/year, year-month-day or month-day-year, from 1900 to 2100."""
    forms = (("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"))
    dates = [F.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(form))) for shape, form in forms]
    return _sure(F.year(F.coalesce(*dates)).between(1900, 2100))


def aba_checksum(x: Column) -> Column:
    d = _digits(x)
    total = reduce(lambda a, b: a + b, (_number(d, i + 1, 1) * (3, 7, 1)[i % 3] for i in range(9)))
    return _sure((F.length(d) == 9) & (total % 10 == 0))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn,
    "ssn_area": ssn_area,
    "phone_format": phone_format,
    "email_domain": email_domain,
    "iban_mod97": iban_mod97,
    "passport_format": passport_format,
    "drivers_license_format": drivers_license_format,
    "ipv4_range": ipv4_range,
    "date_calendar": date_calendar,
    "aba_checksum": aba_checksum,
}


def validator(name: str | None, custom: dict[str, Callable[[Column], Column]] | None = None) -> Callable[[Column], Column]:
    """The check of that name; None checks nothing. Unknown names raise ValueError."""
    if name is None:
        return lambda x: F.lit(True)
    known = VALIDATORS | (custom or {})
    if name not in known:
        raise ValueError(f"unknown validator: {name}")
    return known[name]


# The endpoint's dialect: what agents check differs from what the server checks.


def _between_digits(x: Column, low: int, high: int) -> Column:
    d = F.regexp_replace(x, r"[\s-]", "")
    return _sure(d.rlike(f"^[0-9]{{{low},{high}}}$") & F.call_function("luhn_check", d))


def _endpoint_phone(x: Column) -> Column:
    d = F.regexp_replace(_digits(x), "^1([0-9]{10})$", "$1")
    return _sure((F.length(d) == 10) & ~F.substring(d, 1, 1).isin("0", "1") & (F.substring(d, 4, 1) != "0"))


def _endpoint_email(x: Column) -> Column:
    s = F.trim(x)
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    return _sure(s.rlike("^[^@]{1,64}@[^@]+$") & (local != "") & domain.rlike(r"^[^.-](.*[^.-])?$") & domain.rlike(r"\.[^.]{2,}$"))


def _endpoint_ipv4(x: Column) -> Column:
    s = F.trim(x)
    return _sure(s.rlike(r"^((0|[1-9][0-9]{0,2})\.){3}(0|[1-9][0-9]{0,2})$") & ipv4_range(s))


def _endpoint_date(x: Column) -> Column:
    s = F.trim(x)
    return _sure(F.when(s.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.year(F.try_to_timestamp(s, F.lit("MM/dd/yyyy"))).between(1900, 2025)))


ENDPOINT_VALIDATORS: dict[str, Callable[[Column], Column]] = VALIDATORS | {
    "luhn": lambda x: _between_digits(x, 13, 19),
    "phone_format": _endpoint_phone,
    "email_domain": _endpoint_email,
    "passport_format": lambda x: _sure(F.trim(x).rlike("^[A-Za-z][0-9]{8}$")),
    "drivers_license_format": lambda x: _sure(F.trim(x).rlike("^([A-Za-z][0-9]{6,12}|[0-9]{7,13})$")),
    "ipv4_range": _endpoint_ipv4,
    "date_calendar": _endpoint_date,
}
