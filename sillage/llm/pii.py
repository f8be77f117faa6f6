"""Format-preserving pseudonyms for personal data, as SQL expressions only.

Numbers and dates that pass their format's check are permuted within the format by a
keyed Feistel network: a card number becomes another number with a valid check digit, a
date another date of its century, an address another address.  Equal values get equal
pseudonyms in all documents and different values different ones, so records stay
linked.  E-mail addresses and secrets, which have no such small domain, get keyed
digests in their own format.

A network on pairs from Z_a x Z_b adds a keyed hash of one half to the other, in turn;
it is a permutation whatever a and b are, so no value has to be tried twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.llm.scratch import private

ROUNDS = 8
#: What may be personal data, in the order in which the kinds are tried at a place in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "phone": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9])",
    "local_phone": r"(?<![0-9(.\-+])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9\-])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9\-/])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
}
_NUMERIC = "|".join(f"(?:{PATTERNS[k]})" for k in ("phone", "local_phone", "date", "ssn", "ip", "card"))
#: Any of them; a test of the first character spares most places the tries that must fail.
_ANY = f"(?:{PATTERNS['email']})|(?=[0-9A-Fa-f])(?:{PATTERNS['secret']})|(?=[0-9+(])(?:{_NUMERIC})|(?=[A-Z]{{2}}[0-9]{{2}})(?:{PATTERNS['iban']})"


def _number(text: Column) -> Column:
    return text.cast("long")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _secret_key(key: str | Column) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def feistel(value: Column, a: Column | int, b: Column | int, key: str | Column, tag: str) -> Column:
    """A keyed permutation of the longs 0 <= value < a * b."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def step(state: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", _secret_key(key), F.lit(tag), i.cast("string"), state["r"].cast("string")), 256)
        noise = _number(F.conv(F.substring(digest, 1, 14), 16, 10))
        return F.struct(state["r"].alias("l"), F.pmod(state["l"] + noise, state["a"]).alias("r"), state["b"].alias("a"), state["a"].alias("b"))


    def run(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"), a.alias("a"), b.alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])

    return _let(value, run)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits``, one after the other."""

    def place(i: Column, d: Column) -> Column:
        here = F.substr(shape, i, F.lit(1))
        nth = F.length(_digits(F.substr(shape, F.lit(1), i)))
        return F.when(here.rlike("[0-9]"), F.substr(d, nth, F.lit(1))).otherwise(here)

    return _let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: place(i, d)), ""))


def _pad(number: Column, width: Column | int) -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def _permuted_digits(digits: Column, key: str | Column, tag: str) -> Column:
    """Another run of as many digits, up to 18."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    # the halves are numbers of their own, so eighteen digits fit
    return F.when(n < 2, digits).otherwise(_pad(feistel(_number(digits), _power(n - half), _power(half), key, tag), n))


def luhn_sum(digits: Column, skip: int = 0) -> Column:
    """Sum of the Luhn check; with ``skip`` 1 as if a check digit followed."""
    position = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = _number(F.substr(digits, F.length(digits) - i + 1, F.lit(1)))
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(F.pmod(i + skip, F.lit(2)) == 0, twice).otherwise(digit)

    return F.aggregate(position, F.expr("0L"), add)


def _card(m: Column, key: str | Column) -> tuple[Column, Column]:
    digits = _digits(m)
    valid = (F.pmod(luhn_sum(digits), F.lit(10)) == 0) & ~digits.rlike("^0+$")
    body = _let(F.substr(digits, F.lit(1), F.length(digits) - 1), lambda d: _permuted_digits(d, key, "card"))

    def checked(b: Column) -> Column:
        return F.concat(b, F.pmod(F.lit(10) - F.pmod(luhn_sum(b, 1), F.lit(10)), F.lit(10)).cast("string"))

    return valid, _refill(m, _let(body, checked))


#: The country codes of telephone numbers. Of one digit 1 and 7, of two those listed, of three all others.
COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}|.)"


def _national(digits: Column, key: str | Column) -> Column:
    """Another ten-digit number of the plan of country 1: the area begins with 2 to 9, and so does that of the pseudonym."""
    new = feistel(_number(digits) - 2_000_000_000, 800_000, 10_000, key, "phone1")
    return _let(new, lambda n: _pad(n + 2_000_000_000, 10))


def _phone(m: Column, key: str | Column) -> tuple[Column, Column]:
    """The country's code stays and the digits behind it are permuted, however they are grouped."""

    def new(d: Column) -> Column:
        code = F.regexp_extract(d, COUNTRY_CODE, 0)

        def behind(rest: Column) -> Column:
            return F.when((code == "1") & rest.rlike("^[2-9][0-9]{9}$"), _national(rest, key)).otherwise(_permuted_digits(rest, key, "phone"))

        return F.concat(code, _let(F.substr(d, F.length(code) + 1), behind))

    return F.length(_digits(m)).between(8, 15), _refill(m, _let(_digits(m), new))


def _local_phone(m: Column, key: str | Column) -> tuple[Column, Column]:
    """A number of country 1 without its code; it has the pseudonym of the same number with it."""
    return F.length(_digits(m)) == 10, _refill(m, _let(_digits(m), lambda d: _national(d, key)))


def _mod97(text: Column) -> Column:
    """The number that a run of digits and capitals (A is 10) stands for, modulo 97."""

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), _number(c)).otherwise(F.ascii(c) - 55)
        return F.pmod(rest * F.when(value < 10, 10).otherwise(100) + value, F.lit(97)).cast("long")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.expr("0L"), add)


def _iban(m: Column, key: str | Column) -> tuple[Column, Column]:
    """An account number with valid check digits; its digits are permuted in two runs, letters stay, check digits follow."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    valid = _mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1

    def moved(d: Column) -> Column:
        half = F.floor((F.length(d) + 1) / 2).cast("int")
        return F.concat(_permuted_digits(F.substr(d, F.lit(1), half), key, "iban"), _permuted_digits(F.substr(d, half + 1), key, "iban2"))

    def write(d: Column) -> Column:
        new = _refill(body, d)
        check = _pad(F.lit(98) - _mod97(F.concat(new, country, F.lit("00"))), 2)
        return _refill(F.substr(m, F.lit(3)), F.concat(check, d))

    return valid, F.concat(country, _let(_let(_digits(body), moved), write))


def _ssn(m: Column, key: str | Column) -> tuple[Column, Column]:
    area, group, serial = (_number(F.split(m, "-")[i]) for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")

    def write(n: Column) -> Column:
        high = F.floor(n / 9999).cast("long")
        new_place = F.floor(high / 99).cast("long")
        new_area = new_place + 1 + F.when(new_place >= 665, 1).otherwise(0)
        return F.concat_ws("-", _pad(new_area, 3), _pad(F.pmod(high, F.lit(99)) + 1, 2), _pad(F.pmod(n, F.lit(9999)) + 1, 4))

    return valid, _let(new, write)


def _ip(m: Column, key: str | Column) -> tuple[Column, Column]:
    parts = [_number(F.split(m, r"\.")[i]) for i in range(4)]
    valid = (parts[0] < 256) & (parts[1] < 256) & (parts[2] < 256) & (parts[3] < 256)
    new = feistel(((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3], 65536, 65536, key, "ip")
    return valid, _let(new, lambda n: F.concat_ws(".", *(F.pmod(F.floor(n / 256**k).cast("long"), F.lit(256)).cast("string") for k in (3, 2, 1, 0))))


def _date(m: Column, key: str | Column) -> tuple[Column, Column]:
    numbers = F.transform(F.split(m, r"[\-./]"), _number)
    year = F.when(m.contains("-"), numbers[0]).otherwise(numbers[2])
    month = F.when(m.contains("/"), numbers[0]).otherwise(numbers[1])
    day = F.when(m.contains("-"), numbers[2]).when(m.contains("."), numbers[0]).otherwise(numbers[1])
    leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    length = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = (year >= 100) & month.between(1, 12) & (day >= 1) & (day <= length)
    century = F.floor(year / 100).cast("int")
    long_one = F.pmod(century, F.lit(4)) == 0  # a century of 36,525 days, others have 36,524
    first = F.make_date(F.greatest(century, F.lit(1)) * 100, F.lit(1), F.lit(1))
    offset = F.datediff(F.make_date(F.when(valid, year).otherwise(2000).cast("int"), F.when(valid, month).otherwise(1).cast("int"), F.when(valid, day).otherwise(1).cast("int")), first).cast("long")
    new = feistel(offset, F.when(long_one, 75).otherwise(92), F.when(long_one, 487).otherwise(397), key, "date")

    def write(then: Column) -> Column:
        forms = {f: F.date_format(then, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")}
        return F.when(m.contains("-"), forms["yyyy-MM-dd"]).when(m.contains("."), forms["dd.MM.yyyy"]).otherwise(forms["MM/dd/yyyy"])

    return valid, _let(F.date_add(first, new.cast("int")), write)


def _email(m: Column, key: str | Column) -> tuple[Column, Column]:
    digest = F.sha2(F.concat_ws("|", _secret_key(key), F.lit("email"), F.lower(m)), 256)
    return F.lit(True), F.concat(F.lit("user"), F.substring(digest, 1, 16), F.lit("@mail.invalid"))


def _secret(m: Column, key: str | Column) -> tuple[Column, Column]:
    digest = F.substr(F.sha2(F.concat_ws("|", _secret_key(key), F.lit("secret"), m), 256), F.lit(1), F.length(m))
    return m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), F.when(m.rlike("[A-F]"), F.upper(digest)).otherwise(digest)


_KINDS = {"email": _email, "secret": _secret, "phone": _phone, "local_phone": _local_phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "iban": _iban}


def _kind(m: Column) -> Column:
    """The kind of a match: the first whose pattern fits it alone."""
    out = F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for name, pattern in list(PATTERNS.items())[1:]:
        out = out.when(m.rlike(f"^(?:{pattern})$"), name)
    return out


def _pieces(text: Column, key: str | Column) -> tuple[Column, Column, Callable[[Column], Column]]:
    """The text between candidates, the candidates, and what turns one into struct(kind, text).

    A candidate that fails its check (a number without a valid check digit, an
    impossible date) has no kind and keeps its text.
    """
    if isinstance(key, str) and not key:
        raise ValueError("a key is needed")
    gaps, found = F.split(text, _ANY, -1), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))

    def by_kind(m: Column, kind: Column) -> Column:
        text_ = None
        for name, make in _KINDS.items():
            ok, new = make(m, key)
            new = F.when(F.coalesce(ok, F.lit(False)), new)
            text_ = F.when(kind == name, new) if text_ is None else text_.when(kind == name, new)
        return _let(text_, lambda new: F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, m).alias("text")))

    def replace(m: Column) -> Column:
        return _let(_kind(m), lambda kind: by_kind(m, kind))

    return gaps, found, replace


def mask(docs: DataFrame, key: str | Column, *, text: str = "text", kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a new column ``kinds``: the kind of each replacement, in text order.

    A ``key`` given as a string stands in the plan as a literal, and so in event logs; a
    column (of a secret's one-row table, broadcast to ``docs``) does not.

    Rows are independent, so ties, repeated rows and empty tables need no rule; other
    columns stay, but one named like ``kinds`` is replaced.  Null and empty texts stay,
    with an empty list.
    """
    gaps, found, replace = _pieces(F.col(f"`{text}`").cast("string"), key)
    marked = F.coalesce(F.col(f"`{text}`").rlike("[0-9@]"), F.lit(False))
    name = private("pii")
    work = docs.withColumn(name, F.when(marked, F.transform(found, replace)))
    pieces = F.zip_with(gaps, F.col(name), lambda gap, new: F.concat(gap, F.coalesce(new["text"], F.lit(""))))
    new_text = F.when(F.size(name) > 0, F.array_join(pieces, "")).otherwise(F.col(f"`{text}`"))
    listed = F.coalesce(F.array_compact(F.transform(F.col(name), lambda x: x["kind"])), F.array().cast("array<string>"))
    return work.withColumns({text: new_text, kinds: listed}).drop(name)


KINDS = tuple(_KINDS)
