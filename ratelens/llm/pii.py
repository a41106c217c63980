"""Format-preserving pseudonyms for personal data, DataFrame and SQL functions only.

Values are found by patterns and validated (card numbers by their check digit, IP addresses by
their octets, dates by the calendar). A keyed Feistel network then permutes each within its own
format: digits stay digits, letters stay letters of the same case, separators stay, a card gets
the check digit that fits, an address stays an address and a date a date. Equal values get equal
pseudonyms in every document, and the key's holder can turn them back (inverse=True).

Two halves of a value take turns: each round adds to one half, digit by digit or letter by letter
in its own alphabet, a SHA-256 stream of the key, the kind, the round and the other half. Numbers
are permuted without their separators, which are put back, so that a number is linked however it is
grouped. Addresses take turns as two 16-bit halves, dates as a pair of moduli whose product is the
146,097 days of a 400-year cycle. Where a kind's valid values are fewer than its format's (social
security numbers, dates that only the month-first reading allows), the permutation is repeated
until it meets a valid one, which makes it one of the valid values. What fails validation stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of the network; how often it is repeated at most to meet a valid value (a tenth to four tenths miss each time).
ROUNDS, WALK = 8, 64
FIRST_DAY, DAYS, LEFT, RIGHT = "1800-01-01", 146_097, 189, 773

# Patterns of personal data, tried in this order.
EMAIL = r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}"
SECRET = r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
DAY_DATE = r"\b[0-9]{2}[./][0-9]{2}[./][0-9]{4}\b"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])"
SOCIAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = (
    r"(?<![0-9.\-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}"
    r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
)
ANY = "|".join((EMAIL, SECRET, ISO_DATE, DAY_DATE, ADDRESS, PHONE, SOCIAL, IBAN, CARD))
KINDS = ("email", "secret", "date", "ip", "phone", "ssn", "iban", "card")


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rounds(inverse: bool) -> str:
    return f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"


def _draw(key: str, round_: str, other: str, place: str) -> str:
    """16 bits of the stream at a place."""
    return f"cast(conv(substring(sha2(concat({key}, ':', {round_}, ':', cast({place} div 16 as string), ':', {other}), 256), 1 + 4 * ({place} % 16), 4), 16, 10) as int)"


def _characters(value: str, key: str, inverse: bool, hexadecimal: bool = False) -> str:
    """A Feistel network over the characters of value; others than digits and letters stay."""
    minus = "-" if inverse else ""

    def add(x: str, y: str) -> str:
        k = f"({minus}{_draw(key, 'i', y, 'j')})"

        def turn(base: int, size: int) -> str:
            return f"char({base} + pmod(ascii(c) - {base} + {k}, {size}))"

        if hexadecimal:
            digits = "if(upper(c) = c and lower(c) <> c or c between '0' and '9' and s.upper, '0123456789ABCDEF', '0123456789abcdef')"
            return f"array_join(transform(split({x}, ''), (c, j) -> if(c = '', '', substring({digits}, 1 + pmod(instr('0123456789abcdef', lower(c)) - 1 + {k}, 16), 1))), '')"
        return (
            f"array_join(transform(split({x}, ''), (c, j) -> case when c between '0' and '9' then {turn(48, 10)}"
            f" when c between 'a' and 'z' then {turn(97, 26)} when c between 'A' and 'Z' then {turn(65, 26)} else c end), '')"
        )

    return (
        f"aggregate({_rounds(inverse)}, named_struct('a', substring({value}, 1, length({value}) div 2), 'b', substring({value}, length({value}) div 2 + 1), 'upper', {value} rlike '[A-F]'),"
        f" (s, i) -> if(i % 2 = 0, named_struct('a', s.a, 'b', {add('s.b', 's.a')}, 'upper', s.upper), named_struct('a', {add('s.a', 's.b')}, 'b', s.b, 'upper', s.upper)),"
        " s -> concat(s.a, s.b))"
    )


def _numbers(a: str, b: str, left: int, right: int, key: str, inverse: bool, finish: str) -> str:
    """A Feistel network over a pair of numbers below left and right; finish is SQL of s.a, s.b."""
    sign = "-" if inverse else "+"

    def draw(y: str) -> str:
        return f"cast(conv(substring(sha2(concat({key}, ':', i, ':', cast({y} as string)), 256), 1, 12), 16, 10) as bigint)"

    return (
        f"aggregate({_rounds(inverse)}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)),"
        f" (s, i) -> if(i % 2 = 0, named_struct('a', s.a, 'b', pmod(s.b {sign} {draw('s.a')}, {right}L)), named_struct('a', pmod(s.a {sign} {draw('s.b')}, {left}L), 'b', s.b)),"
        f" s -> {finish})"
    )


def _bind(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _refill(m: str, pattern: str, filled: str) -> str:
    """m with its characters of a class replaced, in turn, by those of filled."""
    step = f"if(c rlike '{pattern}', named_struct('o', concat(z.o, substring(f, z.n + 1, 1)), 'n', z.n + 1), named_struct('o', concat(z.o, c), 'n', z.n))"
    return _bind(filled, "f", f"aggregate(split({m}, ''), named_struct('o', '', 'n', 0), (z, c) -> {step}, z -> z.o)")


def _walk(start: str, step, valid) -> str:
    """step(start), and step of that while it isn't valid."""
    once = _bind(step("z.v"), "y", f"named_struct('v', y, 'ok', {valid('y')})")
    return f"aggregate(sequence(1, {WALK}), named_struct('v', {start}, 'ok', false), (z, t) -> if(z.ok, z, {once}), z -> z.v)"


def _check_sum(digits: str, odd: int) -> str:
    """Luhn sum of the digits, doubling every second from the right, from the last if odd is 0."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, j) -> if((j + {odd}) % 2 = 0, cast(c as int) * 2 - if(c >= '5', 9, 0), cast(c as int))), 0, (t, x) -> t + x)"


def _mod97(s: str) -> str:
    """Remainder by 97 of an account number's characters, letters as 10 to 35."""
    return f"aggregate(split({s}, ''), 0L, (t, c) -> if(c between '0' and '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"


def _kind(m: str) -> str:
    def full(p: str) -> str:
        return f"{m} rlike {_quote('^(?:' + p + ')$')}"

    digits = f"regexp_replace({m}, '[^0-9]', '')"
    iban = f"{_mod97(f"concat(substring(replace({m}, ' ', ''), 5), substring({m}, 1, 4))")} = 1"
    day = _day(m)
    return (
        f"case when instr({m}, '@') > 0 then 'email' when {full(SECRET)} and {m} rlike '[a-fA-F]' and {m} rlike '[0-9]' then 'secret'"
        f" when ({full(ISO_DATE)} or {full(DAY_DATE)}) then if({day} is not null and {day} >= date'{FIRST_DAY}' and {day} < date_add(date'{FIRST_DAY}', {DAYS}), 'date', null)"
        f" when {full(ADDRESS)} then if(forall(split({m}, '[.]'), o -> cast(o as int) < 256), 'ip', null)"
        f" when {m} like '+%' or {m} like '(%' or {full('[0-9]{3}-[0-9]{3}-[0-9]{4}')} then 'phone'"
        f" when {full(SOCIAL)} then if({_social(digits)}, 'ssn', null)"
        f" when {m} rlike '^[A-Z]' then if({iban}, 'iban', null)"
        f" when length({digits}) between 13 and 19 and {_check_sum(digits, 1)} % 10 = 0 then 'card' end"
    )


def _social(digits: str) -> str:
    return f"({digits} not rlike '^(?:000|666|9)|^...00|0000$')"


def _day(m: str) -> str:
    """The date of an ISO or day-first value; month-first where only that is a date."""
    d = f"translate({m}, './', '--')"
    return f"coalesce(try_to_date({d}, 'yyyy-MM-dd'), try_to_date({d}, 'dd-MM-yyyy'), try_to_date({d}, 'MM-dd-yyyy'))"


def _pseudonym(m: str, kind: str, secret: str, inverse: bool) -> str:
    key = f"concat({secret}, ':', {kind})"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    at = f"instr({m}, '@')"
    host = f"substring({m}, {at} + 1)"
    top = f"regexp_extract({host}, '[.][A-Za-z]+$', 0)"
    name = f"concat(substring({m}, 1, {at} - 1), '@', substring({host}, 1, length({host}) - length({top})))"
    # Behind a plus the first digit stays, however the country's code is parted from the rest.
    first = f"if({m} like '+%', 1, 0)"
    phone = _bind(digits, "d", f"concat(substring(d, 1, {first}), {_characters(f'substring(d, 1 + {first})', key, inverse)})")
    body = _characters(f"substring({digits}, 1, length({digits}) - 1)", key, inverse)
    card = _bind(body, "x", f"concat(x, pmod(10 - {_check_sum('x', 0)}, 10))")
    social = _walk(digits, lambda v: _characters(v, key, inverse), _social)
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as int)"
    address = _numbers(
        f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, key, inverse,
        "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)",
    )
    turned = lambda n: _numbers(f"({n}) div {RIGHT}", f"({n}) % {RIGHT}", LEFT, RIGHT, key, inverse, f"cast(s.a * {RIGHT} + s.b as int)")
    day = lambda n: f"date_add(date'{FIRST_DAY}', {n})"
    n = f"datediff({_day(m)}, date'{FIRST_DAY}')"
    spelt = lambda n, form: f"date_format({day(n)}, {form})"
    mark = f"substring({m}, 3, 1)"
    # A month-first value is told by its day over 12: it takes its turns among those.
    late = _walk(n, turned, lambda y: f"(dayofmonth({day(y)}) > 12)")
    date = (
        f"case when {m} rlike '^[0-9]{{4}}' then {spelt(turned(n), _quote('yyyy-MM-dd'))}"
        f" when try_to_date(translate({m}, './', '--'), 'dd-MM-yyyy') is not null then translate({spelt(turned(n), _quote('dd-MM-yyyy'))}, '-', {mark})"
        f" else translate({spelt(late, _quote('MM-dd-yyyy'))}, '-', {mark}) end"
    )
    plain = f"replace({m}, ' ', '')"
    account = _bind(_characters(f"substring({plain}, 5)", key, inverse), "x", f"concat(substring({m}, 1, 2), lpad(cast(98 - {_mod97(f"concat(x, substring({m}, 1, 2), '00')")} as string), 2, '0'), x)")
    return (
        f"case {kind} when 'email' then concat({_characters(name, key, inverse)}, {top})"
        f" when 'phone' then {_refill(m, '[0-9]', phone)} when 'card' then {_refill(m, '[0-9]', card)} when 'ssn' then {_refill(m, '[0-9]', social)}"
        f" when 'ip' then {address} when 'date' then {date} when 'iban' then {_refill(m, '[A-Z0-9]', account)}"
        f" else {_characters(m, key, inverse, True)} end"
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """docs with `text` pseudonymised and `pii`, an array of (kind, value, pseudonym) in text order
    (a column of this name is replaced). Null texts stay null with an empty array; texts without a
    valid value stay as they are; repeated rows come out equal. Different values of a kind have
    different pseudonyms, and inverse restores them where they are found again as the same kind. The key is part of the plan: take it from a secret store and keep plans private."""
    if not key:
        raise ValueError("a key is needed")
    found = f"regexp_extract_all({text}, {_quote(ANY)}, 0)"
    k = _quote(key)
    pseud = f"transform(transform(__found, m -> named_struct('value', m, 'kind', {_kind('m')})), v -> named_struct('kind', v.kind, 'value', v.value, 'pseudonym', if(v.kind is null, v.value, {_pseudonym('v.value', 'v.kind', k, inverse)})))"
    out = docs.select(*[c for c in docs.columns if c != "pii"])
    # Only texts with a digit or an @ can hold a value, and only those with a find are taken apart.
    out = out.withColumn("__found", F.expr(f"if({text} rlike '[0-9@]', {found}, array())"))
    out = out.withColumn("__all", F.expr(f"if(size(__found) > 0, {pseud}, array())"))
    changed = f"array_join(flatten(zip_with(split({text}, {_quote(ANY)}, -1), __all, (p, v) -> array(p, coalesce(v.pseudonym, '')))), '')"
    out = out.withColumn("pii", F.expr("coalesce(filter(__all, v -> v.kind is not null), array())"))
    return out.withColumn(text, F.expr(f"if(size(pii) > 0, {changed}, {text})")).select(*[c for c in docs.columns if c != "pii"], "pii")
