"""PII pseudonyms that keep the format, in DataFrame expressions only.

Numbers and dates are found by pattern and validated: Luhn for cards, country, length and mod 97 for IBANs,
octet ranges for IP addresses, the calendar for dates, unassigned parts for phone and social security
numbers; what fails stays as it is. Valid ones go through a keyed Feistel permutation of the valid values of
their format, by cycle walking where these are no power: a card number becomes another valid one with the
same first six digits, a date another real date, and so on. Equal values get equal pseudonyms under one
key, so they stay linked across documents, and different values of a format never collide. Values count,
not writings: a phone number has one pseudonym with or without its separators and +1, a date one in the
forms yyyy-MM-dd, dd.MM.yyyy and dd/MM/yyyy, an address one with or without leading zeros. A slash date
that has no day-first reading is read month first and permuted among those dates. E-mail addresses and
secrets, which have no finite format, get keyed digests; they are matched to their end, however long they are.

Defined results: null stays null; texts without PII are unchanged; whole texts are searched; dates outside
of 2**16 days from 1900-01-01 stay; columns other than the text are untouched whatever their names, but
for ``pii``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a cycle walk. More than half of all values are valid (a third of phone numbers isn't): so long a walk
#: outside of them has a chance below 1e-11.
WALK = 64
#: The lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, countries in IBAN_LENGTHS.items())
_BLOCKS = "|".join(["[0-9]{4}" + "[ ][0-9]{4}" * 3, "[0-9]{4}" + "-[0-9]{4}" * 3, "[0-9]{4}[ ][0-9]{6}[ ][0-9]{5}", "[0-9]{4}-[0-9]{6}-[0-9]{5}", "[0-9]{13,19}"])
#: The patterns by kind, most specific first.
PATTERNS = {
    "secret": r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?[ \t]{0,3}[:=][ \t]{0,3}["']?)[A-Za-z0-9+/_.-]{12,}+""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}+",
    "iban": rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "phone": r"(?<![0-9+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[ .-]?[0-9]{10}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9])(?:{_BLOCKS})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(value: str, key: str, tweak: str) -> str:
    """48 keyed pseudo-random bits of a string expression, as bigint."""
    return f"cast(conv(substr(sha2(concat({_sql(key)}, '|', {tweak}, '|', {value}), 256), 1, 12), 16, 10) AS bigint)"


def feistel_digits(digits: str, key: str, tweak: str) -> str:
    """A keyed permutation of the strings of n digits, n from 2 to 30, by an alternating Feistel network.

    The string is split into halves of n/2 digits; in turn, one half is shifted by a keyed function of the
    other, modulo its power of ten.
    """
    halves = f"named_struct('a', substr(whole, 1, cast(length(whole) / 2 AS int)), 'b', substr(whole, cast(length(whole) / 2 AS int) + 1), 'swapped', false)"
    shifted = f"lpad(cast(pmod(cast(s.a AS bigint) + {_digest('s.b', key, f'concat({tweak}, cast(i AS string))')}, cast(pow(10, length(s.a)) AS bigint)) AS string), length(s.a), '0')"
    walk = f"aggregate(sequence(1, {ROUNDS}), {halves}, (s, i) -> named_struct('a', s.b, 'b', {shifted}, 'swapped', NOT s.swapped), s -> concat(s.a, s.b))"
    # ROUNDS is even: the halves are back in their places
    return f"element_at(transform(array({digits}), whole -> {walk}), 1)"


def feistel_below(number: str, bits: int, key: str, tweak: str) -> str:
    """A keyed permutation of the integers below 2**bits, bits even."""
    half = 1 << (bits // 2)
    start = f"named_struct('a', cast(n DIV {half} AS bigint), 'b', cast(n % {half} AS bigint))"
    moved = f"pmod(s.a + {_digest('cast(s.b AS string)', key, f'concat({tweak}, cast(i AS string))')}, {half})"
    walk = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> named_struct('a', s.b, 'b', {moved}), s -> s.a * {half} + s.b)"
    return f"element_at(transform(array(cast({number} AS bigint)), n -> {walk}), 1)"


def walk(number: str, bits: int, valid: str, key: str, tweak: str) -> str:
    """A keyed permutation of the numbers below 2**bits for which ``valid``, SQL about ``t``, holds: the one of all
    numbers below 2**bits is repeated until it gives a valid one."""
    step = feistel_below("if(t < 0, -1 - t, t)", bits, key, tweak)
    return f"aggregate(sequence(1, {WALK}), -1 - cast({number} AS bigint), (t, turn) -> if(t >= 0 AND {valid}, t, {step}))"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with the value under a name, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn_sum(digits: str) -> str:
    """The Luhn sum; the last digit has weight 1."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, j) -> if(j % 2 = 0, cast(c AS int), (2 * cast(c AS int)) DIV 10 + (2 * cast(c AS int)) % 10)), 0L, (t, v) -> t + coalesce(v, 0))"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    step = "named_struct('k', s.k + if(c rlike '[0-9]', 1, 0), 'o', concat(s.o, if(c rlike '[0-9]', substr(s.d, s.k + 1, 1), c)), 'd', s.d)"
    return f"aggregate(split({shape}, ''), named_struct('k', 0, 'o', '', 'd', {digits}), (s, c) -> {step}, s -> s.o)"


#: Days of the window in which dates are permuted: 2**16 days from this one (1900-01-01 to 2079-06-05).
FIRST_DAY = "date'1900-01-01'"
#: Forms by their precedence; a slash date is read day first where that is a date.
DATE_FORMS = {"yyyy-MM-dd": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "dd.MM.yyyy": r"[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}", "dd/MM/yyyy": "[0-9]{2}/[0-9]{2}/[0-9]{4}", "MM/dd/yyyy": "[0-9]{2}/[0-9]{2}/[0-9]{4}"}


def _card(x: str, key: str) -> str:
    # the first six digits name the issuer and stay; the check digit is computed anew
    body = f"concat(substr(d, 1, 6), {feistel_digits('substr(d, 7, length(d) - 7)', key, f'concat({_sql('card')}, substr(d, 1, 6))')})"
    check = "concat(b, cast(pmod(10 - " + _luhn_sum("concat(b, '0')") + " % 10, 10) AS string))"
    return _let("d", _digits(x), f"CASE WHEN {_luhn_sum('d')} % 10 = 0 AND NOT d rlike '^0+$' THEN {_refill(x, _let('b', body, check))} ELSE {x} END")


def _ip(x: str, key: str) -> str:
    octets = f"transform(split({x}, '[.]'), o -> cast(o AS int))"
    number = f"aggregate({octets}, 0L, (t, o) -> t * 256 + o)"
    back = f"element_at(transform(array({feistel_below(number, 32, key, _sql('ip'))}), v -> concat_ws('.', cast(v DIV 16777216 AS string), cast((v DIV 65536) % 256 AS string), cast((v DIV 256) % 256 AS string), cast(v % 256 AS string))), 1)"
    return f"CASE WHEN forall({octets}, o -> o < 256) THEN {back} ELSE {x} END"


def _date(x: str, key: str) -> str:
    out = x
    for form, shape in reversed(DATE_FORMS.items()):
        moved = walk("n", 16, f"day(date_add({FIRST_DAY}, cast(t AS int))) > 12", key, _sql("month first")) if form == "MM/dd/yyyy" else feistel_below("n", 16, key, _sql("date"))
        back = f"if(n BETWEEN 0 AND 65535, date_format(date_add({FIRST_DAY}, cast({moved} AS int)), '{form}'), {x})"
        day = f"cast(try_to_timestamp({x}, '{form}') AS date)"
        out = f"CASE WHEN {x} rlike '^{shape}$' AND {day} IS NOT NULL THEN {_let('n', f'datediff({day}, {FIRST_DAY})', back)} ELSE {out} END"
    return out


def _iban(x: str, key: str) -> str:
    as_digits = lambda s: f"aggregate(split({s}, ''), '', (t, c) -> concat(t, if(c rlike '[A-Z]', cast(ascii(c) - 55 AS string), c)))"
    mod97 = lambda s: f"aggregate(split({as_digits(s)}, ''), 0, (t, c) -> if(c = '', t, (t * 10 + cast(c AS int)) % 97))"
    # the country and the letters stay, the digits are permuted, the check digits (02 to 98) computed anew
    kept = "concat(substr(p, 1, 2), regexp_replace(substr(p, 5), '[0-9]', '#'))"
    moved = f"concat(substr(p, 1, 2), '00', {_refill('substr(p, 5)', feistel_digits(_digits('substr(p, 5)'), key, f'concat({_sql('iban')}, {kept})'))})"
    checked = _let("m", moved, f"concat(substr(m, 1, 2), lpad(cast(98 - {mod97('concat(substr(m, 5), substr(m, 1, 4))')} AS string), 2, '0'), substr(m, 5))")
    spaced = f"aggregate(split({x}, ''), named_struct('k', 0, 'o', '', 'd', {checked}), (s, c) -> named_struct('k', s.k + if(c = ' ', 0, 1), 'o', concat(s.o, if(c = ' ', ' ', substr(s.d, s.k + 1, 1))), 'd', s.d), s -> s.o)"
    valid = f"{mod97('concat(substr(p, 5), substr(p, 1, 4))')} = 1 AND substr(p, 3, 2) BETWEEN '02' AND '98' AND length({_digits('substr(p, 5)')}) BETWEEN 2 AND 30"
    return _let("p", f"replace({x}, ' ', '')", f"CASE WHEN {valid} THEN {spaced} ELSE {x} END")


def _phone(x: str, key: str) -> str:
    """Numbers of +1 have an area of three digits, an exchange of three and a line of four; those of other countries
    keep their first two digits."""
    # neither area nor exchange is 000
    number = "((cast(substr(d, -10, 3) AS bigint) - 1) * 999 + cast(substr(d, -7, 3) AS bigint) - 1) * 10000 + cast(substr(d, -4) AS bigint)"
    back = "concat(substr(d, 1, length(d) - 10), lpad(cast(r DIV 9990000 + 1 AS string), 3, '0'), lpad(cast((r DIV 10000) % 999 + 1 AS string), 3, '0'), lpad(cast(r % 10000 AS string), 4, '0'))"
    national = _let("r", walk(number, 34, f"t < {999 * 999 * 10000}", key, _sql("phone")), back)
    abroad = f"concat(substr(d, 1, 2), {feistel_digits('substr(d, 3)', key, f'concat({_sql('phone')}, substr(d, 1, 2))')})"
    new = f"""CASE WHEN {x} rlike '^[+][2-9]' THEN if(length(d) BETWEEN 8 AND 15, {abroad}, d)
        WHEN substr(d, -10, 3) = '000' OR substr(d, -7, 3) = '000' THEN d ELSE {national} END"""
    return _let("d", _digits(x), _refill(x, new))


def _ssn(x: str, key: str) -> str:
    """Areas are 001 to 899 but 666, groups 01 to 99, serial numbers 0001 to 9999."""
    area = "cast(substr(d, 1, 3) AS bigint)"
    number = f"(({area} - if({area} < 666, 1, 2)) * 99 + cast(substr(d, 4, 2) AS bigint) - 1) * 9999 + cast(substr(d, 6) AS bigint) - 1"
    back = "concat(lpad(cast(r DIV 989901 + if(r DIV 989901 < 665, 1, 2) AS string), 3, '0'), lpad(cast((r DIV 9999) % 99 + 1 AS string), 2, '0'), lpad(cast(r % 9999 + 1 AS string), 4, '0'))"
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND substr(d, 4, 2) <> '00' AND substr(d, 6) <> '0000'"
    return _let("d", _digits(x), f"CASE WHEN {valid} THEN {_refill(x, _let('r', walk(number, 30, f't < {898 * 99 * 9999}', key, _sql('ssn')), back))} ELSE {x} END")


def _replacement(x: str, kind: str, key: str) -> str:
    digest = lambda what, n: f"substr(sha2(concat({_sql(key)}, '|{kind}|', {what}), 256), 1, {n})"
    if kind == "email":
        return f"concat('user-', {digest(f'lower({x})', 16)}, '@mail.invalid')"
    if kind == "secret":
        value = rf"regexp_extract({x}, '[A-Za-z0-9+/_.-]+$', 0)"
        return f"concat(substr({x}, 1, length({x}) - length({value})), rpad('', length({value}), sha2(concat({_sql(key)}, '|secret|', {value}), 256)))"
    return {"card": _card, "ip": _ip, "date": _date, "iban": _iban, "phone": _phone, "ssn": _ssn}[kind](x, key)


def pseudonym(x: str, key: str) -> str:
    """SQL of a struct (kind, out) for a string expression that matches one of PATTERNS."""
    kind, out = "CAST(NULL AS string)", x
    for name, pattern in reversed(PATTERNS.items()):
        is_it = f"{x} rlike {_sql('^(?:' + pattern + ')$')}"
        kind, out = f"CASE WHEN {is_it} THEN '{name}' ELSE {kind} END", f"CASE WHEN {is_it} THEN {_replacement(x, name, key)} ELSE {out} END"
    return f"named_struct('kind', {kind}, 'found', {x}, 'out', {out})"


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with PII in ``text`` replaced, and ``pii``: an array of (kind, out) of what was replaced.

    ``key`` is the secret of the permutations: who has it can undo them. Map-only: nothing is shuffled.
    """
    columns = [c for c in docs.columns if c != "pii"]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != text], F.lit(0).alias("_none")).alias("_row"), F.col(text).alias("_text"))
    # texts without a digit, an at sign or a secret's name are left out of the search
    df = df.withColumn("_found", F.when(F.col("_text").rlike(r"[0-9@]|(?i:token|secret|passw|key)"), F.expr(f"regexp_extract_all(_text, {_sql(ANY)}, 0)")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_new", F.expr(f"transform(_found, x -> {pseudonym('x', key)})"))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(F.col("_text"), ANY, -1)))
    # what stands between the matches alternates with what replaces them
    joined = F.expr("array_join(zip_with(_gaps, _new, (g, r) -> concat(g, coalesce(r.out, ''))), '')")
    values = {c: F.col(f"_row.`{c}`").alias(c) for c in columns if c != text} | {text: F.when(F.size("_found") > 0, joined).otherwise(F.col("_text")).alias(text)}
    replaced = F.expr("transform(filter(_new, r -> r.out <> r.found), r -> named_struct('kind', r.kind, 'out', r.out))")
    return df.select(*[values[c] for c in columns], replaced.alias("pii"))
