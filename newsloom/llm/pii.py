"""PII: format-preserving Feistel pseudonyms, in DataFrame and SQL functions only.

Numbers that pass their format's check (card numbers by Luhn, phone numbers by their grouping, IPv4 addresses by their
octets, social security numbers by their ranges) and dates that exist are replaced by a keyed permutation of the
format's own values, so that a pseudonym is valid again, equal values get equal pseudonyms in every document, and no
two valid values of one format share one.  Left alone: numbers of other countries, IPv6, octets
with leading zeros, and what has no check to pass.  Account numbers (IBAN, by their check digits) keep their country.  Mail addresses (their local part) and credentials are permuted letter by letter within their
alphabets in the same way.

A numeric format is a pair of integers (a in [0, M), b in [0, N)).  Each round adds a keyed hash of one half to the
other, modulo its size: a <- a + H(b) mod M, then b <- b + H(a) mod N.  That is a permutation of the pairs for any M
and N, with nothing to store and nothing to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of each half, and the key of tests and examples; production passes its own secret as a column.
ROUNDS, DEFAULT_KEY = 6, "newsloom"

# The formats' patterns.  Java syntax; each alternative is one kind.
MAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]*[\p{L}0-9]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
CARD = r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\d-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}|\d{2}\.\d{2}\.(?:19|20)\d{2})(?![\w/-]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_-]{8,}"
PATTERN = "|".join((MAIL, ACCESS_KEY, SECRET, IBAN, PHONE, SSN, DATE, IP, CARD))
#: Every match has one of these, so texts without any are passed over cheaply.
HINT = r"@|\d[ .-]?\d|AKIA|ASIA|(?i:password|passwd|pwd|token|secret|key)"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, kind: str, round_: str, half: str) -> str:
    """60 bits of a keyed digest as a BIGINT."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', cast({round_} AS string), {half}), 256), 1, 15), 16, 10) AS bigint)"


def feistel(key: str, kind: str, a: str, b: str, m: int, n: int, use: str) -> str:
    """SQL: the permuted pair of (a mod m, b mod n) as p.a and p.b inside the expression ``use``."""
    first = f"pmod(s.a + {_hash(key, kind, 'r', 'cast(s.b AS string)')}, {m}L)"
    step = f"transform(array(named_struct('a', {first}, 'b', s.b)), s -> named_struct('a', s.a, 'b', pmod(s.b + {_hash(key, kind, '-r', 'cast(s.a AS string)')}, {n}L)))[0]"
    pair = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} AS bigint), 'b', cast({b} AS bigint)), (s, r) -> {step})"
    return f"transform(array({pair}), p -> {use})[0]"


def permute_letters(key: str, kind: str, x: str, small: str = "26") -> str:
    """SQL: a string with each letter and digit moved within its own alphabet (``small``: of the small letters).

    The string's halves take turns: each character of one half is shifted by a keyed hash of the other half (its digest,
    taken once) and its place, which keeps length, case, digits and all other characters.
    """
    def shifted(half: str, other: str, round_: str) -> str:
        amount = _hash(key, kind, round_, "concat(d, ':', cast(i AS string))")
        alphabet = lambda low, size: f"chr(cast({low} + pmod(ascii(c) - {low} + {amount}, {size}) AS int))"
        char = f"CASE WHEN c BETWEEN '0' AND '9' THEN {alphabet(48, 10)} WHEN c BETWEEN 'a' AND 'z' THEN {alphabet(97, small)} WHEN c BETWEEN 'A' AND 'Z' THEN {alphabet(65, 26)} ELSE c END"
        return f"transform(array(sha2(h.{other}, 256)), d -> array_join(transform(filter(split(h.{half}, ''), c -> c <> ''), (c, i) -> {char}), ''))[0]"

    left = f"named_struct('l', {shifted('l', 'r', 'k')}, 'r', h.r)"
    both = f"transform(array({left}), h -> named_struct('l', h.l, 'r', {shifted('r', 'l', '-k')}))[0]"
    start = f"named_struct('l', left({x}, cast(length({x}) / 2 AS int)), 'r', substr({x}, cast(length({x}) / 2 AS int) + 1))"
    return f"transform(array(aggregate(sequence(1, {ROUNDS}), {start}, (h, k) -> {both})), h -> concat(h.l, h.r))[0]"


def _refill(x: str, digits: str) -> str:
    """SQL: the characters of x with its digits replaced, in order, by those of ``digits``."""
    return f"array_join(transform(filter(split({x}, ''), c -> c <> ''), (c, i) -> CASE WHEN c BETWEEN '0' AND '9' THEN substr({digits}, length(regexp_replace(substr({x}, 1, i + 1), '[^0-9]', '')), 1) ELSE c END), '')"


def _luhn_sum(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum of a digit string; counted from its end, places of the parity ``doubled`` count twice."""
    value = "cast(substr(t.d, length(t.d) - i, 1) AS int)"
    return f"transform(array(named_struct('d', {digits})), t -> aggregate(transform(sequence(0, length(t.d) - 1), i -> CASE WHEN i % 2 = {doubled} THEN 2 * {value} - 9 * cast({value} > 4 AS int) ELSE {value} END), 0, (s, v) -> s + v))[0]"


def _card(key: str, x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '')"
    # the first digit (the network) stays, the check digit follows, and the digits between are permuted as two halves
    def of(size: int) -> str:
        inner = size - 2
        low, high = inner // 2, inner - inner // 2
        pair = f"concat(substr({d}, 1, 1), lpad(cast(p.a AS string), {low}, '0'), lpad(cast(p.b AS string), {high}, '0'))"
        body = feistel(key, f"card{size}", f"substr({d}, 2, {low})", f"substr({d}, {2 + low}, {high})", 10**low, 10**high, pair)
        return f"transform(array({body}), u -> concat(u, cast(pmod(10 - pmod({_luhn_sum('u', 0)}, 10), 10) AS string)))[0]"

    sized = "CASE length(" + d + ") " + " ".join(f"WHEN {s} THEN {of(s)}" for s in range(13, 20)) + " END"
    return f"CASE WHEN pmod({_luhn_sum(d, 1)}, 10) = 0 THEN transform(array({sized}), v -> {_refill(x, 'v')})[0] ELSE {x} END"


def _mod97(x: str) -> str:
    """SQL: letters and digits as one number (A is 10), modulo 97."""
    return f"aggregate(filter(split({x}, ''), c -> c <> ''), 0, (m, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN pmod(m * 10 + ascii(c) - 48, 97) ELSE pmod(m * 100 + ascii(c) - 55, 97) END)"


def _iban(key: str, x: str) -> str:
    # the country stays, the account moves within its letters and digits, and the check digits follow
    flat, account = f"replace({x}, ' ', '')", f"substr(replace({x}, ' ', ''), 5)"
    checked = f"{_mod97(f'concat({account}, left({flat}, 4))')} = 1"
    moved = permute_letters(key, "iban", account)
    made = f"transform(array({moved}), a -> concat(left({flat}, 2), lpad(cast(98 - {_mod97(f"concat(a, left({flat}, 2), '00')")} AS string), 2, '0'), a))[0]"
    spaced = f"array_join(transform(filter(split({x}, ''), c -> c <> ''), (c, i) -> CASE WHEN c = ' ' THEN c ELSE substr(v, length(replace(substr({x}, 1, i + 1), ' ', '')), 1) END), '')"
    return f"CASE WHEN {checked} THEN transform(array({made}), v -> {spaced})[0] ELSE {x} END"


def _phone(key: str, x: str) -> str:
    # the last ten digits; area codes and exchanges that begin with 2 to 9 (the numbering plan) stay so, and the numbers
    # outside the plan, by area code or by exchange alone, are permuted among themselves
    d = f"right(regexp_replace({x}, '[^0-9]', ''), 10)"
    lead = f"left(regexp_replace({x}, '[^0-9]', ''), length(regexp_replace({x}, '[^0-9]', '')) - 10)"

    def of(kind: str, area: int, areas: int, exchange: int, exchanges: int) -> str:
        a, b = f"(substr({d}, 1, 3) - {area})", f"((substr({d}, 4, 3) - {exchange}) * 10000 + substr({d}, 7, 4))"
        out = f"concat({lead}, lpad(cast({area} + p.a AS string), 3, '0'), lpad(cast({exchange} + p.b DIV 10000 AS string), 3, '0'), lpad(cast(p.b % 10000 AS string), 4, '0'))"
        return f"transform(array({feistel(key, kind, a, b, areas, exchanges * 10_000, out)}), v -> {_refill(x, 'v')})[0]"

    return f"CASE WHEN substr({d}, 1, 1) < '2' THEN {of('phone-area', 0, 200, 0, 1000)} WHEN substr({d}, 4, 1) < '2' THEN {of('phone-exchange', 200, 800, 0, 200)} ELSE {of('phone', 200, 800, 200, 800)} END"


def _ssn(key: str, x: str) -> str:
    area, group, serial = f"int(substr({x}, 1, 3))", f"int(substr({x}, 5, 2))", f"int(substr({x}, 8, 4))"
    # areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999
    a, b = f"({area} - 1 - cast({area} > 666 AS int))", f"(({group} - 1) * 9999 + {serial} - 1)"
    out = "concat_ws('-', lpad(cast(p.a + 1 + cast(p.a >= 665 AS int) AS string), 3, '0'), lpad(cast(p.b DIV 9999 + 1 AS string), 2, '0'), lpad(cast(p.b % 9999 + 1 AS string), 4, '0'))"
    return f"CASE WHEN {area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0 THEN {feistel(key, 'ssn', a, b, 898, 99 * 9999, out)} ELSE {x} END"


def _ip(key: str, x: str) -> str:
    o = lambda k: f"int(split({x}, '[.]')[{k}])"
    out = "concat_ws('.', cast(p.a DIV 256 AS string), cast(p.a % 256 AS string), cast(p.b DIV 256 AS string), cast(p.b % 256 AS string))"
    return f"CASE WHEN forall(split({x}, '[.]'), o -> int(o) <= 255 AND (o = '0' OR left(o, 1) <> '0')) THEN {feistel(key, 'ip', f'({o(0)} * 256 + {o(1)})', f'({o(2)} * 256 + {o(3)})', 65536, 65536, out)} ELSE {x} END"


def _date(key: str, x: str) -> str:
    dotted = f"substr({x}, 3, 1) = '.'"
    iso = f"CASE WHEN {dotted} THEN concat_ws('-', substr({x}, 7, 4), substr({x}, 4, 2), substr({x}, 1, 2)) ELSE replace({x}, '/', '-') END"
    # the days of a century: 36524 = 92 * 397 from 1900, 36525 = 75 * 487 from 2000
    def century(start: str, m: int, n: int) -> str:
        day = f"datediff(t.day, DATE'{start}')"
        shown = f"date_add(DATE'{start}', cast(p.a * {n} + p.b AS int))"
        out = f"CASE WHEN {dotted} THEN date_format({shown}, 'dd.MM.yyyy') ELSE date_format({shown}, CASE WHEN {x} LIKE '%/%' THEN 'yyyy/MM/dd' ELSE 'yyyy-MM-dd' END) END"
        return feistel(key, f"date{start}", f"({day} DIV {n})", f"({day} % {n})", m, n, out)

    return f"transform(array(named_struct('day', try_to_date({iso}, 'yyyy-MM-dd'))), t -> CASE WHEN t.day IS NULL THEN {x} WHEN t.day < DATE'2000-01-01' THEN {century('1900-01-01', 92, 397)} ELSE {century('2000-01-01', 75, 487)} END)[0]"


def _after(x: str, kind: str, pattern: str, key: str) -> str:
    """SQL: what follows the match of ``pattern`` at the start of x permuted, the match itself kept."""
    head = f"regexp_extract({x}, {_quote(pattern)}, 0)"
    rest = f"substr({x}, length({head}) + 1)"
    small = f"CASE WHEN {rest} RLIKE '^[0-9a-f]+$' THEN 6 ELSE 26 END"  # hexadecimal stays hexadecimal
    return f"concat({head}, {permute_letters(key, kind, rest, small)})"


def pseudonym(x: str, key: str) -> str:
    """SQL: the pseudonym of one match x of PATTERN; a match that fails its format's check stays as it is."""
    whole = lambda p: f"{x} RLIKE {_quote('^(?:' + p + ')$')}"
    mail = f"concat({permute_letters(key, 'mail', f"substring_index({x}, '@', 1)")}, '@', substring_index({x}, '@', -1))"
    return f"""CASE WHEN {x} LIKE '%@%' THEN {mail}
        WHEN {whole(ACCESS_KEY)} THEN {_after(x, 'access', '^....', key)}
        WHEN {whole(SECRET)} THEN {_after(x, 'secret', "^(?s).*?[:=][ \\t\\r\\n]*[\\x22']?", key)}
        WHEN {whole(IBAN)} THEN {_iban(key, x)}
        WHEN {whole(PHONE)} THEN {_phone(key, x)}
        WHEN {whole(SSN)} THEN {_ssn(key, x)}
        WHEN {whole(DATE)} THEN {_date(key, x)}
        WHEN {whole(IP)} THEN {_ip(key, x)}
        ELSE {_card(key, x)} END"""


def pseudonymise(docs: DataFrame, key: str | Column = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, text with pseudonyms, n_replaced (values that changed).

    A narrow stage inside the JVM: no shuffle, no Python, one pass over each whole text.  The same key gives the same
    pseudonyms in every run; without the key they cannot be led back.  A key that is a string shows in query plans and
    event logs; production passes a column, such as ``secrets.select("key").scalar()``, which only shows where it is read.

    Null text stays null with 0 replaced; empty text and text without personal data stay as they are; null and repeated
    ids are kept row for row; other columns are not read; an empty table gives no rows.
    """
    secret = "_secret"
    text, pattern = f"`{text_col}`", _quote(PATTERN)
    rows = docs.select(F.col(id_col), F.expr(text).alias("_text"), (key if isinstance(key, Column) else F.lit(key)).alias("_secret"), F.expr(f"CASE WHEN {text} RLIKE {_quote(HINT)} THEN regexp_extract_all({text}, {pattern}, 0) ELSE array() END").alias("_found"))
    rows = rows.withColumn("_new", F.expr(f"CASE WHEN size(_found) > 0 THEN transform(_found, x -> {pseudonym('x', secret)}) ELSE _found END"))
    # the pieces between the matches, from the same pattern; one more than there are matches
    joined = f"CASE WHEN size(_found) > 0 THEN array_join(flatten(zip_with(split(_text, {pattern}), _new, (gap, new) -> array(gap, coalesce(new, '')))), '') ELSE _text END"
    changed = "coalesce(size(filter(zip_with(_found, _new, (a, b) -> a <> b), d -> d)), 0)"
    return rows.select(id_col, F.expr(joined).alias("text"), F.expr(f"cast({changed} AS bigint)").alias("n_replaced"))
