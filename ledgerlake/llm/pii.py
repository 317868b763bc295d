"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Candidates come from one pattern, each is validated (Luhn digit, modulo 97, octets, calendar), and
a valid one is replaced by the image of a keyed permutation of its format, so equal
values stay equal across documents, different ones stay different, and the result is
again valid. Invalid ones stay as they are: they are not what they resemble; but where a
card or account number took in what follows or precedes it, the text is cut there first
(see ``_valid_part``).

* Characters (addresses, phones, secrets, account numbers): a Feistel network over the
  letters and digits at even and odd places; each round adds to one side, in the range of
  each character's class, a keyed digest of the other side.
* Card numbers: the same over all digits but the last, which is the Luhn digit again.
* Internet addresses and dates: a Feistel network over two numbers whose ranges multiply
  to the size of the format (65,536 x 65,536; 17 x 4,297 days from 1900 to 2099).

All of it is built-in expressions inside one projection: no user function, no shuffle.
Texts without candidates skip everything but one search. Cards, accounts and phones are
permuted without their separators, so a number has one pseudonym however it is written.
The key is a parameter, by default the session's ``spark.ledgerlake.pii.key``; whoever
holds it can invert the permutations. Where none is set, as in tests, it is a public one.

Defined results: null stays null, empty stays empty; an empty table gives an empty
table; other columns are kept, and the working columns start with ``_p_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The public key of sessions that set none.
KEY = "ledgerlake"
KEY_SETTING = "spark.ledgerlake.pii.key"
ROUNDS = 8

#: Each kind with its pattern; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp)[-_][0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap search that every candidate passes.
HINT = r"[0-9@]|AKIA|(?:sk|pk|ghp)[-_]|[a-f]{32}|[A-F]{32}"
YEARS = 73049
LEFT, RIGHT = 17, 4297
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(digest: str) -> str:
    """A number below 2 ** 52 from a digest in hexadecimal."""
    return f"CAST(conv(substr({digest}, 1, 13), 16, 10) AS bigint)"


def _letters(value: str, kind: str, key: str, fixed: str = "0", hexadecimal: bool = False) -> str:
    """SQL: ``value`` with its letters and digits, from place ``fixed`` on, permuted within their classes.

    ``alphabet`` gives each character its class as a string and '' where it stays.
    """
    lower, upper = ("abcdef", "ABCDEF") if hexadecimal else (LOWER, UPPER)
    alphabet = f"CASE WHEN i < {fixed} THEN '' WHEN c RLIKE '[0-9]' THEN '{DIGITS}' WHEN c RLIKE '[a-z]' THEN '{lower}' WHEN c RLIKE '[A-Z]' THEN '{upper}' ELSE '' END"
    start = f"transform(split({value}, ''), (c, i) -> named_struct('a', {alphabet}, 'c', c))"
    start = f"transform({start}, x -> named_struct('a', x.a, 'c', x.c, 'v', if(x.a = '', -1, instr(x.a, x.c) - 1)))"
    # the digest of the other side and the length stands for a round's function
    other = f"sha2(concat_ws('|', {_sql(key)}, '{kind}', r, size(s), array_join(transform(s, (x, i) -> if(i % 2 = r % 2, if(x.v < 0, x.c, '*'), x.c)), ',')), 256)"
    added = f"pmod(x.v + {_number('sha2(concat(h, i), 256)')}, length(x.a))"
    step = f"transform(s, (x, i) -> if(i % 2 = r % 2 AND x.v >= 0, {_let('v', added, 'named_struct(' + chr(39) + 'a' + chr(39) + ', x.a, ' + chr(39) + 'c' + chr(39) + ', substr(x.a, CAST(v AS int) + 1, 1), ' + chr(39) + 'v' + chr(39) + ', CAST(v AS int))')}, x))"
    return f"array_join(transform(aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> {_let('h', other, step)}), x -> x.c), '')"


def _pair(x: str, y: str, a: int, b: int, kind: str, key: str) -> str:
    """SQL: (x, y) below (a, b), permuted, as a struct."""
    digest = lambda v: f"sha2(concat_ws('|', {_sql(key)}, '{kind}', r, {v}), 256)"
    left = f"named_struct('x', pmod(s.x + {_number(digest('s.y'))}, {a}L), 'y', s.y)"
    right = f"named_struct('x', s.x, 'y', pmod(s.y + {_number(digest('s.x'))}, {b}L))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('x', CAST({x} AS bigint), 'y', CAST({y} AS bigint)), (s, r) -> if(r % 2 = 0, {left}, {right}))"


def _luhn(digits: str, skip: int) -> str:
    """SQL: the Luhn sum of a digit string; ``skip`` is 0 with the check digit in place, 1 without it."""
    return f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> if((i + {skip}) % 2 = 1, CAST(d AS int) * 2 - if(CAST(d AS int) > 4, 9, 0), CAST(d AS int))), 0, (a, x) -> a + x)"


def _is_card(n: str) -> str:
    return f"({_luhn(n, 0)} % 10 = 0 AND NOT {n} RLIKE '^0+$')"


def _card(m: str, key: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    body = _letters("substr(n, 1, length(n) - 1)", "card", key)
    whole = _let("b", body, f"concat(b, pmod(10 - {_luhn('b', 1)} % 10, 10))")
    return _let("n", digits, f"if({_is_card('n')}, {_let('w', whole, _laid(m, '[0-9]'))}, {m})")


def _laid(m: str, kind: str) -> str:
    """SQL: the characters of ``w`` in the places of those of a kind in ``m``, among its separators."""
    return f"aggregate(split({m}, ''), named_struct('o', '', 'k', 0), (s, c) -> if(c RLIKE '{kind}', named_struct('o', concat(s.o, substr(w, s.k + 1, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _rest(v: str) -> str:
    return f"aggregate(split({v}, ''), 0, (a, c) -> if(c RLIKE '[0-9]', (a * 10 + CAST(c AS int)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _is_iban(m: str) -> str:
    tight = f"replace({m}, ' ', '')"
    return f"({_rest(f'concat(substr({tight}, 5), substr({tight}, 1, 4))')} = 1)"


def _valid_part(m: str) -> str:
    """SQL: the part of an invalid card or account number that is valid, null where there is none.

    The longest part from its start to a group's end counts, else one group: a card
    number or a secret in capitals.
    """
    is_kind = lambda kind: f"{m} RLIKE {_sql('^(?:' + PATTERNS[kind] + ')$')}"
    starts = lambda least: f"transform(filter(sequence(length({m}) - 1, least(length({m}) - 1, {least}), -1), k -> substr({m}, k + 1, 1) IN (' ', '-')), k -> substr({m}, 1, k))"
    digits = "regexp_replace(x, '[^0-9]', '')"
    card = f"filter(concat({starts(13)}, split({m}, '[ -]')), x -> {_let('n', digits, 'length(n) BETWEEN 13 AND 19 AND ' + _is_card('n'))})"
    iban = f"concat(filter({starts(15)}, x -> length(replace(x, ' ', '')) >= 15 AND {_is_iban('x')}), filter(split({m}, ' '), x -> x RLIKE '^[0-9A-F]{{32}}$'))"
    card_first = f"CASE WHEN {_is_card(f'regexp_replace({m}, {_sql("[^0-9]")}, {_sql("")})')} THEN NULL ELSE get({card}, 0) END"
    return f"CASE WHEN {is_kind('secret')} THEN NULL WHEN {is_kind('iban')} THEN CASE WHEN {_is_iban(m)} THEN NULL ELSE get({iban}, 0) END WHEN {is_kind('phone')} OR {is_kind('ssn')} THEN NULL WHEN {is_kind('card')} THEN {card_first} END"


def _iban(m: str, key: str) -> str:
    """Country, two check digits (modulo 97), account; blanks stay in place."""
    check = f"lpad(98 - {_rest('concat(b, substr(' + m + ', 1, 2), ' + _sql('00') + ')')}, 2, '0')"
    moved = _let("b", f"substr({_letters('t', 'iban', key, '4')}, 5)", f"concat(substr({m}, 1, 2), {check}, b)")
    return f"if({_is_iban(m)}, {_let('t', f'replace({m}, {_sql(chr(32))}, {_sql(chr(0)[:0])})', _let('w', moved, _laid(m, '[0-9A-Z]')))}, {m})"


def _phone(m: str, key: str) -> str:
    """All digits but the first of an international number; separators stay in place."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return _let("n", digits, _let("w", _letters("n", "phone", key, f"if(startswith({m}, '+'), 1, 0)"), _laid(m, "[0-9]")))


def _ip(m: str, key: str) -> str:
    octet = lambda k: f"CAST(split({m}, '[.]')[{k}] AS int)"
    valid = " AND ".join(f"{octet(k)} <= 255" for k in range(4))
    image = _pair(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", 65536, 65536, "ip", key)
    return f"if({valid}, {_let('p', image, 'concat_ws(' + chr(39) + '.' + chr(39) + ', p.x div 256, p.x % 256, p.y div 256, p.y % 256)')}, {m})"


def _date(m: str, key: str) -> str:
    """Year-month-day, day-month-year and, where only that is a date, month-day-year."""
    first = "DATE'1900-01-01'"
    forms = (
        ("'^[0-9]{4}-'", f"try_to_date({m}, 'yyyy-MM-dd')", lambda d: f"date_format({d}, 'yyyy-MM-dd')", "ymd"),
        ("'.'", f"try_to_date(translate({m}, '.', '/'), 'dd/MM/yyyy')", lambda d: f"date_format({d}, concat('dd', substr({m}, 3, 1), 'MM', substr({m}, 6, 1), 'yyyy'))", "dmy"),
        ("'.'", f"try_to_date(translate({m}, '.', '/'), 'MM/dd/yyyy')", lambda d: f"date_format({d}, concat('MM', substr({m}, 3, 1), 'dd', substr({m}, 6, 1), 'yyyy'))", "mdy"),
    )
    out = m
    for test, parse, render, _ in reversed(forms):
        days = f"datediff({parse}, {first})"
        image = _pair(f"{days} div {RIGHT}", f"{days} % {RIGHT}", LEFT, RIGHT, "date", key)
        moved = _let("p", image, render(f"date_add({first}, CAST(p.x * {RIGHT} + p.y AS int))"))
        out = f"CASE WHEN {m} RLIKE {test} AND {days} BETWEEN 0 AND {YEARS - 1} THEN {moved} ELSE {out} END"
    return out


def _pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of one candidate, by its kind."""
    whole = lambda kind: f"{m} RLIKE {_sql('^(?:' + PATTERNS[kind] + ')$')}"
    local = f"concat({_letters(f'split({m}, {_sql("@")})[0]', 'email', key)}, '@', substring_index({m}, '@', -1))"
    # capitals in hexadecimal may look like an account number
    images = {
        "secret": _letters(m, "secret", key, "0", hexadecimal=True),
        "email": local,
        "iban": _iban(m, key),
        "ip": _ip(m, key),
        "date": _date(m, key),
        "phone": _phone(m, key),
        "ssn": _letters(m, "ssn", key),
        "card": _card(m, key),
    }
    # letters outside a to f, and of both cases, only occur in the secrets with a prefix
    images["secret"] = f"if({m} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$', {images['secret']}, {_letters(m, 'secret', key, 'if(' + m + ' RLIKE ' + _sql('^AKIA') + ', 4, 3)')})"
    cases = " ".join(f"WHEN {whole(kind)} THEN {image}" for kind, image in images.items())
    return f"CASE {cases} ELSE {m} END"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with the pseudonymised text in place of the text."""
    return _worked(docs, text, session_key(docs.sparkSession) if key is None else key).withColumn(text, F.col("_p_text")).drop("_p_found", "_p_between", "_p_made", "_p_text")


def _worked(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = f"`{text}`"
    none = "CAST(array() AS array<string>)"
    found = lambda x: f"regexp_extract_all({x}, {_sql(ANY)}, 0)"
    between = lambda x: f"split({x}, {_sql(ANY)}, -1)"
    step = docs.withColumn("_p_found", F.expr(f"CASE WHEN {t} RLIKE '{HINT}' THEN {found(t)} ELSE {none} END"))
    step = step.withColumn("_p_between", F.expr(f"CASE WHEN size(_p_found) > 0 THEN {between(t)} ELSE {none} END"))
    # before and after the valid part of an invalid candidate the text is cut, and the pieces are searched again
    step = step.withColumn("_p_parts", F.expr(f"transform(_p_found, m -> {_valid_part('m')})"))
    before = "concat(s.last, _p_between[i], substr(_p_found[i], 1, instr(_p_found[i], _p_parts[i]) - 1))"
    done = f"concat(s.done, if(instr(_p_found[i], _p_parts[i]) = 1, array(concat({before}, _p_parts[i])), array({before}, _p_parts[i])))"
    after = "substr(_p_found[i], instr(_p_found[i], _p_parts[i]) + length(_p_parts[i]))"
    cut = f"if(_p_parts[i] IS NULL, named_struct('done', s.done, 'last', concat(s.last, _p_between[i], _p_found[i])), named_struct('done', {done}, 'last', {after}))"
    pieces = f"aggregate(sequence(0, size(_p_found) - 1), named_struct('done', {none}, 'last', ''), (s, i) -> {cut}, s -> concat(s.done, array(concat(s.last, _p_between[size(_p_found)]))))"
    step = step.withColumn("_p_pieces", F.expr(f"CASE WHEN exists(_p_parts, x -> x IS NOT NULL) THEN {pieces} ELSE {none} END"))
    step = step.withColumn("_p_found", F.expr(f"CASE WHEN size(_p_pieces) > 0 THEN flatten(transform(_p_pieces, (x, i) -> if(i = 0, {found('x')}, concat(array(''), {found('x')})))) ELSE _p_found END"))
    step = step.withColumn("_p_between", F.expr(f"CASE WHEN size(_p_pieces) > 0 THEN flatten(transform(_p_pieces, x -> {between('x')})) ELSE _p_between END"))
    step = step.drop("_p_parts", "_p_pieces")
    step = step.withColumn("_p_made", F.expr(f"CASE WHEN size(_p_found) > 0 THEN transform(_p_found, m -> {_pseudonym('m', key)}) ELSE {none} END"))
    joined = "array_join(transform(_p_between, (b, i) -> if(i < size(_p_made), concat(b, _p_made[i]), b)), '')"
    return step.withColumn("_p_text", F.expr(f"CASE WHEN size(_p_found) > 0 THEN {joined} ELSE {t} END"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, and n_replaced of every document."""
    found = _worked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", session_key(spark))
    replaced = F.expr("CAST(size(filter(_p_made, (m, i) -> m <> _p_found[i])) AS bigint)")
    return found.select("doc_id", F.col("_p_text").alias("text"), replaced.alias("n_replaced"))
