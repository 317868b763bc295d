"""Names, symbols, assets, times and text tests as built-in column expressions.

Nothing here is a user function: every expression stays in the JVM and in the reach of
the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codec.scalars import NAME_CHARS, SLOT_EPOCH_MS, SLOT_MS

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
LONGEST_PRECISION = 18


def name_text(value: Column) -> Column:
    """The name that a 64-bit number (as a signed bigint) stands for."""
    place = lambda shift, mask: F.substring(F.lit(NAME_CHARS), (F.shiftrightunsigned(value, shift).bitwiseAND(mask) + 1).cast("int"), 1)
    chars = [place(shift, 31) for shift in range(59, 3, -5)] + [place(0, 15)]
    return F.regexp_replace(F.concat(*chars), "[.]+$", "")


def name_value(text: Column) -> Column:
    """The number of a name; null if it isn't one."""
    valid = text.rlike("^[.1-5a-z]{0,12}$|^[.1-5a-z]{12}[.1-5a-j]$")
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(F.instr(F.lit(NAME_CHARS), c).alias("p"), i.alias("i")))
    placed = lambda x: F.when(x["i"] == 12, (x["p"] - 1).cast("long")).otherwise(F.call_function("shiftleft", (x["p"] - 1).cast("long"), (59 - 5 * x["i"]).cast("int")))
    return F.when(valid, F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(placed(x))))


def symbol_code_text(value: Column) -> Column:
    """Letters from the low byte on, up to the first zero byte; null if one is not ASCII."""
    raw = F.reverse(F.lpad(F.hex(value), 16, "0"))
    letters = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftrightunsigned", value, (8 * i).cast("int")).bitwiseAND(255))
    used = F.slice(letters, F.lit(1), F.when(F.array_position(letters, F.lit(0).cast("long")) > 0, F.array_position(letters, F.lit(0).cast("long")) - 1).otherwise(8).cast("int"))
    ascii_only = F.forall(used, lambda b: b < 128)
    return F.when(raw.isNotNull() & ascii_only, F.array_join(F.transform(used, lambda b: F.char(b)), ""))


def symbol_code_value(text: Column) -> Column:
    chars = F.split(text, "")
    summed = F.aggregate(F.transform(chars, lambda c, i: F.call_function("shiftleft", F.ascii(c).cast("long"), (8 * i).cast("int"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(text.rlike("^[A-Z]{1,7}$"), summed)


def asset_text(amount: Column, precision: Column, code: Column) -> Column:
    """Units with the point set by the precision; units alone where that is 0 or beyond 18."""
    digits = F.abs(amount.cast("decimal(20,0)")).cast("string")
    padded = F.when(F.length(digits) > precision, digits).otherwise(F.lpad(digits, precision + 1, F.lit("0")))
    whole = F.substring(padded, F.lit(1), F.length(padded) - precision)
    part = F.substring(padded, F.length(padded) - precision + 1, precision)
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    pointed = F.concat(sign, whole, F.lit("."), part)
    return F.concat(F.when((precision > 0) & (precision <= LONGEST_PRECISION), pointed).otherwise(amount.cast("string")), F.lit(" "), code)


def parse_asset(text: Column) -> Column:
    """Struct of amount (bigint units), precision and code; null if the text is no asset."""
    number, code = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
    point = F.instr(number, ".")
    precision = F.when(point > 0, F.length(number) - point).otherwise(0)
    units = F.replace(number, F.lit("."), F.lit("")).try_cast("long")
    fits = text.rlike("^[+-]?[0-9]{1,19}([.][0-9]{0,18})? [A-Z]{1,7}$") & (units > F.lit(-(1 << 63)))
    bounded = F.when(fits, units)
    return F.when(bounded.isNotNull(), F.struct(bounded.alias("amount"), precision.alias("precision"), code.alias("code")))


def asset_number(amount: Column, precision: Column) -> Column:
    return amount / F.pow(F.lit(10.0), precision)


def micros(moment: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    c = moment if isinstance(moment, Column) else F.col(moment)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)


def slot_of(moment: Column | str) -> Column:
    """The half-second slot of a timestamp without zone."""
    return F.floor((micros(moment) / 1000 - SLOT_EPOCH_MS) / SLOT_MS).cast("long")


def millis_text(ms: Column) -> Column:
    """Milliseconds since 1970 in the canonical form, without zone."""
    return F.date_format(F.timestamp_add("MILLISECOND", ms, F.expr(EPOCH)), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def slot_text(slot: Column) -> Column:
    return millis_text(slot * SLOT_MS + SLOT_EPOCH_MS)


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def status_text(status: Column) -> Column:
    from ..codec.wire import STATUS_NAMES

    names = F.array(*[F.lit(n) for n in STATUS_NAMES])
    return F.coalesce(F.get(names, status.cast("int")), F.lit("unknown"))
