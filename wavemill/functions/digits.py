"""Numbers as digits and back (survey F32, F33, Q20), on Arrow arrays: all numbers of a batch at once, never row by row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are written at once: their bytes stay within a few MB, however long a series is.
AT_ONCE = 1 << 15


@dataclass(frozen=True)
class DigitFormat:
    """How numbers are written as digits. Positions before and after the point, and the signs of both formats."""

    separator: str = " ,"
    minus: str = " -"
    missing: str = " Nan"
    digit_separator: str = " "
    whole: int = 7
    decimals: int = 3
    largest: float = 1e7


SPACED = DigitFormat()
COMPACT = DigitFormat(separator=", ", minus="-")


def _written(x: np.ndarray, form: DigitFormat) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers, one after the other, and how many each has. NaN is missing.

    A number is a row of a table with a column for each byte that one can have. Which ones it has follows from its
    kind, that is from how many digits it shows and whether it has a sign or is missing: `kinds` says so for a column."""
    missing, minus = np.isnan(x), x < 0
    rest = np.where(missing, 0.0, np.abs(x))
    if (rest > form.largest).any():
        raise ValueError(f"{x[rest > form.largest][0]} is beyond {form.largest:g}")
    places = form.whole + form.decimals
    shows, signed = np.append(np.tile(np.arange(places + 1), 2), -1), np.arange(2 * places + 3) > places
    table, kinds, tens = [], [], {}

    def put(text: str, has: np.ndarray) -> None:
        table.extend(text.encode())
        kinds.extend([has] * (len(table) - len(kinds)))

    put(form.missing, shows < 0)
    put(form.minus, signed & (shows >= 0))
    shown, begun, cut, less = np.zeros(len(x), dtype=np.int16), np.zeros(len(x), dtype=bool), np.empty_like(rest), np.empty_like(rest)
    for k in range(places, 0, -1):
        power = 10.0 ** (k - 1 - form.decimals)
        np.trunc(np.divide(rest, power, out=cut), out=cut)
        np.subtract(rest, np.multiply(cut, power, out=less), out=rest)
        top = cut.max()
        digit = cut.astype(np.int32) if top < 2**31 else cut.copy()
        begun |= digit != 0
        shown += begun
        put(form.digit_separator, shows > k)
        parts = [10**i for i in reversed(range(len(f"{top:.0f}")))]  # what is cut off may reach ten
        for part in parts:
            table.append((digit if len(parts) == 1 else digit // part % 10).astype(np.uint8) + 48)
            kinds.append(shows >= k if part == 1 else shows > places)
            if part > 1:
                tens[len(table) - 1] = digit >= part
    put(form.separator, np.ones_like(signed))
    kind = np.where(missing, np.int16(len(shows) - 1), np.maximum(shown, 1) + minus * np.int16(places + 1))  # 0 has one digit
    has = np.stack(kinds, axis=1)
    rows, on, count = np.empty((len(x), len(table)), dtype=np.uint8), has.take(kind, axis=0), np.count_nonzero(has, axis=1).take(kind)
    for k, byte in enumerate(table):
        rows[:, k] = byte
    for k, more in tens.items():
        on[:, k] = more
        count += more
    return rows[on], count


def _numbers(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends, and the values of all; null is NaN."""
    offsets = np.asarray(lists.offsets)
    return offsets - offsets[0], lists.values[offsets[0] : offsets[-1]].to_numpy(zero_copy_only=False)


def write_digits(lists: pa.ListArray, form: DigitFormat) -> pa.StringArray:
    if not len(lists):
        return pa.array([], pa.string())
    offsets, x = _numbers(lists)
    parts = [_written(x[k : k + AT_ONCE], form) for k in range(0, len(x), AT_ONCE)] or [(np.empty(0, np.uint8), np.empty(0, np.int64))]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])[offsets]
    data = pa.py_buffer(np.concatenate([b for b, _ in parts]))
    texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), data).cast(pa.string())
    return pc.if_else(lists.is_valid(), texts, None)


def read_digits(texts: pa.StringArray, form: DigitFormat, half: float) -> pa.ListArray:
    if not len(texts):
        return pa.array([], pa.list_(pa.float64()))
    lists = pc.split_pattern(texts, form.separator)
    tokens, offsets = lists.values, np.asarray(lists.offsets)
    full = pc.greater(pc.binary_length(tokens), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
    tokens = tokens.filter(full)
    minus = pc.starts_with(tokens, form.minus)
    digits = pc.split_pattern(pc.if_else(minus, pc.utf8_slice_codeunits(tokens, len(form.minus)), tokens), form.digit_separator)
    listed = pc.ascii_is_decimal(digits.values)
    token = pc.list_parent_indices(digits).filter(listed).to_numpy()[::-1]  # from the last digit on
    digit = digits.values.filter(listed).cast(pa.float64()).to_numpy()[::-1]
    count = np.bincount(token, minlength=len(tokens))
    place = np.arange(len(token)) - (len(token) - np.cumsum(count))[token]  # 0 for a token's last digit
    powers = np.array([10.0 ** (form.decimals - k) for k in range(count.max(initial=0))])
    size = np.bincount(token, digit / powers[place] if len(token) else None, minlength=len(tokens)) + half  # added up in this order
    signed = np.where(minus.to_numpy(zero_copy_only=False), -size, size)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed, pa.float64()), mask=texts.is_null() if texts.null_count else None)


def write_decimals(lists: pa.ListArray, places: int) -> pa.StringArray:
    """Numbers below 1e14 with so many decimals, between brackets."""
    texts = lists.values.cast(pa.decimal128(15 + places, places)).cast(pa.string())
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, texts), ", ")
    return pc.if_else(lists.is_valid(), pc.binary_join_element_wise("[", joined, "]", ""), None)


def digits(v: Column, form: DigitFormat = SPACED) -> Column:
    """F32: each number as its sign and spaced digits, without a point or leading zeros, and a separator after each.

    Digits are cut off one by one, from the largest power of ten on; what is left goes to the next power, so
    rounding errors are those of this order (0.29 is 2 8 9). Null and NaN are missing; a larger number than
    the format allows is an error."""

    @F.arrow_udf("string")
    def written(lists: pa.Array) -> pa.Array:
        return write_digits(lists, form)

    return written(v.cast("array<double>"))


def undigits(c: Column, form: DigitFormat = SPACED, half_step: bool = True) -> Column:
    """Back to numbers, half a step further from zero; what was missing has no digits and so is half a step.

    Digits are added up from the last one on, each over its power of ten."""
    half = 0.5 / 10**form.decimals if half_step else 0.0

    @F.arrow_udf("array<double>")
    def read(texts: pa.Array) -> pa.Array:
        return read_digits(texts, form, half)

    return read(c)


def decimals(v: Column, places: int) -> Column:
    """A list of numbers as text, each with so many decimals: [1.50, -0.25]."""

    @F.arrow_udf("string")
    def shown(lists: pa.Array) -> pa.Array:
        return write_decimals(lists, places)

    return shown(v)
