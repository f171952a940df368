"""Scalar functions as column expressions."""

from __future__ import annotations

import math
import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.schemas import MODES

# Result codes of number parsing, and their messages.
PARSE_CODES = {0: "ok", 1: "empty", 2: "bad character", 3: "too low", 4: "too high", 5: "unexpected end", 6: "too close to zero", 7: "extra characters", 8: "expected an integer"}
INT_RANGES = {f"{s}{b}": (0 if s == "u" else -(1 << b - 1), (1 << (b if s == "u" else b - 1)) - 1) for s in "us" for b in (8, 16, 32, 64)}


def mode_name(octal: Column) -> Column:
    """The kind of a tree entry by its mode as octal text; unknown modes are plain files."""
    number = F.conv(octal, 8, 10).cast("int")
    out = F.lit("BLOB")
    for mode, name in MODES.items():
        out = F.when(number == mode, name).otherwise(out)
    return out


def nice_bytes(n: Column, last: str = "PiB") -> Column:
    """A size with a unit: the next unit from 1000 on, each 1024 of the one before, up to the last."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    units = units[: units.index(last) + 1]
    x = n.cast("double")
    out = F.format_string("%.1f %s", F.round(x / 1024.0 ** (len(units) - 1), 1), F.lit(units[-1]))
    for i in reversed(range(1, len(units) - 1)):
        out = F.when(x < 1000 * 1024.0**i, F.format_string("%.1f %s", F.round(x / 1024.0**i, 1), F.lit(units[i]))).otherwise(out)
    return F.when(x < 1000, F.format_string("%d B", n.cast("long"))).otherwise(out)


def nice_time(seconds: Column) -> Column:
    """A duration with a unit that leaves few digits."""
    s = seconds.cast("double")
    out = F.format_string("%.1f h", F.round(s / 3600, 1))
    for limit, factor, unit in ((7200, 1 / 60, "min"), (120, 1, "s"), (0.1, 1e3, "ms"), (1e-4, 1e6, "us"), (1e-7, 1e9, "ns")):
        out = F.when(s < limit, F.format_string(f"%.1f {unit}", F.round(s * factor, 1))).otherwise(out)
    return out


def date_string(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def strip_prefix(text: Column, prefix: str = "https://github.com/") -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def object_sha(kind: Column, payload: Column) -> Column:
    """SHA-1 of a stored object: its kind, size and a zero byte, then the payload."""
    return F.sha1(F.concat(F.concat(kind, F.lit(" "), F.octet_length(payload).cast("string")).cast("binary"), F.lit(bytearray(1)), payload))


def sha_prefix(sha: Column) -> Column:
    return F.substring(sha, 1, 16)


def gauss(x: Column, mean: Column | float, sigma: Column | float) -> Column:
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return F.exp(-F.pow((x - mean) / sigma, 2) / 2) / (sigma * math.sqrt(2 * math.pi))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_inv(p: float) -> float:
    """Inverse normal distribution by the rational approximation of Abramowitz and Stegun, 26.2.23."""
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return -z if p < 0.5 else z


_NUMBER = re.compile(r"^(?P<sign>[+-]*)(?:0[xX](?P<hex>[0-9a-fA-F]*)|0[bB](?P<bin>[01]*)|(?P<int>\d*)(?P<frac>\.\d*)?(?:[eE](?P<exp>[+-]?\d*))?)(?P<rest>.*)$", re.S)


def parse_number(text: str | None, target: str) -> tuple[float | int | None, int]:
    """Value and code of a number's text for one of u8..u64, s8..s64, f32, f64.

    Signs may run on; 0x, 0b and a leading 0 set the base of whole numbers; integers may carry a fraction and an exponent
    as long as the value is whole; inf and nan words are numbers of the float targets.
    """
    if not text:
        return None, 1
    floats = target in ("f32", "f64")
    m = _NUMBER.match(text)
    negative = m["sign"].count("-") % 2 == 1
    word = text[len(m["sign"]) :].lower()
    if floats and word in ("inf", "infinity", "nan"):
        return (-1 if negative else 1) * float(word), 0
    if m["hex"] is not None or m["bin"] is not None:
        digits, base = (m["hex"], 16) if m["hex"] is not None else (m["bin"], 2)
        if not digits:
            return None, 2 if m["rest"] else 5
        num, den = int(digits, base), 1
    else:
        whole, frac = m["int"] or "", (m["frac"] or "")[1:]
        if not whole and not frac:
            return None, 2 if m["rest"] else 5
        if m["exp"] is not None and m["exp"] in ("", "+", "-"):
            return None, 2 if m["rest"] else 5
        if len(whole) > 1 and whole[0] == "0" and m["frac"] is None and m["exp"] is None:
            if re.search("[89]", whole):
                return None, 2
            num, den = int(whole, 8), 1
        else:
            exp = int(m["exp"] or 0) - len(frac)
            if abs(exp) > 100_000:
                return None, 4 if exp > 0 and int(whole + frac or 0) else 6
            num, den = int(whole + frac or "0") * 10 ** max(exp, 0), 10 ** max(-exp, 0)
    if m["rest"]:
        return None, 7
    if negative:
        num = -num
    if floats:
        try:
            value = num / den
        except OverflowError:
            return None, 3 if negative else 4
        if target == "f32" and abs(value) > 3.4028235677973366e38:
            return None, 3 if negative else 4
        return (None, 6) if num and not value else (value, 0)
    if num % den:
        return None, 8
    low, high = INT_RANGES[target]
    value = num // den
    return (None, 3) if value < low else (None, 4) if value > high else (value, 0)


def parsed(text: Column, target: str) -> Column:
    """parse_number() of a column, as a struct of value and code; whole numbers beyond 2^53 are rounded to doubles."""

    @F.pandas_udf("value double, code int")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [parse_number(t, target) for t in texts]
        return pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype="float64"), "code": pd.Series([c for _, c in found], dtype="int32")})

    return run(text)


def try_number(text: Column) -> Column:
    """The JVM's own reading of plain decimal text as a double; null where it is none."""
    return F.expr("try_cast(null as double)") if text is None else text.try_cast("double")


def wrap(text: str, width: int = 80) -> str:
    return "\n".join(textwrap.wrap(text, width))
