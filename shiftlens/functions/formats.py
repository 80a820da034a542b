"""Driver-side formatting of identifiers and numbers, for at most a few hundred values."""

from __future__ import annotations

import re
from decimal import Decimal


def is_plain(data: bytes) -> bool:
    """Valid UTF-8 without control characters."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return not re.search(rb"[\x00-\x1f\x7f]", data)


def ident_json(data: bytes) -> str:
    return f"u8:{data.decode()}" if is_plain(data) else f"hex:{data.hex()}"


def ident_human(data: bytes) -> str:
    if not is_plain(data):
        return f"hex:{data.hex()}"
    text = data.decode()
    return f"u8:{text}" if text.startswith(("u8:", "hex:")) else text


def parse_identifier(text: str) -> bytes:
    """The bytes named by a plain, ``u8:`` or ``hex:`` identifier."""
    if text.startswith("u8:"):
        return text[3:].encode()
    if text.startswith("hex:"):
        digits = text[4:]
        if len(digits) % 2 or not re.fullmatch(r"[0-9A-Fa-f]*", digits):
            raise ValueError(f"malformed identifier {text!r}: an even number of hex digits is needed")
        return bytes.fromhex(digits)
    return text.encode()


def with_commas(n: int) -> str:
    return f"{n:,}"


def shortest(x: float) -> str:
    """The shorter of plain and scientific notation, plain where they tie."""
    if x == 0:
        return "0"
    d = Decimal(repr(float(x)))
    sign, digits, exp = d.as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    power = len(digits) + exp - 1
    sci = ("-" if sign else "") + text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{power}"
    plain = format(d, "f")
    if "." in plain:
        plain = plain.rstrip("0").rstrip(".")
    return sci if len(sci) < len(plain) else plain


def in_unit(text: str, power: int) -> str:
    """What ``shortest`` gave for a whole multiple of a power of ten, with that power as its exponent."""
    return text if text == "0" else f"{Decimal(text).scaleb(-power):f}e{power}"


def value(x: float) -> str:
    return with_commas(int(x)) if float(x).is_integer() and abs(x) < 1e15 else shortest(x)


def signed(x: float) -> str:
    return "+0" if x == 0 else ("+" if x > 0 else "-") + value(abs(x))


def points(x: float) -> str:
    return f"{x:.1f}%"


def percent(x: float) -> str:
    return points(x * 100)


def byte_name(b: int) -> str:
    return "TAB" if b == 9 else chr(b) if 0x21 <= b <= 0x7E else f"0x{b:02X}"


def shell_quote(text: str) -> str:
    return text if re.fullmatch(r"[A-Za-z0-9_./:=@%+-]+", text) else "'" + text.replace("'", "'\"'\"'") + "'"
