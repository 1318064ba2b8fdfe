"""PII: format-preserving Feistel pseudonyms.

Validated values (cards by their check digit, phones, social security numbers, IBANs by modulo 97, IPv4 and IPv6 addresses, calendar dates,
e-mail addresses, quoted tokens) are found in the text and permuted within their format under a key: digits stay digits, letters
stay letters, check digits stay right, dates stay dates. Equal values get equal pseudonyms in all documents; without the key they
can't be reversed. Numbers that fail validation are left alone, as are
ten digits in a row without a mark, a country code or a group: they may be anything.
"""

from __future__ import annotations

import hashlib
import ipaddress
import os
import re
import unicodedata
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_slices, in_arrow, widened

ROUNDS = 8
DIGITS = "0123456789"
#: Conf key of the secret that op9_pii takes.
KEY_CONF = "spark.ledgerloom.pii.key"
#: Characters that stay within their class.
CLASSES = [DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)]
CLASS_OF = {ch: c for c in CLASSES for ch in c}


@lru_cache(maxsize=4096)
def class_of(ch: str) -> str | None:
    """The characters that may stand for ch: for letters and digits beyond CLASSES those of its kind among the 128 code points around it."""
    if ch in CLASS_OF or ch.isascii():
        return CLASS_OF.get(ch)
    kind, low = unicodedata.category(ch), ord(ch) & ~127
    return "".join(chr(c) for c in range(low, low + 128) if unicodedata.category(chr(c)) == kind and chr(c) not in CLASS_OF) if kind[0] == "L" or kind == "Nd" else None


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size) in which no value stands for itself: a Feistel network, a step of a keyed length around the range, and the network back."""
    if size < 2:
        return value
    told = hashlib.blake2b(f"{tweak}|{size:x}|step".encode(), key=key).digest()
    step = 1 + int.from_bytes(told, "big") % (size - 1)
    return feistel((feistel(value, size, key, tweak) + (-step if back else step)) % size, size, key, tweak, True)


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until the value is in range again."""
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1

    def f(k: int, x: int) -> int:
        told = f"{tweak}|{size:x}|{k}|{x:x}|".encode()
        blocks = [hashlib.blake2b(told + str(n).encode(), key=key).digest() for n in range(-(-half // 512))]
        return int.from_bytes(b"".join(blocks), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ f(k, left), left) if back else (right, left ^ f(k, right))
        value = left << half | right
        if value < size:
            return value


def permuted_text(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Letters and digits permuted within their classes; other characters stay."""
    classes = [class_of(ch) for ch in text]
    value, size = 0, 1
    for ch, own in zip(text, classes, strict=True):
        if own:
            value, size = value * len(own) + own.index(ch), size * len(own)
    value = permuted(value, size, key, tweak, back)
    out = list(text)
    for i in reversed(range(len(text))):
        if classes[i]:
            value, k = divmod(value, len(classes[i]))
            out[i] = classes[i][k]
    return "".join(out)


def with_digits(shape: str, digits: str) -> str:
    """shape with its ASCII digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if ch in DIGITS else ch for ch in shape)


def luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def card(found: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    new = permuted_text(digits[:-1], key, "card", back)
    while len(set(new + luhn_digit(new))) == 1:  # one repeated digit is not taken for a card, so none may arise
        new = permuted_text(new, key, "card", back)
    return with_digits(found, new + luhn_digit(new))


def phone(found: str, key: bytes, back: bool) -> str | None:
    """The last ten digits change, or all after a country code that is parted by a mark, or after an area code with a leading 0; these codes stay."""
    digits = re.sub("[^0-9]", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    code = re.match(r"\+([0-9]{1,3})[ .(-]", found) or re.match(r"(0[1-9][0-9]{1,3})[ /-][0-9]{6,8}\Z", found)
    at = len(code[1]) if code else max(len(digits) - 10, 0)
    return with_digits(found, digits[:at] + permuted_text(digits[at:], key, "phone", back))


def social(found: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(x) for x in found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at, serial = divmod(permuted(at, 898 * 99 * 9999, key, "social", back), 9999)
    area, group = divmod(at, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def iban(found: str, key: bytes, back: bool) -> str | None:
    plain = found.replace(" ", "")
    number = lambda s: int("".join(str(int(ch, 36)) for ch in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    inner = permuted_text(plain[4:], key, "iban" + plain[:2], back)
    new = iter(plain[:2] + f"{98 - number(inner + plain[:2] + '00') % 97:02d}" + inner)
    return "".join(" " if ch == " " else next(new) for ch in found)


def address(found: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    new = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, new.to_bytes(4, "big")))


def long_address(found: str, key: bytes, back: bool) -> str | None:
    """An IPv6 address of a range that is in use; its first group, and how it is shortened, stay."""
    try:
        first = ipaddress.IPv6Address(found).packed[0]
    except ValueError:
        return None
    if not (0x20 <= first < 0x40 or 0xFC <= first):
        return None
    head, mark, rest = found.partition(":")
    shape = re.sub("[0-9A-Fa-f]", "0", rest)
    hexes = DIGITS + ("ABCDEF" if re.search("[A-F]", found) else "abcdef")
    digits = re.sub("[^0-9A-Fa-f]", "", rest)
    if not digits or any(ch not in hexes for ch in digits):
        return None
    value = permuted(int(digits, 16), 16 ** len(digits), key, f"ip6 {hexes[10]}", back)
    text = f"{value:0{len(digits)}x}"
    return head + mark + with_digits(shape, text.upper() if hexes[10] == "A" else text)


def calendar(found: str, key: bytes, back: bool) -> str | None:
    """YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY, MM/DD/YYYY or MM-DD-YYYY; dates of 1900 to 2099 stay there, others stay outside."""
    mark = re.search("[^0-9]", found)[0]
    parts = found.split(mark)
    y, m, d = parts if len(parts[0]) == 4 else (parts[2], parts[1], parts[0]) if mark == "." else (parts[2], parts[0], parts[1])
    try:
        at = date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    low, high, end = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal(), date.max.toordinal() + 1
    if low <= at < high:
        at = low + permuted(at - low, high - low, key, "date", back)
    else:
        at = 1 + permuted(at - 1 if at < low else at - 1 - (high - low), end - 1 - (high - low), key, "far date", back)
        at += (high - low) * (at >= low)
    new = date.fromordinal(at)
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return mark.join((y, m, d) if len(parts[0]) == 4 else (d, m, y) if mark == "." else (m, d, y))


def email(found: str, key: bytes, back: bool) -> str:
    """The part before the @ changes."""
    name, _, domain = found.rpartition("@")
    return f"{permuted_text(name, key, 'email', back)}@{domain}"


def whole_email(found: str, key: bytes, back: bool) -> str:
    """The domain changes too, but for what stands after its last dot."""
    name, _, domain = email(found, key, back).rpartition("@")
    host, _, last = domain.rpartition(".")
    return f"{name}@{permuted_text(host, key, 'domain', back)}.{last}"


def token(found: str, key: bytes, back: bool) -> str | None:
    """A quoted token of small and capital letters and digits; other characters stay."""
    if not all(re.search(p, found) for p in ("[a-z]", "[A-Z]", "[0-9]")):
        return None
    return permuted_text(found, key, "token", back)


def secret(found: str, key: bytes, back: bool) -> str:
    """Hexadecimal digits of a quoted token change."""
    hexes = DIGITS + ("ABCDEF" if re.search("[A-F]", found) else "abcdef")
    value = 0
    for ch in found:
        value = value * 16 + hexes.index(ch)
    value = permuted(value, 16 ** len(found), key, "secret", back)
    out = ""
    for _ in found:
        value, k = divmod(value, 16)
        out = hexes[k] + out
    return out


KINDS = {"email": email, "secret": secret, "token": token, "iban": iban, "date": calendar, "ip6": long_address, "ip": address, "social": social, "phone": phone, "card": card}
PATTERN = re.compile(
    r"(?<![\w.%+-])(?P<email>[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w@]))"
    r"""|(?<=["'])(?P<secret>[0-9a-f]{20,128}|[0-9A-F]{20,128})(?=["'])"""
    r"""|(?<=["'])(?P<token>[A-Za-z0-9_+/=-]{20,128})(?=["'])"""
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![0-9./-])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9/-]|\.[0-9])"
    r"|(?<![\w:.])(?P<ip6>[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4})(?![\w:]|\.[0-9])"
    r"|(?<![\w.])(?<![Vv]ersion )(?<![Rr]elease )(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])"
    r"|(?<![0-9-])(?P<social>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|-[0-9])"
    r"|(?<![0-9])(?P<phone>\+[0-9]{11,13}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|\+[1-9][0-9]{0,2}(?:[ .-]\(?[0-9]{1,5}\)?){1,3}[ .-][0-9]{3,8}|0[1-9][0-9]{1,3}[ /-][0-9]{6,8})(?![0-9]|-[0-9])"
    r"|(?<![0-9])(?P<card>[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
)


def pseudonymised(text: str, key: bytes, back: bool = False, domains: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind have changed; back=True restores the original. With domains, those of e-mail addresses change too."""
    counts: dict[str, int] = {}
    kinds = KINDS | ({"email": whole_email} if domains else {})

    @lru_cache(maxsize=4096)
    def new(kind: str, found: str) -> str | None:
        return kinds[kind](found, key, back)

    def put(m: re.Match) -> str:
        changed = new(m.lastgroup, m[0])
        if changed is None or changed == m[0]:  # nothing to permute
            return m[0]
        counts[m.lastgroup] = counts.get(m.lastgroup, 0) + 1
        return changed

    return PATTERN.sub(put, text), counts


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", domains: bool = False) -> DataFrame:
    """docs with pseudonyms in text_col, and n_values (how many values were replaced) and kinds (which, sorted and comma-joined) added.

    Null texts stay null and empty ones empty, with 0 and ''. Every row gives a row; columns of the added names are replaced.
    Each text is read as a whole. `key` (1 to 64 bytes) is secret: keep it to link later data, drop it to make pseudonyms final.
    """
    kept = docs.drop("n_values", "kinds")
    schema = widened(kept.schema, "n_values bigint, kinds string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole, text_col):
                at = batch.schema.get_field_index(text_col)
                texts = batch.column(at)
                may = pc.fill_null(pc.match_substring_regex(texts, "[0-9@\"':]"), False)  # all kinds hold one of these
                pick = pc.indices_nonzero(may).to_pylist()
                n, kinds = [0] * batch.num_rows, [""] * batch.num_rows
                changed = []
                for i, text in zip(pick, texts.filter(may).to_pylist(), strict=True):
                    new, counts = pseudonymised(text, key, domains=domains)
                    n[i], kinds[i] = sum(counts.values()), ",".join(sorted(counts))
                    changed.append(new)
                columns = list(batch.columns)
                columns[at] = pc.replace_with_mask(texts, may, pa.array(changed, texts.type)) if pick else texts
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], [*batch.schema.names, "n_values", "kinds"])

    return in_arrow(kept, run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_values, kinds. The key is read from KEY_CONF; where that is unset, a new one is drawn, which makes the pseudonyms final."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    key = spark.conf.get(KEY_CONF, None)
    return pseudonymise(docs, key.encode() if key else os.urandom(32))
