"""A header: ordered cards with lookups and edits."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime

from . import cards as C
from .status import FitsError


def date_text(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S")


def is_date(text: str) -> bool:
    return bool(re.match(r"\d{4}-\d\d-\d\d", text))


def fits_glob(text: str, pattern: str) -> bool:
    """Whether a text is like a pattern in which * stands for any characters and ? for one; nothing else is special."""
    return re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern), text, re.DOTALL) is not None


class Header:
    """Cards without END. Names are matched without case, of several the first; positions count from 1."""

    def __init__(self, cards: list[str] | None = None) -> None:
        self.cards = [f"{c:<80}"[:80] for c in cards or []]

    def __len__(self) -> int:
        return len(self.cards)

    # bytes
    @staticmethod
    def parse(data: bytes, most: int = 1024) -> tuple[Header, int]:
        """(header, its bytes with the fill) from the start of data; status 210 if END is missing within `most` records."""
        for k in range(0, min(len(data), most * C.RECORD), C.CARD):
            if data[k : k + 8] == b"END     ":
                text = data[:k].decode("ascii", "replace")
                return Header([text[i : i + 80] for i in range(0, k, 80)]), -(-(k + C.CARD) // C.RECORD) * C.RECORD
        raise FitsError(210)

    def to_bytes(self, more: int = 0) -> bytes:
        """Cards, END and spaces up to a whole record; `more` keeps room for as many cards."""
        text = "".join(self.cards) + f"{'END':<80}"
        size = -(-(len(text) + more * C.CARD) // C.RECORD) * C.RECORD
        return text.ljust(size).encode("ascii", "replace")

    def space(self) -> tuple[int, int]:
        """(cards, free slots in the last record)."""
        return len(self), (-(len(self) + 1)) % 36

    # lookups
    def index(self, name: str) -> int:
        name = name.strip().upper()
        for i, c in enumerate(self.cards):
            if C.keyword(c).upper() == name:
                return i
        raise FitsError(202, name)

    def has(self, name: str) -> bool:
        return any(C.keyword(c).upper() == name.strip().upper() for c in self.cards)

    def record(self, n: int) -> str:
        if not 1 <= n <= len(self):
            raise FitsError(203, str(n))
        return self.cards[n - 1]

    def keyn(self, n: int) -> tuple[str, str, str]:
        """(keyword, value, comment) of the card at a position."""
        card = self.record(n)
        return C.keyword(card), *C.parse(card)

    def __iter__(self):
        """Cards in order."""
        return iter(self.cards)

    def raw(self, name: str) -> tuple[str, str]:
        return C.parse(self.cards[self.index(name)])

    def get(self, name: str, default=None):
        """The value by its form: string, bool, int, float, complex, or None if undefined; default where the key is missing."""
        if not self.has(name):
            return default
        v = self.raw(name)[0]
        if v.startswith("'"):
            return self.long_string(name)
        if v in ("T", "F"):
            return v == "T"
        if not v:
            return None
        if v.startswith("("):
            a, b = v[1:-1].split(",")
            return complex(float(a), float(b))
        if re.fullmatch(r"[+-]?\d+", v):
            return int(v)
        try:
            return float(re.sub("[dD]", "E", v))
        except ValueError:
            return v

    def string(self, name: str) -> str:
        return C.unquote(self.raw(name)[0])

    def logical(self, name: str) -> bool:
        v = self.raw(name)[0][:1]
        if v not in ("T", "F"):
            raise FitsError(404, name)
        return v == "T"

    def integer(self, name: str) -> int:
        v = self.get(name)
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise FitsError(403 if self.has(name) else 202, name)
        return int(v)

    def real(self, name: str) -> float:
        v = self.get(name)
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise FitsError(405 if self.has(name) else 202, name)
        return float(v)

    def unit(self, name: str) -> str:
        m = re.match(r"\[([^\]]*)\]", self.raw(name)[1])
        return m[1] if m else ""

    def long_string(self, name: str) -> str:
        i = self.index(name)
        out = C.unquote(C.parse(self.cards[i])[0])
        while out.endswith("&") and i + 1 < len(self) and self.cards[i + 1].startswith("CONTINUE"):
            i += 1
            out = out[:-1] + C.unquote(C.parse(self.cards[i])[0])
        return out

    def keys(self, root: str, start: int = 1, most: int = 999) -> list:
        out = []
        while len(out) < most and self.has(f"{root}{start + len(out)}"):
            out.append(self.get(f"{root}{start + len(out)}"))
        return out

    def find(self, include: list[str], exclude: list[str] | None = None, after: int = 0) -> str:
        """The first card past position `after` whose keyword fits a pattern of include and none of exclude; * and ? stand for any."""
        fits = lambda c, patterns: any(fits_glob(C.keyword(c).upper(), p.upper()) for p in patterns)
        for c in self.cards[after:]:
            if fits(c, include) and not fits(c, exclude or []):
                return c
        raise FitsError(202, ", ".join(include))

    # edits
    @staticmethod
    def form(value, decimals: int | None = None, fixed: bool = False) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return "T" if value else "F"
        if isinstance(value, int):
            return str(value)
        if isinstance(value, str):
            return C.quote(value)
        n = 15 if decimals is None else decimals
        if isinstance(value, complex):
            return C.complex_value(value.real, value.imag, n, not fixed)
        if not math.isfinite(value):
            raise FitsError(402, str(value))
        if decimals is None:
            s = repr(float(value)).upper()
            return s
        return C.fixed(value, n) if fixed else C.exponent(value, n)

    @staticmethod
    def card(name: str, value, comment: str | None = None, decimals: int | None = None, fixed: bool = False) -> str:
        if value is None:
            return f"{C.make(name, '?', comment):<80}".replace("?", " ", 1)
        return C.make(name, Header.form(value, decimals, fixed), comment)

    def put(self, card: str, at: int | None = None) -> Header:
        """Appends, or inserts before position `at`."""
        if at is not None and not 1 <= at <= len(self) + 1:
            raise FitsError(203, str(at))
        self.cards.insert(len(self) if at is None else at - 1, f"{card:<80}"[:80])
        return self

    def write(self, name: str, value, comment: str | None = None, decimals: int | None = None, fixed: bool = False) -> Header:
        return self.put(self.card(name, value, comment, decimals, fixed))

    def update(self, name: str, value, comment: str | None = None, decimals: int | None = None, fixed: bool = False) -> Header:
        """Replaces, or appends; without a comment the old one stays."""
        return self.modify(name, value, comment, decimals, fixed) if self.has(name) else self.write(name, value, comment, decimals, fixed)

    def modify(self, name: str, value, comment: str | None = None, decimals: int | None = None, fixed: bool = False) -> Header:
        i = self.index(name)
        comment = self.raw(name)[1] if comment is None else comment
        self.cards[i] = f"{self.card(name, value, comment, decimals, fixed):<80}"
        return self

    def comment(self, text: str, kind: str = "COMMENT") -> Header:
        for a in range(0, max(len(text), 1), 72):
            self.put(f"{kind:<8}{text[a : a + 72]}")
        return self

    def modify_comment(self, name: str, comment: str) -> Header:
        i = self.index(name)
        self.cards[i] = f"{C.make(name, self.raw(name)[0], comment):<80}"
        return self

    def rename(self, old: str, new: str) -> Header:
        i = self.index(old)
        self.cards[i] = f"{C.make(new, *C.parse(self.cards[i])):<80}"
        return self

    def delete(self, name: str | int) -> Header:
        i = self.index(name) if isinstance(name, str) else name - 1
        if not 0 <= i < len(self):
            raise FitsError(203, str(name))
        del self.cards[i]
        return self

    def set_unit(self, name: str, unit: str) -> Header:
        rest = re.sub(r"^\[[^\]]*\] ?", "", self.raw(name)[1])
        return self.modify_comment(name, f"[{unit}] {rest}".rstrip() if unit else rest)

    def write_long(self, name: str, value: str, comment: str | None = None) -> Header:
        """A string over CONTINUE cards where one is too short."""
        escaped = value.replace("'", "''")
        if len(escaped) <= 68:
            return self.write(name, value, comment)
        parts, at = [], 0
        while at < len(escaped):
            cut = min(at + 67, len(escaped))
            while cut < len(escaped) and (escaped[:cut].count("'") - escaped[:at].count("'")) % 2:
                cut -= 1  # a doubled quote stays together
            parts.append(escaped[at:cut])
            at = cut
        for k, p in enumerate(parts):
            more = "&" if k < len(parts) - 1 else ""
            self.put((f"{name.upper():<8}= '{p}{more}'" if k == 0 else f"CONTINUE  '{p}{more}'") + (f" / {comment}" if comment and not more else ""))
        return self

    def write_keys(self, root: str, values: list, start: int = 1, comment: str | None = None) -> Header:
        for i, v in enumerate(values):
            self.write(f"{root}{start + i}", v, comment)
        return self

    def write_date(self, seconds: float) -> Header:
        return self.update("DATE", date_text(seconds), "file creation date (YYYY-MM-DDThh:mm:ss UT)")

    def write_time(self, name: str, whole: int, fraction: float, comment: str | None = None) -> Header:
        if not 0 <= fraction < 1:
            raise FitsError(402)
        return self.put(C.make(name, f"{whole}{fraction:.16f}".replace(f"{whole}0.", f"{whole}.", 1), comment))

    def template(self, lines: list[str]) -> Header:
        """Edits by lines: KEY value / comment updates, -KEY deletes, -OLD NEW renames, END stops."""
        for line in lines:
            line = line.rstrip("\n")
            if line.startswith("END"):
                break
            if line.startswith("-"):
                old, _, new = line[1:].strip().partition(" ")
                if new.strip():
                    self.rename(old, new.strip())
                elif self.has(old):
                    self.delete(old)
            elif line[:8].strip() in ("COMMENT", "HISTORY"):
                self.comment(line[8:].strip(), line[:8].strip())
            elif line.strip():
                m = re.match(r"\s*([^\s=]+)\s*=?\s*('(?:[^']|'')*'|[^/]*?)\s*(?:/\s*(.*))?$", line)
                value = m[2]
                if value and not value.startswith("'") and not re.fullmatch(r"[TF]|[+-]?[\d.]+([EeDd][+-]?\d+)?|\(.*\)", value):
                    value = C.quote(value)
                new = C.make(m[1], value, m[3])
                if self.has(m[1]):
                    self.cards[self.index(m[1])] = f"{new:<80}"
                else:
                    self.put(new)
        return self
