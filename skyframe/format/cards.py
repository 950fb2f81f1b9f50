"""The 80-byte cards of a header: making, parsing, classes."""

from __future__ import annotations

import re

from .status import FitsError

CARD, RECORD = 80, 2880
COMMENTARY = ("COMMENT", "HISTORY", "")
#: The class code of a keyword by a pattern over its eight characters, the first that fits. Others are 150, user.
CLASSES = (
    (10, r"^(SIMPLE  |XTENSION|BITPIX  |BLOCKED |NAXIS[0-9 ]|PCOUNT  |GCOUNT  |EXTEND  |GROUPS  |END     |T(TYPE|FORM|BCOL)[0-9]|TFIELDS |THEAP   )"),
    (20, r"^Z(IMAGE  |CMPTYPE|NAME[0-9]|VAL[0-9]|TILE[0-9]|BITPIX |NAXIS[0-9 ]|SCALE  |ZERO   |BLANK  |SIMPLE |TENSION|EXTEND |BLOCKED|PCOUNT |GCOUNT |QUANTIZ|DITHER0)"),
    (30, r"^(BSCALE  |BZERO   |T(SCAL|ZERO)[0-9])"),
    (40, r"^(BLANK   |TNULL[0-9])"),
    (50, r"^TDIM[0-9]"),
    (60, r"^(DATAMIN |DATAMAX |T(LMIN|LMAX|DMIN|DMAX)[0-9])"),
    (70, r"^(BUNIT   |TUNIT[0-9])"),
    (80, r"^TDISP[0-9]"),
    (90, r"^(EXT(NAME |VER  |LEVEL)|HDU(NAME |VER  |LEVEL))"),
    (100, r"^(CHECKSUM|DATASUM )"),
    (110, r"^(C(TYPE|UNIT|RVAL|RPIX|ROTA|RDER|SYER|DELT)[0-9]|CD[0-9]|LONPOLE|LATPOLE|L(ONP|ATP)[0-9]|P[CVS][0-9]|WCS(AXES|NAME)|W(CAX|CSN)[0-9]"
          r"|[T0-9]C(TYP|UNI|RVL|RPX|ROT|DLT)..?[0-9]*|[T0-9]C(TYP|UNI|RVL|RPX|ROT|DLT)[0-9]|[T0-9]C(TY|UN|RV|RP|DE|RD|SY)[0-9]|TWCS[0-9]|T[CPVS][0-9]|[0-9][VS][0-9]|[0-9][0-9](PC|CD)[0-9])"),
    (120, r"^(DATE-OBS|EQUINOX|EQUI[0-9]|EPOCH   |MJD-OBS |MJDOB[0-9]|RADECSYS|RADESYS|RADE[0-9])"),
    (130, r"^(COMMENT |HISTORY |        | )"),
    (140, r"^CONTINUE"),
)
USER = 150
#: Starts of comment cards that every file has, which count as structure.
STANDARD_COMMENTS = ("FITS (Flexible Image Transport System", "and Astrophysics', volume 376, page 3", "Astrophysics Supplement Series v44/p3", "Contact the NASA Science Office of St", "FITS Definition document #100 and oth")


def key_class(card: str) -> int:
    key = card[:8].upper().ljust(8)
    if key == "COMMENT " and card[10:].startswith(STANDARD_COMMENTS):
        return 10
    if card.startswith("EXTNAME = 'COMPRESSED_IMAGE'"):
        return 20
    return next((code for code, pattern in CLASSES if re.search(pattern, key)), USER)


def test_keyword(name: str) -> None:
    """Up to eight of A-Z, 0-9, _ and -, and nothing after a blank; else status 207."""
    if not re.fullmatch(r"[A-Z0-9_-]* *", name[:8]):
        raise FitsError(207, name)


def test_record(card: str) -> None:
    if not re.fullmatch(r"[ -~]*", card[8:]):
        raise FitsError(207, card)


def quote(s: str) -> str:
    """A string value: quotes doubled, 68 characters at most, at least eight between the quotes."""
    out = ""
    for c in s:
        piece = "''" if c == "'" else c
        if len(out) + len(piece) > 68:
            break
        out += piece
    return f"'{out:<8}'"


def unquote(value: str) -> str:
    if not value.startswith("'"):
        return value.strip()
    m = re.match(r"'((?:[^']|'')*)'?", value)
    return m[1].replace("''", "'").rstrip(" ")


def fixed(x: float, decimals: int) -> str:
    return f"{x:.{decimals}f}"


def exponent(x: float, decimals: int) -> str:
    return f"{x:.{decimals}E}"


def complex_value(re_: float, im: float, decimals: int, exp: bool = True) -> str:
    f = exponent if exp else fixed
    return f"({f(re_, decimals)}, {f(im, decimals)})"


def make(name: str, value: str = "", comment: str | None = None) -> str:
    """A card without its padding. Short valid names take columns 1 to 8; others become HIERARCH cards."""
    name = name.strip()
    if "=" in name:
        raise FitsError(207, name)
    if len(name) <= 8 and re.fullmatch(r"[A-Za-z0-9_-]*", name):
        head = f"{name.upper():<8}= "
        if not value:  # a comment alone
            return f"{name.upper():<8}  {comment or ''}"[:CARD]
    else:
        if not re.fullmatch(r"[ -~]+", name):
            raise FitsError(207, name)
        head = ("" if name.upper().startswith("HIERARCH ") else "HIERARCH ") + name + " = "
        if len(head) + len(value) > CARD:
            head = head[:-3] + "= "
        if len(head) + len(value) > CARD:
            raise FitsError(207, name)
    long_name = len(head) > 10
    if value.startswith("'"):
        body = head + value
        if len(body) > CARD:
            body = body[: CARD - 1] + "'"
        body = body if long_name else f"{body:<30}"
    else:
        body = head + (value if long_name else f"{value:>20}")
    if comment and len(body) + 3 < CARD:
        body += f" / {comment}"
    return body[:CARD]


def keyword(card: str) -> str:
    """The keyword, of HIERARCH cards the long name."""
    if card.startswith("HIERARCH ") and "=" in card:
        return card[9 : card.index("=")].strip()
    return card[:8].strip()


def parse(card: str) -> tuple[str, str]:
    """(value as written, comment) of a card."""
    if card.startswith("HIERARCH ") and "=" in card:
        rest = card[card.index("=") + 1 :]
    elif card[:8].strip() in COMMENTARY or card[8:10] != "= ":
        if card.startswith("CONTINUE"):
            rest = card[8:]
        else:
            return "", card[8:].rstrip()
    else:
        rest = card[10:]
    rest = rest.lstrip()
    if rest.startswith("'"):
        m = re.match(r"'(?:[^']|'')*'", rest)
        if not m:
            raise FitsError(205, card)
        value, rest = m[0], rest[m.end() :]
    elif rest.startswith("("):
        end = rest.find(")") + 1
        if not end:
            raise FitsError(205, card)
        value, rest = rest[:end], rest[end:]
    else:
        value, slash, rest = rest.partition("/")
        return value.strip(), rest.strip() if slash else ""
    slash = rest.find("/")
    return value, rest[slash + 1 :].strip() if slash >= 0 else ""
