"""Status codes: errors carry one, and each has a text."""

from __future__ import annotations

import threading
from collections import deque

#: The texts of the status codes.
TEXTS = {
    0: "OK - no error",
    101: "same input and output files",
    103: "attempt to open too many files",
    104: "could not open the named file",
    105: "couldn't create the named file",
    106: "error writing to FITS file",
    107: "tried to move past end of file",
    108: "error reading from FITS file",
    110: "could not close the file",
    111: "array dimensions too big",
    112: "cannot write to readonly file",
    113: "could not allocate memory",
    114: "invalid fitsfile pointer",
    115: "NULL input pointer",
    116: "error seeking file position",
    117: "bad value for file download timeout setting",
    121: "invalid URL prefix",
    122: "too many I/O drivers",
    123: "I/O driver init failed",
    124: "no I/O driver for this URLtype",
    125: "parse error in input file URL",
    126: "parse error in range list",
    151: "bad argument (shared mem drvr)",
    152: "null ptr arg (shared mem drvr)",
    153: "no free shared memory handles",
    154: "share mem drvr not initialized",
    155: "IPC system error (shared mem)",
    156: "no memory (shared mem drvr)",
    157: "share mem resource deadlock",
    158: "lock file open/create failed",
    159: "can't resize share mem block",
    201: "header already has keywords",
    202: "keyword not found in header",
    203: "keyword number out of bounds",
    204: "keyword value is undefined",
    205: "string missing closing quote",
    206: "error in indexed keyword name",
    207: "illegal character in keyword",
    208: "required keywords out of order",
    209: "keyword value not positive int",
    210: "END keyword not found",
    211: "illegal BITPIX keyword value",
    212: "illegal NAXIS keyword value",
    213: "illegal NAXISn keyword value",
    214: "illegal PCOUNT keyword value",
    215: "illegal GCOUNT keyword value",
    216: "illegal TFIELDS keyword value",
    217: "negative table row size",
    218: "negative number of rows",
    219: "named column not found",
    220: "illegal SIMPLE keyword value",
    221: "first keyword not SIMPLE",
    222: "second keyword not BITPIX",
    223: "third keyword not NAXIS",
    224: "missing NAXISn keywords",
    225: "first keyword not XTENSION",
    226: "CHDU not an ASCII table",
    227: "CHDU not a binary table",
    228: "PCOUNT keyword not found",
    229: "GCOUNT keyword not found",
    230: "TFIELDS keyword not found",
    231: "missing TBCOLn keyword",
    232: "missing TFORMn keyword",
    233: "CHDU not an IMAGE extension",
    234: "illegal TBCOLn keyword value",
    235: "CHDU not a table extension",
    236: "column exceeds width of table",
    237: "more than 1 matching col. name",
    241: "row width not = field widths",
    251: "unknown FITS extension type",
    252: "1st key not SIMPLE or XTENSION",
    253: "END keyword is not blank",
    254: "Header fill area not blank",
    255: "Data fill area invalid",
    261: "illegal TFORM format code",
    262: "unknown TFORM datatype code",
    263: "illegal TDIMn keyword value",
    264: "invalid BINTABLE heap pointer",
    301: "illegal HDU number",
    302: "column number < 1 or > tfields",
    304: "negative byte address",
    306: "negative number of elements",
    307: "bad first row number",
    308: "bad first element number",
    309: "not an ASCII (A) column",
    310: "not a logical (L) column",
    311: "bad ASCII table datatype",
    312: "bad binary table datatype",
    314: "null value not defined",
    317: "not a variable length column",
    320: "illegal number of dimensions",
    321: "1st pixel no. > last pixel no.",
    322: "BSCALE or TSCALn = 0.",
    323: "illegal axis length < 1",
    340: "not group table",
    341: "HDU already member of group",
    342: "group member not found",
    343: "group not found",
    344: "bad group id",
    345: "too many HDUs tracked",
    346: "HDU alread tracked",
    347: "bad Grouping option",
    348: "identical pointers (groups)",
    360: "malloc failed in parser",
    361: "file read error in parser",
    362: "null pointer arg (parser)",
    363: "empty line (parser)",
    364: "cannot unread > 1 line",
    365: "parser too deeply nested",
    366: "file open failed (parser)",
    367: "hit EOF (parser)",
    368: "bad argument (parser)",
    369: "unexpected token (parser)",
    401: "bad int to string conversion",
    402: "bad float to string conversion",
    403: "keyword value not integer",
    404: "keyword value not logical",
    405: "keyword value not floating pt",
    406: "keyword value not double",
    407: "bad string to int conversion",
    408: "bad string to float conversion",
    409: "bad string to double convert",
    410: "illegal datatype code value",
    411: "illegal no. of decimals",
    412: "datatype conversion overflow",
    413: "error compressing image",
    414: "error uncompressing image",
    420: "bad date or time conversion",
    431: "syntax error in expression",
    432: "expression result wrong type",
    433: "vector result too large",
    434: "missing output column",
    435: "bad data in parsed column",
    436: "output extension of wrong type",
    501: "WCS angle too large",
    502: "bad WCS coordinate",
    503: "error in WCS calculation",
    504: "bad WCS projection type",
    505: "WCS keywords not found",
}
UNKNOWN = "unknown error status"


def text(status: int) -> str:
    return TEXTS.get(status, UNKNOWN)


class Messages(threading.local):
    """Messages of a thread, taken in the order in which they came."""

    def __init__(self) -> None:
        self.waiting: deque[str] = deque()

    def push(self, message: str) -> None:
        self.waiting.append(message)

    def pop(self) -> str | None:
        return self.waiting.popleft() if self.waiting else None

    def clear(self) -> None:
        self.waiting.clear()


MESSAGES = Messages()


class FitsError(Exception):
    """An error with a status and messages, the oldest first."""

    def __init__(self, status: int, *messages: str) -> None:
        super().__init__(f"{status}: {text(status)}" + "".join(f"; {m}" for m in messages))
        self.status, self.messages = status, list(messages)

    def __reduce__(self):
        return FitsError, (self.status, *self.messages)
