"""Sky coordinates of images from their headers."""

from __future__ import annotations

from ..format.header import Header
from ..format.status import FitsError


def img_coord(h: Header) -> dict:
    """The parameters of pix_to_world() and world_to_pix() by a header: reference values and pixels, steps, the rotation of axis 2 or else of
    axis 1, and the last four characters of CTYPE1. Only CRVAL1 must be there: status 505."""

    def number(name: str, default: float) -> float:
        v = h.get(name)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    if number("CRVAL1", float("nan")) != number("CRVAL1", float("nan")):
        raise FitsError(505)
    kind = h.get("CTYPE1")
    return {
        "ref": (number("CRVAL1", 0.0), number("CRVAL2", 0.0)), "pix": (number("CRPIX1", 0.0), number("CRPIX2", 0.0)), "inc": (number("CDELT1", 1.0), number("CDELT2", 1.0)),
        "rot": number("CROTA2", number("CROTA1", 0.0)), "projection": kind[-4:] if isinstance(kind, str) else "",
    }
