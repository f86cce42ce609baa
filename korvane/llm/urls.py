"""Name of the page that an address leads to."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote, unquote_to_bytes

# A chosen list: parameters that tell where a visitor came from, not what is shown.
TRACKING = re.compile(r"(?:utm_\w+|[gfymt]clid|dclid|msclkid|gclsrc|_openstat|mc_[ce]id|igshid|_ga|ref|ref_src|from|source|share|s_cid|sessionid|phpsessid|sid)", re.IGNORECASE)
_SPLIT = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", re.DOTALL)
_KEPT = "-._~!$'()*,;:@"


def _plain(part: str, kept: str) -> str:
    """One spelling of percent-encoding."""
    return quote(unquote_to_bytes(part), safe=kept)


def page_key(url: str | None) -> str | None:
    """The same for all spellings of one page's address: scheme, case of the host, a leading www., default ports, encoding, a closing
    slash, dot segments, fragment, tracking parameters and order of parameters do not count; the path's case does. Null for null or blank.
    """
    if url is None or not (url := url.strip()):
        return None
    m = _SPLIT.match(url)
    if m is None:
        return url
    host = m[2].rpartition("@")[2].lower().rstrip(".")
    host = re.sub(r":(?:80|443)?$", "", host)
    try:
        if not host.isascii():
            host = host.encode("idna").decode()
    except UnicodeError:
        pass
    host = host.removeprefix("www.")
    path = re.sub(r"/{2,}", "/", m[3] or "/")
    path = "/".join(_plain(x, _KEPT + "&=+") for x in path.split("/"))
    if "/." in path:
        path = posixpath.normpath(path)
    path = path.rstrip("/")
    fields = [tuple(_plain(y.replace("+", "%20"), _KEPT + "/") for y in x.partition("=")[::2]) for x in re.split("[&;]", m[4] or "") if x]
    query = "&".join("=".join(x) for x in sorted(x for x in fields if not TRACKING.fullmatch(x[0])))
    return f"{host}{path}" + (f"?{query}" if query else "")
