"""URL resolution after the URL standard, for http and https."""

from __future__ import annotations

import re
from urllib.parse import quote

PORTS = {"http": 80, "https": 443}
_ABSOLUTE = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)", re.S)


def _path(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low, last = p.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def _host(raw: str) -> str | None:
    if not raw or re.search(r"[\s#/<>?@\\^|\[\]%]", raw.replace("[", "", 1).replace("]", "", 1) if raw.startswith("[") else raw):
        return None
    try:
        return raw.lower() if raw.isascii() else raw.encode("idna").decode().lower()
    except UnicodeError:
        return None


def resolve(base: str | None, href: str | None) -> str | None:
    """The absolute http(s) address of href on a page, without its fragment; None if there is none."""
    if href is None:
        return None
    href = re.sub(r"[\t\n\r]", "", href.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f \x1f"))
    m = _ABSOLUTE.match(href)
    scheme, rest = (m[1].lower(), m[2]) if m else (None, href)
    if scheme and scheme not in PORTS:
        return None
    b = _ABSOLUTE.match(base) if base else None
    own = None
    if b and b[1].lower() in PORTS:
        own = re.fullmatch(r"[\\/]*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?", b[2], re.S)
    if scheme is None and own is None:
        return None
    special = rest.replace("\\", "/") if "?" not in rest and "#" not in rest else re.sub(r"^[^?#]*", lambda x: x[0].replace("\\", "/"), rest)
    if scheme and not (special.startswith("/") or b and own and b[1].lower() != scheme) and own and b[1].lower() == scheme:
        scheme = None  # "http:path" is relative to a page of the same scheme
    if scheme is None and not special.startswith("//"):
        scheme, authority = b[1].lower(), own[1]
        m = re.fullmatch(r"([^?#]*)(\?[^#]*)?(#.*)?", special, re.S)
        path, query = m[1], m[2]
        if path.startswith("/"):
            pass
        elif path:
            path = (own[2].replace("\\", "/").rpartition("/")[0] or "") + "/" + path
        else:
            path, query = own[2].replace("\\", "/"), query if query is not None else own[3]
    else:
        scheme = scheme or b[1].lower()
        m = re.fullmatch(r"/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", special, re.S)
        authority, path, query = m[1], m[2], m[3]
    user, _, hostport = authority.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", hostport)
    if not m:
        return None
    host = _host(m[1])
    if not host:
        return None
    port = int(m[2]) if m[2] else None
    if port is not None and port > 65535:
        return None
    where = (user + "@" if user else "") + host + (f":{port}" if port is not None and port != PORTS[scheme] else "")
    path = quote(_path(path or "/"), safe="/%!$&'()*+,;=:@-._~[]|^\\")
    query = "" if query in (None, "") else "?" + quote(query[1:], safe="%!$&()*+,;=:@-._~/?[]|^\\`{}")
    return f"{scheme}://{where}{path}{query if query else ''}"


def host_of(url: str | None) -> str | None:
    m = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#]+)", url or "")
    return m[1] if m else None
