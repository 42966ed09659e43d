"""URLs the way browsers read them, for the parse step, and the same keys as column expressions."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import quote, unquote_plus

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
#: Query parameters that only track visits.
TRACKING = re.compile(r"^(utm_.*|gclid|dclid|fbclid|msclkid|_ga(_.+)?|mc_[ce]id)$", re.IGNORECASE)
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", re.DOTALL)


class Url(NamedTuple):
    scheme: str
    auth: str
    host: str
    port: str
    path: str
    query: str
    fragment: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")

    def text(self, query: bool = True, fragment: bool = True) -> str:
        auth = f"{self.auth}@" if self.auth else ""
        out = f"{self.scheme}://{auth}{self.host}" + (f":{self.port}" if self.port else "") + self.path if self.scheme in PORTS else f"{self.scheme}:{self.path}"
        return out + (f"?{self.query}" if query and self.query else "") + (f"#{self.fragment}" if fragment and self.fragment else "")


def _escape(s: str, safe: str) -> str:
    return quote(s, safe=safe + "%", encoding="utf-8", errors="replace")


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            out = out[:-1]
        if low in (".", ".."):
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def parse_url(text: str, base: Url | None = None) -> Url | None:
    """text as a URL, against a base if it is relative; None if it can't be one."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text, _, fragment = text.partition("#")
    m = _SCHEME.fullmatch(text)
    if m and (m[1].lower() not in PORTS or not base or base.scheme != m[1].lower() or m[2][:1] in "/\\"):
        scheme, rest = m[1].lower(), m[2]
        if scheme not in PORTS:
            rest, _, query = rest.partition("?")
            return Url(scheme, "", "", "", rest, query, fragment)
    elif base is None:
        return None
    else:
        scheme, rest = base.scheme, m[2] if m else text
        if base.scheme not in PORTS:
            return None
        rest = rest.split("?", 1)[0].replace("\\", "/") + ("?" + rest.split("?", 1)[1] if "?" in rest else "")
        if not rest.startswith("//"):
            path, mark, query = rest.partition("?")
            if not path:
                return base._replace(query=_escape(query, "!$&()*+,/:;=?@[]^`{|}~") if mark else base.query, fragment=_escape(fragment, "!$&'()*+,/:;=?@[]^{|}~"))
            if not path.startswith("/"):
                path = base.path.rpartition("/")[0] + "/" + path
            return base._replace(path=_dots(_escape(path, "!$&'()*+,/:;=@[]^|~")), query=_escape(query, "!$&()*+,/:;=?@[]^`{|}~"), fragment=_escape(fragment, "!$&'()*+,/:;=?@[]^{|}~"))
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/").lstrip("/")
    authority, slash, path = rest.partition("/")
    auth, _, host = authority.rpartition("@")
    port = ""
    if (p := re.fullmatch(r"(.*):([0-9]*)", host)) and not host.endswith("]"):
        host, port = p[1], p[2].lstrip("0") or ("0" if p[2] else "")
    if not host or re.search(r"[\x00-\x20#%/:<>?@\\^|]", host) and not host.startswith("[") or port and int(port) > 65535:
        return None
    try:
        host = host.lower() if host.isascii() else host.lower().encode("idna").decode()
    except UnicodeError:
        return None
    if port == PORTS[scheme]:
        port = ""
    return Url(scheme, auth, host, port, _dots(_escape(slash + path, "!$&'()*+,/:;=@[]^|~")) if path or slash else "/", _escape(query, "!$&()*+,/:;=?@[]^`{|}~"), _escape(fragment, "!$&'()*+,/:;=?@[]^{|}~"))


def _form(s: str) -> str:
    return quote(s, safe="*-._ ").replace(" ", "+")


# ASCII in the order of the root collation, before the letters.
_COLLATION = {c: i for i, c in enumerate("_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789")}


def collated(s: str) -> tuple:
    """A sort key as people order words: letters regardless of marks and case first, then marks, then lower before upper case."""
    plain = unicodedata.normalize("NFD", s)
    base = [c for c in plain if not unicodedata.combining(c)]
    return [(0, _COLLATION[c]) if c in _COLLATION else (1, c.lower()) for c in base], [c for c in plain if unicodedata.combining(c)], [c != c.lower() for c in base], s


def crawl_key(text: str) -> str | None:
    """A URL for the crawl's frontier: no fragment, no tracking parameters, the others sorted by name and value; case and final slash stay."""
    url = parse_url(text)
    if url is None or url.scheme not in ("http", "https"):
        return None
    pairs = [(unquote_plus(k), unquote_plus(v)) for p in url.query.split("&") if p for k, _, v in [p.partition("=")]]
    kept = sorted((p for p in pairs if not TRACKING.match(p[0])), key=lambda p: (collated(p[0]), collated(p[1])))
    return url._replace(query="&".join(f"{_form(k)}={_form(v)}" for k, v in kept), fragment="").text()


def blocked_host(host: str) -> bool:
    """Whether a request to host must not leave: local names, and addresses that aren't public."""
    host = host.lower().rstrip(".").strip("[]")
    if host in ("localhost", "") or host.endswith((".localhost", ".local", ".internal", ".home.arpa")):
        return True
    try:
        return not ipaddress.ip_address(host).is_global
    except ValueError:
        return False


def fold(text: str | None) -> str | None:
    """NFKD without marks, lower case, anything but letters and digits as one space."""
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^\w]+|_+", " ", plain).strip()


def _by_value(f: Callable[[str], str | None]) -> Callable[[pd.Series], pd.Series]:
    """f over a batch, once for each distinct value."""

    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        got = np.array([*[f(v) if v else None for v in values], None], object)
        return pd.Series(got[codes], index=s.index, dtype=object)

    return run


def crawl_key_of(url: Column) -> Column:
    """crawl_key as a column, by Arrow batches."""
    return F.pandas_udf(_by_value(crawl_key), StringType())(url)


def blocked_target(url: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a URL's host must not be asked: see blocked_host; hosts named in allowed may be."""
    name = host(url)
    asked = F.pandas_udf(_by_value(lambda h: "y" if blocked_host(h) else "n"), StringType())(F.coalesce(F.nullif(name, F.lit("")), F.lit("localhost")))
    return (asked == "y") & ~name.isin(*allowed) if allowed else asked == "y"


def folded(text: Column) -> Column:
    return F.pandas_udf(_by_value(fold), StringType())(text)


def scheme_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host without port or user, in lower case; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    got = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(got == "", "/").otherwise(got)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def page_key(url: Column) -> Column:
    """Without query, fragment and one final slash."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/$", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def route_key(url: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments(url), "/"))


def directory(url: Column) -> Column:
    return F.regexp_extract(path(url), r"^(.*/)[^/]*$", 1)


def on_origin(url: Column, origin: Column) -> Column:
    """The same path, query and fragment on another origin."""
    return F.concat(F.regexp_extract(origin, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))


def skipped(url: Column) -> Column:
    """Whether the path ends like a file that isn't a page."""
    return F.lower(path(url)).rlike(r"\.(pdf|txt|xml|jpg|jpeg|png|gif|svg|webp|mp4|mp3|zip|gz|css|js)$")


def route_path(value: Column) -> Column:
    """A URL's path, or what is given as a path, with a leading slash and without final ones; "/" for none."""
    own = F.when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), path(value)).otherwise(value)
    bare = F.regexp_replace(F.trim(own), "/+$", "")
    return F.when(bare == "", "/").when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), bare))


def homepage(url: Column) -> Column:
    return (path(url) == "/") & (query(url) == "")
