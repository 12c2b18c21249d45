"""Which addresses and files may be read."""

from __future__ import annotations

import ipaddress
import re
import socket
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

from ..functions.urls import glob_regex


def resolved(host: str) -> tuple[str, ...]:
    """All addresses of a host; none if its name is unknown."""
    try:
        return tuple(sorted({str(x[4][0]).split("%")[0] for x in socket.getaddrinfo(host, None)}))
    except OSError:
        return ()


class AccessDenied(PermissionError):
    """The policy does not let this be read."""


@dataclass(frozen=True)
class AccessPolicy:
    """Open mode lets public hosts through and private networks only if told to; with `allowlist` only named hosts and networks pass. Files must lie below a root."""

    allowlist: bool = False
    hosts: tuple[str, ...] = ()
    networks: tuple[str, ...] = ()
    private: bool = False
    roots: tuple[str, ...] = ()

    def check(self, url: str, addresses: tuple[str, ...] = ()) -> None:
        """Raises AccessDenied unless the URL may be read; `addresses` are what its host resolves to, all of which must be allowed."""
        s = urlsplit(url)
        if s.scheme == "file":
            p = PurePosixPath(unquote(s.path))
            if ".." in p.parts or not any(p.is_relative_to(r) for r in self.roots):
                raise AccessDenied(url)
            return
        host = (s.hostname or "").rstrip(".").lower()
        if not host or s.scheme not in ("http", "https"):
            raise AccessDenied(url)
        try:
            known = (str(ipaddress.ip_address(host)),)
        except ValueError:
            if any(re.match(glob_regex(h.lower()), host) for h in self.hosts):
                return
            known = addresses
        listed = lambda a: any(ipaddress.ip_address(a) in ipaddress.ip_network(n) for n in self.networks)
        fine = lambda a: listed(a) or (not self.allowlist and (self.private or ipaddress.ip_address(a).is_global))
        if host == "localhost" and not self.private:
            raise AccessDenied(url)
        # A name that resolves to nothing is no reason to let it through: what it names later was never checked.
        if (known and not all(map(fine, known))) or not known:
            raise AccessDenied(url)

    def admit(self, url: str, resolve: Callable[[str], tuple[str, ...]] = resolved) -> None:
        """`check` with the addresses its host has now."""
        s = urlsplit(url)
        self.check(url, resolve(s.hostname) if s.scheme != "file" and s.hostname else ())
