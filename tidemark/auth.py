"""Who may read and write, from an access token and the configured policy."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass
from enum import Enum


class Principal(Enum):
    ANONYMOUS, READER, WRITER = "anonymous", "reader", "writer"


class AuthError(Exception):
    """An HTTP status and a stable code."""

    def __init__(self, status: int, code: str):
        super().__init__(code)
        self.status, self.code = status, code


@dataclass(frozen=True)
class Policy:
    """For each of read and write: 'any', 'off', or the SHA-256 of a password in hex."""

    read: str = "any"
    write: str = "any"


def _is_password(setting: str) -> bool:
    return setting not in ("any", "off")


def principal_of(token: str | None, policy: Policy) -> Principal:
    """The caller that a token stands for; no token is anonymous unless nothing is open to everyone."""
    if token is None:
        if "any" not in (policy.read, policy.write):
            raise AuthError(401, "NEED_ACCESS_TOKEN")
        return Principal.ANONYMOUS
    if not (_is_password(policy.read) or _is_password(policy.write)):
        raise AuthError(400, "USELESS_ACCESS_TOKEN")
    digest = hashlib.sha256(token.encode()).hexdigest()
    for setting, who in ((policy.write, Principal.WRITER), (policy.read, Principal.READER)):
        if _is_password(setting) and hmac.compare_digest(digest, setting):
            return who
    raise AuthError(401, "INVALID_ACCESS_TOKEN")


def allowed(who: Principal, action: str, policy: Policy) -> bool:
    """action: 'read' or 'write'. Writers may do all, readers read, and what is open to any is open to all."""
    if who is Principal.WRITER:
        return True
    if action == "read":
        return who is Principal.READER or policy.read == "any"
    return policy.write == "any"


def bearer(header: str | None) -> str | None:
    if header is None:
        return None
    if not header.startswith("Bearer "):
        raise AuthError(401, "INVALID_AUTHORIZATION_HEADER")
    return header[7:]
