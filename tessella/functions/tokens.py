"""Keys and tokens that are made or checked for one caller at a time."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets


def assignment_key() -> str:
    """A new key: eight random bytes in hex."""
    return secrets.token_hex(8)


def status_token(batch_id: str, secret: str) -> str:
    """The token by which the state of an upload can be asked for: an HMAC, in base64 for addresses and without padding."""
    return base64.urlsafe_b64encode(hmac.new(secret.encode(), batch_id.encode(), hashlib.sha256).digest()).decode().rstrip("=")


def token_holds(batch_id: str, token: str, secret: str) -> bool:
    """In a time that does not tell how much of a token is right."""
    return hmac.compare_digest(status_token(batch_id, secret).encode(), token.encode())
