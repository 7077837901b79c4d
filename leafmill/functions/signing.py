"""Signed blobs: what was stored is only read back if it carries a signature of this installation's key."""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets

PREFIX = b"leafmill-signed-1:"
DIGEST = hashlib.sha256
SIZE = DIGEST().digest_size


def load_key(path: str) -> bytes:
    """The key in a file that only its owner may read; a new one is made, written beside it and renamed, if there is none."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        draft = f"{path}.{os.getpid()}.{secrets.token_hex(4)}"
        handle = os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(handle, "wb") as f:
            f.write(secrets.token_bytes(SIZE))
        try:
            os.link(draft, path)  # of two processes at once one wins
        except FileExistsError:
            pass
        os.unlink(draft)
    with open(path, "rb") as f:
        return f.read()


def sign(blob: bytes, key: bytes) -> bytes:
    return PREFIX + hmac.new(key, blob, DIGEST).digest() + blob


def verify(wrapped: bytes | None, key: bytes) -> bytes | None:
    """The blob, or None if the prefix, the length or the signature is wrong."""
    if wrapped is None or len(wrapped) < len(PREFIX) + SIZE or not wrapped.startswith(PREFIX):
        return None
    signature, blob = wrapped[len(PREFIX) : len(PREFIX) + SIZE], wrapped[len(PREFIX) + SIZE :]
    return blob if hmac.compare_digest(signature, hmac.new(key, blob, DIGEST).digest()) else None
