"""Vectors as array columns."""

from __future__ import annotations

import struct
from hashlib import sha256
from math import isfinite, sqrt
from numbers import Real

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..schema import EMBED_DIM


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where a vector is."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n == 0, F.lit(0.0))


def valid(a: Column | str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components."""
    a = _col(a).cast("array<double>")
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dim) & fine, F.lit(False))


def unit_length(a: Column | str, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def hashed(text: Column | str, dim: int, namespace: str = "tidemark-test") -> Column:
    """A deterministic unit vector of a text: no meaning, for tests and dry runs."""
    text = _col(text)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), i.cast("string"), F.lit(":"), text), 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64) * 2 - 1,
    )
    size = norm(raw)
    return F.transform(raw, lambda x: x / size)


def hashed_local(text: str, dim: int, namespace: str = "tidemark-test") -> list[float]:
    """The same vector for one text on the driver."""
    raw = [struct.unpack(">Q", sha256(f"{namespace}:{i}:{text}".encode()).digest()[:8])[0] / 2.0**64 * 2 - 1 for i in range(dim)]
    size = sqrt(sum(x * x for x in raw))
    return [x / size for x in raw]


def check_vector(value, dim: int = EMBED_DIM) -> list[float]:
    """Validate a query vector on the driver."""
    if not isinstance(value, list | tuple):
        raise QueryError("not a vector", code="invalid_embedding")
    if len(value) != dim:
        raise QueryError(f"expected {dim} components", code="embedding_dimension_mismatch")
    if any(isinstance(x, bool) or not isinstance(x, Real) or not isfinite(x) for x in value):
        raise QueryError("components must be finite numbers", code="invalid_embedding")
    return [float(x) for x in value]


def replay_key(model: Column | str, revision: Column | str, kind: Column | str, text: Column | str) -> Column:
    """Key of a stored vector: model digest, input kind, text digest."""
    return F.concat_ws(":", F.sha2(F.concat_ws("|", _col(model), _col(revision)), 256), _col(kind), F.sha2(_col(text), 256))
