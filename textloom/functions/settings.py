"""Settings that results depend on: their bounds, and a fingerprint to store with results."""

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 700
    chunk_overlap: int = 150
    least_chunk: int = 80
    top_k: int = 12
    floor: float = 0.425
    model: str = "hash-384"

    def __post_init__(self):
        if wrong := [why for bad, why in (
            (self.chunk_size <= 0, "chunk_size must be positive"), (not 0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be at least 0 and below chunk_size"),
            (not 0 <= self.least_chunk <= self.chunk_size, "least_chunk must be at least 0 and at most chunk_size"), (self.top_k < 1, "top_k must be at least 1"), (not -1 <= self.floor <= 1, "floor must be a cosine"),
        ) if bad]:
            raise ValueError("; ".join(wrong))

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def require(self, stored: str) -> None:
        """An index made under other settings is refused."""
        if stored != self.fingerprint():
            raise ValueError(f"stored results have settings {stored}, these are {self.fingerprint()}")
