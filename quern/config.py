"""Settings of the data-reduction operators, passed explicitly."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkParams:
    """Content-defined chunk sizes in bytes."""

    least: int = 64
    normal: int = 256
    most: int = 1024
    gear_seed: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.normal <= self.most:
            raise ValueError("0 < least <= normal <= most must hold")

    @property
    def strict_until(self) -> int:
        """Where the strict mask gives way to the loose one."""
        off = min(self.least + -(-self.least // 2), self.normal)
        return min(self.normal - off, self.most)

    def _mask(self, bits: int) -> int:
        return (1 << max(1, min(bits, 31))) - 1

    @property
    def bits(self) -> int:
        return round(math.log2(self.normal))

    @property
    def strict_mask(self) -> int:
        return self._mask(self.bits + 1)

    @property
    def loose_mask(self) -> int:
        return self._mask(self.bits - 1)


#: Sizes for whole backups.
BACKUP = ChunkParams(4096, 8192, 16384)


@dataclass(frozen=True)
class SketchParams:
    """Super-features: `groups` sub-chunk groups of `supers` sub-chunks each."""

    supers: int = 3
    groups: int = 4
    window: int = 48
    polynomial: int = 0xBFE6B8A5BF378D83  # fixed value

    @property
    def subchunks(self) -> int:
        return self.supers * self.groups


@dataclass(frozen=True)
class ReductionConfig:
    chunker: str = "cdc"  # or "fixed", with chunks of chunk.normal bytes
    chunk: ChunkParams = field(default_factory=ChunkParams)
    sketch: SketchParams = field(default_factory=SketchParams)
    container_bytes: int = 4 << 20
    read_bytes: int = 128 << 20  # files are read in parts of so many bytes; no chunk spans two
    secret: bytes = b"\x01" * 32
    zstd_level: int = -1
    most_padding: int = 255
    salt: bytes = b"elc"  # of the random padding of method elc; one for each run makes runs differ
    keep_versions: int = 1
    greedy_rounds: int = 8
    group_rows: int = 100_000  # chunks of a component that one task walks

    def __post_init__(self) -> None:
        if self.chunker not in ("cdc", "fixed"):
            raise ValueError(f"no chunker {self.chunker!r}")


def from_json(text: str) -> ReductionConfig:
    """Settings from a nested JSON document; what it leaves out keeps its default."""
    import json

    d = json.loads(text)
    c, s = d.get("chunk", {}), d.get("sketch", {})
    rest = {k: v for k, v in d.items() if k not in ("chunk", "sketch", "secret")}
    if "secret" in d:
        rest["secret"] = bytes.fromhex(d["secret"])
    return ReductionConfig(chunk=ChunkParams(**c), sketch=SketchParams(**s), **rest)
