"""Options of a store and their validation; and how deployment properties map to them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from .functions.numbers import bloom_bits_per_key
from .operators.compaction import parse_style


@dataclass(frozen=True)
class Options:
    """Sizes are in versions, times in milliseconds.

    flush_rows: unflushed versions that start a flush. block_rows: rows of a page of a generation. l0_trigger: level-0
    generations that start a compaction. l0_stop: those at which a write compacts first, waits (stall_ms) and tries
    again (stall_retries). bloom, bloom_bits: whether generations have Bloom filters on key, and their bits a key.
    cache_entries: keys whose newest version point reads keep. cleanup_ms: period of the background cleanup. slow_ms:
    what a slow read or scan takes at least.
    """

    flush_rows: int = 4096
    block_rows: int = 128
    l0_trigger: int = 4
    l0_stop: int = 16
    bloom_bits: int = 10
    bloom: bool = True
    cache_entries: int = 1024
    stall_ms: int = 10
    stall_retries: int = 100
    cleanup_ms: int = 3000
    slow_ms: int = 20
    scan_limit: int = 100
    style: str = "leveled"

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            least = 2 if f.name.startswith("l0_") else 1
            if f.type == "int" and value < least:
                raise ValueError(f"{f.name} must be at least {least}")
        if self.l0_stop < self.l0_trigger:
            raise ValueError("l0_stop must not be less than l0_trigger")
        object.__setattr__(self, "style", parse_style(self.style))


#: The defaults of deployment properties.
PROPERTIES = {"memtable-max-entries": 10000, "scan-default-limit": 100, "cache-max-entries": 4096, "bloom-enabled": True, "bloom-false-positive-rate": 0.01, "l0-compaction-trigger": 4, "l0-max-files": 16, "flush-batch-size": 1000, "tombstone-retention-seconds": 3600, "compaction-style": "leveled"}


def from_properties(given: Mapping | None = None) -> Options:
    p = PROPERTIES | dict(given or {})
    return Options(
        flush_rows=int(p["memtable-max-entries"]),
        block_rows=max(32, int(p["flush-batch-size"])),
        l0_trigger=int(p["l0-compaction-trigger"]),
        l0_stop=max(int(p["l0-max-files"]), int(p["l0-compaction-trigger"]) + 1),
        bloom_bits=bloom_bits_per_key(float(p["bloom-false-positive-rate"])),
        cache_entries=int(p["cache-max-entries"]),
        bloom=str(p["bloom-enabled"]).lower() == "true",
        cleanup_ms=max(1000, int(p["tombstone-retention-seconds"]) * 1000),
        scan_limit=int(p["scan-default-limit"]),
        style=p["compaction-style"],
    )


def override(defaults: Mapping, *sources: Mapping) -> dict:
    """Values by name, the first source that has one deciding; names also in upper case with underscores."""
    out = dict(defaults)
    for name in out:
        for source in sources:
            found = [source[n] for n in (name, name.upper().replace("-", "_").replace(".", "_")) if n in source]
            if found:
                out[name] = found[0]
                break
    return out
