"""Settings from a small JSON file, and what of them a store, a connection and cleanup take."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

#: Fixed value: a longer file is refused.
MOST_BYTES = 1024


@dataclass(frozen=True)
class WorkerPool:
    """Spark schedules tasks; these feed the scale-out rule only."""

    min_workers: int = 1
    max_workers: int = 8
    idle_timeout_seconds: int = 5
    task_wait_threshold_us: int = 800


@dataclass(frozen=True)
class Memtable:
    max_size: int = 2_621_440
    max_level: int = 8


@dataclass(frozen=True)
class SSTable:
    block_size: int = 4096
    bloom_bits_per_key: int = 10


@dataclass(frozen=True)
class Cache:
    size: int = 32


@dataclass(frozen=True)
class Tiered:
    max_level: int = 6
    level_multiplier: int = 2
    level_threshold: int = 4


@dataclass(frozen=True)
class Compaction:
    tiered: Tiered = field(default_factory=Tiered)


@dataclass(frozen=True)
class Cleanup:
    interval_seconds: int = 60
    file_count_threshold: int = 5


@dataclass(frozen=True)
class Settings:
    data_folder: str | None = None
    worker_pool: WorkerPool = field(default_factory=WorkerPool)
    memtable: Memtable = field(default_factory=Memtable)
    sstable: SSTable = field(default_factory=SSTable)
    sstable_cache: Cache = field(default_factory=Cache)
    compaction: Compaction = field(default_factory=Compaction)
    cleanup: Cleanup = field(default_factory=Cleanup)
    max_connections: int = 128
    batch_response_limit: int = 512

    def store(self) -> dict[str, int]:
        """Arguments of a Store."""
        tiered = self.compaction.tiered
        return {"fan_in": tiered.level_multiplier, "threshold": tiered.level_threshold, "max_level": tiered.max_level, "delta_bytes": self.memtable.max_size}


def parse(text: str) -> Settings:
    """Settings of a JSON object; parts left out keep their defaults. Unknown names, wrong types, negative numbers and
    texts of more than MOST_BYTES raise ValueError."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError(f"settings have more than {MOST_BYTES} bytes")
    return _build(Settings, json.loads(text), "settings")


def _build(cls: type, given: object, where: str):
    if not isinstance(given, dict):
        raise ValueError(f"{where} must be an object")
    defaults, values = cls(), {}
    if unknown := given.keys() - {f.name for f in dataclasses.fields(cls)}:
        raise ValueError(f"{where} has unknown names: {sorted(unknown)}")
    for name, value in given.items():
        default = getattr(defaults, name)
        if dataclasses.is_dataclass(default):
            values[name] = _build(type(default), value, f"{where}.{name}")
        elif name == "data_folder":
            if value is not None and not isinstance(value, str):
                raise ValueError(f"{where}.{name} must be a text")
            values[name] = value
        elif isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ValueError(f"{where}.{name} must be a number from 0 on")
        else:
            values[name] = value
    return cls(**values)
