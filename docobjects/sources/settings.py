"""Settings as a JSON file; what cannot be read counts as not set."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from enum import Enum


class ImageLimit(Enum):
    """How far images may shrink; stored by name."""

    SCREEN = 0
    DRAFT = 1
    STANDARD = 2
    FINE = 3
    ARCHIVE = 4


@dataclass
class Settings:
    reduce_images: bool = False
    image_limit: ImageLimit = ImageLimit.STANDARD
    jpeg_quality: int = 85

    def __post_init__(self):
        self.jpeg_quality = min(max(int(self.jpeg_quality), 50), 100)


def load(path: str) -> Settings:
    try:
        with open(path, encoding="utf-8") as source:
            raw = json.load(source)
        known = {f.name for f in fields(Settings)}
        values = {k: v for k, v in raw.items() if k in known}
        if "image_limit" in values:
            values["image_limit"] = ImageLimit[values["image_limit"]]
        return Settings(**values)
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return Settings()


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(asdict(settings) | {"image_limit": settings.image_limit.name}, out, indent=2)


def unused_name(candidate: str, taken: set[str]) -> str:
    """The name itself, or with ' (2)', ' (3)', ... before its extension, until it is free."""
    stem, dot, ext = candidate.rpartition(".")
    stem, ext = (stem, dot + ext) if dot else (candidate, "")
    out, n = candidate, 2
    while out in taken:
        out, n = f"{stem} ({n}){ext}", n + 1
    return out
