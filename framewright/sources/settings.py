"""Settings: defaults, JSON files, cleaning, and options that override them."""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from ..functions.shapes import Shape
from ..operators.pixels import Enhancement, enhancement


def _held(value: float, lo: float, hi: float, default: float) -> float:
    return min(max(value if math.isfinite(value) else default, lo), hi)


@dataclass
class Detection:
    score_threshold: float = 0.9
    nms_threshold: float = 0.3
    top_k: int = 5000

    def clean(self) -> None:
        self.score_threshold = _held(self.score_threshold, 0.0, 1.0, 0.9)
        self.nms_threshold = _held(self.nms_threshold, 0.0, 1.0, 0.3)


@dataclass
class Input:
    width: int = 640
    height: int = 640
    resize_quality: str = "speed"

    def clean(self) -> None:
        self.width, self.height = self.width or 640, self.height or 640


@dataclass
class Metadata:
    mode: str = "preserve"
    include_crop_settings: bool = True
    include_quality_metrics: bool = True
    custom_tags: dict[str, str] = field(default_factory=dict)


@dataclass
class QualityRules:
    auto_select_best_face: bool = False
    min_quality: str | None = None
    auto_skip_no_high_quality: bool = False
    quality_suffix: bool = False


@dataclass
class Crop:
    preset: str = "linkedin"
    output_width: int = 400
    output_height: int = 400
    face_height_pct: float = 70.0
    positioning_mode: str = "center"
    vertical_offset: float = 0.0
    horizontal_offset: float = 0.0
    fill_color: tuple[int, int, int, int] = (0, 0, 0, 255)
    output_format: str = "png"
    jpeg_quality: int = 90
    png_compression: str = "default"
    webp_quality: int = 90
    auto_detect_format: bool = True
    metadata: Metadata = field(default_factory=Metadata)
    quality_rules: QualityRules = field(default_factory=QualityRules)
    shape: Shape = field(default_factory=Shape)
    vignette_softness: float = 0.0
    vignette_intensity: float = 1.0
    vignette_color: tuple[int, int, int, int] = (0, 0, 0, 255)
    eye_line_align: bool = False
    auto_orient_exif: bool = True

    def clean(self) -> None:
        self.shape = self.shape.sanitized()
        self.vignette_softness = _held(self.vignette_softness, 0.0, 1.0, 0.0)
        self.vignette_intensity = _held(self.vignette_intensity, 0.0, 1.0, 1.0)
        self.face_height_pct = _held(self.face_height_pct, 1.0, 100.0, 70.0)
        self.vertical_offset = _held(self.vertical_offset, -1.0, 1.0, 0.0)
        self.horizontal_offset = _held(self.horizontal_offset, -1.0, 1.0, 0.0)
        self.output_width, self.output_height = self.output_width or 512, self.output_height or 512


@dataclass
class BatchLog:
    enabled: bool = False
    format: str = "json"


@dataclass
class Settings:
    model_path: str | None = None
    input: Input = field(default_factory=Input)
    detection: Detection = field(default_factory=Detection)
    crop: Crop = field(default_factory=Crop)
    enhance: Enhancement = field(default_factory=lambda: Enhancement(unsharp_amount=0.0))
    telemetry_level: str = "debug"
    batch_logging: BatchLog = field(default_factory=BatchLog)
    batch_parallelism: int | None = None

    def clean(self) -> "Settings":
        self.input.clean()
        self.detection.clean()
        self.crop.clean()
        return self

    def parallelism(self) -> int:
        """Explicit, or half the cores but one to four."""
        if self.batch_parallelism is not None:
            return max(1, self.batch_parallelism)
        return min(max((os.cpu_count() or 1) // 2, 1), 4)


def _filled(kind: type, values: dict):
    """An instance of ``kind`` with known keys taken from ``values``, others ignored, the rest defaults."""
    base = kind()
    known = {f.name for f in fields(kind)}
    taken = {}
    for k, v in values.items():
        if k in known and v is not None:
            own = getattr(base, k)
            taken[k] = _filled(type(own), v) if is_dataclass(own) and isinstance(v, dict) else tuple(v) if isinstance(own, tuple) and isinstance(v, list) else v
    return replace(base, **taken)


def load(path: str) -> Settings:
    """From a JSON file, cleaned; keys that are absent or unknown are no error."""
    with open(path, encoding="utf-8") as f:
        return _filled(Settings, json.load(f)).clean()


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)


def apply_options(settings: Settings, options: dict) -> Settings:
    """Options over a file's settings.

    face_height_pct, the offsets, positioning_mode, output_format and jpeg_quality have defaults of their
    own, so they always replace what the file says.
    """
    out = _filled(Settings, asdict(settings))
    always = {"face_height_pct": 70.0, "horizontal_offset": 0.0, "vertical_offset": 0.0, "positioning_mode": "center", "output_format": "png", "jpeg_quality": 90}
    for k, v in (always | {k: v for k, v in options.items() if v is not None}).items():
        for part in (out.crop, out.crop.quality_rules, out.crop.metadata, out.detection, out.input, out):
            if hasattr(part, k):
                setattr(part, k, v)
                break
    low = options.get("skip_low_quality")
    if low is not None:
        out.crop.quality_rules.min_quality = "Medium" if low else None
    return out.clean()


def enhancement_from_options(options: dict) -> Enhancement | None:
    """Nothing unless enhance is set; then the preset and explicit values over it."""
    if not options.get("enhance"):
        return None
    known = {f.name for f in fields(Enhancement)}
    return enhancement(options.get("preset"), **{k: v for k, v in options.items() if k in known})


def parse_tags(texts: list[str]) -> dict[str, str]:
    """``key=value`` texts, trimmed; empty keys are ignored and later ones win."""
    out = {}
    for t in texts:
        key, _, value = t.partition("=")
        if key.strip():
            out[key.strip()] = value.strip()
    return dict(sorted(out.items()))
