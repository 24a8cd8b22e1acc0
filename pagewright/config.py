"""Settings as frozen values: used when a plan is built, never data in it."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

MIB = 1 << 20
MODES = ("raw", "structured", "semantic", "table", "form", "complete")
CONTENT_TYPES = ("text", "image", "vector", "form", "table", "annotation", "structural")
LOG_LEVELS = ("debug", "info", "warn", "error")
MAX_TEXT_BYTES = 10 * MIB
MAX_FILE_SIZE_LIMIT = 1 << 30
PAGE_BREAK = "\n\n--- Page Break ---\n\n"


@dataclass(frozen=True)
class Layout:
    """Estimated geometry of text lines, in points."""

    left: float = 72.0
    right: float = 540.0
    first_baseline: float = 720.0
    first_top: float = 732.0
    pitch: float = 12.0
    font_size: float = 12.0
    line_confidence: float = 0.8
    word_confidence: float = 0.7

    @property
    def width(self) -> float:
        return self.right - self.left


@dataclass(frozen=True)
class TableRules:
    """Table inference.  ``scope`` says whether rows of all pages of a document are pooled."""

    threshold: float = 0.7
    least_confidence: float = 0.5
    row_tolerance: float = 5.0
    least_elements: int = 4
    least_rows: int = 2
    scope: str = "document"

    def __post_init__(self) -> None:
        if self.scope not in ("document", "page"):
            raise ValueError("scope must be 'document' or 'page'")


@dataclass(frozen=True)
class ExtractConfig:
    """What ``extract`` builds.  Page numbers keep their order and repetitions."""

    mode: str = "structured"
    text: bool = True
    images: bool = True
    vectors: bool = False
    forms: bool = False
    annotations: bool = True
    coordinates: bool = True
    pages: tuple[int, ...] = ()
    strict: bool = False
    layout: Layout = Layout()
    tables: TableRules = TableRules()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

    @property
    def by_line(self) -> bool:
        """Lines and words; otherwise one element a page.  Table mode needs lines unless strict."""
        return self.mode in ("structured", "complete") or (self.mode == "table" and not self.strict)

    @property
    def finds_tables(self) -> bool:
        return self.mode in ("table", "complete")


@dataclass(frozen=True)
class Box:
    llx: float
    lly: float
    urx: float
    ury: float


@dataclass(frozen=True)
class Query:
    """Conjunction of conditions on elements; an empty one does not filter.

    ``properties`` is accepted for completeness and has no effect.
    """

    types: tuple[str, ...] = ()
    pages: tuple[int, ...] = ()
    box: Box | None = None
    text: str = ""
    min_confidence: float = 0.0
    properties: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Query:
        """A query from a JSON object; text that is no object searches for itself."""
        import json

        try:
            got = json.loads(text)
        except ValueError:
            got = None
        if not isinstance(got, dict):
            return cls(text=text)
        box = got.get("box")
        return cls(tuple(got.get("types", ())), tuple(got.get("pages", ())), Box(*box) if box else None, got.get("text", ""), got.get("min_confidence", 0.0), got.get("properties", {}))


@dataclass(frozen=True)
class Settings:
    """Service settings; a flag wins over the environment, that over the default."""

    mode: str = "stdio"
    host: str = "127.0.0.1"
    port: int = 8080
    dir: str = "."
    log_level: str = "info"
    max_file_size: int = 100 * MIB

    @classmethod
    def load(cls, flags: Mapping[str, object] | Sequence[str] = (), env: Mapping[str, str] | None = None, prefix: str = "PAGEWRIGHT") -> Settings:
        env = os.environ if env is None else env
        if not isinstance(flags, Mapping):
            flags = dict(f.removeprefix("--").split("=", 1) for f in flags)
        out = cls()
        for f in fields(cls):
            dashed = f.name.replace("_", "-")
            value = flags.get(dashed, flags.get(f.name, env.get(f"{prefix}_{f.name.upper()}")))
            if value is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(value)})
        return out.validated()

    @classmethod
    def from_spark(cls, spark) -> Settings:
        """From the session's ``spark.pagewright.*`` entries."""
        names = [f.name.replace("_", "-") for f in fields(cls)]
        got = {n: spark.conf.get(f"spark.pagewright.{n}", None) for n in names}
        return cls.load({k: v for k, v in got.items() if v is not None}, env={})

    def validated(self) -> Settings:
        if self.mode not in ("stdio", "server"):
            raise ValueError("mode must be either 'stdio' or 'server'")
        if self.mode == "server" and not 1 <= self.port <= 65535:
            raise ValueError("port must be between 1 and 65535")
        if not self.dir:
            raise ValueError("PDF directory cannot be empty")
        if self.max_file_size <= 0:
            raise ValueError("maximum file size must be positive")
        if self.log_level not in LOG_LEVELS:
            raise ValueError(f"invalid log level: {self.log_level} (must be one of: {', '.join(LOG_LEVELS)})")
        return self


def check_file_limit(max_file_size: int) -> int:
    if max_file_size <= 0:
        raise ValueError("maxFileSize must be greater than 0")
    if max_file_size > MAX_FILE_SIZE_LIMIT:
        raise ValueError("maxFileSize cannot exceed 1GB")
    return max_file_size
