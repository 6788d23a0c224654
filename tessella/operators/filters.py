"""File filters and predicates as Columns over paths and sizes; cheap ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.ignore import ignored
from tessella.functions.scalar import strip, suffix

# Directories, names, endings and suffixes of the default file filter.
IGNORED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "vendor", "dist", "build", "out", "target", "bin", "obj", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode", ".vs", ".next", ".nuxt",
]
GENERATED_ENDINGS = [".min.js", ".min.css", ".min.mjs", ".bundle.js", ".chunk.js"]
#: Compared with lower-cased names, so that those with capitals never match.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "Cargo.lock", "uv.lock"]
SUFFIXES = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".rs", ".go", ".c", ".h", ".cpp", ".hpp", ".cc", ".java", ".rb", ".php", ".swift", ".kt", ".scala",
    ".cs", ".lua", ".dart", ".sh", ".bash", ".zsh", ".md", ".txt", ".rst", ".org", ".tex", ".html", ".htm", ".xml", ".css", ".scss", ".json",
    ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env", ".csv", ".tsv", ".pdf", ".docx", ".pptx", ".xlsx", ".epub", ".rtf", ".png", ".jpg",
    ".jpeg", ".gif", ".bmp", ".tiff", ".webp", ".mp3", ".wav", ".flac", ".m4a", ".ogg", ".aac", ".mp4", ".mkv", ".avi", ".webm", ".mov",
    ".sql", ".graphql", ".proto",
]
MAX_BYTES = 5 * 1024 * 1024


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def visible(path: Column) -> Column:
    return ~name_of(path).startswith(".")


def in_kept_dirs(path: Column) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def not_generated(path: Column) -> Column:
    name = F.lower(name_of(path))
    ends = F.lit(False)
    for e in GENERATED_ENDINGS:
        ends = ends | name.endswith(e)
    return ~name.isin(LOCK_FILES) & ~ends


def supported(path: Column, suffixes: list[str] | None = None) -> Column:
    return suffix(path).isin([s.lower() for s in (SUFFIXES if suffixes is None else suffixes)])


def sized(size: Column, most: int = MAX_BYTES) -> Column:
    return (size > 0) & (size <= most)


def not_blank(text: Column) -> Column:
    return strip(text) != ""


def should_index(path: Column, size: Column, patterns: list[str] | None = None, suffixes: list[str] | None = None, most: int = MAX_BYTES) -> Column:
    """All layers of the file filter; paths are relative to the folder that `patterns` (lines of ignore files) come from."""
    lines = [*(patterns or []), *[f"**/{d}/" for d in IGNORED_DIRS]]
    return sized(size, most) & visible(path) & in_kept_dirs(path) & not_generated(path) & supported(path, suffixes) & ~ignored(path, lines)


def dir_allowed(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a walk enters a directory; dot directories outside the list are entered."""
    inside = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    lines = [*(patterns or []), *[f"**/{d}/" for d in IGNORED_DIRS]]
    return ~F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1).isin(IGNORED_DIRS) & ~ignored(inside, lines)


def of_types(path: Column, types: str) -> Column:
    """Of results: whether the path ends with one of the comma-separated types (with or without dot, case counts)."""
    out = F.lit(False)
    for t in types.split(","):
        t = t.strip()
        out = out | path.endswith(t if t.startswith(".") else f".{t}")
    return out


#: Messages that are critical by themselves, and what they are called. The first that matches counts.
CRITICAL = [
    ("Out of memory", "oom"),
    ("OOM killer", "oom"),
    ("segfault", "segfault"),
    ("kernel panic", "kernel_panic"),
    ("Connection refused", "connection_refused"),
    ("Permission denied", "permission_denied"),
    ("service failed", "service_failed"),
    ("disk full", "disk_full"),
    ("No space left on device", "disk_full"),
]


def critical_label(message: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """The label of the first pattern that a message matches in any case, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(CRITICAL if patterns is None else patterns):
        out = F.when(message.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def tier(value: Column, warn: float = 80.0, critical: float = 90.0) -> Column:
    return F.when(value >= critical, F.lit("critical")).when(value >= warn, F.lit("warning"))


def find_tools(tools: DataFrame, capability: str | None = None, name: str | None = None) -> DataFrame:
    """Rows of (name, capabilities, …) whose name holds `name` and that can do `capability`."""
    if name:
        tools = tools.where(F.contains("name", F.lit(name)))
    return tools.where(F.array_contains("capabilities", capability)) if capability else tools
