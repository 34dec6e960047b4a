"""Languages by file suffix, and other fixed tables of the file filters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix -> language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "c_sharp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".r": "r",
    ".m": "objective_c",
    ".sh": "bash",
    ".bash": "bash",
    ".zsh": "bash",
    ".sql": "sql",
    ".html": "html",
    ".css": "css",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
    ".md": "markdown",
    ".rst": "rst",
}

#: Where this engine keeps its own tables inside a source tree.
HOME = ".quarry"

# Names of path parts that are never read, compared literally.
EXCLUDED_NAMES = (
    ".git",
    ".svn",
    ".hg",
    "__pycache__",
    "node_modules",
    ".venv",
    "venv",
    ".env",
    HOME,
    "dist",
    "build",
    ".pytest_cache",
    ".mypy_cache",
    ".ruff_cache",
    ".tox",
    "*.pyc",
    "*.pyo",
    "*.egg-info",
)

# Suffixes of binary files.
BINARY_SUFFIXES = (
    ".pyc",
    ".pyo",
    ".so",
    ".dll",
    ".dylib",
    ".exe",
    ".bin",
    ".dat",
    ".db",
    ".sqlite",
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".ico",
    ".pdf",
    ".zip",
    ".tar",
    ".gz",
    ".bz2",
    ".woff",
    ".woff2",
    ".ttf",
    ".eot",
)


def suffix(name: Column) -> Column:
    """The last suffix of a file name, lower-cased; a leading dot or a trailing one is none."""
    return F.lower(F.regexp_extract(name, r"^.*[^/](\.[^./]+)$", 1))


def language(name: Column) -> Column:
    """Language of a file name, or null."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(name)]
