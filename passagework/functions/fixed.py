"""Fixed values that are part of the results: lists, limits, patterns and formats."""

from __future__ import annotations

# Suffix of a file -> its language.
LANGUAGE_OF_SUFFIX = {
    "c": "c",
    "cc": "cpp",
    "cfg": "ini",
    "cjs": "javascript",
    "cpp": "cpp",
    "cs": "csharp",
    "csv": "data",
    "cts": "typescript",
    "go": "go",
    "h": "c",
    "hpp": "cpp",
    "ini": "ini",
    "java": "java",
    "js": "javascript",
    "json": "json",
    "jsonl": "data",
    "jsx": "javascript",
    "kt": "kotlin",
    "lua": "lua",
    "markdown": "markdown",
    "md": "markdown",
    "mdx": "markdown",
    "mjs": "javascript",
    "mts": "typescript",
    "ndjson": "data",
    "parquet": "data",
    "pdf": "pdf",
    "php": "php",
    "ps1": "powershell",
    "py": "python",
    "rb": "ruby",
    "rs": "rust",
    "rst": "text",
    "scala": "scala",
    "sh": "bash",
    "sql": "sql",
    "swift": "swift",
    "toml": "toml",
    "ts": "typescript",
    "tsv": "data",
    "tsx": "tsx",
    "txt": "text",
    "yaml": "yaml",
    "yml": "yaml",
}
# Groups of languages.
PROSE = ("markdown", "pdf", "text")
WRITTEN_AS_MARKDOWN = ("data", "markdown", "pdf")
CONFIGURATION = ("ini", "json", "toml", "yaml")
CUT_BY_GRAMMAR = ("bash", "c", "cpp", "csharp", "go", "java", "javascript", "kotlin", "lua", "php", "ruby", "rust", "scala", "sql", "swift", "tsx", "typescript")
DATA_FORMATS = {"csv": "csv", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "tsv": "csv"}

# Folders that are never listed, and size limits of files in bytes.
SKIPPED_FOLDERS = (".git", ".mypy_cache", ".pytest_cache", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
MAX_FILE_BYTES = 1_000_000
MAX_PDF_BYTES = 50_000_000
BINARY_PROBE_BYTES = 8192

# Document types and the path words that make a test.
ARTICLE, DATASET, CONFIG_TYPE, TEST, SOURCE_CODE = "Article", "Dataset", "Configuration", "Test", "SoftwareSourceCode"
TEST_WORDS = ("__tests__", "conftest", "spec", "specs", "test", "testing", "tests")

# Lengths of chunks.
CHUNK_CHARS = 1500
PAGE_SIZE_OF_TABLES = 750

# Limits of links and of the search.
MAX_DEFINERS = 3
MAX_SHARED = 5
MAX_NAMED_FILES = 20
NEIGHBOUR_TERMS = 24
NEIGHBOUR_DEPTH = 50
NEIGHBOURS_A_SEED = 10
SEEDS = 5
POOL = 15
TOP = 5
EXPAND_LIMIT = 10
LINKS_A_HIT = 5
TYPE_MIN_P = 0.25
GREP_LINES = 50
SIMILAR_SHOWN = 3

# BM25.
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6

# Ranking passes.
PASSAGES_A_PASS = 15
STATE_CHARS = 26_000
QUERY_CHARS = 1500
OPTIONS = 512

# Content categories, in their order; the last keeps nothing.
CATEGORIES = ("Rule", "Procedure", "Reference", "Explanation", "Finding", "Record", "Other")
NO_CATEGORY = "Other"
KEEP_P = 0.5
# Least probability at which a category names a chunk, and the names.
CATEGORY_NOUN_AT = {"Finding": 0.8, "Procedure": 0.8, "Record": 0.7}
CATEGORY_NOUN = {"Finding": "finding", "Procedure": "steps", "Record": "record"}
TYPE_NOUN = {"Configuration": "config", "Dataset": "table", "SoftwareSourceCode": "code", "Test": "test"}

# Shapes of names in text (Java syntax; `W` is a Unicode word character).
W = r"\p{L}\p{N}_"
LEFT, RIGHT = rf"(?<![{W}])", rf"(?![{W}])"
SNAKE = LEFT + r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+" + RIGHT
CAMEL = LEFT + r"[a-z]+(?:[A-Z][a-z0-9]+)+" + RIGHT
PASCAL = LEFT + r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+" + RIGHT
TICKET = LEFT + r"[A-Z][A-Z0-9]+-\p{Nd}+" + RIGHT
DOTTED = LEFT + r"[a-z0-9_]+\.[a-z0-9_]+\.[a-z0-9_]+" + RIGHT
REPO_ITEM = LEFT + rf"[{W}.\-]+/[{W}.\-]+#\p{{Nd}}+" + RIGHT
TICKS = r"`([^`\n]{2,80})`"
NAME_IN_TICKS = rf"^[A-Za-z_@][{W}.\-/:@]*$"
QUOTED = rf"[\"']([A-Za-z_][{W}\-]*(?:[.\-][{W}\-]+)+)[\"']"
PYTHON_NAME = LEFT + r"[A-Za-z_][A-Za-z0-9_]{2,}" + RIGHT
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
# Letters that only Vietnamese writes.
VIETNAMESE = "đĐơƠưƯăĂ"
VIETNAMESE_RANGE = ("Ạ", "ỹ")
