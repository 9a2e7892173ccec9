"""File trees: which files are kept, how a tree is drawn, and how a project is packed into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import basename

# Folders that are left out, file names that are kept, extensions that are kept.
EXCLUDED = [".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "venv", ".venv", "env", ".env", "dist", "build", ".next", ".cache", "__pycache__", ".pytest_cache", "coverage"]
KEPT_NAMES = ["Dockerfile", "Makefile"]
KEPT = [
    ".txt", ".md", ".rst", ".py", ".ipynb", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".json", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".conf", ".env", ".sample",
    ".html", ".htm", ".css", ".scss", ".less", ".svg", ".xml", ".java", ".kt", ".kts", ".groovy", ".gradle", ".go", ".rs", ".rb", ".php", ".c", ".h", ".cpp",
    ".hpp", ".cc", ".hh", ".sql", ".ps1", ".bat", ".cmd", ".sh", ".zsh", ".fish", ".make", ".mk", ".dockerfile", ".tf", ".tfvars",
]
BORDER = "=" * 80
# The headings of a packed text.
TREE_HEADING, FILES_HEADING = "# CÂY THƯ MỤC", "# NỘI DUNG CÁC FILE (text/code)"
MAX_BYTES, SNIFFED, MOST_ODD = 1_000_000, 4096, 0.30


def probably_binary(content: Column) -> Column:
    """Whether the first 4096 bytes hold a NUL, or more than 30 % of them are no text; empty is text, null binary."""
    head = F.hex(F.substring(content, 1, SNIFFED))
    n = F.length(head) / 2
    # Pairs of digits outside 07-0A, 0C, 0D, 1B and 20-FF; matching by pairs keeps to whole bytes.
    odd = F.length(F.regexp_replace(head, "(0[789ACD]|1B|[2-9A-F][0-9A-F])|([01][0-9A-F])", "$2")) / 2
    nul = F.regexp_like(head, F.lit("^([0-9A-F]{2})*?00"))
    return F.coalesce(nul | F.coalesce(odd / F.nullif(n, F.lit(0)) > MOST_ODD, F.lit(False)), F.lit(True))


def hidden(path: Column) -> Column:
    """Whether any part of the path begins with a dot."""
    return F.regexp_like(path, F.lit(r"(^|/)\."))


def excluded(path: Column) -> Column:
    """Whether the path lies in a folder that is left out."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED)))


def keep_file(path: Column, include_env: bool = True) -> Column:
    """Files of kept names, and of kept extensions as they stand after the last dot but the first character."""
    base = basename(path)
    ext = F.lower(F.regexp_extract(base, r"(?<=[^.])(\.[^.]*)$", 1))
    exts = [e for e in KEPT if include_env or e != ".env"]
    return base.isin(KEPT_NAMES) | ext.isin(exts)


def listed(df: DataFrame, path: str = "path", include_hidden: bool = False) -> DataFrame:
    """Files of a listing that a walk would reach."""
    rows = df.where(~excluded(F.col(path)))
    return rows if include_hidden else rows.where(~hidden(F.col(path)))


def tree(df: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """(root, tree): folders and files of each root, four spaces a level; folders of the first level stand at the
    root's own indent. A folder's files come right after it, then its folders by name."""
    files = df.select(F.col(root).alias("r"), F.split(F.col(path), "/").alias("p"))
    dirs = files.select("r", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda n: F.slice("p", 1, n))).alias("d")).distinct()
    # Files sort before folders of one folder: parts of a folder's path are marked with 1, the file itself with 0.
    mark = lambda parts: F.transform(parts, lambda x: F.concat(F.lit("1"), x))
    depth = F.greatest(F.size("d") - 1, F.lit(0))
    folders = dirs.select("r", mark(F.col("d")).alias("key"), F.concat(F.repeat(F.lit("    "), depth), F.when(F.size("d") > 0, F.try_element_at("d", F.lit(-1))).otherwise(F.col("r")), F.lit("/")).alias("line"))
    own = F.slice("p", 1, F.size("p") - 1)
    leaves = files.select("r", F.concat(mark(own), F.array(F.concat(F.lit("0"), F.element_at("p", -1)))).alias("key"), F.concat(F.repeat(F.lit("    "), F.greatest(F.size("p") - 2, F.lit(0)) + 1), F.element_at("p", -1)).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("key", "line")))
    return folders.union(leaves).groupBy("r").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("tree")).withColumnRenamed("r", root)


def pack(df: DataFrame, root: str = "root", path: str = "path", text: str = "text") -> DataFrame:
    """(root, packed): the tree, then the text of each kept file under its name. df: (root, path, size, binary, text)."""
    seen = listed(df, path)
    head = F.concat(F.lit(f"{BORDER}\nPROJECT ROOT: "), F.col(root), F.lit(f"\n{BORDER}\n\n{TREE_HEADING}\n\n"), F.col("tree"), F.lit(f"\n\n{BORDER}\n{FILES_HEADING}\n{BORDER}\n\n"))
    kept = seen.where(keep_file(F.col(path)) & (F.col("size") <= MAX_BYTES) & ~F.col("binary"))
    parts = F.split(F.col(path), "/")
    key = F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("1"), x)), F.array(F.concat(F.lit("0"), F.element_at(parts, -1))))
    section = F.concat(F.lit(f"{BORDER}\n# FILE: "), F.col(path), F.lit(f"\n{BORDER}\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n\n"))
    bodies = kept.select(root, key.alias("key"), section.alias("s")).groupBy(root).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "s"))), lambda x: x["s"]), "").alias("body"))
    return tree(seen, root, path).join(bodies, root, "left").select(root, F.concat(head, F.coalesce("body", F.lit(""))).alias("packed"))
