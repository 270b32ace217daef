"""Paths, addresses and languages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by suffix and by file name; what a scan leaves out.
LANGUAGE_OF_SUFFIX = {
    ".py": "Python", ".java": "Java", ".js": "JavaScript", ".jsx": "JavaScript JSX", ".ts": "TypeScript", ".tsx": "TypeScript TSX",
    ".c": "C", ".h": "C Header", ".cpp": "C++", ".cc": "C++", ".hpp": "C++ Header", ".cs": "C#", ".go": "Go", ".rs": "Rust",
    ".php": "PHP", ".rb": "Ruby", ".kt": "Kotlin", ".kts": "Kotlin Script", ".swift": "Swift", ".html": "HTML", ".htm": "HTML",
    ".jsp": "JSP", ".css": "CSS", ".scss": "SCSS", ".md": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".xml": "XML", ".sql": "SQL", ".sh": "Shell", ".toml": "TOML",
}
LANGUAGE_OF_NAME = {
    "Dockerfile": "Dockerfile", "Makefile": "Makefile", "requirements.txt": "Python Requirements",
    "pyproject.toml": "Python Project Configuration", "Pipfile": "Python Pipfile", "package.json": "Node Package Configuration",
    "tsconfig.json": "TypeScript Configuration", "pom.xml": "Maven Configuration", "build.gradle": "Gradle Configuration",
    "build.gradle.kts": "Gradle Kotlin Configuration", "settings.gradle": "Gradle Configuration",
    "settings.gradle.kts": "Gradle Kotlin Configuration", "docker-compose.yml": "Docker Compose", "docker-compose.yaml": "Docker Compose",
}
IGNORED_FOLDERS = (
    ".git", ".github", ".idea", ".vscode", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "target",
    "coverage", ".next", ".nuxt", ".cache", ".pytest_cache", ".mypy_cache", ".gradle", "bin", "obj", "vendor",
)
IGNORED_NAMES = (
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "composer.lock", "poetry.lock",
)
IGNORED_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".pdf", ".zip", ".rar", ".7z", ".tar", ".gz", ".exe", ".dll",
    ".so", ".dylib", ".class", ".jar", ".war", ".mp3", ".mp4", ".avi", ".mov", ".pem", ".key", ".crt",
)
HOSTS = ("github.com", "www.github.com")
CODE_LANGUAGES = (
    "Python", "Java", "JavaScript", "JavaScript JSX", "TypeScript", "TypeScript TSX", "C", "C Header", "C++", "C++ Header",
    "C#", "Go", "Rust", "PHP", "Ruby", "Kotlin", "Kotlin Script", "Swift", "Shell",
)
STRUCTURED_LANGUAGES = (
    "Docker Compose", "Dockerfile", "Gradle Configuration", "Gradle Kotlin Configuration", "HTML", "JSP", "JSON", "Makefile",
    "Markdown", "Maven Configuration", "Node Package Configuration", "Python Pipfile", "Python Project Configuration",
    "Python Requirements", "SCSS", "CSS", "SQL", "TOML", "TypeScript Configuration", "XML", "YAML",
)
COHESIVE_TYPES = {
    "Dockerfile": "dockerfile", "Gradle Configuration": "gradle_configuration", "Gradle Kotlin Configuration": "gradle_kotlin_configuration",
    "Makefile": "makefile", "Python Requirements": "python_requirements",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix of the file name in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), "(?<=.)(\\.[^.]+)$", 1))


def ignored(path: Column) -> Column:
    """One of the parent folders, the name or the suffix is on its list."""
    parts = F.split(path, "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(parents, F.array(*map(F.lit, IGNORED_FOLDERS))) | file_name(path).isin(*IGNORED_NAMES) | suffix(path).isin(*IGNORED_SUFFIXES)


def language(path: Column) -> Column:
    """By exact file name, else by suffix, else null."""
    return F.coalesce(F.element_at(literal_map(LANGUAGE_OF_NAME), file_name(path)), F.element_at(literal_map(LANGUAGE_OF_SUFFIX), suffix(path)))


def supports_chunking(lang: Column) -> Column:
    return F.coalesce(lang.isin(*CODE_LANGUAGES, *STRUCTURED_LANGUAGES), F.lit(False))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")


def repository_of(url: Column) -> Column:
    """Struct (url, owner, name): closing slashes are left out, and .git of the name."""
    bare = F.rtrim(url, F.lit("/"))
    parts = path_parts(bare)
    return F.struct(bare.alias("url"), F.get(parts, F.lit(0)).alias("owner"), F.regexp_replace(F.get(parts, F.lit(1)), "(?i)\\.git$", "").alias("name"))


def repository_url_valid(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*HOSTS), F.lit(False)) & (F.size(path_parts(url)) == 2)


def id_valid(value: Column, kind: str) -> Column:
    return F.coalesce(value.rlike(f"^{kind}_[a-f0-9]{{8}}$"), F.lit(False))
