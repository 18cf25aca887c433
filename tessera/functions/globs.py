"""Path patterns and file selection: patterns compile to regular expressions once, and match in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an index of source files takes and leaves out by default.
HARD_DIRS = (".git", "graphify-out")
NOISE_DIRS = ("node_modules", "vendor")
DOC_NOISE_DIRS = ("testdata", "test", "tests", "mock", "mocks", "__mocks__", "fixtures", "node_modules", "vendor", "dist", "build", ".git")
DOC_EXTENSIONS = ("go", "py", "js", "jsx", "ts", "tsx", "java", "kt", "rb", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "php", "swift", "scala", "m", "mm", "sh", "sql")
EXTENSIONS = (*DOC_EXTENSIONS, "svelte", "vue", "lua", "zig", "ex", "exs")
NAMES = ("go.mod", "go.sum", "dockerfile", "makefile", "gemfile", "rakefile", "cargo.toml", "cargo.lock", "package.json", "pyproject.toml", "requirements.txt")
DEPLOY = ("compose", "docker-compose", "docker-stack", "values", "chart", ".gitlab-ci")
MOST_BYTES = 512 * 1024


def _segment(glob: str) -> str:
    """One path segment's pattern: * and ? stay within it, [..] as usual."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def path_regex(glob: str, deep: bool = True) -> str:
    """A whole path's pattern; ``**`` stands for any number of segments if ``deep``."""
    parts, out = glob.split("/"), ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if deep and p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(p) + ("" if last else "/")
    return f"^{out}$"


def any_glob(path: Column, globs: list[str], deep: bool = True) -> Column:
    """A pattern ``x/`` takes all below x; others match the whole path or, without a slash, its last part."""
    out = F.lit(False)
    base = F.element_at(F.split(path, "/"), -1)
    for g in globs:
        if g.endswith("/"):
            out = out | path.rlike(path_regex(g.rstrip("/"), deep)[:-1] + "/")
        else:
            out = out | path.rlike(path_regex(g, deep))
            if "/" not in g:
                out = out | base.rlike(path_regex(g, deep))
    return out


def ignored(path: Column, globs: list[str]) -> Column:
    """A pattern that matches the path, its last part, any segment or any leading part leaves it out."""
    out = F.lit(False)
    for g in globs:
        p = path_regex(g.strip("/"))[1:-1]
        out = out | path.rlike(f"^{p}(/|$)")
        if "/" not in g.strip("/"):
            out = out | path.rlike(f"(^|/){p}(/|$)")
    return out


def deploy_config(path: Column) -> Column:
    """YAML of workflows, or whose name is one of the families, alone or before '.' or '-'; case does not matter."""
    names = "|".join(map(re.escape, DEPLOY))
    return path.rlike(r"(?i)(^|/)\.github/workflows/.*\.ya?ml$") | path.rlike(rf"(?i)(^|/)(?:{names})(?:[.-][^/]*)?\.ya?ml$")


def built_in(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_extract(base, r"\.([^.]*)$", 1).isin(*extensions) | base.isin(*NAMES) | deploy_config(path)


def test_file(path: Column) -> Column:
    """Names by which languages tell tests; case does not matter."""
    return F.lower(path).rlike(r"(_test\.(go|py)|(^|/)test_[^/]*\.py|\.(test|spec)\.[jt]sx?|tests?\.(java|kt|cs|scala))$")


def _below(path: Column, dirs: tuple[str, ...]) -> Column:
    names = "|".join(map(re.escape, dirs))
    return path.rlike(rf"(^|/)({names})/")


def _excluded_dir(path: Column, exclude: list[str], deep: bool) -> Column:
    """Whether some folder above the path is excluded as a folder."""
    out = F.lit(False)
    for g in exclude:
        out = out | path.rlike(path_regex(g.rstrip("/"), deep)[:-1] + "/")
    return out


def selected(path: Column, size: Column, include: list[str] = (), include_extra: list[str] = (), exclude: list[str] = (), skip_dirs: list[str] = ()) -> Column:
    """Code files to index: not too large, not in a noise folder, not excluded, and included.

    ``include_extra`` adds to, ``include`` replaces, the built-in choice, and takes off the
    rule on noise folders; exclusion wins. ``skip_dirs``: folders of generated documents.
    """
    wanted = any_glob(path, list(include)) if include else built_in(path) & ~_below(path, NOISE_DIRS)
    extra = any_glob(path, list(include_extra)) if include else any_glob(path, list(include_extra)) & ~_below(path, NOISE_DIRS)
    gone = any_glob(path, list(exclude)) | _excluded_dir(path, list(exclude), True)
    return (size <= MOST_BYTES) & ~_below(path, (*HARD_DIRS, *skip_dirs)) & ~gone & (extra | wanted)


def selected_docs(path: Column, include: list[str] = (), include_extra: list[str] = (), exclude: list[str] = (), skip_dirs: list[str] = ()) -> Column:
    """Files to write documents about: tests and noise folders only if asked for; no ``**`` here, and no size limit."""
    wanted = any_glob(path, list(include_extra), deep=False) | (any_glob(path, list(include), deep=False) if include else built_in(path, DOC_EXTENSIONS))
    if not include:
        wanted = wanted & ~test_file(path) & ~_below(F.lower(path), DOC_NOISE_DIRS)
    gone = any_glob(path, list(exclude), deep=False) | _excluded_dir(path, list(exclude), False)
    return ~_below(path, (*HARD_DIRS, *skip_dirs)) & wanted & ~gone
