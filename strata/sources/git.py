"""Git repositories as sources of entries. The runner is the only seam to a process."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from strata import schemas

SUPPORTED = (".rs", ".py", ".ts", ".tsx")
Runner = Callable[[list[str], str, bytes | None], bytes]


class GitError(RuntimeError):
    """A git command that failed."""


def system_git(arguments: list[str], cwd: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", *arguments], cwd=cwd, input=stdin, capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def is_supported(path: str) -> bool:
    return path.endswith(SUPPORTED) or path.rsplit("/", 1)[-1] == "Cargo.toml"


def is_missing_path(detail: str) -> bool:
    """Whether git's message says that a revision lacks a path, rather than that the revision or the repository is at fault."""
    said = ("' does not exist in '", "' exists on disk, but not in '")
    return any(line.strip().startswith("fatal: path '") and any(x in line for x in said) for line in detail.splitlines())


class Repository:
    def __init__(self, path: str, run: Runner = system_git):
        self._run = run
        self.root = run(["rev-parse", "--show-toplevel"], path, None).decode().strip()

    def git(self, *arguments: str, stdin: bytes | None = None) -> bytes:
        return self._run(list(arguments), self.root, stdin)

    def resolve(self, revision: str) -> str:
        return self.git("rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()

    def history(self, revision: str, count: int) -> list[str]:
        """Up to ``count`` first-parent commits, oldest first."""
        if not 1 <= count <= 100:
            raise ValueError("count must lie between 1 and 100")
        return self.git("rev-list", "--first-parent", f"--max-count={count}", revision).decode().split()[::-1]

    def files(self, revision: str) -> list[tuple[str, str, int, str]]:
        """``(path, kind, mode, object)`` of supported files at a revision."""
        out = []
        for row in self.git("ls-tree", "-r", "-z", "--full-tree", revision).decode("utf-8", "surrogateescape").split("\0"):
            if row:
                head, path = row.split("\t", 1)
                mode, kind, blob = head.split(" ")
                if is_supported(path):
                    out.append((path, "symlink" if mode == "120000" else "file" if kind == "blob" else "submodule", int(mode, 8), blob))
        return out

    def blobs(self, ids: list[str]) -> Iterator[tuple[str, bytes]]:
        """Contents of objects, by one process for all."""
        data = self.git("cat-file", "--batch", stdin="\n".join(ids).encode() + b"\n") if ids else b""
        at = 0
        while at < len(data):
            end = data.index(b"\n", at)
            name, _, size = data[at:end].decode().partition(" blob ")
            if not size:
                raise GitError(f"missing object {name}")
            yield name, data[end + 1 : end + 1 + int(size)]
            at = end + 2 + int(size)

    def blob(self, revision: str, path: str) -> bytes | None:
        """The contents of a path at a revision; None if the revision has no such path, any other failure raises."""
        if path.startswith("/") or "\\" in path or not all(part not in ("", ".", "..") for part in path.split("/")):
            raise ValueError(f"no relative path: {path!r}")
        try:
            return self.git("cat-file", "-p", f"{revision}:{path}")
        except GitError as error:
            if is_missing_path(str(error)):
                return None
            raise

    def churn(self, revision: str, count: int) -> list[tuple[str, int]]:
        """``(commit, added and deleted lines)`` of up to ``count`` first-parent commits, merges left out, newest first; binary files count 0."""
        rows = self.git("log", "--first-parent", "--no-merges", f"--max-count={count}", "--numstat", "--format=%x00%H", revision).decode("utf-8", "replace")
        out = []
        for part in rows.split("\0")[1:]:
            commit, *files = part.strip().split("\n")
            numbers = [n for line in files if line for n in line.split("\t")[:2]]
            out.append((commit, sum(int(n) for n in numbers if n.isdigit())))
        return out

    def entries(self, spark: SparkSession, revision: str) -> DataFrame:
        commit = self.resolve(revision)
        found = self.files(commit)
        contents = dict(self.blobs(sorted({blob for _, kind, _, blob in found if kind == "file"})))
        return spark.createDataFrame([(commit, p, k, m, bytearray(contents.get(b, b""))) for p, k, m, b in found], schemas.ENTRIES)

    def working_tree(self, spark: SparkSession, ignored: bool = False) -> DataFrame:
        """Entries of the working tree, tracked and untracked, labelled with HEAD."""
        commit = self.resolve("HEAD")
        paths = self.git("ls-files", "-z", "--cached", "--others", "--exclude-standard").decode("utf-8", "surrogateescape").split("\0")
        if ignored:
            paths += self.git("ls-files", "-z", "--others", "--ignored", "--exclude-standard").decode("utf-8", "surrogateescape").split("\0")
        rows = []
        for path in sorted({p for p in paths if p and is_supported(p)}):
            try:
                place = f"{self.root}/{path}"
                if os.path.islink(place):
                    rows.append((commit, path, "symlink", 0o120000, bytearray(os.readlink(place).encode("utf-8", "surrogateescape"))))
                    continue
                with open(place, "rb") as file:
                    mode = 0o100755 if os.fstat(file.fileno()).st_mode & 0o100 else 0o100644
                    rows.append((commit, path, "file", mode, bytearray(file.read())))
            except FileNotFoundError:
                continue
        return spark.createDataFrame(rows, schemas.ENTRIES)

    def renames(self, spark: SparkSession, base: str, head: str) -> DataFrame:
        """``(path, old_path)`` of renamed files; copies count as new."""
        parts = self.git("diff", "--name-status", "-z", "--find-renames", "--diff-filter=R", base, head).decode("utf-8", "surrogateescape").split("\0")
        rows = [(parts[i + 2], parts[i + 1]) for i in range(0, len(parts) - 2, 3) if re.match("R", parts[i])]
        return spark.createDataFrame(rows, "path string, old_path string")

    def patches(self, spark: SparkSession, base: str, head: str, paths: list[str]) -> DataFrame:
        """``(path, text)``: zero-context diffs of the given paths."""
        rows = [(p, self.git("diff", "--unified=0", "--no-color", base, head, "--", p).decode("utf-8", "replace")) for p in paths]
        return spark.createDataFrame(rows, "path string, text string")
