import os
import subprocess

import pytest

from strata.operators.metrics import largest_commits
from strata.sources.git import GitError, Repository


@pytest.fixture
def repo(tmp_path):
    def git(*arguments):
        who = ["-c", "user.name=a", "-c", "user.email=a@b.c", "-c", "commit.gpgsign=false"]
        subprocess.run(["git", *who, *arguments], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    for k in range(1, 8):
        (tmp_path / "a.py").write_text("x = 1\n" * (k * k))
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    return Repository(str(tmp_path))


def test_absent_paths_are_none_and_other_failures_raise(repo):
    assert repo.blob("HEAD~6", "a.py") == b"x = 1\n"
    assert repo.blob("HEAD", "b.py") is None
    (path := os.path.join(repo.root, "new.py")) and open(path, "w").close()
    assert repo.blob("HEAD", "new.py") is None
    with pytest.raises(GitError):
        repo.blob("nowhere", "a.py")
    with pytest.raises(ValueError):
        repo.blob("HEAD", "../a.py")


def test_working_tree_keeps_modes_and_links(spark, repo):
    os.chmod(os.path.join(repo.root, "a.py"), 0o755)
    os.symlink("a.py", os.path.join(repo.root, "b.py"))
    got = {r.path: (r.kind, r.mode) for r in repo.working_tree(spark).collect()}
    assert got == {"a.py": ("file", 0o100755), "b.py": ("symlink", 0o120000)}


def test_churn_and_largest_commits(spark, repo):
    churn = repo.churn("HEAD", 7)
    assert [n for _, n in churn] == [13, 11, 9, 7, 5, 3, 1]
    rows = spark.createDataFrame([("r", c, n) for c, n in churn], "repo string, commit string, churn long")
    assert sorted((r["rank"], r["churn"]) for r in largest_commits(rows, ["repo"]).collect()) == [(1, 13), (2, 11), (3, 9), (4, 7), (5, 5)]
