"""Git as a data source (SC5, SC6, SC8, SC9, SC25 to SC30, SC49, ST9, XT15, XT27).

``spark.read.format("codefacts_git")`` with ``repo`` and ``kind``:

* ``blobs`` (with ``ref``): path, text of every file of a commit; partitions are
  chunks of paths, each read by one ``git cat-file --batch``;
* ``log`` (with ``range``): sha, ts, agent, path, one row a touched file;
* ``diff`` (with ``range``, or none for the working tree): the diff's text;
* ``untracked``: path; ``ignored``: path; ``worktrees``: path, branch.

The repository has to be readable where the tasks run.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codefacts.session import ship

SCHEMAS = {
    "blobs": "path string, text string",
    "log": "sha string, ts long, agent string, path string",
    "diff": "diff string, text string",
    "untracked": "path string",
    "ignored": "path string",
    "worktrees": "path string, branch string",
}
CHUNK = 256


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    """A git command's output, without any GIT_ variable of the caller; an error is raised."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], input=stdin, capture_output=True, check=True, env=env).stdout


class Paths(InputPartition):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.kind = options["repo"], options["kind"]
        self.ref, self.range = options.get("ref", "HEAD"), options.get("range")

    def partitions(self):
        if self.kind != "blobs":
            return [Paths([])]
        rows = [x.split(b"\t", 1) for x in git(self.repo, "ls-tree", "-r", "-z", self.ref).split(b"\0") if x]
        names = [(head.split()[2].decode(), path.decode(errors="replace")) for head, path in rows if head.split()[1] == b"blob"]
        return [Paths(names[i : i + CHUNK]) for i in range(0, len(names), CHUNK)] or [Paths([])]

    def read(self, partition):
        yield from getattr(self, f"_{self.kind}")(partition)

    def _blobs(self, partition):
        if not partition.names:
            return
        out = git(self.repo, "cat-file", "--batch", stdin="".join(f"{sha}\n" for sha, _ in partition.names).encode())
        at = 0
        for _, path in partition.names:
            end = out.index(b"\n", at)
            size = int(out[at:end].split()[2])
            yield path, out[end + 1 : end + 1 + size].decode(errors="replace")
            at = end + size + 2

    def _log(self, partition):
        found = git(self.repo, "log", "--no-merges", "--first-parent", "--format=%x01%H%x02%ct%x02%an", "--name-only", *([self.range] if self.range else []))
        for part in found.decode(errors="replace").split("\x01")[1:]:
            head, *paths = part.split("\n")
            sha, ts, agent = head.split("\x02")
            for path in paths:
                if path:
                    yield sha, int(ts), agent, path

    def _diff(self, partition):
        yield self.range or "worktree", git(self.repo, "diff", "--unified=0", "--no-color", *([self.range] if self.range else ["HEAD"])).decode(errors="replace")

    def _untracked(self, partition):
        for x in sorted(git(self.repo, "ls-files", "--others", "--exclude-standard", "-z").split(b"\0")):
            if x:
                yield (x.decode(errors="replace"),)

    def _ignored(self, partition):
        for x in git(self.repo, "ls-files", "--others", "--ignored", "--exclude-standard", "-z").split(b"\0"):
            if x:
                yield (x.decode(errors="replace"),)

    def _worktrees(self, partition):
        path = None
        for line in git(self.repo, "worktree", "list", "--porcelain").decode().split("\n"):
            if line.startswith("worktree "):
                path = line[9:]
            elif line.startswith(("branch ", "detached")) and path:
                yield path, line[7:].removeprefix("refs/heads/") if line.startswith("branch ") else ""


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "codefacts_git"

    def schema(self):
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema):
        return GitReader(dict(self.options))


def read(spark, repo: str, kind: str, **options: str):
    """One kind of table of a repository."""
    spark.dataSource.register(GitSource)
    r = spark.read.format("codefacts_git").option("repo", repo).option("kind", kind)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


ship(__name__)
