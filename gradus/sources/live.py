"""Datasets that grow by commits: which folders of a path are live.

``_live`` under the path holds one small file per version, each with the whole list of
live folders. A new version is a file that must not exist yet, so of two writers one
fails; a file that a lost driver left half written can't be read and doesn't count.
Readers take the newest version. Folders are merged in tiers: as soon as ``FAN``
entries have one level, one entry of the next level takes their place, so the number of
entries grows with the logarithm of the commits, and each row is written again as often.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

#: Entries of one level that are merged into one.
FAN = 8
#: Versions that are kept for readers that began earlier.
KEPT_VERSIONS = 3


@dataclass
class Entry:
    """A live folder: its level, the commits in it, and those of them that were
    replaced since, whose rows don't count."""

    folder: str
    level: int = 0
    commits: list[int] = field(default_factory=list)
    without: list[int] = field(default_factory=list)


class LiveFolders:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- Versions ---

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_live")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, version: int) -> list[Entry] | None:
        stream = self._fs.open(self._path(f"{self.path}/_live/{version:012d}"))
        try:
            return [Entry(**e) for e in json.loads(self._io.toString(stream, "UTF-8"))]
        except ValueError:
            return None
        finally:
            stream.close()

    def entries(self) -> list[Entry]:
        """The newest version's folders; none if there is no version."""
        for version in reversed(self._versions()):
            found = self._read(version)
            if found is not None:
                return found
        return []

    def _commit(self, entries: list[Entry]) -> None:
        versions = self._versions()
        version = versions[-1] + 1 if versions else 0
        out = self._fs.create(self._path(f"{self.path}/_live/{version:012d}"), False)
        self._io.write(json.dumps([asdict(e) for e in entries]), out, "UTF-8")
        out.close()
        self._forget(versions[: -KEPT_VERSIONS + 1], entries)

    def _forget(self, versions: list[int], entries: list[Entry]) -> None:
        """Drop old versions, and folders that only they name."""
        kept = {e.folder for e in entries}
        for v in self._versions():
            if v not in versions:
                kept |= {e.folder for e in self._read(v) or ()}
        for v in versions:
            for e in self._read(v) or ():
                if e.folder not in kept:
                    self._fs.delete(self._path(f"{self.path}/{e.folder}"), True)
            self._fs.delete(self._path(f"{self.path}/_live/{v:012d}"), False)

    # --- Commits ---

    def fresh(self) -> str:
        """Name of a new folder, not live yet."""
        return f"part-{uuid.uuid4().hex}"

    def next_commit(self) -> int:
        return max((c for e in self.entries() for c in e.commits), default=-1) + 1

    def add(self, folder: str, commit: int) -> None:
        """Make a folder live as ``commit``, in place of what that commit had."""
        kept = []
        for e in self.entries():
            if commit in e.commits and commit not in e.without:
                e.without.append(commit)
            if set(e.commits) > set(e.without):
                kept.append(e)
        self._commit([*kept, Entry(folder, 0, [commit])])

    def merge(self, rewrite: Callable[[list[Entry], str], None]) -> bool:
        """Merge ``FAN`` entries of one level, if there are as many: ``rewrite`` writes
        their rows to a new folder. Until the new version is there, nothing changes."""
        entries = self.entries()
        for level in sorted({e.level for e in entries}):
            same = [e for e in entries if e.level == level]
            if len(same) >= FAN:
                folder = self.fresh()
                rewrite(same, folder)
                live = sorted({c for e in same for c in e.commits if c not in e.without})
                rest = [e for e in entries if e.level != level]
                self._commit([*rest, Entry(folder, level + 1, live)])
                return True
        return False
