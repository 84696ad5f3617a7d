"""Sinks that write files from Python workers: tasks write to a staging folder, a commit moves their files into place, an abort removes them."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The files of one finished task: (path in the staging folder, ending), the main file last."""

    partition: int
    files: list[tuple[str, str]] = field(default_factory=list)
    rows: int = 0


class StagedWriter(DataSourceWriter):
    """Parts appear in ``path`` only when the whole job has succeeded.

    With overwrite the parts of earlier writes go at that time; else names carry the job, so that parts of several writes stand side by side.
    """

    def __init__(self, path: str, overwrite: bool, ending: str):
        self.path, self.overwrite, self.ending, self.job = path, overwrite, ending, uuid.uuid4().hex
        self.staging = os.path.join(path, f"_staging-{self.job}")

    def begin(self) -> tuple[str, Written]:
        """Where this attempt writes, without an ending, and the message to return."""
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.staging, exist_ok=True)
        return os.path.join(self.staging, f"{task.partitionId():05d}-{task.taskAttemptId()}"), Written(task.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        old = [n for n in os.listdir(self.path) if n.startswith("part-")] if self.overwrite and os.path.isdir(self.path) else []
        for name in sorted(old, key=len):  # the files before their indexes, which are of no use alone
            os.remove(os.path.join(self.path, name))
        for m in messages:
            tail = "" if self.overwrite else f"-{self.job[:8]}"
            for file, ending in m.files if m else ():
                os.replace(file, os.path.join(self.path, f"part-{m.partition:05d}{tail}{ending}"))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
