"""A sink of ZIP packages: one for each lecture, all of them or none.

Tasks write their packages into a staging folder and read each one back; the commit
moves what the successful attempts wrote to its place.  A failed task, a file that must not
leave, or a lost executor whose attempt was repeated leaves nothing behind.
The folder has to be one that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillspan.functions import fixed

SUFFIX = "_knowledge_package.zip"


def refused(names: list[str]) -> list[str]:
    """The members that a package must not have."""
    outside = lambda n: any(f"/{d}/" in f"/{n}" for d in fixed.EXCLUDED_FOLDERS)
    return [n for n in names if n.endswith(tuple(fixed.EXCLUDED_FILES)) or outside(n)]


@dataclass
class Written(WriterCommitMessage):
    """Staged and final path of each package of a task."""

    packages: list[tuple[str, str]]


class PackageWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, os.path.join(folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> Written:
        """rows (lecture_id, name, content) sorted by lecture: one package is open at a time, and each member is written as it comes."""
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        packages: list[tuple[str, str]] = []
        lecture, package = None, None
        for row in rows:
            if lecture != row.lecture_id:
                if package is not None:
                    package.close()
                lecture, at = row.lecture_id, os.path.join(own, f"{row.lecture_id}{SUFFIX}")
                packages.append((at, os.path.join(self.folder, os.path.basename(at))))
                package = zipfile.ZipFile(at, "x", zipfile.ZIP_DEFLATED)
            package.writestr(row.name, bytes(row.content))
        if package is not None:
            package.close()
        for at, _ in packages:
            with zipfile.ZipFile(at) as z:
                if bad := refused(z.namelist()) or z.testzip():
                    raise ValueError(f"{os.path.basename(at)}: {bad}")
        return Written(packages)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for at, to in m.packages if m else []:
                os.replace(at, to)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PackageSource(DataSource):
    """`df.write.format("quillspan_packages")`; use export_packages(), which lays the rows out."""

    @classmethod
    def name(cls) -> str:
        return "quillspan_packages"

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"])


def export_packages(files: DataFrame, folder: str, allowed: list[str] | None = None) -> None:
    """Write files (lecture_id, name, content) as a flat ZIP for each lecture; names that aren't allowed stay out.

    A lecture's files go to one task, sorted; they are written one by one.  An allowed name
    that a package must not have stops the export before anything is in its place.
    """
    names = [*fixed.PACKAGE_FILES, *fixed.OPTIONAL_PACKAGE_FILES] if allowed is None else allowed
    files.sparkSession.dataSource.register(PackageSource)
    rows = files.filter(F.col("name").isin(names)).select(F.col("lecture_id").cast("string").alias("lecture_id"), "name", "content")
    rows.repartition("lecture_id").sortWithinPartitions("lecture_id", "name").write.format("quillspan_packages").mode("append").option("path", folder).save()
