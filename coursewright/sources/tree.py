"""A tree of lesson files as a data source: ``lesson_tree`` reads files as rows and writes rows as files.

Rows are (set, file, path, raw, error): the first three components of the path below the root, the
file's name, the path itself, its text. Filters on set, file and path are pushed to the source, so that
only the folders asked for are listed and only the files asked for are opened. A file that cannot be
read, or isn't UTF-8, is a row with an error, and so is a wanted path that is not there. Files of a
set share tasks of bounded size; a large set has many. The driver looks at one set at a time; of a tree of
more than NAMED files it keeps the sets' numbers alone, and the tasks list their sets by themselves.

Rows (path, raw) are written to a staging folder, one for each attempt of a task, and moved to their places
when all tasks are done: an attempt that fails, or runs twice, leaves nothing. A path that
comes twice, leaves the root or is there already (unless overwritten) is an error, and then no file has been moved.
The driver knows the attempts' folders and no names of files; ``write_tree`` has tasks check and move them.
Roots are paths or URIs of any file system that pyarrow knows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "set string, file string, path string, raw string, error string"
#: Files and bytes of a task, and files moved at a time.
PART_FILES, PART_BYTES, MOVERS = 2000, 32 << 20, 16
#: Files that the driver names to tasks, and files looked up or moved at a time.
NAMED, SOME = 20_000, 1000
SET_DEPTH = 3
#: Tasks that a folder's files are staged by.
STAGERS = 8
STAGING, FOLDERS = "_staging", "_folders"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        system, base = pafs.FileSystem.from_uri(root)
    else:
        system, base = pafs.LocalFileSystem(), root
    return system, base.rstrip("/")


def set_of(path: str) -> str:
    return "/".join(path.split("/")[:SET_DEPTH])


@dataclass
class Files(InputPartition):
    """Paths below the root that one task reads."""

    paths: list[str]


@dataclass
class Share(InputPartition):
    """Folders whose files a task lists by itself, and reads one of so many shares of."""

    folders: list[str]
    share: int
    of: int


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt of a task has staged its files."""

    folder: str


def staged(system: pafs.FileSystem, folder: str, below: str = "") -> Iterator[str]:
    """Paths of the files below a folder in the order of their components; one folder of each level is looked at a time."""
    infos = system.get_file_info(pafs.FileSelector(posixpath.join(folder, below) if below else folder))
    for info in sorted(infos, key=lambda i: i.base_name):
        path = posixpath.join(below, info.base_name)
        if info.type == pafs.FileType.Directory:
            yield from staged(system, folder, path)
        else:
            yield path


def there(system: pafs.FileSystem, base: str, folder: str) -> Iterator[str]:
    """Staged paths whose places are taken."""
    for some in itertools.batched(staged(system, folder), SOME):
        yield from (p for p, info in zip(some, system.get_file_info([posixpath.join(base, p) for p in some]), strict=True) if info.type != pafs.FileType.NotFound)


def put_in_place(system: pafs.FileSystem, base: str, folder: str) -> int:
    """Moves what is staged in a folder, and what is left of it where this runs again; the number of files."""

    def move(path: str) -> None:
        try:
            system.move(posixpath.join(folder, path), posixpath.join(base, path))
        except FileNotFoundError:  # another attempt has moved it
            if system.get_file_info(posixpath.join(base, path)).type == pafs.FileType.NotFound:
                raise

    n, made = 0, ""
    with ThreadPoolExecutor(MOVERS) as movers:
        for some in itertools.batched(staged(system, folder), SOME):
            for above in dict.fromkeys(posixpath.dirname(p) for p in some):
                if above != made:
                    system.create_dir(posixpath.join(base, above), recursive=True)
                    made = above
            list(movers.map(move, some))
            n += len(some)
    return n


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, wanted: list[str] | None):
        self.root, self.suffix, self.wanted = root, suffix, wanted
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, IsNotNull) and one.attribute in (("set",), ("file",), ("path",)):
                continue  # these never are
            values = [one.value] if isinstance(one, (EqualTo, EqualNullSafe)) else one.value if isinstance(one, In) else None
            if values is None or len(one.attribute) != 1 or one.attribute[0] not in ("set", "file", "path"):
                yield one
                continue
            named = {v for v in values if isinstance(v, str)}
            (column,) = one.attribute
            self.only[column] = self.only[column] & named if column in self.only else named

    def accepts(self, path: str) -> bool:
        of = {"set": set_of(path), "file": posixpath.basename(path), "path": path}
        return all(of[column] in named for column, named in self.only.items())

    def files(self, system: pafs.FileSystem, base: str, folder: str, recursive: bool) -> list[tuple[str, int]]:
        """(path, bytes) of the files asked for in a folder, sorted."""
        infos = system.get_file_info(pafs.FileSelector(posixpath.join(base, folder) if folder else base, recursive=recursive, allow_not_found=bool(folder)))
        return sorted((info.path[len(base) + 1 :], info.size) for info in infos if info.type == pafs.FileType.File and self.is_lesson(info.path[len(base) + 1 :]))

    def is_lesson(self, path: str) -> bool:
        return path.endswith(self.suffix) and not any(part[:1] in "._" for part in path.split("/")) and self.accepts(path)

    def whole(self, folder: str) -> bool:
        """Whether a folder is listed with all below it: sets are, and what lies above them is not."""
        return "set" in self.only or folder.count("/") + 1 >= SET_DEPTH

    def folders(self, system: pafs.FileSystem, base: str) -> Iterator[str]:
        """Folders to list; those that cannot hold any file asked for are left out."""
        if "set" in self.only:
            yield from sorted(self.only["set"])
            return
        waiting = [""]
        while waiting:
            folder = waiting.pop()
            yield folder
            if not (folder and self.whole(folder)):
                infos = system.get_file_info(pafs.FileSelector(posixpath.join(base, folder) if folder else base))
                waiting += [info.path[len(base) + 1 :] for info in infos if info.type == pafs.FileType.Directory and info.base_name[:1] not in "._"]

    def partitions(self) -> list[InputPartition]:
        if self.wanted is not None:
            return self.named([(p, 0) for p in sorted(set(self.wanted)) if self.accepts(p)])
        system, base = opened(self.root)
        found, sizes, n = [], [], 0
        for folder in self.folders(system, base):
            some = self.files(system, base, folder, bool(folder) and self.whole(folder))
            sizes.append((folder, len(some), sum(size for _, size in some)))
            n += len(some)
            found = found + some if n <= NAMED else []
        return self.named(sorted(found)) if n <= NAMED else self.shares(sizes)

    def named(self, found: list[tuple[str, int]]) -> list[InputPartition]:
        parts, size = [], 0
        for path, n in found:
            if not parts or len(parts[-1].paths) >= PART_FILES or size + n > PART_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(path)
            size += n
        return parts or [Files([])]

    def shares(self, sizes: list[tuple[str, int, int]]) -> list[InputPartition]:
        parts: list[InputPartition] = []
        together, n, size = [], 0, 0
        for folder, more, bytes_ in sorted(s for s in sizes if s[1]):
            of = max(-(-more // PART_FILES), -(-bytes_ // PART_BYTES))
            if of > 1:
                parts += [Share([folder], i, of) for i in range(of)]
                continue
            if together and (n + more > PART_FILES or size + bytes_ > PART_BYTES):
                parts.append(Share(together, 0, 1))
                together, n, size = [], 0, 0
            together.append(folder)
            n, size = n + more, size + bytes_
        return parts + ([Share(together, 0, 1)] if together else [])

    def paths(self, system: pafs.FileSystem, base: str, partition: Files | Share) -> Iterator[str]:
        if isinstance(partition, Files):
            yield from partition.paths
            return
        for folder in partition.folders:
            for path, _ in self.files(system, base, folder, bool(folder) and self.whole(folder)):
                if zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.of == partition.share:
                    yield path

    def read(self, partition: Files | Share) -> Iterator[tuple]:
        system, base = opened(self.root)
        for path in self.paths(system, base, partition):
            raw, error = None, None
            try:
                with system.open_input_stream(posixpath.join(base, path)) as stream:
                    raw = stream.read().decode("utf-8")
            except FileNotFoundError:
                error = f"no such file: {path}"
            except UnicodeDecodeError as wrong:
                error = f"not UTF-8: {wrong.reason} at byte {wrong.start}"
            except OSError as wrong:
                error = f"cannot be read: {wrong.strerror or wrong}"
            yield set_of(path), posixpath.basename(path), path, raw, error


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, columns: list[str], overwrite: bool, job: str | None = None):
        if not {"path", "raw"} <= set(columns):
            raise ValueError("a tree is written from columns path and raw")
        self.root, self.overwrite, self.job, self.by_tasks = root, overwrite, job or uuid.uuid4().hex, job is not None
        system, base = opened(root)
        system.create_dir(self.staging(base), recursive=True)

    def staging(self, base: str) -> str:
        return posixpath.join(base, STAGING, self.job)

    def write(self, rows: Iterator) -> Staged:
        system, base = opened(self.root)
        context = TaskContext.get()
        folder = posixpath.join(self.staging(base), f"{context.partitionId()}-{context.taskAttemptId()}")
        made = ""
        for row in rows:
            path = row["path"]
            if not path or path.startswith("/") or path != posixpath.normpath(path) or path.split("/")[0] == "..":
                raise ValueError(f"not a path below the root: {path!r}")
            at = posixpath.join(folder, path)
            if (above := posixpath.dirname(at)) != made:
                if system.get_file_info(self.staging(base)).type == pafs.FileType.NotFound:
                    raise RuntimeError("the job has ended without this task")
                system.create_dir(above, recursive=True)
                made = above
            if system.get_file_info(at).type != pafs.FileType.NotFound:
                raise ValueError(f"written twice: {path!r}")
            with system.open_output_stream(at) as stream:
                stream.write((row["raw"] or "").encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = opened(self.root)
        named = [m.folder for m in messages if m is not None]
        folders = [f for f in named if system.get_file_info(f).type == pafs.FileType.Directory]
        if self.by_tasks:
            with system.open_output_stream(posixpath.join(self.staging(base), FOLDERS)) as stream:
                stream.write(json.dumps(folders).encode())
            return
        order = heapq.merge(*[staged(system, f) for f in folders], key=lambda p: p.split("/"))
        twice = list(itertools.islice((one for one, two in itertools.pairwise(order) if one == two), 5))
        taken = [] if self.overwrite or twice else list(itertools.islice(itertools.chain.from_iterable(there(system, base, f) for f in folders), 5))
        if twice or taken:
            self.abort(messages)
            raise ValueError(f"written twice: {twice}" if twice else f"there already: {taken}")
        for folder in folders:
            put_in_place(system, base, folder)
        self.abort(messages)

    def abort(self, messages: list[Staged | None] = ()) -> None:
        system, base = opened(self.root)
        if system.get_file_info(self.staging(base)).type == pafs.FileType.Directory:
            system.delete_dir(self.staging(base))
        above = posixpath.join(base, STAGING)
        if system.get_file_info(above).type == pafs.FileType.Directory and not system.get_file_info(pafs.FileSelector(above)):
            system.delete_dir(above)


class LessonTree(DataSource):
    """Options: path (the root), suffix (of the files read), wanted (a JSON array of paths to read, there or not), job (a name: files stay staged under it)."""

    @classmethod
    def name(cls) -> str:
        return "lesson_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        wanted = self.options.get("wanted")
        return TreeReader(self.options["path"], self.options.get("suffix", ""), json.loads(wanted) if wanted else None)

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], schema.names, overwrite, self.options.get("job"))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LessonTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_tree(spark: SparkSession, root: str, suffix: str = ".json") -> DataFrame:
    """set, file, path, raw, error of the files below a root whose names end with ``suffix``."""
    return registered(spark).read.format("lesson_tree").option("suffix", suffix).load(root)


def read_files(spark: SparkSession, root: str, wanted: list[str]) -> DataFrame:
    """The wanted files of a root, a row for each: those of a command line."""
    return registered(spark).read.format("lesson_tree").option("wanted", json.dumps(wanted)).load(root)


def write_tree(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Each row's text ``raw`` as the file ``path`` below the root.

    Rows of one path meet in one task, which sees that they do; tasks check that the places are free, and move.
    """
    spark = registered(rows.sparkSession)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    dealt = rows.select("path", "raw").repartition(n, folder, F.pmod(F.xxhash64("path"), F.lit(STAGERS))).sortWithinPartitions("path")
    job = uuid.uuid4().hex
    dealt.write.format("lesson_tree").mode("overwrite" if overwrite else "append").option("job", job).save(root)
    system, base = opened(root)
    with system.open_input_stream(posixpath.join(base, STAGING, job, FOLDERS)) as stream:
        folders = json.loads(stream.read())

    def by_tasks(act, kind: str) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = opened(root)
            for batch in batches:
                for one in batch.column("folder").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(act(system, base, one))], ["found"])

        return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders)).mapInArrow(work, f"found {kind}")

    try:
        taken = [] if overwrite or not folders else by_tasks(lambda *at: pa.array(itertools.islice(there(*at), 5), pa.string()), "string").take(5)
        if taken:
            raise ValueError(f"there already: {[r.found for r in taken]}")
        if folders:
            by_tasks(lambda *at: [put_in_place(*at)], "long").collect()  # a number a task
    finally:
        TreeWriter(root, ["path", "raw"], overwrite, job).abort()
