"""Files that are stored: a folder of any kind of store, and saving, copying, deleting and
merging many files from tasks.

Tasks reach a store by its URI through `pyarrow.fs` (local or mounted folders, S3 and what
speaks its protocol, HDFS, GCS), a piece of a file at a time. A file is written beside its
place and moved there once it is whole, so that a task that ends midway, or runs twice,
leaves no half file. Each file fails by itself: its row says how. Bulk functions write
their outcomes to the shared folder before they return them, so that reading the outcomes
again doesn't repeat the work; running them again finds what is already in place.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.sources.files import PATH_COLUMNS, SCHEMES
from winnow.sources.packages import ship
from winnow.sources.shared import written

PIECE = 1 << 20
#: First bytes that tell a file's kind.
HEAD = 16
_PART = re.compile(r"part_(\d+)")


def file_system(root: str, settings: dict[str, str] | None = None) -> tuple[pafs.FileSystem, str]:
    """The file system of a root's URI and the root's path in it.

    oss, cosn and s3a are reached by the S3 protocol; settings are options of
    `pyarrow.fs.S3FileSystem` (region, endpoint_override, access_key, secret_key).
    """
    scheme, _, rest = root.rpartition("://")
    if scheme in {SCHEMES["s3"], SCHEMES["oss"], SCHEMES["cos"], "s3"}:
        return pafs.S3FileSystem(**settings or {}), rest.strip("/")
    if root.startswith("file:/") and not scheme:
        root = "file://" + root.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(root)
    return fs, path.rstrip("/")


class Store:
    """The files under a root, by relative path; `uploads/` before a path is passed over."""

    def __init__(self, root: str, settings: dict[str, str] | None = None) -> None:
        self.root = root
        self.fs, self.top = file_system(root, settings)

    def at(self, path: str) -> str:
        """The whole path; raises ValueError for one that leads out of the root."""
        path = path.removeprefix("uploads/").lstrip("/")
        if not path or ".." in path.split("/"):
            raise ValueError(f"no path in the store: {path!r}")
        return f"{self.top}/{path}"

    def save(self, path: str, pieces: bytes | Iterator[bytes]) -> int:
        """Stores a file, with the folders above it; returns its size."""
        place, size = self.at(path), 0
        beside = f"{place}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(place.rpartition("/")[0], recursive=True)
        try:
            with self.fs.open_output_stream(beside) as out:
                for piece in [pieces] if isinstance(pieces, bytes) else pieces:
                    out.write(piece)
                    size += len(piece)
            self.fs.move(beside, place)
        except BaseException:
            self.delete(f"{path}{beside.removeprefix(place)}")
            raise
        return size

    def pieces(self, path: str) -> Iterator[bytes]:
        with self.fs.open_input_stream(self.at(path)) as f:
            while piece := f.read(PIECE):
                yield piece

    def read(self, path: str) -> bytes:
        """A whole file; raises FileNotFoundError if it isn't there."""
        return b"".join(self.pieces(path))

    def delete(self, path: str) -> None:
        """Removes a file, if it is there."""
        if self.exists(path):
            self.fs.delete_file(self.at(path))

    def size(self, path: str) -> int | None:
        info = self.fs.get_file_info(self.at(path))
        return info.size if info.type == pafs.FileType.File else None

    def exists(self, path: str) -> bool:
        return self.size(path) is not None

    def url(self, path: str) -> str:
        """Where clients find a file: below /uploads of a local store, else by its URI."""
        own = self.at(path).removeprefix(f"{self.top}/")
        return f"/uploads/{own}" if isinstance(self.fs, pafs.LocalFileSystem) else f"{self.root.rstrip('/')}/{own}"

    # ---- uploads in parts, in a folder of their own beside the files

    def _part(self, upload: str, number: int | None = None) -> str:
        return f"_parts/{upload}" + ("" if number is None else f"/part_{number}")

    def save_part(self, upload: str, number: int, content: bytes) -> str:
        """Stores a part of an upload; returns its tag, the MD5 of its content."""
        self.save(self._part(upload, number), content)
        return hashlib.md5(content).hexdigest()

    def parts(self, upload: str) -> list[tuple[int, str, int]]:
        """Number, tag and size of the parts that are there, by number; other files are left out."""
        found = self.fs.get_file_info(pafs.FileSelector(self.at(self._part(upload)), allow_not_found=True))
        numbers = sorted((int(m[1]), f.size) for f in found if (m := _PART.fullmatch(f.base_name)))
        return [(n, hashlib.md5(self.read(self._part(upload, n))).hexdigest(), size) for n, size in numbers]

    def complete(self, path: str, upload: str, numbers: list[int]) -> int:
        """Merges parts in order of number into a file, and removes them; raises FileNotFoundError, and
        stores nothing, if one is missing. Returns the size."""
        for n in sorted(numbers):
            if not self.exists(self._part(upload, n)):
                raise FileNotFoundError(f"Missing part file: part_{n}")
        size = self.save(path, (piece for n in sorted(numbers) for piece in self.pieces(self._part(upload, n))))
        self.abort(upload)
        return size

    def abort(self, upload: str) -> None:
        """Removes the parts of an upload, if there are any."""
        place = self.at(self._part(upload))
        if self.fs.get_file_info(place).type == pafs.FileType.Directory:
            self.fs.delete_dir(place)


OUTCOME = "path string, outcome string, size long, error string"


def _each(rows: DataFrame, work: Callable[[dict], tuple], name: str, schema: str = OUTCOME, more: tuple[pa.DataType, ...] = ()) -> DataFrame:
    """OUTCOME of work on each row, whose first column is a path, once for each row.

    work gives the outcome, a size and what the schema has more; what it raises becomes
    the outcome `failed` with the error, and the other rows go on.
    """
    ship(rows.sparkSession)
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), *more)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                try:
                    outcome, size, *rest = work(row)
                    out.append((row["path"], outcome, size, None, *rest))
                except Exception as e:  # of this file alone
                    out.append((row["path"], "failed", None, f"{type(e).__name__}: {e}", *[None] * len(more)))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return written(rows.mapInArrow(run, schema), name)


def dealt(rows: DataFrame) -> DataFrame:
    """rows (path) over many tasks: by their bytes they are few, and would be in one, but a file is far more work than its row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "path")


def save_files(contents: DataFrame, root: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Stores the contents (path, content) as files below the root; OUTCOME with `saved` or `failed`."""

    def save(row: dict) -> tuple[str, int]:
        return "saved", Store(root, settings).save(row["path"], row["content"] or b"")

    return _each(contents.select("path", F.col("content").cast("binary").alias("content")), save, "saved")


def copy_files(paths: DataFrame, source: str, target: str, source_settings: dict[str, str] | None = None, target_settings: dict[str, str] | None = None) -> DataFrame:
    """Copies files (path), each once, between two roots; OUTCOME with `copied`, `present` or `failed`.

    A file that the target has at the source's size is not copied again. Paths are
    dealt over the tasks by hash, whatever folders they lie in.
    """

    def copy(row: dict) -> tuple[str, int]:
        a, b = Store(source, source_settings), Store(target, target_settings)
        size = a.size(row["path"])
        if size is not None and b.size(row["path"]) == size:
            return "present", size
        return "copied", b.save(row["path"], a.pieces(row["path"]))

    return _each(paths.where("path is not null and path <> ''").select("path").distinct(), copy, "copied")


#: Outcomes of `take_files`.
TAKEN = f"{OUTCOME}, md5 string, head binary"


def take_files(files: DataFrame, source: str, target: str, source_settings: dict[str, str] | None = None, target_settings: dict[str, str] | None = None) -> DataFrame:
    """Copies files (path, place) from one root to their places below another, each path once and read once;
    TAKEN with `taken`, the MD5 and the first bytes, or `failed`."""

    def take(row: dict) -> tuple[str, int, str, bytes]:
        md5, head = hashlib.md5(), b""

        def pieces() -> Iterator[bytes]:
            nonlocal head
            for piece in Store(source, source_settings).pieces(row["path"]):
                head = head or piece[:HEAD]
                md5.update(piece)
                yield piece

        size = Store(target, target_settings).save(row["place"], pieces())
        return "taken", size, md5.hexdigest(), head

    rows = dealt(files.select("path", "place")).dropDuplicates(["path"])
    return _each(rows, take, "taken", TAKEN, (pa.string(), pa.binary()))


def delete_files(paths: DataFrame, root: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Removes files (path); OUTCOME with `deleted`, `absent` or `failed`."""

    def delete(row: dict) -> tuple[str, None]:
        store = Store(root, settings)
        there = store.exists(row["path"])
        store.delete(row["path"])
        return "deleted" if there else "absent", None

    return _each(paths.select("path").distinct(), delete, "deleted")


def save_parts(parts: DataFrame, root: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Stores parts of uploads (upload_id, part_no, content); OUTCOME by part's path."""

    def save(row: dict) -> tuple[str, int]:
        Store(root, settings).save_part(row["upload_id"], row["part_no"], row["content"])
        return "saved", len(row["content"])

    path = F.concat(F.lit("_parts/"), F.col("upload_id").cast("string"), F.lit("/part_"), F.col("part_no").cast("string"))
    rows = parts.select(path.alias("path"), F.col("upload_id").cast("string").alias("upload_id"), F.col("part_no").cast("int").alias("part_no"), F.col("content").cast("binary").alias("content"))
    return _each(rows, save, "parts")


def complete_uploads(uploads: DataFrame, root: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Merges the stored parts of uploads (upload_id, path, total_parts) into files, piece by piece, so that no
    object is ever one row; OUTCOME with `merged` or `failed`. An upload that was merged before is `merged`."""

    def merge(row: dict) -> tuple[str, int]:
        store = Store(root, settings)
        if not store.parts(row["upload_id"]) and store.exists(row["path"]):
            return "merged", store.size(row["path"])
        return "merged", store.complete(row["path"], row["upload_id"], list(range(1, row["total_parts"] + 1)))

    rows = uploads.select("path", F.col("upload_id").cast("string").alias("upload_id"), F.col("total_parts").cast("int").alias("total_parts"))
    return _each(dealt(rows), merge, "merged")


def digests(paths: DataFrame, root: str, settings: dict[str, str] | None = None) -> DataFrame:
    """path, size and md5 of files (path), each once, read a piece at a time; those that aren't there are left out."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Store(root, settings)
        for batch in batches:
            out = []
            for path in filter(s.exists, batch.column(0).to_pylist()):
                md5 = hashlib.md5()
                for piece in s.pieces(path):
                    md5.update(piece)
                out.append((path, s.size(path), md5.hexdigest()))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "size", "md5"])

    return dealt(paths.select("path").distinct()).mapInArrow(run, "path string, size long, md5 string")


def migrate(media: DataFrame, source: str, target: str, **settings) -> tuple[DataFrame, DataFrame]:
    """Copies every file that rows of media (id and PATH_COLUMNS) name from one root to another.

    Returns the outcomes by path as the rows have it, and media with the paths of what
    is at the target without `uploads/` before them; paths that failed stay as they are.
    """
    named = media.select(F.explode(F.array(*PATH_COLUMNS)).alias("path")).where("path is not null and path <> ''").distinct()
    outcomes = copy_files(named, source, target, **settings)
    moved = outcomes.where("outcome <> 'failed' and path like 'uploads/%'").select("path", F.substring("path", len("uploads/") + 1, 1 << 30).alias("now"))
    flat = media.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("path")) for c in PATH_COLUMNS])).alias("x")).select("id", "x.c", "x.path")
    new = flat.join(moved, "path").groupBy("id").agg(*[F.max(F.when(F.col("c") == c, F.col("now"))).alias(f"_{c}") for c in PATH_COLUMNS])
    kept = media.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in PATH_COLUMNS})
    return outcomes, kept.select(*media.columns)


def summary(outcomes: DataFrame) -> DataFrame:
    """total, success and failed: how many paths there were, are at the target, and aren't."""
    failed = F.count_if(F.col("outcome") == "failed")
    return outcomes.agg(F.count("*").alias("total"), (F.count("*") - failed).alias("success"), failed.alias("failed"))

