"""Single answers as numbered files: a data source that lands them one file each and reads them in partitions of many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Files of a partition of the reader.
FILES = 500
NAME = "landed_answers"


def source() -> type:
    """The data source's class; made in a function, so that it travels to executors as a whole and they need no package."""
    import json
    import posixpath
    import uuid
    from dataclasses import dataclass

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

    def place(options) -> tuple[fs.FileSystem, str]:
        path = options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def pretty(body: str) -> str:
        try:
            return json.dumps(json.loads(body), ensure_ascii=False, indent=2)
        except ValueError:
            return body

    class Files(InputPartition):
        def __init__(self, names: list[str]):
            self.names = names

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            files, path = place(self.options)
            found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
            names = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
            size = int(self.options.get("files", FILES))
            return [Files(names[i : i + size]) for i in range(0, len(names), size)] or [Files([])]

        def read(self, partition):
            files, _ = place(self.options)
            for name in partition.names:
                with files.open_input_stream(name) as f:
                    yield posixpath.basename(name), f.read().decode("utf-8", "replace")

    @dataclass
    class Landed(WriterCommitMessage):
        folder: str
        names: list[str]

    class Writer(DataSourceWriter):
        def __init__(self, options, overwrite: bool):
            self.options, self.overwrite, self.run = options, overwrite, f".landing-{uuid.uuid4().hex}"

        def write(self, rows):
            files, path = place(self.options)
            folder, names = f"{path}/{self.run}/{uuid.uuid4().hex}", []
            files.create_dir(folder)
            for row in rows:
                name = row["file"]
                if not name or name.startswith((".", "_")) or "/" in name:
                    raise ValueError(f"no name of a file: {name!r}")
                with files.open_output_stream(f"{folder}/{name}") as f:
                    f.write(pretty(row["body"] or "").encode())
                names.append(name)
            return Landed(folder, names)

        def commit(self, messages):
            files, path = place(self.options)
            done = [m for m in messages if m is not None]
            names = [n for m in done for n in m.names]
            if len(names) != len(set(names)):
                self.abort(messages)
                raise ValueError("several rows name one file")
            if self.overwrite:
                for f in files.get_file_info(fs.FileSelector(path)):
                    if f.type == fs.FileType.File:
                        files.delete_file(f.path)
            for m in done:
                for name in m.names:
                    files.move(f"{m.folder}/{name}", f"{path}/{name}")
            self.abort(messages)

        def abort(self, messages):
            files, path = place(self.options)
            if files.get_file_info(f"{path}/{self.run}").type == fs.FileType.Directory:
                files.delete_dir(f"{path}/{self.run}")

    class Answers(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return "file string, body string"

        def reader(self, schema):
            return Reader(self.options)

        def writer(self, schema, overwrite):
            return Writer(self.options, overwrite)

    return Answers


def land(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """SNK14: one file below path for each row (file, body), JSON indented.

    Tasks write aside; only when all are done the files take their names, and a run that fails leaves none. Names must be
    files' names, each once; a file that is there already is replaced. The folder must be one that all executors share, in a file system that Arrow knows.
    """
    rows.sparkSession.dataSource.register(source())
    rows.select("file", "body").write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def landed(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """SRC5, SRC6: file and body of each file right below path, so many files a task; hidden ones and folders are left out."""
    spark.dataSource.register(source())
    return spark.read.format(NAME).option("files", files).load(path)
