"""A Python data source for granules: one partition for each granule and beam.

Granules are read from Parquet exports: `<folder>/<granule>/<beam>.parquet`, or what Spark writes partitioned by
granule and gt, `<folder>/granule=<granule>/gt=<beam>/`. A beam that isn't there is skipped, as is one that lacks a
column asked for. Exports in HDF5 would need a library that this library doesn't require.

Option version: `old` adds tcc_bin, the upper edge of the ten-percent bin (low, high] of tcc_prc, and leaves quality
filters to later steps, as the older reader did; anything else reads the columns as they are.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BEAMS = ("gt1l", "gt1r", "gt2l", "gt2r", "gt3l", "gt3r")


class Beam(InputPartition):
    def __init__(self, granule: str, beam: str):
        self.granule, self.beam = granule, beam


class GranuleReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields if f.name not in ("granule_name", "gt")]
        self.order = [f.name for f in schema.fields]
        self.folder, self.old = options["path"], options.get("version") == "old"
        if self.old:
            self.names = [n for n in self.names if n != "tcc_bin"]

    def _open(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self):
        from pyarrow import fs

        store, root = self._open(self.folder)
        found = store.get_file_info(fs.FileSelector(root))
        return [Beam(f.path, b) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory for b in BEAMS]

    def _files(self, store, partition) -> list[str]:
        from pyarrow import fs

        single, folder = f"{partition.granule}/{partition.beam}.parquet", f"{partition.granule}/gt={partition.beam}"
        if store.get_file_info(single).type == fs.FileType.File:
            return [single]
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return []
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = self._open(self.folder)
        wanted = list(dict.fromkeys([*self.names, *(["tcc_prc"] if self.old and "tcc_bin" in self.order else [])]))
        for path in self._files(store, partition):
            with store.open_input_file(path) as f:
                source = pq.ParquetFile(f)
                if not set(wanted) <= set(source.schema_arrow.names):
                    return
                for batch in source.iter_batches(columns=wanted):
                    n = batch.num_rows
                    extra = {"granule_name": pa.array([partition.granule.rsplit("/", 1)[-1].removeprefix("granule=")] * n, pa.string()), "gt": pa.array([partition.beam] * n, pa.string())}
                    if self.old and "tcc_bin" in self.order:
                        share = batch.column(batch.schema.get_field_index("tcc_prc")).cast(pa.float64())
                        inside = pc.and_(pc.greater(share, 0.0), pc.less_equal(share, 100.0))
                        extra["tcc_bin"] = pc.if_else(inside, pc.multiply(pc.ceil(pc.divide(share, 10.0)), 10.0), None).cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([extra[c] if c in extra else batch.column(batch.schema.get_field_index(c)) for c in self.order], names=self.order)


class GranuleSource(DataSource):
    """spark.dataSource.register(GranuleSource); spark.read.format("granule").schema(...).load(folder)"""

    @classmethod
    def name(cls):
        return "granule"

    def schema(self):
        return "granule_name string, gt string, lon double, lat double, h_can double"

    def reader(self, schema):
        return GranuleReader(schema, self.options)
