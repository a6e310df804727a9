"""New table dumps of a folder as a stream: each trigger reads the files that were not there before."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSourceStreamReader

from netloom.sources.mrt import File, MrtReader, listed


class RibFiles(DataSourceStreamReader):
    """Offsets are file names in order; archives name their files by time."""

    def __init__(self, options, schema):
        self.inner = MrtReader(options, schema)

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        return {"last": max((p.rsplit("/", 1)[-1] for p in self._files()), default="")}

    def _files(self):
        return listed(self.inner.options["path"])

    def partitions(self, start, end):
        start, end = (json.loads(x) if isinstance(x, str) else x for x in (start, end))
        return [File(p) for p in self._files() if start["last"] < p.rsplit("/", 1)[-1] <= end["last"]]

    def read(self, partition):
        return self.inner.read(partition)

    def commit(self, end):
        pass
