"""Versioned datasets: a Parquet folder for each version, and a manifest whose rename commits it."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from packaging.specifiers import SpecifierSet
from packaging.version import Version
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import filesystem, shared_dir

DEFAULT = "local"


class DatasetNotFoundError(KeyError):
    """No such dataset or version."""


@dataclass(frozen=True)
class Name:
    """namespace.project.name"""

    namespace: str
    project: str
    name: str

    @classmethod
    def of(cls, name: str, namespace: str | None = None, project: str | None = None) -> Name:
        parts = name.split(".")
        if "@" in name or not all(parts) or len(parts) > 3:
            raise ValueError(f"{name!r} is no dataset's name")
        spaces = [namespace or DEFAULT, project or DEFAULT]
        return cls(*([*spaces[: 3 - len(parts)], *parts]))

    def __str__(self) -> str:
        return f"{self.namespace}.{self.project}.{self.name}"


class Catalog:
    """Datasets under a root folder, by default in the session's shared one."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/weft-catalog").rstrip("/")
        self.fs, self.base = filesystem(self.root)

    def _uri(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _dir(self, n: Name) -> str:
        return f"datasets/{n.namespace}/{n.project}/{n.name}"

    def _entries(self, path: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{path}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def _read(self, path: str) -> dict | None:
        if not self.fs.get_file_info(f"{self.base}/{path}").is_file:
            return None
        with self.fs.open_input_stream(f"{self.base}/{path}") as f:
            return json.loads(f.read())

    def _write(self, path: str, value: dict) -> None:
        """By a temporary name, so that readers see all of it or nothing."""
        target, temp = f"{self.base}/{path}", f"{self.base}/{path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(temp, compression=None) as out:
            out.write(json.dumps(value, indent=1, default=str).encode())
        self.fs.move(temp, target)

    def versions(self, name: Name | str) -> list[str]:
        n = Name.of(name) if isinstance(name, str) else name
        return sorted((v.removesuffix(".json") for v in self._entries(self._dir(n)) if v.endswith(".json")), key=Version)

    def resolve(self, name: Name | str, version: str | int | None = None) -> tuple[Name, str]:
        """The newest version, or the newest that a version, a specifier or a major number allows."""
        n = Name.of(name) if isinstance(name, str) else name
        have = self.versions(n)
        if isinstance(version, int) or version is not None and version.isdigit():
            have = [v for v in have if Version(v).major == int(version)]
        elif version is not None:
            spec = SpecifierSet(version if version[0] in "<>=!~" else f"=={version}")
            have = [v for v in have if Version(v) in spec]
        if not have:
            raise DatasetNotFoundError(f"{n}" + (f" version {version}" if version is not None else ""))
        return n, have[-1]

    def manifest(self, name: Name | str, version: str | int | None = None) -> dict:
        n, v = self.resolve(name, version)
        return self._read(f"{self._dir(n)}/{v}.json")

    def read(self, name: Name | str, version: str | int | None = None) -> DataFrame:
        m = self.manifest(name, version)
        schema = T.StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(self._uri(m["data"]))

    def next_version(self, name: Name, update: str = "patch") -> str:
        have = self.versions(name)
        if not have:
            return "1.0.0"
        v = Version(have[-1])
        steps = {"patch": (v.major, v.minor, v.micro + 1), "minor": (v.major, v.minor + 1, 0), "major": (v.major + 1, 0, 0)}
        if update not in steps:
            raise ValueError("update_version is 'patch', 'minor' or 'major'")
        return ".".join(map(str, steps[update]))

    def save(self, df: DataFrame, name: Name | str, version: str | None = None, update_version: str = "patch", description: str | None = None, attrs: list[str] | None = None, dependencies: list[dict] | None = None, plan: str | None = None) -> str:
        """Writes the rows, then the manifest with statistics, a preview and the dependencies."""
        n = Name.of(name) if isinstance(name, str) else name
        have = self.versions(n)
        version = version or self.next_version(n, update_version)
        if version in have:
            raise ValueError(f"{n} has version {version} already")
        if have and Version(version) < Version(have[-1]):
            raise ValueError(f"versions of {n} only grow; the newest is {have[-1]}")
        data = f"{self._dir(n)}/data-{version}-{uuid.uuid4().hex}"
        sizes = [f"{f.name}.size" for f in df.schema if isinstance(f.dataType, T.StructType) and {"path", "size"} <= set(f.dataType.fieldNames())]
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.col(s)), F.lit(0)).alias(f"s{i}") for i, s in enumerate(sizes)]).write.parquet(self._uri(data))
        stats = seen.get
        table = self.spark.read.schema(df.schema).parquet(self._uri(data))
        preview = table.limit(20).select(F.to_json(F.struct("*")).alias("j")).collect()
        self._write(
            f"{self._dir(n)}/{version}.json",
            {"name": str(n), "version": version, "uuid": uuid.uuid4().hex, "created_at": time.time(), "description": description, "attrs": attrs or [], "data": data, "schema": df.schema.jsonValue(),
             "num_rows": stats["rows"], "size": sum(stats[f"s{i}"] for i in range(len(sizes))), "preview": [json.loads(r.j) for r in preview], "dependencies": dependencies or [], "plan": plan},
        )
        return version

    def names(self, namespace: str | None = None, project: str | None = None) -> list[Name]:
        return [Name(a, b, c) for a in self._entries("datasets") if namespace in (None, a) for b in self._entries(f"datasets/{a}") if project in (None, b) for c in self._entries(f"datasets/{a}/{b}") if self.versions(Name(a, b, c))]

    def datasets(self, attrs: list[str] | None = None, prefix: str = "", exclude: str | None = "lst__") -> DataFrame:
        """The registry as rows; ``attrs`` has 'k' or 'k=v', all of which must be there."""
        rows = []
        names = [n for n in self.names() if n.name.startswith(prefix) and not (exclude and n.name.startswith(exclude))]
        wanted = [(n, v) for n in names for v in self.versions(n)]
        with ThreadPoolExecutor(16) as pool:
            for (n, v), m in zip(wanted, pool.map(lambda x: self._read(f"{self._dir(x[0])}/{x[1]}.json"), wanted)):
                own = {a for x in m["attrs"] for a in (x, x.split("=")[0])}
                if set(attrs or []) <= own:
                    rows.append((n.namespace, n.project, n.name, v, m["num_rows"], m["size"], m["description"], m["attrs"], float(m["created_at"])))
        return self.spark.createDataFrame(rows, "namespace string, project string, name string, version string, num_rows long, size long, description string, attrs array<string>, created_at double")

    def delete(self, name: Name | str, version: str | None = None, force: bool = False) -> None:
        """The given version; without one the newest, or all of them by ``force``."""
        n = Name.of(name) if isinstance(name, str) else name
        chosen = self.versions(n) if force and version is None else [self.resolve(n, version)[1]]
        if not chosen:
            raise DatasetNotFoundError(str(n))
        for v in chosen:
            m = self._read(f"{self._dir(n)}/{v}.json")
            self.fs.delete_file(f"{self.base}/{self._dir(n)}/{v}.json")
            self.fs.delete_dir(f"{self.base}/{m['data']}")
        if not self.versions(n):
            self.fs.delete_dir(f"{self.base}/{self._dir(n)}")

    def move(self, source: Name | str, target: Name | str) -> None:
        a, b = (Name.of(x) if isinstance(x, str) else x for x in (source, target))
        if self.versions(b):
            raise ValueError(f"{b} exists")
        versions = self.versions(a)
        if not versions:
            raise DatasetNotFoundError(str(a))
        for v in versions:
            m = self._read(f"{self._dir(a)}/{v}.json")
            moved = f"{self._dir(b)}/{m['data'].rsplit('/', 1)[-1]}"
            self.fs.create_dir(f"{self.base}/{self._dir(b)}", recursive=True)
            self.fs.move(f"{self.base}/{m['data']}", f"{self.base}/{moved}")
            self._write(f"{self._dir(b)}/{v}.json", m | {"name": str(b), "data": moved})
        self.fs.delete_dir(f"{self.base}/{self._dir(a)}")

    def dependencies(self, name: Name | str, version: str | None = None, recursive: bool = False) -> list[dict]:
        out = list(self.manifest(name, version)["dependencies"])
        if recursive:
            for d in list(out):
                try:
                    out += [x for x in self.dependencies(d["name"], f"=={d['version']}", True) if x not in out]
                except DatasetNotFoundError:
                    continue  # the version it was made from is gone; the link to it stays
        return out

    def create_project(self, namespace: str, project: str) -> None:
        Name.of("x", namespace, project)
        self.fs.create_dir(f"{self.base}/datasets/{namespace}/{project}", recursive=True)

    def delete_namespace(self, namespace: str) -> None:
        if namespace == DEFAULT:
            raise ValueError("the default namespace stays")
        if self.names(namespace):
            raise ValueError(f"{namespace} isn't empty")
        if not self._entries(f"datasets/{namespace}") and namespace not in self._entries("datasets"):
            raise DatasetNotFoundError(namespace)
        self.fs.delete_dir(f"{self.base}/datasets/{namespace}")

    def checkpoint(self, key: str) -> dict | None:
        return self._read(f"checkpoints/{key}.json")

    def set_checkpoint(self, key: str, name: str, version: str) -> None:
        self._write(f"checkpoints/{key}.json", {"name": name, "version": version})
