"""Small files of a store (manifests, markers, ledgers), on any file system that pyarrow opens.

Bulk data goes through Spark's own readers and writers; this is for the driver, and for tasks that must
choose the exact name of the file they write. The two sides name object stores differently (s3 and s3a): a store knows both names.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyarrow import fs as pafs

SCHEMES = ("file", "s3", "hdfs", "gs", "abfs", "viewfs")


@dataclass(frozen=True)
class S3Access:
    """How an S3 store is reached. Keys stay in the environment: these are the names of its variables."""

    endpoint: str | None = None
    region: str | None = None
    access_key_env: str = "S3_ACCESS_KEY"
    secret_key_env: str = "S3_SECRET_KEY"
    anonymous: bool = False

    @staticmethod
    def from_env() -> "S3Access":
        """An endpoint and region named by S3_ENDPOINT and S3_REGION; none if there is no endpoint."""
        endpoint = os.environ.get("S3_ENDPOINT")
        return S3Access(endpoint, os.environ.get("S3_REGION", "auto")) if endpoint else S3Access()

    def _keys(self) -> tuple[str, str] | None:
        found = (os.environ.get(self.access_key_env), os.environ.get(self.secret_key_env))
        return found if all(found) and not self.anonymous else None

    def for_arrow(self) -> dict:
        out: dict = {"anonymous": True} if self.anonymous else {}
        if keys := self._keys():
            out |= dict(zip(("access_key", "secret_key"), keys))
        if self.endpoint:
            at = urlparse(self.endpoint if "://" in self.endpoint else f"https://{self.endpoint}")
            out |= {"endpoint_override": at.netloc, "scheme": at.scheme}
        return out | ({"region": self.region} if self.region else {})

    def for_spark(self) -> dict[str, str]:
        """Session settings for s3a paths."""
        out = {}
        if self.endpoint:
            plain = self.endpoint.startswith("http://")
            out |= {"endpoint": self.endpoint, "path.style.access": "true", "connection.ssl.enabled": str(not plain).lower()}
        if self.region:
            out["endpoint.region"] = self.region
        if keys := self._keys():
            out |= dict(zip(("access.key", "secret.key"), keys))
        if self.anonymous:
            out["aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
        return {f"spark.hadoop.fs.s3a.{k}": v for k, v in out.items()}


@dataclass(frozen=True)
class Store:
    """A root folder; names are relative to it."""

    uri: str
    s3: S3Access = field(default_factory=S3Access)

    @staticmethod
    def at(path: str, s3: S3Access | None = None) -> "Store":
        """A URI or a plain path; s3a is s3 by another name. Without s3, the environment says how S3 is reached."""
        if "://" not in path and not path.startswith("file:"):
            path = f"file://{os.path.abspath(os.path.expanduser(path))}"
        scheme, _, rest = path.partition(":")
        scheme = "s3" if scheme == "s3a" else scheme
        if scheme not in SCHEMES:
            raise ValueError(f"scheme {scheme!r} is not supported")
        if scheme in ("s3", "gs", "abfs") and not urlparse(path).netloc:
            raise ValueError(f"{path!r} names no bucket")
        return Store(f"{scheme}:{rest}".rstrip("/"), s3 or S3Access.from_env())

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if self.uri.startswith("s3:"):
            return pafs.S3FileSystem(**self.s3.for_arrow()), self.uri.partition("://")[2]
        return pafs.FileSystem.from_uri(self.uri)

    @property
    def spark_uri(self) -> str:
        """What Spark reads and writes."""
        return "s3a" + self.uri[2:] if self.uri.startswith("s3:") else self.uri

    def path(self, name: str) -> str:
        return f"{self.spark_uri}/{name}"

    def local_path(self, name: str) -> str | None:
        """The operating system's path of a file, if the store is a local folder."""
        store, root = self._open()
        return f"{root}/{name}" if isinstance(store, pafs.LocalFileSystem) else None

    def open_input(self, name: str):
        """A file to read at any place."""
        store, root = self._open()
        return store.open_input_file(f"{root}/{name}")

    def exists(self, name: str) -> bool:
        store, root = self._open()
        return store.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound

    def read(self, name: str) -> bytes:
        store, root = self._open()
        with store.open_input_stream(f"{root}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: a file beside it, then a move. Object stores put in one step."""
        store, root = self._open()
        target = f"{root}/{name}"
        if isinstance(store, pafs.LocalFileSystem) or type(store).__name__ == "HadoopFileSystem":
            store.create_dir(os.path.dirname(target), recursive=True)
            beside = f"{target}.tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(beside) as f:
                f.write(data)
            store.move(beside, target)
        else:
            with store.open_output_stream(target) as f:
                f.write(data)

    def delete(self, name: str, missing_ok: bool = True) -> None:
        store, root = self._open()
        try:
            store.delete_file(f"{root}/{name}")
        except FileNotFoundError:
            if not missing_ok:
                raise

    def names(self, folder: str) -> list[str]:
        """Names of the files of a folder, sorted; none if there is no such folder."""
        return self._list(folder, pafs.FileType.File)

    def folders(self, folder: str = "") -> list[str]:
        return self._list(folder, pafs.FileType.Directory)

    def _list(self, folder: str, kind) -> list[str]:
        store, root = self._open()
        found = store.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == kind)
