"""The folder of a run, local or in a store that Arrow reaches: small JSON files from the driver, pages from the executors."""

from __future__ import annotations

import json
import time
from datetime import date
from decimal import Decimal
from enum import Enum
from functools import singledispatch

from pyarrow import fs


@singledispatch
def as_json(value):
    """The JSON form of a value that JSON has no type for."""
    raise TypeError(f"no JSON form for {value!r}")


as_json.register(date, lambda day: day.isoformat())  # times too
as_json.register(Decimal, float)
as_json.register(Enum, lambda member: member.value)


def stamp(seconds: float | None = None) -> str:
    """A name for a run from the time (UTC) at which it begins."""
    return time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(seconds))


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path or a URI), and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Folder:
    """A folder by name. Tasks can make their own from the name."""

    def __init__(self, name: str):
        self.name = name.rstrip("/")

    def __truediv__(self, inner: str) -> Folder:
        return Folder(f"{self.name}/{inner}")

    def put(self, file: str, text: str) -> None:
        system, path = opened(self.name)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{file}") as out:
            out.write(text.encode())

    def put_json(self, file: str, value) -> None:
        self.put(file, json.dumps(value, default=as_json, indent=1))


def new_run(data_root: str, name: str | None = None) -> Folder:
    """The folder of a run; frontier, plans, manifest and raw are in it."""
    return Folder(data_root) / "runs" / (name or stamp())
