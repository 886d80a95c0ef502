"""Answers that were paid for, kept where every task finds them again."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyarrow import fs as pa_fs


class Ledger:
    """A folder of answers, a file for each, named by what was asked.

    A task looks here before it asks and writes what it got before it goes on: a
    task that is run again, or a build begun anew after a failure, pays for nothing twice.  Files
    appear whole (written aside, then renamed), so that two runs of one task may meet.
    """

    def __init__(self, top: str):
        self.top = top

    @staticmethod
    def key(*asked: object) -> str:
        return hashlib.sha256(json.dumps(asked).encode()).hexdigest()

    def __getstate__(self) -> dict:
        return {"top": self.top}

    def reach(self) -> tuple[pa_fs.FileSystem, str]:
        if "at" not in self.__dict__:
            self.at = (pa_fs.LocalFileSystem(), self.top.removeprefix("file:").replace("//", "/")) if self.top.startswith(("file:", "/")) else pa_fs.FileSystem.from_uri(self.top)
        return self.at

    def get(self, key: str) -> dict | None:
        fs, base = self.reach()
        try:
            with fs.open_input_file(f"{base}/{key[:2]}/{key}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, answer: dict) -> None:
        fs, base = self.reach()
        fs.create_dir(f"{base}/{key[:2]}", recursive=True)
        aside = f"{base}/{key[:2]}/.{key}-{os.getpid()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps(answer).encode())
        fs.move(aside, f"{base}/{key[:2]}/{key}.json")
