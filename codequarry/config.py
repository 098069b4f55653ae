"""Settings: defaults, a file beside the project or in the home folder, and the environment on top."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

FILE_NAME, HOME_FOLDER, PREFIX = "config.json", ".codequarry", "CODEQUARRY_"


@dataclass(frozen=True)
class Config:
    model: str = ""
    api_key: str = ""
    api_base: str = ""
    language: str = "en"
    max_file_size: int = 200 * 1024
    max_files: int = 1000
    output_dir: str = "wiki"
    concurrency: int = 5
    generation_mode: str = "full"

    @classmethod
    def load(cls, folder: str = ".", aliases: dict[str, str] | None = None) -> Config:
        """The first settings file found, overridden by CODEQUARRY_* variables; model names go through aliases."""
        found: dict = {}
        for path in (Path(folder) / FILE_NAME, Path.home() / HOME_FOLDER / FILE_NAME):
            if path.is_file():
                found = json.loads(path.read_text())
                break
        values = {}
        for f in fields(cls):
            value = os.environ.get(PREFIX + f.name.upper(), found.get(f.name))
            if value not in (None, ""):
                values[f.name] = int(value) if f.type == "int" else str(value)
        if "model" in values:
            values["model"] = (aliases or {}).get(values["model"], values["model"])
        return cls(**values)

    def save(self, folder: str = ".") -> None:
        """Write what is set; empty values are left out."""
        (Path(folder) / FILE_NAME).write_text(json.dumps({k: v for k, v in asdict(self).items() if v != ""}, indent=2))
