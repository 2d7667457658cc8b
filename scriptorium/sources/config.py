"""Configuration as a JSON document."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "api_key string, model_name string, mailing_list array<string>, notifier struct<email: string, password: string>, last_master_update string, last_master_filename string, schedule array<map<string,string>>, programs array<struct<key: string, name: string>>"


@dataclass
class Config:
    """Each setter saves at once, by writing another file and renaming it."""

    path: str
    mailing_list: list[str]
    notifier: dict[str, str]
    programs: list[dict[str, str]]
    api_key: str = ""
    model_name: str = ""
    last_master_update: str = ""
    last_master_filename: str = ""
    schedule: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """Raises if the file, or one of the keys without a default, is missing."""
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        if missing := {"mailing_list", "notifier", "programs"} - held.keys():
            raise KeyError(f"missing keys {sorted(missing)}")
        return cls(path, **{k: v for k, v in held.items() if k in cls.__dataclass_fields__ and k != "path"})

    def save(self) -> None:
        held = {k: v for k, v in asdict(self).items() if k != "path"}
        with tempfile.NamedTemporaryFile("w", dir=Path(self.path).parent, delete=False, encoding="utf-8") as f:
            json.dump(held, f, ensure_ascii=False, indent=2)
        os.replace(f.name, self.path)

    def set(self, **values) -> None:
        """Checked: known names, the right kind, and no empty text for the model's settings."""
        kinds = {"api_key": str, "model_name": str, "mailing_list": list, "notifier": dict, "schedule": list, "programs": list}
        for k, v in values.items():
            if not isinstance(v, kinds[k]) or kinds[k] is str and not v:
                raise ValueError(f"{k} must be a {'non-empty ' if kinds[k] is str else ''}{kinds[k].__name__}")
            if k == "notifier" and not (v.get("email") and v.get("password")):
                raise ValueError("notifier needs email and password")
        for k, v in values.items():
            setattr(self, k, v)
        self.save()

    def ids(self) -> dict[str, str]:
        """code -> name; the last of a repeated code holds."""
        return {p["key"]: p["name"] for p in self.programs}

    def set_master(self, codes: dict[str, str], filename: str) -> None:
        self.programs = [{"key": k, "name": v} for k, v in codes.items()]
        self.last_master_update, self.last_master_filename = date.today().strftime("%d/%m/%Y"), Path(filename).name
        self.save()

    def __repr__(self) -> str:
        return f"Config({self.path!r}, {len(self.programs)} programs, {len(self.mailing_list)} recipients, secrets hidden)"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True)


def programs(config: DataFrame) -> DataFrame:
    """code, name."""
    return config.selectExpr("inline(programs)").toDF("code", "name")


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines into the environment; blank lines, comments and what is set already
    are passed over."""
    put = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        k, eq, v = line.strip().partition("=")
        if eq and not k.startswith("#") and k.strip() not in os.environ:
            put[k.strip()] = os.environ[k.strip()] = v.strip()
    return put
