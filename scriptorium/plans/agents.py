"""Ways to extract a letter's fields, behind one interface."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..operators import fields
from ..operators.model_fields import Client, model_fields
from ..profile import HEBREW, Profile
from .report import render_html


class Agent(Protocol):
    name: str
    method: str

    def extract(self, text: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Long fields from text(doc_id, raw, readable), and doc_id, stage, message of what
        went wrong."""
        ...

    def render(self, rows: DataFrame, names: DataFrame) -> DataFrame:
        """doc_id, file, html from report rows."""
        ...


@dataclass
class RuleAgent:
    profile: Profile = HEBREW
    name: str = "rules"
    method: str = "parse"

    def extract(self, text: DataFrame) -> tuple[DataFrame, DataFrame]:
        none = text.sparkSession.createDataFrame([], "doc_id string, stage string, message string")
        return fields.fields_long(fields.request_fields(text, self.profile), self.profile, self.method), none

    def render(self, rows: DataFrame, names: DataFrame) -> DataFrame:
        return render_html(rows, names, self.method)


@dataclass
class ModelAgent:
    client: Client
    profile: Profile = HEBREW
    answers: str | None = None
    name: str = "model"
    method: str = "llm"

    def extract(self, text: DataFrame) -> tuple[DataFrame, DataFrame]:
        found, errors = model_fields(text, self.profile, self.client, self.answers)
        return fields.with_links(found, text, self.profile), errors

    def render(self, rows: DataFrame, names: DataFrame) -> DataFrame:
        return render_html(rows, names, self.method)
