"""Summary fields by a language model, behind an injected client."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..profile import Profile
from ..sources.stage import kept, once, ship, waits

#: (prompt, schema) -> JSON text. Raises RetryLater when asked to come back.
Client = Callable[[str, dict], str]


class RetryLater(Exception):
    """The service is busy: status 429, 500, 502 or 503."""


def answer_schema(profile: Profile) -> dict:
    return {"type": "object", "properties": {f: {"type": "string"} for f in profile.fields}, "required": list(profile.fields), "additionalProperties": False}


def rules_of(profile: Profile) -> dict[str, str]:
    """What to give for each field; links to decisions are found by rule."""
    either = f"just '{profile.yes}' or '{profile.no}'"
    told = (
        f"the date after '{profile.date_label}' on the pages with tables, as DD/MM/YYYY",
        f"the numbers alone (NNN-NN) of all requests, joined by commas, without '{profile.request_label}', then ' | {profile.committee_label}: ' and the committee's number",
        f"the six-digit codes of the programmes that head a paragraph in the part that begins with '{profile.breakdown_starts[0]}', all of them, joined by commas; none from tables",
        f"the short paragraph after '{profile.gist[0]}', and no more",
        f"the whole text after '{profile.breakdown_starts[0]}', with the headings of programmes and what is said of them",
        "an empty string",
        f"{either}, by what the letter says outright; a letter that says it holds no such funds is '{profile.no}'",
        either,
    )
    return dict(zip(profile.fields, told, strict=True))


def prompt(text: F.Column, profile: Profile) -> F.Column:
    """Numbers put right, the letter cut at the input cap, a rule for each field in front."""
    rules = "Extract these fields from the budget request letter below. A field that the letter does not hold is an empty string.\n" + "".join(f"- {field}: {rule}.\n" for field, rule in rules_of(profile).items())
    return F.concat(F.lit(rules + "\n"), t.cap_text(t.unreverse_numbers(F.coalesce(text, F.lit(""))), profile.input_cap))


def ask(client: Client, text: str, schema: dict, attempts: int = 5, pause: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Retried after 1, 2, 4 and 8 seconds while the service is busy; the answer must
    have exactly the schema's keys, all strings."""
    busy: RetryLater | None = None
    for seconds in waits(attempts):
        if seconds:
            pause(seconds)
        try:
            answer = json.loads(client(text, schema))
            break
        except RetryLater as e:
            busy = e
    else:
        raise busy or RetryLater
    if answer.keys() != schema["properties"].keys() or not all(isinstance(v, str) for v in answer.values()):
        raise ValueError("the answer does not follow the schema")
    return answer


def judged_answers(answers: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Answers (with a column answer, JSON text; other columns stay) with m, a map with just
    the wanted names, or message, what is wrong. An answer must be an object with these
    names, each once, no others, and text under each.

    What is read of an answer is made a row of (inline), so that a filter on the message
    does not have it read again for each time that the message refers to it.
    """
    names = F.array(*map(F.lit, wanted))
    keys, whole = F.json_object_keys("answer"), F.try_parse_json("answer")
    listed = lambda what, xs: F.when(F.size(xs) > 0, F.concat(F.lit(what), F.array_join(xs, ", ")))
    told = [F.when(F.schema_of_variant(F.try_element_at("_typed", F.lit(name))) != "STRING", F.lit(name)) for name in wanted]
    again = F.filter(F.array_distinct("_keys"), lambda k: F.size(F.filter("_keys", lambda x: x == k)) > 1)
    fault = F.coalesce(
        listed("repeated: ", again),
        F.when(F.col("_whole").isNull(), "no JSON"),
        F.when(F.col("_keys").isNull(), "no object"),
        listed("missing: ", F.array_except(names, F.col("_keys"))),
        listed("unknown: ", F.array_except(F.col("_keys"), names)),
        listed("no text: ", F.array_compact(F.array(*told))),
    )
    once = lambda df, **own: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in own.items()]))))
    rows = once(answers, _keys=keys, _whole=whole)
    rows = once(rows, _typed=F.when(F.col("_whole").isNotNull() & F.col("_keys").isNotNull(), F.from_json("answer", "map<string,variant>")))
    rows = once(rows, message=fault).drop("_keys", "_whole", "_typed")
    return rows.withColumn("m", F.when(F.col("message").isNull(), F.from_json("answer", "map<string,string>")))


def checked_answers(answers: DataFrame, wanted: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(values, errors) of judged answers: values has m, errors has message."""
    rows = judged_answers(answers, wanted)
    return rows.filter("message IS NULL").drop("message"), rows.filter("message IS NOT NULL").drop("m")


def model_fields(text: DataFrame, profile: Profile, client: Client, cache_path: str | None = None, attempts: int = 5, pause: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """(long fields, errors) from text(doc_id, readable). Answers are kept by the prompt's
    hash at ``cache_path``, so that a rerun asks, and pays, only for what is new; equal
    prompts are asked once."""
    spark, schema = text.sparkSession, answer_schema(profile)
    asked = text.select("doc_id", prompt(F.col("readable"), profile).alias("prompt")).withColumn("key", F.sha2("prompt", 256))
    wanted = asked.select("key", "prompt").dropDuplicates(["key"])
    known = None
    if cache_path:
        try:
            known = spark.read.parquet(cache_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if known is not None:
        wanted = wanted.join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, p in zip(batch["key"], batch["prompt"], strict=True):
                answer = error = None
                try:
                    answer = json.dumps(ask(client, p, schema, attempts, pause), ensure_ascii=False)
                except Exception as e:  # a letter's failure is a row
                    error = str(e)
                yield pd.DataFrame({"key": [key], "answer": [answer], "error": [error]})

    ship(spark)
    got = wanted.mapInPandas(run, "key string, answer string, error string")
    got = once(got, cache_path) if cache_path else kept(got, "model-answers")
    if cache_path:
        got.filter("answer IS NOT NULL").select("key", "answer").write.mode("append").parquet(cache_path)
        answers = spark.read.parquet(cache_path)
    else:
        answers = got.filter("answer IS NOT NULL").select("key", "answer")
    parsed, unfit = checked_answers(asked.select("doc_id", "key").join(answers, "key"), profile.fields)
    entries = F.array(*[F.struct(F.lit(k).alias("field_no"), F.lit(f).alias("field"), F.coalesce(F.try_element_at("m", F.lit(f)), F.lit("")).alias("value")) for k, f in enumerate(profile.fields)])
    errors = asked.select("doc_id", "key").join(got.filter("error IS NOT NULL"), "key").select("doc_id", F.lit("model").alias("stage"), F.col("error").alias("message"))
    errors = errors.unionByName(unfit.select("doc_id", F.lit("model").alias("stage"), "message"))
    return parsed.select("doc_id", F.lit("llm").alias("method"), F.inline(entries)), errors
