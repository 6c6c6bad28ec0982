"""Optional enrichment of flagged units by a model behind a plain function."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fence
from tessera.operators.usage import cost, is_local

BATCH, PROMPT_CHARS, DOCUMENT_CHARS, ENTITIES = 6, 2400, 24_000, 8
#: A provider: (prompt) to (text, in_tokens, out_tokens, cached_tokens). It is shipped to executors, so it must pickle.
Provider = Callable[[str], tuple[str, int, int, int]]
RETRY_STATUS = (408, 429)


def none_provider(prompt: str) -> tuple[str, int, int, int]:
    """No model: nothing is said, nothing is spent."""
    return "", 0, 0, 0


def with_retries(call: Callable[[], tuple[int, dict, str]], tries: int = 4, base: float = 0.5, most: float = 20.0, sleep=time.sleep) -> str:
    """The body of the first answer that isn't 408, 429 or 5xx; waits with full jitter, or as asked for up to ``most`` seconds."""
    for k in range(tries):
        status, headers, body = call()
        if status not in RETRY_STATUS and status < 500:
            return body
        if k + 1 < tries:
            asked = headers.get("Retry-After", "")
            sleep(min(most, float(asked)) if asked.replace(".", "", 1).isdigit() else random.uniform(0, min(most, base * 2**k)))
    raise RuntimeError(f"no answer after {tries} tries: {status}")


def choose_provider(wanted: str, available: dict[str, Provider]) -> tuple[str, Provider]:
    """The provider asked for; ``auto`` takes a local one first; none there, none taken."""
    if wanted == "auto":
        wanted = next((n for n in sorted(available, key=lambda n: (not n.startswith(("ollama", "local", "mlx")), n))), "none")
    return (wanted, available[wanted]) if wanted in available else ("none", none_provider)


def batches_of_flagged(units: DataFrame, size: int = BATCH) -> DataFrame:
    """Flagged units with the ``batch`` of their document that they are asked in, in order."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return units.filter(F.size("escalation_flags") > 0).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def prompts(flagged: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, batch, ids, prompt``: the document once, then its units of the batch."""
    chunk = F.concat(F.lit('<chunk id="'), "id", F.lit('">\n'), fence(F.substring("content", 1, PROMPT_CHARS)), F.lit("\n</chunk>"))
    g = flagged.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("seq", "id", chunk.alias("c")))).alias("l"))
    body = F.concat(F.lit("<document>\n"), fence(F.substring("text", 1, DOCUMENT_CHARS)), F.lit("\n</document>\nFor each chunk give one sentence that situates it in the document, and its entities.\n"), F.array_join(F.transform("l", lambda x: x["c"]), "\n"))
    return g.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "batch", F.transform("l", lambda x: x["id"]).alias("ids"), body.alias("prompt"))


def ask(asked: DataFrame, provider: Provider, model: str, parallel: int = 3) -> tuple[DataFrame, DataFrame]:
    """(answers ``doc_id, id, summary, entities, n_in_batch``, calls) from up to ``parallel`` tasks at a time; failures are counted, not raised."""

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                try:
                    text, i, o, c = provider(row.prompt)
                    failed = False
                except Exception:  # noqa: BLE001 - a provider's failure is a result
                    text, i, o, c, failed = "", 0, 0, 0, True
                out.append((row.doc_id, row.batch, len(row.ids), text, i, o, c, failed))
            yield pd.DataFrame(out, columns=["doc_id", "batch", "n", "answer", "in_tokens", "out_tokens", "cached_tokens", "failed"])

    schema = "doc_id long, batch int, n int, answer string, in_tokens long, out_tokens long, cached_tokens long, failed boolean"
    said = asked.repartition(parallel).mapInPandas(run, schema).persist()
    parsed = said.select("doc_id", "n", F.explode_outer(F.from_json("answer", "array<struct<id:string,summary:string,entities:array<string>>>")).alias("a"), (cost(F.lit(model), F.col("in_tokens"), F.col("out_tokens"), F.col("cached_tokens")) / F.col("n")).alias("share"))
    answers = parsed.filter("a.id IS NOT NULL").select("doc_id", "a.id", "a.summary", "a.entities", "share")
    return answers, said.withColumn("model", F.lit(model))


def apply_answers(units: DataFrame, answers: DataFrame, model: str) -> DataFrame:
    """Units with summary, entities (eight at most), tier and their share of the cost; of several answers the first holds."""
    first = answers.groupBy("doc_id", "id").agg(F.min(F.struct("summary", "entities", "share")).alias("a"))
    tier = F.when(is_local(F.lit(model)), 1).otherwise(2)
    out = units.join(first, ["doc_id", "id"], "left")
    got = F.col("a").isNotNull() & (F.coalesce(F.col("a.summary"), F.lit("")) != "")
    return out.withColumns({
        "situating_summary": F.when(got, F.col("a.summary")).otherwise(F.col("situating_summary")), "tier": F.when(got, tier).otherwise(F.coalesce("tier", F.lit(0))),
        "entities": F.when(got, F.slice(F.coalesce("a.entities", F.array().cast("array<string>")), 1, ENTITIES)).otherwise(F.col("entities")),
        "llm_calls": F.when(got, 1).otherwise(F.coalesce("llm_calls", F.lit(0))), "cost_usd": F.when(got, F.round("a.share", 6)).otherwise(F.coalesce("cost_usd", F.lit(0.0))),
    }).drop("a")


def merge_entities(units: DataFrame, named: DataFrame, least_tokens: int = 30, most_units: int = 15) -> DataFrame:
    """Units with entities found elsewhere (``doc_id, id, found``): the first ``most_units`` of a document that are long enough and no schema card."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    fit = units.filter((F.col("token_count") >= least_tokens) & ~F.col("content").startswith("# Schema")).join(named, ["doc_id", "id"]).filter(F.size("found") > 0).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most_units).select("doc_id", "id", "found")
    none = F.array().cast("array<string>")
    return units.join(fit, ["doc_id", "id"], "left").withColumn("entities", F.when(F.col("found").isNotNull(), F.array_union(F.coalesce("entities", none), "found")).otherwise(F.col("entities"))).drop("found")


def summary_row(units: DataFrame, calls: DataFrame) -> DataFrame:
    """Flagged and enriched units, calls, calls saved by batching, failures."""
    u = units.agg(F.count_if(F.size("escalation_flags") > 0).alias("flagged"), F.count_if(F.coalesce("situating_summary", F.lit("")) != "").alias("enriched"))
    c = calls.agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("asked"))
    return u.join(F.broadcast(c)).withColumn("calls_saved", F.col("asked") - F.col("calls"))


def parse_json(text: str) -> list | dict | None:
    """A model's JSON, with or without a code fence; None if there is none."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(body)
    except ValueError:
        return None


