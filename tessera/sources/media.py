"""Audio, video and images: normalised answers of workers, and labelled stand-ins without them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import ELEMENT_KINDS

CHANGE_TYPES = ("shot", "scene", "slide", "event")
#: A worker: (file name, bytes) to its JSON answer. It is shipped to executors, so it must pickle.
Worker = Callable[[str, bytes], str]
_SEGMENTS = "array<struct<text:string,start:double,end:double,speaker:string>>"
_META = "struct<visual_summary:string,scene:string,visual_change_type:string,ocr_text:string,entities:array<string>>"
_VIDEO = f"array<struct<id:string,kind:string,text:string,t0:double,t1:double,speaker:string,visual_change_type:string,meta:{_META}>>"
_SCENES = "array<struct<t0:double,t1:double,speech:string,speaker:string,visual:string,on_screen_text:string,change_type:string>>"


def ask_worker(files: DataFrame, worker: Worker, parallel: int = 3) -> DataFrame:
    """``doc_id, name, answer, problem``: the worker's answer for each file; a failure is told, not raised."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.doc_id, r.name, worker(r.name, r.content), None))
                except Exception as e:  # noqa: BLE001 - one file's failure must not end the others
                    rows.append((r.doc_id, r.name, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "answer", "problem"])

    return files.select("doc_id", "name", "content").repartition(parallel).mapInPandas(run, "doc_id long, name string, answer string, problem string")


def speech_elements(answers: DataFrame) -> DataFrame:
    """Segments of a transcript (``answer``: a JSON array). Blank ones are left out; ids keep their places."""
    s = answers.select("doc_id", F.posexplode(F.from_json("answer", _SEGMENTS)).alias("pos", "s")).filter("s IS NOT NULL AND trim(s.text) <> ''")
    return s.select("doc_id", "pos", F.concat(F.lit("el_"), F.col("pos").cast("string")).alias("id"), F.lit("speech_segment").alias("kind"), F.trim("s.text").alias("text"), F.col("s.start").alias("t0"), F.col("s.end").alias("t1"), "s.speaker")


def video_elements(answers: DataFrame) -> DataFrame:
    """Elements of a video worker: a change type at the top holds where the element's own meta has none."""
    v = answers.select("doc_id", F.posexplode(F.from_json("answer", _VIDEO)).alias("pos", "v")).filter("v IS NOT NULL")
    kind = F.coalesce(F.nullif("v.kind", F.lit("")), F.lit("speech_segment"))
    change = F.coalesce("v.meta.visual_change_type", F.when(F.col("v.visual_change_type").isin(*CHANGE_TYPES), F.col("v.visual_change_type")))
    return v.select("doc_id", "pos", F.coalesce("v.id", F.format_string("v_el_%04d", "pos")).alias("id"), F.when(kind.isin(*ELEMENT_KINDS), kind).otherwise("other").alias("kind"), F.trim(F.coalesce("v.text", F.lit(""))).alias("text"), "v.t0", "v.t1", "v.speaker", "v.meta.visual_summary", "v.meta.scene", change.alias("visual_change_type"), "v.meta.ocr_text", "v.meta.entities", F.lit(False).alias("synthetic"), F.lit("video_worker").alias("extraction_mode"))


def scene_elements(answers: DataFrame) -> DataFrame:
    """A vision model's scenes: for each what is said and what is seen; a scene without an end lasts five seconds."""
    s = answers.select("doc_id", F.posexplode(F.from_json("answer", _SCENES)).alias("k", "s")).filter("s IS NOT NULL")
    seen = F.concat(F.format_string("[Scene %d] ", F.col("k") + 1), F.coalesce("s.visual", F.lit("")), F.when(F.coalesce(F.col("s.on_screen_text"), F.lit("")) != "", F.concat(F.lit(" | On-screen Text: "), "s.on_screen_text")).otherwise(""))
    end = F.coalesce("s.t1", F.col("s.t0") + 5.0)
    change = F.when(F.col("s.change_type").isin(*CHANGE_TYPES), F.col("s.change_type"))
    row = lambda n, kind, text, speaker, summary: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), text.alias("text"), speaker.cast("string").alias("speaker"), summary.cast("string").alias("visual_summary"))
    both = F.array(row(0, "speech_segment", F.coalesce("s.speech", F.lit("")), F.col("s.speaker"), F.col("s.visual")), row(1, "visual_event", F.when(F.coalesce("s.visual", F.lit("")) != "", seen).otherwise(""), F.lit(None), F.col("s.visual")))
    out = s.select("doc_id", "k", F.col("s.t0").alias("t0"), end.alias("t1"), change.alias("visual_change_type"), F.nullif("s.on_screen_text", F.lit("")).alias("ocr_text"), F.explode(both).alias("e")).filter("trim(e.text) <> ''")
    pos = F.col("k") * 2 + F.col("e.n")
    return out.select("doc_id", pos.cast("int").alias("pos"), F.format_string("v_el_%04d", pos).alias("id"), "e.kind", "e.text", "t0", "t1", "e.speaker", "e.visual_summary", "visual_change_type", "ocr_text", F.lit(False).alias("synthetic"), F.lit("vision_model").alias("extraction_mode"))


def image_elements(answers: DataFrame) -> DataFrame:
    """A description as a figure and its text as a caption; a placeholder figure where there is neither."""
    a = answers.select("doc_id", "name", F.from_json("answer", "struct<description:string,ocr_text:string>").alias("a"))
    said = F.coalesce(F.nullif(F.trim("a.description"), F.lit("")), F.concat(F.lit("[image "), "name", F.lit("]")))
    read = F.trim(F.coalesce("a.ocr_text", F.lit("")))
    some = read != ""
    figure = F.struct(F.lit(0).alias("pos"), F.lit("figure").alias("kind"), said.alias("text"), F.when(some, F.array(F.lit("el_1"))).alias("caption_ids"))
    caption = F.struct(F.lit(1).alias("pos"), F.lit("caption").alias("kind"), read.alias("text"), F.lit(None).cast("array<string>").alias("caption_ids"))
    rows = a.select("doc_id", F.explode(F.when(some, F.array(figure, caption)).otherwise(F.array(figure))).alias("e"))
    return rows.select("doc_id", "e.pos", F.concat(F.lit("el_"), F.col("e.pos").cast("string")).alias("id"), "e.kind", "e.text", "e.caption_ids", F.lit(1).alias("page"))


def _topic() -> Column:
    return F.translate(F.regexp_replace("name", r"\.[^.]*$", ""), "_-", "  ")


def _stand_in(files: DataFrame, count: int, seconds: float, what: str) -> DataFrame:
    """``count`` stretches of ``seconds`` each, one after the other, with a text that says what it stands for."""
    k = F.col("pos")
    placed = files.select("doc_id", _topic().alias("topic"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("pos"))
    text = F.format_string(f"Placeholder {what} %d of {count} for %s.", k + 1, F.col("topic"))
    return placed.select("doc_id", "pos", "topic", text.alias("text"), (k * seconds).alias("t0"), ((k + 1) * seconds).alias("t1"))


def stand_in_speech(files: DataFrame, segments: int = 5, seconds: float = 4.0) -> DataFrame:
    """Placeholder segments where no transcriber is at hand; only for those who ask for them."""
    rows = _stand_in(files, segments, seconds, "segment")
    return rows.select(
        "doc_id",
        "pos",
        F.concat(F.lit("el_"), F.col("pos").cast("string")).alias("id"),
        F.lit("speech_segment").alias("kind"),
        "text",
        "t0",
        "t1",
        F.concat(F.lit("VOICE_"), (F.col("pos") % 2).cast("string")).alias("speaker"),
    )


def stand_in_video(files: DataFrame, elements: int = 6, seconds: float = 3.0) -> DataFrame:
    """Placeholder elements, every third one seen and the others said, each labelled synthetic with no confidence."""
    rows = _stand_in(files, elements, seconds, "element")
    seen = F.col("pos") % 3 == 2
    return rows.select(
        "doc_id",
        "pos",
        F.format_string("v_el_%04d", "pos").alias("id"),
        F.when(seen, "visual_event").otherwise("speech_segment").alias("kind"),
        "t0",
        "t1",
        F.when(~seen, F.concat(F.lit("VOICE_"), (F.col("pos") % 2).cast("string"))).alias("speaker"),
        "text",
        F.when(seen, F.concat(F.lit("placeholder picture of "), "topic")).alias("visual_summary"),
        F.when(seen, "placeholder").alias("scene"),
        F.when(seen, "scene").alias("visual_change_type"),
        F.lit(True).alias("synthetic"),
        F.lit("synthetic_fallback").alias("extraction_mode"),
        F.lit(0.0).alias("data_confidence"),
    )
