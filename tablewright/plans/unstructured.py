"""From texts to a table of records and its advisory in one call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewright.operators import text as texts
from tablewright.plans.advisory import Advisory, run_advisory
from tablewright.session import materialised


@dataclass(frozen=True)
class TextAdvisory:
    records: DataFrame
    rejects: DataFrame
    advisory: Advisory


def text_table(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: texts.Lexicon = texts.Lexicon(),
    directive: Mapping[str, tuple[str, str]] | None = None,
    separator: str = texts.PARAGRAPH_SEPARATOR,
    max_chunks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of all chunks of all texts.

    A record has the key and place of its chunk, category, sentiment, urgency, action, main topic and the fields of the
    directive. With a directive, chunks in which none of its fields is found are rejects with the reason. Texts without a
    chunk give neither; a null key is a key of its own; chunks of repeated keys that share a place share a topic.
    """
    chunks = texts.batch(texts.chunk_documents(df, key, text, separator, max_chunks=max_chunks), ["key", "pos"], "chunk")
    records = texts.extract_records(chunks, "chunk", lexicon, keep=["key", "pos", "chunk"])
    rejects = df.sparkSession.createDataFrame([], "reason string")
    if directive:
        clash = [n for n in directive if n in (*records.columns, "main_topic")]
        if clash:
            raise ValueError(f"names of the directive that records already have: {', '.join(clash)}")
        found = texts.extract_fields(records, "chunk", directive, keep=records.columns)
        records, rejected = texts.split_rejects(found, "chunk", list(directive))
        rejects = rejected.select("key", "pos", "chunk", "reason")
    # Chunks share key and place only if texts share the key.
    topics = texts.with_main_topic(records, ["key", "pos"], "chunk", texts.repeated_keys(df, [key]), ["key"])
    return topics.drop("chunk"), rejects


def run_text_advisory(
    df: DataFrame,
    key: str,
    text: str,
    goal: str = "",
    lexicon: texts.Lexicon = texts.Lexicon(),
    directive: Mapping[str, tuple[str, str]] | None = None,
    separator: str = texts.PARAGRAPH_SEPARATOR,
    max_chunks: int | None = None,
    **options,
) -> TextAdvisory:
    """The records of the texts, written once to the shared folder, and everything ``run_advisory`` says of them.

    ``options`` go to ``run_advisory``; keys, places and topics (nearly as many as records) take no part in the models.
    """
    records, rejects = text_table(df, key, text, lexicon, directive, separator, max_chunks)
    records = materialised(records)
    advisory = run_advisory(records.drop("key", "pos", "main_topic"), goal, **options)
    return TextAdvisory(records, rejects, advisory)
