"""Registered queries over the supplied tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkmill.plans import answers, corpus, live, records, search, sources, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus.QUERIES, **search.QUERIES, **transcripts.QUERIES, **live.QUERIES, **records.QUERIES, **answers.QUERIES, **sources.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus.ORACLE_SQL, **search.ORACLE_SQL, **transcripts.ORACLE_SQL, **live.ORACLE_SQL, **records.ORACLE_SQL, **answers.ORACLE_SQL, **sources.ORACLE_SQL}
