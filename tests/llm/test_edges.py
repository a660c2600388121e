"""Nulls, empty and very long texts, repeated rows, empty tables, columns with clashing names: every operator gives one defined row for each."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.llm import byte_bpe, language_id, line_dedup, media_columns, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup, token_counts
from timberline.llm.queries import TOKENIZERS

from . import plain


def _labels(docs):
    return docs.select("doc_id", (F.length("text") % 2).cast("int").alias("quality"))


OPERATORS = {
    "token_counts": lambda d: token_counts.count_tokens(d, f"{TOKENIZERS}/byte_bpe_50k.json"),
    "quality_rules": lambda d: quality_rules.judge(d, _labels(d)),
    "suffix_dedup": suffix_dedup.cut,
    "quality_classifier": quality_classifier.classify,
    "line_dedup": line_dedup.report,
    "byte_bpe": lambda d: byte_bpe.round_trip_digests(d, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"),
    "language_id": language_id.identify,
    "ngram_join": ngram_join.similar_components,
    "media_columns": media_columns.text_media,
    "mixing": mixing.decisions,
}


@pytest.fixture(scope="module")
def edges(spark):
    return plain.table(spark, plain.edge_rows()).cache()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_for_each(edges, name):
    got = OPERATORS[name](edges).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in plain.edge_rows())
    same = {tuple(map(str, r)) for r in got if r.doc_id == 6}
    assert len(same) == 1


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(edges, name):
    assert OPERATORS[name](edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(OPERATORS))
def test_only_nulls(spark, name):
    docs = plain.table(spark, [(None, None, None), (1, None, None)])
    got = OPERATORS[name](docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1]


STAGES = {"keep": quality_classifier.keep, "dedup": line_dedup.dedup, "keep_first": ngram_join.keep_first, "mix": mixing.mix}


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_columns(edges, name):
    out = STAGES[name](edges)
    assert out.schema.names == edges.schema.names
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in plain.edge_rows()}
    assert all(r["size"] == "x" and r["_key"] == "x" for r in out.collect())
    assert STAGES[name](edges.limit(0)).count() == 0
