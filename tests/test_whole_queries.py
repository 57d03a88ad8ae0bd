"""Queries over all sections of each document against plain counts."""

import re
from collections import Counter, defaultdict

import pytest

from folioscope import registry


@pytest.fixture(scope="module")
def sections(spark, sf_dir):
    """(doc_id, section_number, text) of every line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(i, k, line) for i, text in docs if text is not None for k, line in enumerate(text.split("\n"), 1)]


def made(spark, sf_dir, name, *columns):
    return [tuple(r) for r in registry.queries()[name](spark, sf_dir).select(*columns).collect()]


@pytest.mark.parametrize("name", ["lateral_top1_all", "range_left_all"])
def test_every_section_is_there(spark, sf_dir, sections, name):
    assert sorted(made(spark, sf_dir, name, "doc_id", "section_number")) == sorted((i, k) for i, k, _ in sections)
    assert max(k for _, k, _ in sections) > 40


def test_mode_of_every_section_number(spark, sf_dir, sections):
    total = Counter(k for _, k, _ in sections)
    assert dict(made(spark, sf_dir, "mode_heading_all", "section_number", "total")) == total


def test_prevalence_by_heading(spark, sf_dir, sections):
    want = Counter((line[:40].strip().lower(), k) for _, k, line in sections if line)
    assert {r[:2]: r[2] for r in made(spark, sf_dir, "section_prevalence_all", "title", "section_number", "n")} == want


def test_terms_of_any_length_in_text(spark, sf_dir, sections):
    terms = defaultdict(set)
    for i, _, line in sections:
        terms[i].update(t.lower() for t in re.findall("[A-Z][a-z]{3,}", line))
    want = {(i, k): n for i, k, line in sections if (n := sum(t in line.lower() for t in terms[i]))}
    assert {r[:2]: r[2] for r in made(spark, sf_dir, "terms_in_text_all", "doc_id", "section_number", "terms")} == want


def test_lists_of_terms_of_any_length(spark, sf_dir, sections):
    docs = defaultdict(set)
    for i, _, line in sections:
        for t in re.findall("[A-Z][a-z]{3,}", line):
            docs[t].add(i)
    want = {t: ",".join(map(str, sorted(ids)[:5])) for t, ids in docs.items()}
    assert dict(made(spark, sf_dir, "ordered_lists_all", "term", "examples")) == want
