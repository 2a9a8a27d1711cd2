"""Substring search by trigrams against the plain test."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions.text import contains_fragment
from rosterlake.operators.fragments import FragmentIndex, wanted_grams
from rosterlake.session import new_path

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
NAMES = [
    "Anna Berg", "ANNABEL Li", "Bo", "", None, "a%nna_b", "100% sure", "Ömer Kaya", "ömer KAYA", "Kim", "Kim Kim", "İnanna",
    "ab" * 50, "nanan", "x\ny anna", "under_score", "underXscore", "back\\slash", "aaa", "Hannah Anna",
]


@pytest.fixture(scope="module")
def index(spark):
    out = FragmentIndex(spark, new_path(spark, "fragments"), SCHEMA, "id", F.col("name"), parts=8)
    out.build(spark.createDataFrame(list(enumerate(NAMES * 3)), SCHEMA))
    return out


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("fragment", ["anna", "NNA", "an", "", "a%n", "ann%ber", "er_sco", "100%", "ömer k", "kim", "aya", "ababa", "aaaa", "nothing", "a b"])
def test_search_equals_the_plain_test(index, fragment, literal):
    plain = index.table.rows().filter(contains_fragment(F.col("name"), fragment, literal=literal))
    found = index.search(fragment, literal=literal)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in plain.collect())


def test_escapes_take_the_exact_way(index):
    assert index.candidates("er\\_sco") is None
    assert {r.name for r in index.search("er\\_sco").collect()} == {"under_score"}


def test_wanted_grams():
    assert wanted_grams("Anna") == ["ann", "nna"] and wanted_grams("an%na_b") == [] and wanted_grams("ab%cde") == ["cde"]
    assert wanted_grams("a_cd", literal=True) == ["_cd", "a_c"] and wanted_grams("äbcd") == ["bcd"]


def test_postings_are_pruned_by_part_and_gram(index):
    plan = index.candidates("anna")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ (IN|INSET)", plan) and re.search(r"PushedFilters: \[[^]]*In\(gram", plan)


def test_null_keys_are_refused_and_empty_tables_searched(spark):
    index = FragmentIndex(spark, new_path(spark, "fragments"), SCHEMA, "id", F.col("name"), parts=2)
    with pytest.raises(Exception, match="null key"):
        index.build(spark.createDataFrame([(None, "a")], SCHEMA))
    empty = FragmentIndex(spark, new_path(spark, "fragments"), SCHEMA, "id", F.col("name"), parts=2)
    empty.build(spark.createDataFrame([], SCHEMA))
    assert empty.search("anna").count() == 0
