from pyspark.sql import functions as F

from termloom.functions import text as t


def column(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_possessives(spark):
    assert column(spark, t.is_possessive, "Euler's number", "Banach", "classes' sum") == [True, False, True]
    assert column(spark, t.nonpossessive, "Euler's", "Gauss' law", "Banach") == ["Euler", "Gauss law", "Banach"]
    assert column(spark, t.possessive, "Euler formula", "Gauss law") == ["Euler's formula", "Gauss' law"]


def test_plurals(spark):
    assert column(spark, t.singular_word, "matrices", "vertices", "loci", "groups", "theses", "series") == ["matrix", "vertex", "locus", "group", "these", "sery"]
    assert column(spark, t.singular_phrase, "spaces of functions", "proofs by induction") == ["space of functions", "proof by induction"]
    assert column(spark, t.plural, "root of unity", "matrix", "city", "group") == ["roots of unity", "matrices", "cities", "groups"]
    assert column(spark, t.is_plural, "groups", "group") == [True, False]
    assert column(spark, t.root, "groups", "cities") == ["group", "cit"]


def test_words(spark):
    assert column(spark, t.normal_word, "The", "Möbius", "Straße", "Banach's", "groups") == ["", "mobius", "strasse", "banach", "group"]
    assert column(spark, t.undetermined, "the group", "a", "another") == ["group", "", "another"]
    assert column(spark, t.normal_phrase, "The Groups of Order", " the ") == ["group of order", ""]
    assert column(spark, t.first_word, "banach algebra", "-x") == ["banach", None]
    assert column(spark, t.tail_words, "banach algebra", "group") == ["algebra", ""]
    assert column(spark, t.admissible, "banach algebra", "a, b", "k-theory") == [True, False, True]


def test_urls(spark):
    urls = ["http://www.x.org/a/./b", "https://x.org/a/b/../c", "x.org/a/b/../../c"]
    assert column(spark, t.canonical_url, *urls) == ["x.org/a/b", "x.org/a/c", "x.org/c"]
    assert column(spark, t.with_protocol, "x.org", "http://x.org", "") == ["http://x.org", "http://x.org", ""]
    assert column(spark, t.tag_to_concept, "ag.semi-simple-rings", "at.3-manifolds") == ["semi-simple rings", "3-manifolds"]
    assert column(spark, t.unescaped, "a%20b+c") == ["a b+c"]
    assert column(spark, t.domain_name, "pLANET", "no way") == ["Planet", None]
