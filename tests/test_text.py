import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("token", "want"), [("penalties", "penalty"), ("travaux", "traval"), ("travail", "traval"), ("journaux", "journal"), ("boxes", "box"), ("clauses", "clause"), ("livraisons", "livraison"), ("process", "process"), ("gas", "gas"), ("12.4", "12.4"), ("iso", "iso")])
def test_fold(spark, token, want):
    assert one(spark, token, T.fold) == want


def test_tokens(spark):
    assert one(spark, "a b 7 to", T.tokenize) == ["7", "to"]
    assert "12.4" in one(spark, "Revenue was 12.4M EUR", T.tokenize)
    assert one(spark, None, T.tokenize) == []


@pytest.mark.parametrize("raw", ["Éçà ß", "ﬁne ²", "Ａ１", "İstanbul", "ŒUVRE", "ΑΣ Σ", "plain", "½ℌ", "ÀÉÎÕÜÝ àéîõüýÿ æøðþ ÆØ ß", ""])
def test_normalize(spark, raw):
    assert one(spark, raw, T.normalize) == "".join(map(T.plain, raw))


@pytest.mark.parametrize("n", [0, 999, 1000, 1050, 1150, 1250, 1350, 1950, 1999, 2050, 12345, 99950, 123456])
def test_human_size(spark, n):
    got = spark.createDataFrame([(n,)], "n long").select(T.human_size(F.col("n")).alias("y")).first().y
    assert got == (f"{n} chars" if n < 1000 else f"{n / 1000:.1f}k chars")


def test_opening(spark):
    text = "First sentence is long enough here. " + "Second " * 40
    assert one(spark, text, T.opening) == "First sentence is long enough here."
    assert one(spark, "word " * 60, T.opening).endswith("…")
    assert one(spark, "  short \n text ", T.opening) == "short text"


def test_grounded(spark):
    row = spark.createDataFrame([("The  Café closed.", "cafe closed"), ("a", " "), ("a", None)], "t string, q string").select(T.grounded(F.col("t"), F.col("q")).alias("g")).collect()
    assert [r.g for r in row] == [True, False, False]


def test_characters_that_become_several(spark):
    more = T._tables()[2]
    rows = [(c, T.plain(c)) for c in more] + [("Aﬀaire ℃ Straße", "affaire °C strasse")]
    got = spark.createDataFrame(rows, "c string, plain string").select("c", "plain", T.normalize(F.col("c")).alias("n")).collect()
    assert [(r.c, r.n) for r in got if r.n != r.plain] == []
