import pytest

EXTRA = ["kept", "size", "target", "shard", "slot", "score", "row", "row_id", "label", "node", "digest", "bucket", "bands", "words", "toxic", "held_out", "rank",
         "n_tokens", "text_hash", "_id", "_part", "component_id", "lang_pred", "copies", "perplexity", "logp"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that bear the names of results."""
    rows = [
        (1, "The Cat sat on the mat and the dog ran away today", "en", "b", 1), (2, "the cat SAT on the mat and the dog ran away today", "en", "a", 2),
        (2, "the cat SAT on the mat and the dog ran away today", "en", "a", 2), (3, "", "en", "a", 0), (4, None, "de", "b", None), (5, " \n\t ", None, None, 3),
        (None, "der Hund und die Katze sind im Haus", "de", "a", 4), (7, "der Hund und die Katze sind im Haus", None, "c", 4), (8, "12 34 !! 56", "en", "b", 5),
        (9, "Ünïcödé é    日本語 текст <|endoftext|> end", "de", None, 6), (10, "long words go on and on " * 6000, "en", "b", 7), (11, "two words", None, "c", 8),
        (None, None, None, None, None), (12, "x", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in EXTRA])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
