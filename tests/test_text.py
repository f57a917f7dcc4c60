from pyspark.sql import functions as F

from taxoweave.functions import text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalize(spark):
    assert one(spark, "  Зап’ястя,  ДЛЯ_рук² (x) ", text.normalize) == "зап ястя для_рук² x"
    assert one(spark, None, text.normalize) == ""


def test_keywords(spark):
    assert one(spark, "Масло для мотора, масло и ол", text.keywords) == ["масло", "мотора"]
    assert one(spark, "Масло масло", text.keyword_list) == ["масло", "масло"]
    assert one(spark, None, text.keywords) == []


def test_stem_takes_long_suffixes_first(spark):
    assert one(spark, "зимний", text.stem) == "зим"
    assert one(spark, "моторный", text.stem) == "моторн"
    assert one(spark, "нов", text.stem) == "нов"


def test_advanced_keywords(spark):
    assert sorted(one(spark, "Зимний шлем the", text.advanced_keywords)) == ["зим", "зимний", "шлем"]


def test_char_ngrams_of_short_names(spark):
    assert one(spark, "", text.char_ngrams) == []
    assert one(spark, "a", text.char_ngrams) == []
    assert one(spark, "ab", text.char_ngrams) == ["ab"]
    assert one(spark, "a b-c", text.char_ngrams) == ["ab", "bc", "abc"]


def test_word_ngrams(spark):
    assert one(spark, "One two, three", text.word_ngrams) == ["one", "two", "three", "one two", "two three", "one two three"]
    assert one(spark, "", text.word_ngrams) == []


def test_paths(spark):
    ids = lambda x: text.path_ids(x)
    assert one(spark, "1>2>3", lambda x: text.parent_of(ids(x))) == "2"
    assert one(spark, "1", lambda x: text.parent_of(ids(x))) is None
    assert one(spark, "10>2", lambda x: text.root_of(ids(x))) == "10"
    assert sorted(one(spark, "A > b", text.path_words)) == [">", "a", "b"]
    assert one(spark, "A", text.path_words) == ["a"]


def test_duration_has_more_than_a_day(spark):
    assert one(spark, 100 * 3600 + 61.9, text.duration, "double") == "100:01:01"


def test_transliterate(spark):
    assert one(spark, "їжак і ґава є", text.transliterate) == "ижак и гава е"


def test_hints(spark):
    assert sorted(one(spark, "Мотоциклетный шлем", lambda x: text.hint_words(x, {"мотоциклетный": ["мото"]}))) == ["мото", "мотоциклетный"]
