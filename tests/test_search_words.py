"""Several words looked up at once give what each gives alone."""

from pyspark.sql import functions as F

from quernel.functions import text
from quernel.operators import graph


def test_words_together_are_as_each_alone(spark):
    rows = [(1, "Anna Lee", 5), (2, "Anna", 2), (3, "Joanna", 9), (4, "the anna x", 1), (5, "Bob", 7), (6, "a.b Bob", 1)]
    n = spark.createDataFrame(rows, "id long, name string, mention_count long")
    words = ["anna", "bob", "a.b", "lee", "none", "a_na"]
    for limit in (1, 2, 5):
        want = [(i, r.name) for i, w in enumerate(words) for r in graph.search_nodes(n, w, limit).where(text.whole_word(F.col("name"), w)).collect()]
        assert [(r.word_no, r.name) for r in graph.search_words(n, words, limit).collect()] == want
    assert graph.search_words(n, [], 5).count() == 0
