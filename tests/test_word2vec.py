"""Word vectors are trained on whatever vocabulary the driver can hold."""

import pytest

from passagemill.operators import embedding as E


def test_the_vocabulary_is_bounded_by_the_drivers_memory():
    gb = 1 << 30
    # 6 GB of texts have some 2.1 million frequent words.
    assert E.most_words(2 * gb, 16) > 2_500_000
    assert E.most_words(8 * gb, 16) == pytest.approx(4 * E.most_words(2 * gb, 16), rel=1e-3)
    assert E.most_words(gb // 2, 16) == E.LEAST_WORDS
    assert E.most_words(1000 * gb, 1000) * 1000 < 2**31


def test_a_vocabulary_that_cannot_be_held_is_an_error(spark, monkeypatch):
    texts = spark.createDataFrame([(n, "one two three") for n in range(6)], "doc_id long, text string")
    assert E.fit_word2vec(texts, dim=2, text_col="text").getVectors().count() == 3
    with pytest.raises(ValueError, match="3 words occur 5 times or more, 2 can be held"):
        E.fit_word2vec(texts, dim=2, text_col="text", max_vocabulary=2)
    monkeypatch.setattr(E, "most_words", lambda heap, dim: 2 if heap > 1 << 20 and dim == 2 else 9)
    with pytest.raises(ValueError, match="more memory"):
        E.fit_word2vec(texts, dim=2, text_col="text")


def test_a_null_text_has_no_words(spark):
    """Spark's Word2Vec fails on a null list of words."""
    texts = spark.createDataFrame([(n, "one two three") for n in range(6)] + [(6, None), (7, "...")], "doc_id long, text string")
    model = E.fit_word2vec(texts, dim=2, text_col="text")
    vectors = {r.doc_id: r.embedding for r in E.embed_word2vec(texts, model, text_col="text").collect()}
    assert vectors[6] == vectors[7] == [0.0, 0.0] != vectors[0]
    counts = {r.doc_id: (r.n_words, r.n_known) for r in E.known_words(texts, model, "doc_id", "text").collect()}
    assert counts[6] == counts[7] == (0, 0) and counts[0] == (3, 3)
