"""All languages are learned."""

from terraframe.llm import language_id


def test_more_than_two_hundred_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 1)
    rows = [(i, f"text number {i}", f"l{i:03}") for i in range(230)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == sorted(lang for _, _, lang in rows)
