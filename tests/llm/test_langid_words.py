import numpy as np

from strandlake.llm import langid as L


def test_long_words_are_read_whole():
    word = "語言處理是一門很有趣的學問而且很實用" + "abcdefghij" * 5
    doc, code, vocabulary = L.split_words(["short " + word, "x"])
    assert b"".join(vocabulary[c] for c in code[doc == 0][1:]).decode() == word
    assert max(map(len, vocabulary)) <= L.WIDTH - 2 and doc.tolist() == sorted(doc.tolist())
    assert [vocabulary[c] for c in code[doc == 1]] == [b"x"]
    assert np.array_equal(np.unique(code), np.arange(len(vocabulary)))


def test_lexicons_work_for_ten_languages():
    samples = [(f"l{j}", " ".join(f"{chr(97 + j)}{chr(97 + (3 * j + i) % 26)}o" for i in range(40)) + f" only{chr(97 + j)}" * 5) for j in range(10)]
    model = L.train(samples, sequences=200, rounds=5)
    known = model.known([f"only{chr(97 + j)}".encode() for j in range(10)] + [b"never"])
    assert np.array_equal(known, np.eye(11, 10)) and np.abs(model.lex_w).sum() > 0


def test_languages_of_long_documents_only_are_learned(spark):
    a, b = "der hund und die katze ", "le chien et le chat "
    rows = [(i, (a if i % 2 else b) * (2000 if i % 2 else 3), "de" if i % 2 else "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(docs)
    assert model.labels == ["de", "fr"]
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
