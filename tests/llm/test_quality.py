import pytest

from tessera.llm.quality import PROFILES, Profiles, divergence, fit_profiles, fit_words, fitted_profiles, not_prose, text_statistics

PROSE = "When the river is high, we do not go to the mill, because the bridge was built for a lower water and it is not safe."
GERMAN = "Wenn der Fluss hoch ist, gehen wir nicht zur Mühle, weil die Brücke für ein niedriges Wasser gebaut wurde und nicht sicher ist."
CASES = {
    1: (PROSE, False),
    2: (PROSE.upper(), False),
    3: (GERMAN, False),
    4: ("\n".join(["when the river is high we do", "not go to the mill because the", "bridge was built for it and", "was low"]), False),
    5: ("- noisy crane\n- modern polymer\n- voluntary oven\n- uneven seminar", True),
    6: ("crane;0.5;12;0.7\npolymer;0.1;77;0.2\noven;0.9;3;0.8", True),
    7: ("def f(a, b=3):\n    c = a[3:]\n    return {'x': c @ b.T}", True),
    8: ("[12:01:02] step=5 loss=1.25 lr=3e-05\n[12:01:09] step=6 loss=1.24 lr=3e-05", True),
    9: ("xq zvk prtl mnbv wrtk\nkjh plmn trw", True),
    10: ("=====\n-----\n*****", True),
    11: (PROSE + "\n" + "Qm9" * 200, True),
    12: (None, False),
    13: ("", False),
    14: (" \n\t ", False),
    15: ("**The** river **is** high **and** the mill **was** not **built** for it.", False),
    16: ("Q: is the mill at the river and is it safe for us?\nA: bridge", False),
}
SCHEMA = "doc_id bigint, text string, key int, profile string"


def test_forms(spark):
    df = spark.createDataFrame([(i, t, 0, "") for i, (t, _) in CASES.items()], SCHEMA)
    assert {r.doc_id for r in not_prose(df).collect()} == {i for i, (_, case) in CASES.items() if case}


def test_statistics_by_hand(spark):
    rows = [(1, "The cat.\n\na-b 12!", 0, ""), (2, None, 0, ""), (3, " ", 0, ""), (None, "x", 0, ""), (1, "The cat.\n\na-b 12!", 0, "")]
    got = text_statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    r = next(x for x in got if x.doc_id == 1)
    assert (r.n_words, r.mean_word_len, r.stop_line_share) == (5, 10 / 5, 1.0)
    assert r.symbol_ratio == 0 and r.digit_ratio == pytest.approx(2 / 13) and r.common_word_share == pytest.approx(2 / 5)
    for i in (2, 3):
        x = next(y for y in got if y.doc_id == i)
        assert (x.n_words, x.profile, x.mean_word_len, x.prose_share, x.divergence) == (0, "blank", None, None, None)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, (PROSE + "\n") * 20_000, 0, "")], SCHEMA)
    assert text_statistics(df).first().n_words == len(PROSE.split()) * 20_000
    assert text_statistics(df.where("false")).collect() == [] and not_prose(df.where("false")).collect() == []


def test_divergence_is_a_bounded_symmetric_distance():
    import numpy as np

    p = np.array(list(PROFILES.values()))
    p /= p.sum(axis=1, keepdims=True)
    d = divergence(p[:, None], p[None])
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0) and d.max() <= 1 + 1e-9


def test_fitting_gives_profiles_by_form():
    texts = [PROSE, GERMAN] + ["- noisy crane\n- modern polymer"] * 8
    got = fit_profiles(texts, ["prose", "prose"] + ["list"] * 8, ["en", "de"] + ["en"] * 8)
    assert {"prose_en", "prose_de", "prose_de_capitals", "list_lower"} <= set(got)
    assert all(abs(sum(v) - 1) < 0.01 for v in got.values())


OTHER = {
    1: "Retrieval models differ greatly. Careful authors chose every sentence, avoiding small words. Short clauses read well.",
    2: "Os modelos diferem muito. Eles foram treinados com textos diferentes, e os resultados mudam bastante.",
    3: "Modele wyszukiwania bardzo się różnią. Zostały wytrenowane na wielu tekstach, a wyniki zmieniają się znacznie.",
    4: "Модели поиска сильно различаются. Они обучены на многих текстах, и результаты заметно меняются.",
    5: "检索模型差别很大。它们是在许多不同的文本上训练的，因此结果会有明显的变化。作者仔细选择了每一个句子。",
    6: "I modelli di ricerca sono molto diversi. Sono stati addestrati su molti testi, e i risultati cambiano parecchio.",
    7: "検索モデルは大きく異なる。多くの文章で学習されており、結果はかなり変わる。",
}


def test_prose_of_other_languages_is_no_junk(spark):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in OTHER.items()], SCHEMA)
    got = {r.doc_id: r for r in text_statistics(df).collect()}
    assert all(r.profile.startswith("prose") and r.prose_share > 0.9 and r.language == "unknown" for r in got.values())
    assert not_prose(df).collect() == []


def test_lists_stay_lists_in_other_languages(spark):
    rows = [(1, "1. Vinagre\n2. Moinho, lagarta\n3) Ponte\n4. Rio\n5. Farol, praia"), (2, "мост, река, мельница, вода, камень, лодка, берег, дорога"), (3, "Ponte | Rio | Farol\nPraia | Moinho | Lago"), (4, "€#Â?Ã €â?Ã? ™Â?\nÃ?Â €â#? Ã™Â")]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    assert {r.doc_id for r in not_prose(df).collect()} == {1, 2, 3, 4}


def test_language_by_function_words(spark):
    df = spark.createDataFrame([(1, PROSE, 0, ""), (2, GERMAN, 0, ""), (3, "crane polymer oven", 0, "")], SCHEMA)
    assert {r.doc_id: r.language for r in text_statistics(df).collect()} == {1: "en", 2: "de", 3: "unknown"}


def test_profiles_follow_the_labels(spark):
    docs = spark.createDataFrame([(i, PROSE + "\n" + PROSE, "en-GB") for i in range(60)] + [(100 + i, "- noisy crane\n- modern polymer", "en") for i in range(60)] + [(500, None, "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, "r", "prose") for i in range(60)] + [(100 + i, "r", "list") for i in range(60)] + [(1, "r", None), (None, "r", "list"), (500, "r", "junk")], "doc_id bigint, rater string, form string")
    got = fitted_profiles(docs, labels)
    assert got.classes["prose_en"] != PROFILES["prose_en"] and got.classes["list_lower"] != PROFILES["list_lower"] and got.classes["prose_fr"] == PROFILES["prose_fr"]
    assert abs(got.words["en"].sum() - 1) < 1e-9 and (got.words["en"] != Profiles().words["en"]).any()
    few = fitted_profiles(docs, labels, rows=5)
    assert few.classes == PROFILES and all((few.words[g] == w).all() for g, w in Profiles().words.items())
    assert fitted_profiles(docs, labels.where("false")).classes == PROFILES
    assert {r.doc_id for r in not_prose(docs, got).collect()} == set(range(100, 160))
    assert fit_words([], [], []) == {}
