"""Text operators: exact tokens, mixtures, languages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import bpe, language, mixing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def ours():
    return bpe.PrefixEncoder.load()


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab e\n.1", max_size=200) | st.text(alphabet="的股価é", max_size=40))
def test_ids_equal_the_library(ours, theirs, text):
    assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_long_and_odd_pieces(ours, theirs):
    for t in ("a" * 5000, "ab" * 3000, "=" * 4000, "　​\xa0\x07", "<|endoftext|> x", " \n \n  x", "股" * 3000, "🚀🚀👨‍👩‍👧"):
        assert ours.encode(t) == theirs.encode(t, add_special_tokens=False).ids
    assert ours.encode(None) == ours.encode("") == []


def test_encode_texts_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 2000).astype(float)
    p = mixing.fly(np.full(2000, 0.37), size, np.random.default_rng(1))
    left = (p > 0) & (p < 1)
    assert left.sum() <= 2
    assert abs(p.sum() - 740) < 1e-6 and abs((p * size).sum() - 0.37 * size.sum()) < 1e-4
    done = mixing.land(p, size)
    assert set(done) <= {0.0, 1.0} and abs((done * size).sum() - 0.37 * size.sum()) <= 500
    assert 500 < mixing.fly(np.full(1000, 0.6), np.ones(1000), rng).sum() < 700
    assert mixing.fly(np.array([0.0, 1.0, 0.5]), np.array([1.0, 2, 3]), rng).tolist()[:2] == [0, 1]


def test_mixture_reaches_shares_within_repeats(spark):
    rng = random.Random(0)
    rows = [(i, s, "word " * rng.randint(1, 60), 0) for i, s in enumerate(rng.choices(["a", "b", "c", "d", None], [6000, 1500, 300, 50, 50], k=9000))] + [(99991, "a", None, 0), (99992, "a", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, repeats int")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("empty", 0.0, 9)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, goals)
    used = chosen.collect()
    most = {"a": 1, "b": 2, "c": 4}
    assert len({r["doc_id"] for r in used}) == len(used) and all(1 <= r["repeats"] <= most[r["source"]] for r in used)
    for r in shares.collect():
        assert abs(r["share"] - r["target_share"]) < 0.001 and r["tokens"] > 0
    assert mixing.mix(docs.limit(0), goals)[0].count() == 0


def test_paragraphs_and_labels():
    assert language.paragraphs("a\r\nb\r\n \r\n\r\nc\rd\n\n\n") == ["a\nb", "c\nd"]
    assert language.paragraphs(None) == language.paragraphs(" \n ") == []
    assert [language.label_language(x) for x in ("EN", "zh_Hans", "pt-BR", "eng", "und", "??", "", None, "n/a", "unknown", " ")] == ["en", "zh", "pt", "en", None, None, None, None, None, None, None]


def test_units_leave_out_what_is_of_no_language():
    assert language.units("cs_rank(ts_mean(amount, 60)) * -1\ndf['mom_5d'] = df['close'].rolling(9).mean()\n960665.SZ 38.34 <br/>") == []
    assert language.units("Osyorの株価は2022年 don't été") == ["Osyor", "の株価は", "年", "don", "t", "été"]


SENTENCES = {
    "en": ["the board said that the price would rise", "it is not clear whether the company can pay", "please check the table because a report is missing"],
    "de": ["der Vorstand sagte dass der Preis steigen werde", "es ist nicht klar ob die Gesellschaft zahlen kann", "bitte prüfen Sie die Tabelle denn ein Bericht fehlt"],
    "fr": ["le conseil a dit que le prix va monter", "il n'est pas clair si la société peut payer", "merci de vérifier le tableau car un rapport manque"],
    "es": ["el consejo dijo que el precio subiría", "no está claro si la empresa puede pagar", "por favor revise la tabla porque falta un informe"],
    "pt": ["o conselho disse que o preço subiria", "não está claro se a empresa pode pagar", "por favor verifique a tabela porque falta um relatório"],
    "ja": ["取締役会は価格が上がると述べました", "会社が払えるかどうかはまだわかりません", "報告が抜けているので表を確認してください"],
    "zh": ["董事会表示价格将会上涨", "目前还不清楚公司能否支付", "请核对表格因为缺少一份报告"],
}


def test_languages_of_documents_and_paragraphs(spark):
    rows = [(100 * k + i, f"{a}. {b}.", lang, 0) for k, (lang, ss) in enumerate(SENTENCES.items()) for i, (a, b) in enumerate((x, y) for x in ss for y in ss)]
    cases = [
        (9001, SENTENCES["fr"][0] + "\n\nts_corr(close, volume, 60)\n\n" + SENTENCES["zh"][1], "fr", 0),
        (9002, SENTENCES["pt"][2], "es-ES", 0),
        (9003, "123457.SH 38.07 599\n\n----", "en", 0),
        (9004, None, None, 0),
        (9005, "", "zh", 0),
        (9006, SENTENCES["ja"][1], "JA", 0),
        (9007, SENTENCES["de"][1], "??", 0),
    ]
    df = spark.createDataFrame(rows + cases, "doc_id long, text string, lang string, seg_no int")
    out = language.assign_languages(df, "doc_id", "text", "lang").where(language.wrong_or_mixed())
    got = {(r["doc_id"], r["seg_no"], r["lang"]) for r in out.where("doc_id > 9000").collect()}
    assert got == {(9001, 1, "fr"), (9001, 3, "zh"), (9002, 0, "pt"), (9007, 0, "de")}
    assert out.where("doc_id < 9000").count() == 0


def test_forward_sums_every_segmentation():
    pieces = language.Pieces()
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(pieces.size), 2).T
    model = language.LanguageModel(("x", "y"), p)
    for unit in ("price", "股価は", "ſ", "上がる"):
        n, arcs = pieces.lattice(unit)

        def total(at):
            if at == n:
                return np.ones(2)
            return sum((np.prod([p[i] for i in ids], axis=0) * total(b) for a, b, ids in arcs if a == at), np.zeros(2))

        np.testing.assert_allclose(language.score_unit(pieces, model, unit), np.log(total(0)))
    assert np.isfinite(language.score_unit(pieces, model, "ab" * 5000)).all()


def test_copies_of_a_text_fill_one_place_of_the_sample(spark):
    rows = [(i, "the same words again and again", "en") for i in range(50)] + [(100 + i, f"other words number {i}", "en") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_sample(df, "doc_id", "text", "lang", 6, 1000)
    assert len(got) == 6 and len({t for t, _ in got}) == 6
