"""Cross-parsing against plain substring search, held-out accuracy, odd rows."""

import numpy as np
import pytest

from tessella.llm import language_id as li
from tests.llm import common


def parsed(text, sample):
    """Phrases of a greedy parse by substring search."""
    text, sample = bytes(text), bytes(sample)
    i = n = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i, n = (j if text[i : i + 1] in sample else i + 1), n + 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_phrases_equal_substring_search(seed):
    rng = np.random.default_rng(seed)
    sample = rng.integers(0, 3 + seed, 200).astype(np.uint8)
    texts = [rng.integers(0, 5 + seed, n).astype(np.uint8) for n in (1, 2, 30, 200, 77)] + [sample[20:90]]
    texts.sort(key=len, reverse=True)
    lanes = np.zeros((len(texts[0]), len(texts)), np.uint8)
    for i, t in enumerate(texts):
        lanes[: len(t), i] = t
    table = li.automaton(sample, 16)
    assert li.phrases(lanes, np.array([len(t) for t in texts]), table).tolist() == [parsed(t, sample) for t in texts]


def test_lanes_hold_whole_texts():
    texts = [np.arange(n) % 7 + 1 for n in (1, 1024, 1025, 5000, 3)]
    lanes, lengths, owner = li._lanes([t.astype(np.uint8) for t in texts])
    assert lengths.tolist() == sorted(lengths, reverse=True) and lengths.sum() == sum(map(len, texts))
    for i, t in enumerate(texts):
        assert sum(int(lanes[: lengths[j], j].sum()) for j in np.flatnonzero(owner == i)) == t.sum()


def test_symbols_are_letters_and_single_gaps():
    table = li.symbol_table([ord("a"), ord("b"), ord("é")])
    assert li.symbols(li.code_points("  A-b12\tÉ!"), table).tolist() == [1, 0, 2, 0, 3]
    assert li.symbols(li.code_points("12 !"), table).sum() == 0
    assert li.symbols(li.code_points(""), table).tolist() == []
    assert li.symbols(li.code_points("z"), table)[0] > 3


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.language_digest(docs)
    assert rows.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = rows.collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 'zz' else lang end lang", "'x' source")
    assert sorted(map(tuple, li.language_digest(docs).collect())) == sorted(map(tuple, li.language_digest(other).collect()))


def test_odd_rows(spark):
    rows = [tuple(r) for r in li.language_digest(common.docs(spark)).collect()]
    assert len(rows) == len(common.rows())
    texts = {r[0]: r[1] for r in common.rows()}
    for doc_id, _, lang, score in rows:
        if doc_id in (1, 2, 3):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in ("en", "de", "fr") and 0 < score <= 1, texts[doc_id]
    assert li.language_digest(common.empty(spark)).collect() == []
    unlabelled = common.docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang", "lang h")
    assert {r["lang_pred"] for r in li.language_digest(unlabelled).collect()} == {"und"}


def test_scripts_and_long_texts(spark):
    samples = {"ru": "съешь же ещё этих мягких французских булок да выпей чаю ", "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία ", "ja": "いろはにほへとちりぬるをわかよたれそつねならむ ", "zh": "天地玄黃宇宙洪荒日月盈昃辰宿列張 "}
    rows = [(i * 10 + j, t * (3 + j), la) for i, (la, t) in enumerate(samples.items()) for j in range(8)]
    rows += [(1000, samples["ru"] * 100_000, "el")]
    out = {r["doc_id"]: r for r in li.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["lang_pred"] == la for i, _, la in rows if i < 1000)
