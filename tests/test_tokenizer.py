import hashlib
import random

from pyspark.sql import functions as F

from tessella.functions import tokenizer as t


def test_pairs():
    same = lambda a, b: bool(set(t.tokenize(a)) & set(t.tokenize(b)))
    assert t.tokenize("Ｆｕｌｌ １２") == t.tokenize("full 12")
    assert same("café", "café") and "cafe" in t.tokenize("café")
    assert "istanbul" in [t.fold(x) for x in t.tokenize("İstanbul")]
    assert same("مُحَمَّد", "محمد") and same("ΟΔΟΣ", "οδοσ") and same("שלום", "שלומ")
    assert t.tokenize("zero​width") == ["zerowidth"]
    assert same("การทดสอบ", "ทดสอบระบบ") and same("ошибками", "ошибка")
    assert t.tokenize(None) == [] and t.tokenize("  ") == []


def test_compounds_give_whole_and_parts():
    assert t.tokenize("src/mainFile.py") == ["src/main", "src", "main", "file.py", "file", "py"]
    assert t.tokenize("snake_case_name").count("snake") == 1
    assert "a1" in t.tokenize("x/a1.b2")


def test_profiles_differ_and_are_deterministic():
    text = "日本語 テスト ошибка café"
    results = {p: tuple(t.tokenize(text, t.PROFILES[p])) for p in t.PROFILES}
    assert len(set(results.values())) >= 5
    assert all(tuple(t.tokenize(text, t.PROFILES[p])) == results[p] for p in t.PROFILES for _ in range(5))


def test_columns(spark):
    texts = ["Ünïcode Straße", None, "plain ASCII", "ไทย", "word"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r for r in df.select("i", t.tokens(F.col("x")).alias("t"), t.normalized(F.col("x")).alias("n"), t.script(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(texts):
        assert got[i].t == t.tokenize(x) and got[i].n == (None if x is None else t.normalize(x))
    assert got[3].s == "Thai" and got[4].s == "Latin" and got[1].s is None


def test_summaries_are_those_of_each_profile():
    import hashlib

    texts = [None, "", "a b1 src/Main.py fooBar", "Straße straße ﬁn café ÆON 9é", "λόγος ΣΊΣΥΦΟΣ", "กำลัง ไทย ທຳ", "漢字かな 漢字 カナ漢", "한국어 각ᆨ 가", "שלום ארץ", "آب أَبٌ", "ми ж мир й", "नमस्ते क्षि", "éä x‍y"]
    for text in texts + [" ".join(x or "" for x in texts)]:
        got = t.summarize(text, list(t.PROFILES.values()))
        for row, p in zip(got, t.PROFILES.values(), strict=True):
            all_of = t.tokenize(text, p)
            assert row == {"profile": p.name, "tokens": len(all_of), "distinct_tokens": len(set(all_of)), "digest": hashlib.sha256(" ".join(sorted(set(all_of))).encode()).hexdigest()}


def test_words_have_the_graphemes_and_scripts_of_their_characters():
    import regex

    for word in ["กำลัง", "한국어", "각ᆨ", "가", "नमस्ते", "éa", "漢字", "ทำ", "🇩🇪🇫🇷", "ab‍c", "ൎക"]:
        parts = regex.findall(r"\X", word)
        assert t.graphemes(word, (2, 3)) == ["".join(parts[i : i + n]) for n in (2, 3) for i in range(len(parts) - n + 1)]
    assert [t.script_of(w) for w in ("aΩ", "漢か", "a漢", "ж", "9", "ᚠ")] == ["Greek", "Japanese", "Han", "Cyrillic", None, None]


def test_summaries_look_at_no_word_by_itself(monkeypatch):
    """A text of one script is cut into grams as a whole; its words are folded together."""
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(80)) for letters in ("καςσ", "ابىأـً", "אבךםףַ", "настрой", "กขค", "가나다", "कखगि", "ñéßabŋ", "漢字かな", "йךéka1")]
    want = [[(p.name, t.tokenize(x, p)) for p in t.PROFILES.values()] for x in texts]
    monkeypatch.setattr(t, "word_tokens", lambda *a: 1 / 0)
    monkeypatch.setattr(t, "word_forms", lambda *a: 1 / 0)
    for text, each in zip(texts, want):
        got = t.summarize(text, list(t.PROFILES.values()))
        assert [(g["profile"], g["tokens"], g["distinct_tokens"], g["digest"]) for g in got] == [(n, len(x), len(set(x)), hashlib.sha256(" ".join(sorted(set(x))).encode()).hexdigest()) for n, x in each], text


def test_the_script_of_a_text_is_that_of_its_characters(spark):
    texts = ["", "abc", "καλη ab", "漢字かな", "漢字", "123 .", "настрой abc", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.s for r in rows.select("i", t.text_script(F.col("x")).alias("s")).collect()}
    assert got == {i: None if x is None else t.script_of(x) for i, x in enumerate(texts)}
    assert got == {r.i: r.s for r in rows.filter("x is not null").select("i", t.script(F.col("x")).alias("s")).collect()} | {7: None}


def test_texts_are_summarized_once(spark):
    from tessella.plans import scripts

    plan = scripts.script_tokens(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
