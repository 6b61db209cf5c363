"""Speech acts and anchors by written cases."""

import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import classify, speech

SAID = {
    "show the memory health": ("report", "report-request"), "记忆系统最近效果": ("report", "report-request"), "status": ("report", "report-request"),
    "please confirm": ("review-workflow", "review-request"), "复核一下": ("review-workflow", "review-request"),
    "she said remember me": ("no-memory-action", "quoted-or-meta"), "translate: please remember": ("no-memory-action", "quoted-or-meta"), "他说记得": ("no-memory-action", "quoted-or-meta"), 'the word "remember" here': ("no-memory-action", "quoted-or-meta"),
    "Can you recall the port?": ("recall", "recall-question"), "你还记得吗": ("recall", "recall-question"),
    "I don’t remember": ("no-memory-action", "acknowledgement-or-self-report"), "好的，记住了。": ("no-memory-action", "acknowledgement-or-self-report"), "Got it.": ("no-memory-action", "acknowledgement-or-self-report"), "我记得他": ("no-memory-action", "acknowledgement-or-self-report"),
    "you'd better remember": ("durability-clarification", "ambiguous-tone"), "呵呵，记住": ("durability-clarification", "ambiguous-tone"),
    "remember my api key is x": ("sensitive-rejection", "sensitive-persistence-request"), "记住我的密码": ("sensitive-rejection", "sensitive-persistence-request"), "remember to use the password manager": ("durability-review", "explicit-persist"),
    "please do not forget this": ("durability-review", "positive-persist-double-negative"), "别忘了开会": ("durability-review", "positive-persist-double-negative"),
    "don't remember that": ("delete-workflow", "delete-or-supersede-request"), "forget what I said": ("delete-workflow", "delete-or-supersede-request"), "忘掉之前说的": ("delete-workflow", "delete-or-supersede-request"), "不要保存": ("delete-workflow", "delete-or-supersede-request"),
    "for now always use tabs": ("durability-clarification", "compound-duration"), "this time use tabs": ("transient-context", "transient-scope"), "今天先这样": ("transient-context", "transient-scope"),
    "remember this!": ("durability-clarification", "ambiguous-reference"), "请记住这个。": ("durability-clarification", "ambiguous-reference"), "please memorize": ("durability-clarification", "missing-proposition"), "帮我记一下": ("durability-clarification", "missing-proposition"),
    "remember we deploy on Fridays": ("durability-review", "explicit-persist"), "save it as a preference": ("durability-review", "explicit-persist"), "保存 端口 9": ("durability-review", "explicit-persist"),
    "always like that": ("durability-clarification", "ambiguous-reference"), "以后照这个": ("durability-clarification", "ambiguous-reference"), "I prefer tabs": ("durability-review", "implicit-persist"), "don't do it again": ("durability-review", "implicit-persist"), "以后用中文回答": ("durability-review", "implicit-persist"), "我更喜欢深色": ("durability-review", "implicit-persist"),
    "where is the port": ("recall", "recall-fallback"), "": ("recall", "recall-fallback"),
}


def test_speech_acts(spark):
    df = spark.createDataFrame([(s,) for s in SAID], "s string").select("s", classify.speech_act(F.col("s")).alias("a")).select("s", "a.*")
    assert {r.s: (r.action, r.reason) for r in df.collect()} == SAID


ANCHORS = {
    "see lib/a.py and C:\\dir\\x or notes.md": (["lib/a.py", "c:/dir/x", "notes.md"], [], []),
    "ValueError E123 ERR_BAD_X X-12_A 8080 080": ([], ["valueerror", "e123", "err_bad_x", "x-12_a", "8080"], ["x-12_a"][1:]),
    "call getUserName or a.b:c and snake_case_1": ([], [], ["getusername", "a.b:c", "snake_case_1"]),
    "ABC-DEF and HTTP2": ([], [], ["abc-def"]),
}


def test_anchors(spark):
    df = spark.createDataFrame([(s,) for s in ANCHORS], "s string").select("s", classify.anchors(F.col("s")).alias("a")).select("s", "a.*")
    assert {r.s: (r.paths, r.errors, r.identifiers) for r in df.collect()} == ANCHORS


def test_builders():
    assert re.fullmatch(speech.phrase("a b", "c.d"), "a \t b") and not re.fullmatch(speech.phrase("c.d"), "cxd")
    assert re.search(speech.together("x", "y", 2), "y--x") and not re.search(speech.near("x", "y", 2), "y--x")
    assert re.search(speech.whole("ok"), "ok!") and not re.search(speech.whole("ok"), "ok then")


@pytest.mark.parametrize(("text", "n"), [("Timeout RATE_LIMIT IOException 4040 ab", 3), ("nothing at all 12", 0)])
def test_known_errors(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string").select(F.size(F.regexp_extract_all("t", F.lit(classify.ascii_bounds(classify.KNOWN_ERROR)), F.lit(0))).alias("n"))
    assert df.first().n == n
