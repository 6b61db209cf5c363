"""Grammars as pattern text: vocabularies of speech acts and the forms that queries' anchors take.

Patterns are made of word tables by a few builders, so the tables say what counts and the builders say how words stand
together. Everything is portable between regular expression engines: no look-around, and \\b as the word bound (see
classify.ascii_bounds).
"""

from __future__ import annotations

import re


def either(*parts: str) -> str:
    return f"(?:{'|'.join(parts)})"


def phrase(*words: str) -> str:
    """One of the phrases; a blank stands for any white space."""
    return either(*(re.escape(w).replace(r"\ ", r"\s+") for w in words))


def near(first: str, second: str, gap: int) -> str:
    """The second at most `gap` characters after the first."""
    return f"{first}.{{0,{gap}}}{second}"


def together(a: str, b: str, gap: int) -> str:
    """In either order."""
    return either(near(a, b, gap), near(b, a, gap))


def whole(body: str, stop: str = "[.!。！]?") -> str:
    """The whole message, but for a stop at its end."""
    return f"^{body}{stop}$"


def bounded(body: str) -> str:
    return rf"\b{body}\b"


# Vocabularies. The words that tell the speech acts apart, by language.
STORE = {"en": ("memory",), "zh": ("记忆系统", "记忆")}
MEASURE = {"en": ("status", "health", "effectiveness"), "zh": ("最近", "效果", "运行", "健康", "指标", "统计")}
ACCOUNT = {"en": ("report",), "zh": ("报告",)}
CHECK = {"en": ("review", "confirm"), "zh": ("复核",)}
KEEP = {"en": ("remember", "memorize"), "zh": ("记住", "记一下", "记下来")}
SAVE = {"en": ("save", "store"), "zh": ("保存", "存下")}
SAVED_FOR = ("memory", "for later", "preference", "rule")
REPORTED = {"en": ("he said", "she said", "they said", "if user says", "if a user says", "translate", "explain"), "zh": ("他说", "她说", "别人说", "如果用户说", "如果别人说", "翻译", "解释")}
ASKED = {"en": ("do you remember", "what do you remember", "can you recall"), "zh": ("你记得", "你还记得", "还记得吗", "记不记得")}
OWN = ("i remember", "i remembered", "i already remember", "i already remembered", "i do not remember", "i don't remember", "i dont remember")
RECALLS = ("他", "她", "他们", "为什么", "这", "那")
TAKEN = {"en": ("got it", "noted"), "zh": ("我", "好", "好的", "嗯", "知道了")}
MOCKED = ("呵呵", "反话", "讽刺")
SECRETS = {"en": ("secret", "password", "passcode", "otp", "credit card", "social security", "api key", "apikey"), "zh": ("密码", "口令", "验证码", "银行卡", "信用卡", "卡号", "身份证", "护照")}
NOT = {"en": ("do not", "don't", "dont", "never"), "zh": ("别", "不要", "不用")}
DROP = {"en": ("forget", "delete", "remove"), "zh": ("忘掉", "忘记", "删掉", "删除")}
DROPPED = {"en": ("this", "that", "what i said", "the memory", "memory"), "zh": ("这", "那", "之前", "以前", "我说", "记忆", "memory")}
ONCE = {"en": ("this time", "for this task only", "for now", "today only"), "zh": ("这次", "本轮", "当前任务", "今天")}
ALWAYS = {"en": ("from now on", "in the future", "next time", "every time", "always", "never", "default to"), "zh": ("以后", "今后", "往后", "从现在起", "下次", "每次", "一直", "总是", "永远", "别再", "不再")}
HABIT = ("这样", "照这个", "默认", "保持", "用", "别", "不要", "不再", "回答", "回复", "写", "做", "提醒", "叫我", "称呼")
LIKES = {"en": ("always", "prefer", "dislike"), "zh": ("一直", "总是", "更喜欢", "偏好", "不喜欢", "习惯")}
SPEAKER = ("我", "本人")
POINTER = {"en": ("this", "that", "it"), "zh": ("这", "那", "这个", "那个")}
PLEASE = {"en": ("please",), "zh": ("请", "麻烦", "帮我")}


def _all(table: dict[str, tuple[str, ...]]) -> str:
    return phrase(*table["en"], *table["zh"])


def _ask(lang: str) -> str:
    """A politeness that may stand before a verb."""
    return f"(?:{phrase(*PLEASE[lang])}\\s*)?"


def _verb(lang: str) -> str:
    """A verb of keeping, with or without a politeness."""
    return _ask(lang) + phrase(*KEEP[lang])


def _negated_forget() -> str:
    return either(bounded(phrase("do not forget")), "别忘了")


def acts() -> dict[str, str]:
    """Name of a condition -> pattern on a normalized message in lower case."""
    store, measure = _all(STORE), _all(MEASURE)
    account = either(measure, _all(ACCOUNT))
    secret_key = r"\baccess[_\s-]*token\b|\bsk-[a-z0-9_-]{8,}\b"
    written = phrase("记住", "remember")
    return {
        "report": either(f"^{phrase('report', 'health', 'status')}$", near(store, account, 20), near(measure, store, 20)),
        "review": _all(CHECK),
        "quoted": either(near(phrase(*REPORTED["zh"]), phrase("记住", "记得", "remember"), 30), near(phrase(*REPORTED["en"]), bounded("remember"), 40), near(near('["“]', written, 80), '["”]', 80)),
        "question": _all(ASKED),
        "acknowledged": either(rf"^{phrase(*OWN)}\b", f"^我记得{phrase(*RECALLS)}", whole(rf"(?:{phrase(*TAKEN['zh'])}[，,\s]*)?记住了"), whole(phrase(*TAKEN["en"]), "[.!]?")),
        "tone": either(near(phrase(*MOCKED), "记住", 12), r"you(?:'d)? better remember[.!]?$"),
        "persist": either("记住(?:[^了]|$)", phrase(*KEEP["zh"][1:]), rf"{phrase(*SAVE['zh'])}\s*\S", rf"{bounded(phrase(*KEEP['en']))}\s+\S", near(phrase(*SAVE["en"]), phrase(*SAVED_FOR), 20), _negated_forget()),
        "sensitive": either(phrase(*SECRETS["zh"]), bounded(phrase(*SECRETS["en"])), secret_key),
        "keep": _negated_forget(),
        "delete": either(near(phrase(*NOT["zh"]), phrase("记住", "记下来", "保存"), 6), near(phrase(*DROP["zh"]), phrase(*DROPPED["zh"]), 24), rf"{phrase(*NOT['en'])}\s+{phrase(*KEEP['en'], 'save')}", rf"{phrase(*DROP['en'])}\s+{phrase(*DROPPED['en'])}"),
        "transient": _all(ONCE),
        "durable": either(near(phrase(*ALWAYS["zh"]), phrase(*HABIT), 40), phrase(*ALWAYS["en"]), near("don't ", " again", 24), near("do not ", " anymore", 24), near(phrase(*SPEAKER), phrase(*LIKES["zh"]), 8), rf"\bi\s+{phrase(*LIKES['en'])}\b"),
        "pointing": either(whole(rf"{_verb('zh')}\s*{phrase(*POINTER['zh'])}"), whole(rf"{_verb('en')}\s+{phrase(*POINTER['en'])}", "[.!]?")),
        "bare": either(whole(_verb("zh")), whole(_verb("en"), "[.!]?")),
        "points": rf"{phrase('这样', '照这个', 'this', 'that')}\s*[.!。！]?$",
    }


# Forms of anchors. File extensions, and words that ask for a decision.
EXTENSIONS = ("c", "cc", "cpp", "go", "h", "html", "java", "js", "json", "jsx", "kt", "kts", "md", "mjs", "mm", "py", "sh", "sql", "swift", "ts", "tsx", "xml", "yaml", "yml")
DECIDING = {"en": ("why", "decision", "tradeoff", "trade-off", "trade off", "rationale", "choose", "chosen", "should we"), "zh": ("为什么", "为何", "裁决", "决定", "决策", "取舍", "权威", "依据", "原因")}


def path_form() -> str:
    """Names of letters, digits, _ . and - joined by slashes of either kind, after a drive or a first slash; or one name
    with a known extension."""
    name, slash = r"[\p{L}\p{N}_.-]+", r"[\\/]"
    return either(rf"(?:[a-z]:)?{slash}?{name}(?:{slash}{name})+", rf"\b[\p{{L}}\p{{N}}_-]+\.{phrase(*EXTENSIONS)}\b")


#: What an error looks like, by form. A code in capitals needs a digit and a _ or -, in either order.
ERROR_FORMS = {
    "exception": "[A-Za-z][A-Za-z0-9]*(?:Error|Exception)",
    "numbered": r"E\d{3,}",
    "prefixed": "(?:ERROR|ERR|E)[_-][A-Z0-9_.-]{2,}",
    "code": r"[A-Z][A-Z0-9.]*(?:[_-][A-Z0-9_.-]*\d|\d[A-Z0-9.]*[_-])[A-Z0-9_.-]*",
    "number": r"[1-9]\d{3,}",
    "constant": "[A-Z][A-Z0-9_.-]{2,}",
}


def error_form(*forms: str) -> str:
    return bounded(either(*(ERROR_FORMS[f] for f in forms)))


def identifier_form() -> str:
    """Words joined by punctuation, camel case, or words with underscores."""
    word = "[A-Za-z0-9]"
    joined, camel, snake = f"[A-Za-z]{word}*(?:[._:-]{word}+)+", f"{word}*[a-z][A-Z]{word}*", f"[A-Za-z]{word}*_[A-Za-z0-9_]+"
    return either(bounded(joined), bounded(camel), bounded(snake))


def decision_form() -> str:
    return either(phrase(*DECIDING["zh"]), bounded(phrase(*DECIDING["en"])))
