"""Token budgets: shrink a result step by step until its estimate fits."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

_WIDE = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")
#: Topics, tokens, excerpt length and explanations of each tier.
TIERS = {"default": (1, 400, 240, 2), "expanded": (3, 1200, 600, 4)}


def estimate(text: str) -> int:
    """Wide characters plus a quarter of the other bytes, rounded up."""
    wide = len(_WIDE.findall(text))
    return wide - (-len(_WIDE.sub("", text).encode()) // 4)


def _cut(text: str | None, most: int) -> str | None:
    if text is None:
        return None
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1].rstrip() + "…"


def _shrink(r: dict, step: int) -> None:
    """The eight steps, mildest first."""
    if step == 0:
        r["excerpt"] = _cut(r["excerpt"], 160)
    elif step == 1:
        r["terms"] = r["terms"][:3]
    elif step == 2:
        r["authority"] = r["authority"][:2]
    elif step == 3:
        r["explanation"] = [_cut(x, 120) for x in r["explanation"][:1]]
    elif step == 4:
        r["excerpt"] = _cut(r["excerpt"], 80)
    elif step == 5:
        r["terms"] = []
    elif step == 6:
        r["authority"] = []
    else:
        r["excerpt"] = None


def envelope(query: str, results: list[dict]) -> tuple[str, int]:
    """JSON and its estimate; the estimate is part of the JSON, so it is taken until it stands still."""
    tokens = 0
    for _ in range(10):
        text = json.dumps({"query": query, "results": results, "estimated_tokens": tokens}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        now = estimate(text)
        if now == tokens:
            break
        tokens = now
    return text, tokens


def fit(query: str, candidates: list[dict], tier: str = "default") -> dict:
    """Take candidates in order while the envelope fits; a topic that does not fit after all steps is dropped and ends
    the list."""
    topics, budget, excerpt, explanations = TIERS[tier]
    taken: list[dict] = []
    truncated = False
    for c in candidates[:topics]:
        r = {"id": c["id"], "excerpt": _cut(c.get("excerpt"), excerpt), "terms": list(c.get("terms") or []), "authority": list(c.get("authority") or []), "explanation": list(c.get("explanation") or [])[:explanations]}
        for step in range(-1, 8):
            if step >= 0:
                _shrink(r, step)
                truncated = True
            if envelope(query, [*taken, r])[1] <= budget:
                taken.append(r)
                break
        else:
            break
    text, tokens = envelope(query, taken)
    return {"envelope": text, "estimated_tokens": tokens, "topics": len(taken), "dropped": max(0, min(len(candidates), topics) - len(taken)), "truncated": truncated, "abstain_reason": None if taken else "budget-empty" if candidates else "no-trusted-candidate"}


def budgeted(ranked: DataFrame, tier: str = "default") -> DataFrame:
    """One row per query from (query_id, query, rank, id, excerpt, terms, authority, explanation). A query's candidates
    are few (they come from a top-k), so a query is one group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        clean = [{k: (list(v) if hasattr(v, "tolist") else v) for k, v in r.items()} for r in rows]
        return pd.DataFrame([{"query_id": rows[0]["query_id"]} | fit(rows[0]["query"], clean, tier)])

    kind = ranked.schema["query_id"].dataType.simpleString()
    return ranked.groupBy("query_id").applyInPandas(run, f"query_id {kind}, envelope string, estimated_tokens int, topics int, dropped int, truncated boolean, abstain_reason string")


#: What an answer of the fallback says, and the texts and lists that it keeps at most.
FALLBACK_EXPLANATION, FALLBACK_SHORT = "Markdown BM25F fallback after snapshot rebuild failed", "markdown-fallback"
FALLBACK = {"excerpt": 160, "fields": 12, "terms": 6, "authority": 2, "short_terms": 3, "short_authority": 1, "short_excerpt": 80, "warnings": 5}


def fallback(query: str, found: list[dict], tier: str = "default", warnings: tuple[str, ...] = ()) -> dict:
    """The envelope of direct search where no snapshot can be read: at most three results, as many as the tier has topics.
    If they do not fit, texts are shortened, then the last results go, then the first loses its texts, then all."""
    topics, budget, _, _ = TIERS[tier]
    kept = [{"id": r["id"], "score": round(max(0.0, r["score"]), 6), "channels": ["bm25f"], "fields": list(dict.fromkeys(r.get("fields") or ["body"]))[: FALLBACK["fields"]], "terms": list(dict.fromkeys(r.get("terms") or []))[: FALLBACK["terms"]], "excerpt": (r.get("excerpt") or "").strip()[: FALLBACK["excerpt"]] or None, "authority": list(dict.fromkeys(r.get("authority") or []))[: FALLBACK["authority"]], "explanation": [FALLBACK_EXPLANATION]} for r in found[:3]]
    truncated = len(kept) > topics
    kept = kept[:topics]
    fits = lambda: envelope(query, kept)[1] <= budget
    if not fits():
        truncated = True
        for r in kept:
            short = r["excerpt"] if r["excerpt"] is None or len(r["excerpt"]) <= FALLBACK["short_excerpt"] else r["excerpt"][: FALLBACK["short_excerpt"] - 1] + "…"
            r |= {"explanation": [FALLBACK_SHORT], "authority": r["authority"][: FALLBACK["short_authority"]], "terms": r["terms"][: FALLBACK["short_terms"]], "excerpt": short}
        while len(kept) > 1 and not fits():
            kept.pop()
        if not fits() and kept:
            kept[0] |= {"excerpt": None, "terms": [], "authority": []}
        if not fits():
            kept = []
    for i, r in enumerate(kept):
        r["rank"] = i + 1
    text, tokens = envelope(query, kept)
    reason = None if kept else "budget-empty" if found else "no-trusted-candidate"
    return {"envelope": text, "estimated_tokens": tokens, "topics": len(kept), "dropped": len(found[:3]) - len(kept), "truncated": truncated, "abstain_reason": reason, "warnings": list(dict.fromkeys(warnings))[: FALLBACK["warnings"]]}


def fallback_budgeted(ranked: DataFrame, tier: str = "default") -> DataFrame:
    """fallback() for each query of (query_id, query, rank, id, score, fields, terms, excerpt, authority): a few rows a query,
    from a top-k."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        clean = [{k: (list(v) if hasattr(v, "tolist") else v) for k, v in r.items()} for r in rows]
        out = fallback(rows[0]["query"], clean, tier)
        return pd.DataFrame([{"query_id": rows[0]["query_id"]} | {k: v for k, v in out.items() if k != "warnings"}])

    kind = ranked.schema["query_id"].dataType.simpleString()
    return ranked.groupBy("query_id").applyInPandas(run, f"query_id {kind}, envelope string, estimated_tokens int, topics int, dropped int, truncated boolean, abstain_reason string")


def without_seen(candidates: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates that their session has not been shown, abstentions): candidates (query_id, session, doc_id) without those
    of seen (session, doc_id); a query that loses all of them abstains with all-candidates-excluded."""
    from pyspark.sql import functions as F

    left = candidates.join(seen.select("session", "doc_id").distinct(), ["session", "doc_id"], "left_anti")
    empty = candidates.select("query_id").distinct().join(left.select("query_id").distinct(), "query_id", "left_anti")
    return left.select(candidates.columns), empty.select("query_id", F.lit(True).alias("abstained"), F.lit("all-candidates-excluded").alias("reason"))


#: What a matched term and a query token add to a paragraph's score.
PER_TERM, PER_TOKEN = 4, 1


def best_chunks(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk, score, matched): of a document's paragraphs (doc_id, start_byte, chunk) the one that holds most
    of a candidate's terms and query tokens (query_id, doc_id, terms, tokens: arrays in lower case), by score, then number,
    then place."""
    from pyspark.sql import functions as F

    from tessella.functions.tokenizer import normalized

    rows = asked.join(chunks.withColumn("_t", normalized(F.col("chunk"))), "doc_id")
    held = lambda c: F.size(F.filter(F.array_distinct(c), lambda x: (x != "") & F.contains(F.col("_t"), x)))
    rows = rows.withColumn("a", held("terms")).withColumn("b", held("tokens"))
    best = F.max(F.struct((PER_TERM * F.col("a") + PER_TOKEN * F.col("b")).alias("score"), (F.col("a") + F.col("b")).alias("matched"), (-F.col("start_byte")).alias("place"), "chunk"))
    return rows.groupBy("query_id", "doc_id").agg(best.alias("x")).select("query_id", "doc_id", "x.chunk", "x.score", "x.matched")


def structured_excerpts(values: DataFrame, matched: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(query_id, doc_id, field, text): of a document's fields (doc_id, field, value) the first that the candidate (query_id,
    doc_id, fields) matches in, else the first that has a text; `order` is the fields' order. Values are joined by a bar."""
    from pyspark.sql import functions as F

    text = values.filter(F.trim("value") != "").groupBy("doc_id", "field").agg(F.array_join(F.array_sort(F.collect_list(F.trim("value"))), " | ").alias("text"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("field"))
    rows = matched.join(text, "doc_id").filter(place > 0)
    best = F.min(F.struct((~F.array_contains("fields", F.col("field"))).alias("other"), place.alias("place"), "field", "text"))
    return rows.groupBy("query_id", "doc_id").agg(best.alias("x")).select("query_id", "doc_id", "x.field", "x.text")


def excerpts(chunks: DataFrame, values: DataFrame, asked: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(query_id, doc_id, field, text): the best paragraph where it matches anything, else the structured excerpt.
    asked: query_id, doc_id, terms, tokens, fields."""
    from pyspark.sql import functions as F

    body = best_chunks(chunks, asked).filter("matched > 0").select("query_id", "doc_id", F.lit("body").alias("_f"), F.col("chunk").alias("_t"))
    short = structured_excerpts(values, asked, order)
    both = asked.select("query_id", "doc_id").join(body, ["query_id", "doc_id"], "left").join(short, ["query_id", "doc_id"], "left")
    return both.select("query_id", "doc_id", F.coalesce("_f", "field").alias("field"), F.coalesce("_t", "text").alias("text"))
