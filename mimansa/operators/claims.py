"""Claims in messages against retrieved zones, and citations of generated answers. Rules only; nothing is guessed.

Hits are `hits(query_id, rank, doc_id, zone, text, url, net, bm25_score)`, as the search gives them.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mimansa.functions import text as tx

# Patterns of amounts, fees, free offers and deadlines.
AMOUNT = r"(?i)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
FEE = r"(?i)\b(?:fee|fees|charge|charges|registration|activate|activation)\b"
FEE_CONTEXT = r"(?i)\b(?:fee|fees|charge|charges|registration|activate|activation|payment|payments)\b"
FREE = r"(?i)\b(?:free|without\s+any\s+fee|no\s+(?:registration\s+|activation\s+)?fees?)\b"
EVIDENCE_FREE = r"(?i)\b(?:no\s+(?:registration\s+|activation\s+)?fees?|free\s+of\s+charge|without\s+any\s+fee|free\s+to\s+activate|free\s+activation|free\s+registration|free\s+card)\b"
DEADLINE = r"(?i)\b(?:before|by|until|deadline|last\s+date(?:\s+to\s+\w+)?(?:\s+is)?)\s+([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{2,4})\b"
WINDOW = 40
MIN_NET = 0.05

_FACTS = T.StructType().add("fee_amounts", T.ArrayType(T.DoubleType())).add("free", T.BooleanType())
_amount, _context, _free, _evidence_free = map(re.compile, (AMOUNT, FEE_CONTEXT, FREE, EVIDENCE_FREE))


def _near_fee(text: str, m: re.Match) -> bool:
    return bool(_context.search(text[max(0, m.start() - WINDOW) : m.end() + WINDOW]))


def _facts(text: str | None) -> tuple[list[float], bool]:
    """Amounts with a fee word within 40 characters, and whether the text offers something for free."""
    text = text or ""
    amounts = [float(m[1].replace(",", "")) for m in _amount.finditer(text) if _near_fee(text, m)]
    return amounts, bool(_evidence_free.search(text)) or any(_near_fee(text, m) for m in re.finditer(r"(?i)\bfree\b", text))


@F.pandas_udf(_FACTS)
def facts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_facts(t if isinstance(t, str) else None) for t in texts], columns=["fee_amounts", "free"])


def amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit("")).cast("double"))


def deadlines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DEADLINE), F.lit(1))


def spans(text: str | Column) -> Column:
    """The stretches that make a claim: amounts, the first free offer, deadlines; a fee word only if there are none."""
    c = tx.col(text)
    first = lambda p: F.slice(F.regexp_extract_all(c, F.lit(p), F.lit(0)), 1, 1)
    found = F.concat(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), first(FREE), F.regexp_extract_all(c, F.lit(DEADLINE), F.lit(0)))
    return F.when(F.size(found) > 0, found).otherwise(first(FEE))


def date_key(text: Column) -> Column:
    """d-m-y in numbers, two-digit years in this century; null for other dates."""
    pattern = r"^\s*([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    return F.when(part(1).isNotNull(), F.concat_ws("-", part(1), part(2), F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))))


def read_messages(messages: DataFrame, text: str = "message") -> DataFrame:
    """Adds c_spans, c_amounts, c_free, c_deadlines, c_fees to messages."""
    c = F.coalesce(F.col(text), F.lit(""))
    return messages.withColumns({"c_spans": spans(c), "c_amounts": amounts(c), "c_free": c.rlike(FREE), "c_deadlines": deadlines(c), "c_fees": facts(c)["fee_amounts"]})


def compare(e_fees: Column, e_free: Column, e_deadlines: Column) -> Column:
    """SUPPORTED, CONTRADICTED, INSUFFICIENT_EVIDENCE or NO_CLAIM_FOUND of a read message against a read zone."""
    positive = lambda a: F.exists(a, lambda x: x > 0)
    silent = F.lit("INSUFFICIENT_EVIDENCE")
    fee = (
        F.when((F.size(e_fees) == 0) & ~e_free, silent)
        .when(e_free & positive(F.col("c_fees")), "CONTRADICTED")
        .when(F.arrays_overlap("c_fees", e_fees), "SUPPORTED")
        .when(F.size(e_fees) > 0, "CONTRADICTED")
        .otherwise(silent)
    )
    free = F.when(e_free, "SUPPORTED").when(positive(e_fees), "CONTRADICTED").otherwise(silent)
    keys = lambda ds: F.filter(F.transform(ds, date_key), lambda k: k.isNotNull())
    low = lambda ds: F.transform(ds, lambda d: F.lower(F.trim(d)))
    agreed = F.when((F.size(keys(F.col("c_deadlines"))) > 0) & (F.size(keys(e_deadlines)) > 0), F.arrays_overlap(keys(F.col("c_deadlines")), keys(e_deadlines))).otherwise(
        F.arrays_overlap(low(F.col("c_deadlines")), low(e_deadlines))
    )
    date = F.when(F.size(e_deadlines) == 0, silent).when(agreed, "SUPPORTED").otherwise("CONTRADICTED")
    return F.when(F.size("c_fees") > 0, fee).when(F.col("c_free"), free).when(F.size("c_deadlines") > 0, date).otherwise("NO_CLAIM_FOUND")


def missing_net(n_net: Column, n_bm25: Column) -> Column:
    """Why hits without any net score cannot be used; null if there is one."""
    return F.when(n_net > 0, None).when(n_bm25 > 0, "unsupported_bm25_evidence").otherwise("missing_net_score")


def verdicts(messages: DataFrame, hits: DataFrame, min_net: float = MIN_NET) -> DataFrame:
    """query_id, label, cite, score, refusal_reason of `messages(query_id, message)` against their hits.

    Hits below the least net score are no evidence. The first contradicting and the first supporting hit decide; both
    together are insufficient and are both cited. Without either, the hit nearest in words is named, the first if tied.
    """
    read = read_messages(messages)
    # hits of one message are few (the k of the search), so they are gathered by message
    usable = hits.where(F.col("net") >= min_net)
    ranked = usable.join(read, "query_id")
    e = facts(F.coalesce("text", F.lit("")))
    judged = ranked.withColumns({"_e": e, "_ed": deadlines(F.coalesce("text", F.lit("")))}).withColumn("_label", compare(F.col("_e.fee_amounts"), F.col("_e.free"), F.col("_ed")))
    overlap = tx.token_overlap(tx.claim_words("message"), tx.claim_words("text"))
    numbered = judged.withColumn("_overlap", overlap)
    place = F.row_number().over(_by_rank())
    numbered = numbered.withColumn("_i", place)
    pick = lambda label: F.min(F.when(F.col("_label") == label, F.struct("_i", "net")))
    per = numbered.groupBy("query_id").agg(pick("CONTRADICTED").alias("no"), pick("SUPPORTED").alias("yes"), F.max(F.struct("_overlap", (-F.col("_i")).alias("_m"), "net")).alias("near"))
    state = hits.groupBy("query_id").agg(F.count("net").alias("n_net"), F.count("bm25_score").alias("n_bm25"), F.count("*").alias("n"))
    rows = read.join(state, "query_id", "left").join(per, "query_id", "left")
    z = lambda i: F.concat(F.lit("Z"), i)
    none = F.size("c_spans") == 0
    unscored = F.when(F.col("n") > 0, missing_net(F.col("n_net"), F.col("n_bm25")))
    both = F.col("no").isNotNull() & F.col("yes").isNotNull()
    open_ = ~none & unscored.isNull()
    label = F.when(none, "NO_CLAIM_FOUND").when(unscored.isNotNull() | both, "INSUFFICIENT_EVIDENCE").when(F.col("no").isNotNull(), "CONTRADICTED").when(F.col("yes").isNotNull(), "SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")
    cite = F.when(both, F.concat_ws(", ", z(F.col("no._i")), z(F.col("yes._i")))).otherwise(z(F.coalesce("no._i", "yes._i", -F.col("near._m"))))
    score = F.when(both, F.greatest("no.net", "yes.net")).otherwise(F.coalesce("no.net", "yes.net", "near.net"))
    return rows.select("query_id", label.alias("label"), F.when(open_, cite).alias("cite"), F.when(open_, score).alias("score"), F.when(~none, unscored).alias("refusal_reason"))


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("rank", "doc_id")


def refusals(queries: DataFrame, hits: DataFrame, threshold: float, allow_mock: bool = False) -> DataFrame:
    """query_id, reason: why a query must not be answered, null if it may be. The first of the rules that holds counts."""
    mock = F.count_if(F.col("source") == "mock_fixture") if "source" in hits.columns else F.lit(0)
    stats = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), mock.alias("n_mock"), F.count("net").alias("n_net"), F.count("bm25_score").alias("n_bm25"), F.count_if(F.col("net").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("n_text"), F.max("net").alias("top")
    )
    rows = queries.select("query_id").distinct().join(stats, "query_id", "left")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty_hits")
        .when((F.col("n_mock") > 0) & F.lit(not allow_mock), "mock_evidence")
        .when(F.col("n_net") == 0, missing_net(F.col("n_net"), F.col("n_bm25")))
        .when(F.col("n_text") == 0, "empty_evidence")
        .when(F.col("top") < threshold, "low_retrieval_score")
    )
    return rows.select("query_id", reason.alias("reason"))


def labelled(hits: DataFrame) -> DataFrame:
    """Adds label (Z1, Z2, ...) and cite_key (doc_id::zone), in the order of the hits."""
    return hits.withColumn("label", F.concat(F.lit("Z"), F.row_number().over(_by_rank()))).withColumn("cite_key", F.concat_ws("::", F.col("doc_id").cast("string"), "zone"))


def cite_table(hits: DataFrame) -> DataFrame:
    """query_id, cite, text: every way to cite a hit that names exactly one: its label, its key, its document."""
    names = labelled(hits).select("query_id", "label", "text", F.explode(F.array_distinct(F.array("label", "cite_key", F.col("doc_id").cast("string")))).alias("cite"))
    return names.groupBy("query_id", "cite").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("text").alias("text")).where(F.col("n") == 1).drop("n")


def check_citations(sentences: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """query_id, sentence_index, overlap, supported, flag of `sentences(query_id, sentence_index, text, cite_ids)`.

    A sentence without cites misses its citation, one with any unknown cite is void, else the best overlap with a cited
    zone must reach the threshold.
    """
    norm = lambda c: F.when(F.trim(c).rlike(r"^[Zz]\d+$"), F.upper(F.trim(c))).otherwise(F.trim(c))
    rows = sentences.withColumnRenamed("text", "_s").withColumn("_cites", F.coalesce("cite_ids", F.array().cast("array<string>")))
    each = rows.select("query_id", "sentence_index", "_s", F.explode("_cites").alias("c")).withColumn("cite", norm(F.col("c")))
    found = each.join(cite_table(hits), ["query_id", "cite"], "left")
    overlap = tx.token_overlap(tx.claim_words("_s"), tx.claim_words("text"))
    per = found.groupBy("query_id", "sentence_index").agg(F.count_if(F.col("label").isNull()).alias("unknown"), F.max(overlap).alias("best"))
    joined = rows.join(per, ["query_id", "sentence_index"], "left")
    flag = F.when(F.size("_cites") == 0, "missing_citation").when(F.col("unknown") > 0, "unknown_cite_id").when(F.col("best") < threshold, "unsupported")
    known = F.when((F.size("_cites") > 0) & (F.col("unknown") == 0), F.col("best")).otherwise(0.0)
    return joined.select("query_id", "sentence_index", known.alias("overlap"), flag.isNull().alias("supported"), flag.alias("flag"))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, prompt: the question and its labelled evidence, those hits that have a net score."""
    rows = labelled(hits.where(F.col("net").isNotNull()))
    block = F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("["), "label", F.lit("]")), F.concat(F.lit("doc_id="), "doc_id"), F.concat(F.lit("zone="), "zone"), F.concat(F.lit("url="), "url")), F.trim("text"))
    evidence = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    rules = (
        'Answer from the evidence alone, one claim a sentence, as JSON {"claims": [{"text": "...", "cite_ids": ["Z1"]}]}. '
        "Every claim cites labels from the evidence. If the evidence has no answer, say that it was not found in official sources."
    )
    return queries.join(evidence, "query_id").select("query_id", F.concat(F.lit(rules + "\n\nQuestion: "), "query", F.lit("\n\nEvidence:\n"), F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n")).alias("prompt"))


_ANSWER = T.StructType().add("valid", T.BooleanType()).add("claims", T.ArrayType(T.StructType().add("text", T.StringType()).add("cite_ids", T.ArrayType(T.StringType()))))


def _answer(raw: str | None) -> tuple[bool, list[dict]]:
    raw = (raw or "").strip()
    if not raw:
        return True, []
    body = re.sub(r"^```[^\n]*\n?|\n?```\s*$", "", raw)
    try:
        claims = json.loads(body)["claims"]
        out = []
        for c in claims if isinstance(claims, list) else [None]:
            text = str(c.get("text", "")).strip()
            if not text:
                continue
            if not isinstance(c.get("cite_ids"), list) or not c["cite_ids"]:
                return False, []
            out.append({"text": text, "cite_ids": [str(x) for x in c["cite_ids"]]})
        return True, out
    except (ValueError, KeyError, TypeError, AttributeError):
        return False, []


@F.pandas_udf(_ANSWER)
def parse_answer(raws: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_answer(r if isinstance(r, str) else None) for r in raws], columns=["valid", "claims"])


def answers(queries: DataFrame, hits: DataFrame, generate, threshold: float) -> DataFrame:
    """query_id, refusal_reason, claims. `generate` maps a prompt column to a text column; None refuses.

    The gate runs before generation, so refused queries cost nothing. Unknown cites make a generation invalid.
    """
    gate = refusals(queries, hits, threshold)
    if generate is None:
        return gate.select("query_id", F.coalesce("reason", F.lit("llm_not_configured")).alias("refusal_reason"), F.lit(None).cast(_ANSWER["claims"].dataType).alias("claims"))
    asked = queries.join(gate.where(F.col("reason").isNull()).select("query_id"), "query_id", "left_semi")
    made = prompts(asked, hits).withColumn("_a", parse_answer(generate(F.col("prompt")))).select("query_id", "_a.*")
    cited = made.select("query_id", F.explode("claims").alias("c")).select("query_id", F.explode("c.cite_ids").alias("c"))
    known = cite_table(hits.where(F.col("net").isNotNull())).select("query_id", "cite", F.lit(True).alias("_ok"))
    trimmed = cited.withColumn("cite", F.when(F.trim("c").rlike(r"^[Zz]\d+$"), F.upper(F.trim("c"))).otherwise(F.trim("c")))
    bad = trimmed.join(known, ["query_id", "cite"], "left_anti").select("query_id").distinct().withColumn("_bad", F.lit(True))
    done = made.join(bad, "query_id", "left")
    reason = F.when(~F.col("valid") | F.col("_bad"), "invalid_generation").when(F.size("claims") == 0, "empty_generation")
    out = done.select("query_id", reason.alias("refusal_reason"), F.when(reason.isNull(), F.col("claims")).alias("claims"))
    return out.unionByName(gate.where(F.col("reason").isNotNull()).select("query_id", F.col("reason").alias("refusal_reason"), F.lit(None).cast(out.schema["claims"].dataType).alias("claims")))


def is_evidence(evidence: Column, text: Column) -> Column:
    """Whether a verdict's evidence is a retrieved text: one holds the other; blank ones never match."""
    a, b = F.trim(evidence), F.trim(text)
    return F.coalesce((a != "") & (b != "") & (F.contains(evidence, b) | F.contains(b, a)), F.lit(False))


# What to do with an answer whose citations do not hold, and the reason of one that is held back.
POLICIES = ("flag", "withhold")
NOT_VERIFIED = "citation_validation_failed"


def apply_policy(answered: DataFrame, checks: DataFrame, policy: str = "flag") -> DataFrame:
    """`answered(query_id, refused, refusal_reason, ...)` with n_unsupported, the citations that do not hold.

    Under "withhold" an answer with any such citation is refused; under "flag", and any other policy, it stays. Answers
    refused before have no checks and stay refused.
    """
    bad = checks.groupBy("query_id").agg(F.count_if(~F.col("supported")).alias("n_unsupported"))
    rows = answered.join(bad, "query_id", "left").withColumn("n_unsupported", F.when(F.col("refused"), 0).otherwise(F.coalesce("n_unsupported", F.lit(0))))
    if policy.strip().lower() != "withhold":
        return rows
    held = ~F.col("refused") & (F.col("n_unsupported") > 0)
    return rows.withColumns({"refusal_reason": F.when(held, NOT_VERIFIED).otherwise(F.col("refusal_reason")), "refused": F.col("refused") | held})
