"""Formats against `re`, what contexts add, redaction, odd rows."""

import hashlib
import re

from collections import Counter

from tickloom.llm.pii import _occurrences, digest, personal_spans, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    "mail a.b@c.de, x@y, é@é.com q@w.e_r@t.z @a.b a@b.c@d.e", "1.2.3.4 256.1.1.1 001.02.3.004 1.2.3.4.5.6.7.8 99999999999.1.1.1", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111- 12345",
    "+1 (555) 555-1234 +12 +123456789012345678 ++49 30 1234567 x", "ü€𝔘 a@b.cd 4111111111111111", "1 " * 3000, "a@" * 2000, "", None, "0" * 5000, "a." * 3000 + "@b.c", "4111111111111111 4111111111111111"]


def test_formats(spark, texts):
    rows = list(enumerate(TEXTS)) + [(d + 1000, t) for d, t in texts.items()]
    got = {r.doc_id: r for r in digest(personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, t in rows:
        own = brute(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest(), (d, own)
        assert set(own) <= set(got[d].spans.split(",")) | {""}


def test_contexts_add_identifiers(spark):
    rows = [(i, f"some words here tel: +1 (555) 555-{1000 + i} and more words of a text") for i in range(30)]
    rows += [(100, "write tel: (555) 555-9876 to us"), (101, "the year 2024-2025 and 1234567 items"), (102, "ask for (555) 555-9876 there")]
    got = {r.doc_id: r for r in digest(personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100].spans == "phone:11:25" and got[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[101].spans == "" and got[5].n_phone == 1


def test_contexts_are_judged_on_all_texts(spark):
    """A word that mostly stands in texts without any identifier is no sign of one."""
    rows = [(i, f"some words here call +1 (555) 555-{1000 + i} and more words of a text") for i in range(30)]
    rows += [(100, "write call (555) 555-9876 to us"), *[(200 + i, "a call is a call, so call again") for i in range(30)]]
    got = {r.doc_id: r for r in digest(personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100].spans == "" and got[5].n_phone == 1 and got[200].spans == ""


def test_words_of_all_texts_do_not_go_through_a_shuffle(spark, docs, texts):
    """Whatever Spark makes of sizes: words are dropped or counted in the task that cut them."""
    words = Counter(w for t in texts.values() for w in re.split(r"[\W_]+", (t or "").lower()) if w)
    few = [w for w, _ in words.most_common(40)] + ["notaword"]
    cues = spark.createDataFrame([(w,) for w in few], "cue string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (100, 5):
            found = _occurrences(docs, cues, most)
            assert {r.cue: r.occurs for r in found.collect()} == {w: words[w] for w in few if w in words}
            plan = found._jdf.queryExecution().executedPlan().toString()
            above = plan[: plan.index("Generate")].splitlines()[::-1]
            first = lambda word: next(i for i, line in enumerate(above) if word in line)
            assert ("BroadcastHashJoin" in plan) == (most == 100) and first("partial_count") < first("Exchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_labels_glued_to_identifiers_are_contexts(spark):
    rows = [(i, f"some words here Tel:+1 (555) 555-{1000 + i} and mail=a{i}@b.cd of a text") for i in range(30)]
    rows += [(100, "write Tel:(555) 555-9876 to us"), (101, "or mail=x (at) y.z today"), (102, "the year 2024-2025 and 1234567 items")]
    got = {r.doc_id: r.spans for r in digest(personal_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[100], got[101], got[102]) == ("phone:10:24", "email:8:18", "")


def test_redaction(spark):
    rows = [(1, "a b@c.de f 1.2.3.4 g", "k"), (2, "clean", "k"), (3, None, "k"), (4, "+4111 1111 1111 1111 x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = redact(df)
    assert got.columns == df.columns
    left = {r.doc_id: r.text for r in got.collect()}
    assert left[1] == "a <EMAIL> f <IP> g" and left[2] == "clean" and left[3] is None and not re.search("[0-9]{4}", left[4])


def test_odd_rows(odd, none):
    rows = digest(personal_spans(odd)).collect()
    assert len(rows) == 9 and all(r.spans == "" for r in rows if r.doc_id in (1, 2, 3, 4))
    assert digest(personal_spans(none)).collect() == [] and redact(odd).count() == 9 and redact(none).collect() == []


def test_clashing_names_come_back_as_they_were(spark):
    """Extra columns called like the operator's own keep their values."""
    df = spark.createDataFrame([(1, "mail a.b@example.org now", 77, "x", 1.5, "k")], "doc_id long, text string, _row_key int, _base string, _all double, row_key string")
    row = redact(df).first()
    assert tuple(row) == (1, "mail <EMAIL> now", 77, "x", 1.5, "k") and redact(df).columns == df.columns
