"""Language identification: counts and scores by brute force, held-out accuracy, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tickloom.llm import language_id
from tickloom.llm.queries import op13_language_id

FOLDER = "/root/testdata/sf0.001"


def plain_ngrams(text):
    """N-grams as strings: of words of letters, with a space on either side."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        out.update(word)
        for n in (2, 3):
            padded = f" {word} "
            out.update(padded[k: k + n] for k in range(len(padded) - n + 1))
    return out


def hashed(gram):
    found, _ = language_id.ngrams([gram])
    return found


def test_ngrams_are_those_of_the_words():
    texts = ["Ab c", "", None, "12 ,;", "  Été\n\nx-y9z  ", "ab c"]
    found, whose = language_id.ngrams(texts, 1 << 24)
    names = {}
    for k, text in enumerate(texts):
        grams = plain_ngrams(text or "")
        mine = Counter(found[whose == k].tolist())
        assert sorted(mine.values()) == sorted(grams.values()), text
        names[k] = mine
    assert names[0] == names[5] and (np.diff(whose) >= 0).all()


def test_scores_by_hand(spark):
    """Posterior of a small corpus from counts of n-gram strings (few n-grams, so no two share a bucket)."""
    rows = [(k, t, g) for k, (t, g) in enumerate([("the then that", "en"), ("der die das", "de"), ("this is it", "en"), ("nicht und ein", "de"), ("thing", "en"), ("und", "de"), ("those", "en"), ("dass", "de")])]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    counts, texts = {"de": Counter(), "en": Counter()}, Counter(r[2] for r in train)
    for _, text, lang in train:
        counts[lang] += plain_ngrams(text)
    for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        logs = {}
        for lang, seen in counts.items():
            total = sum(seen.values()) + 0.1 * language_id.BUCKETS
            logs[lang] = math.log(texts[lang] / len(train)) + sum(n * math.log((seen[g] + 0.1) / total) for g, n in plain_ngrams(rows[r.doc_id][1]).items())
        best = max(logs, key=lambda g: logs[g])
        assert r.lang_pred == best and math.isclose(r.score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark, docs):
    found = op13_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang_pred == found.lang).mean() > 0.95


def test_nothing_but_the_text_predicts(spark, docs):
    """Other languages, sources and ids in the rows to predict change nothing."""
    model = language_id.fit(docs)
    texts = [r.text for r in docs.select("text").collect()]
    best, sure, some = language_id.score(texts, *model[1:])
    one = [language_id.score([t], *model[1:]) for t in texts]
    assert [int(b) for b in best] == [int(o[0][0]) for o in one] and sure.tolist() == [float(o[1][0]) for o in one] and some.tolist() == [bool(o[2][0]) for o in one]
    moved = language_id.identify(docs.repartition(5)).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, language_id.identify(docs).select("doc_id", "lang_pred", "score").collect()))


def test_odd_rows(spark, odd, none):
    df = odd.selectExpr("*", "CASE WHEN doc_id > 5 THEN NULL ELSE 'xx' END AS lang", "1 AS held_out", "'q' AS lang_pred")
    found = language_id.identify(df).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3)) and by[4].lang_pred == by[5].lang_pred == by[7].lang_pred == "xx" and by[5].score == 1
    assert by[None].held_out and [r.doc_id for r in found].count(5) == 2
    assert language_id.identify(none).count() == 0
    nothing = language_id.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
