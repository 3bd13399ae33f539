"""Personal data: fixed formats as seeds, and contexts learned from them.

Seeds are e-mail and IP addresses, card and phone numbers in their plain formats.  The word
before a seed is a lexical pattern.  Patterns and the identifier-like strings they precede form
a graph: a pattern is as good as the share of its occurrences that stand before believed
identifiers, an instance as good as its patterns together.  A few rounds of that score both;
instances that good patterns support are added in all the places where one of those patterns
stands before them.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import fresh, store

KINDS = ("email", "ip", "card", "phone")
#: The formats; repeated groups are possessive, which matches the same and needs no stack.
FORMATS = {
    # A local part can begin only where its run begins, or where the last match ended.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has no valid span of the kind.
_GATE = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9][0-9 -]{14}", "phone": r"\+[0-9]"}
#: Identifier-like strings that the plain formats may miss.
CANDIDATE = r"(?<![0-9A-Za-z@.+_-])(?:[(]?[0-9][0-9 ().-]{5,28}[0-9]|[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}){1,4})(?![0-9A-Za-z@_])"
_CANDIDATE_GATE = r"[0-9][0-9 ().-]{5}|(?i:[\[(]at[\])])"
#: Fewest distinct seeds of a pattern, least share of believed occurrences, rounds, belief needed.
SEEDS, ROUNDS, BELIEF = 3, 3, 0.9

_SPAN = "array<struct<start:int,end:int,hit:string,left:string>>"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    value = lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"[^0-9]", "")
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _located(df: DataFrame, name: str, pattern: str, gate: str) -> DataFrame:
    """Add `name`: the matches with their places and the word before each.

    Splitting at the matches and extracting them gives pieces and hits in turn; the lengths
    summed up are the places, in code points.
    """
    has = F.col("text").rlike(gate)
    df = df.withColumn("_hits", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.expr("array()").cast("array<string>")))
    df = df.withColumn("_hits", F.coalesce("_hits", F.expr("array()").cast("array<string>")))
    df = df.withColumn("_pieces", F.when(F.size("_hits") > 0, F.split("text", pattern, -1)))
    df = df.withColumn(name, F.expr(f"""
        CASE WHEN size(_hits) = 0 THEN CAST(array() AS {_SPAN}) ELSE
        aggregate(sequence(1, size(_hits)), named_struct('at', 0, 'out', CAST(array() AS {_SPAN})), (acc, i) -> named_struct(
            'at', acc.at + length(element_at(_pieces, i)) + length(element_at(_hits, i)),
            'out', concat(acc.out, array(named_struct(
                'start', acc.at + length(element_at(_pieces, i)), 'end', acc.at + length(element_at(_pieces, i)) + length(element_at(_hits, i)),
                'hit', element_at(_hits, i), 'left', right(element_at(_pieces, i), 48))))), acc -> acc.out) END"""))
    return df.drop("_hits", "_pieces")


def _kept(spans: Column, k: int) -> Column:
    """The valid spans of a kind, with its number."""
    valid = F.filter(spans, lambda x: _valid(KINDS[k], x["hit"]))
    return F.transform(valid, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), x["left"].alias("left")))


def base_spans(df: DataFrame) -> DataFrame:
    """Add `base`: array of (kind number, start, end, hit, left) in the order of kinds, then starts.  Needs a column `text`."""
    parts = []
    for k, kind in enumerate(KINDS):
        df = _located(df, f"_{kind}", FORMATS[kind], _GATE[kind])
        parts.append(_kept(F.col(f"_{kind}"), k))
    return df.withColumn("base", F.concat(*parts)).drop(*[f"_{kind}" for kind in KINDS])


#: What cuts a text into the words that can be cues; a label's colon is no part of it.
_CUT = r"[^\p{L}\p{N}]+"


def _cue(left: Column) -> Column:
    """The word before, in lower case, also one glued to the identifier; null without one."""
    word = F.lower(F.regexp_extract(left, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
    return F.when(word != "", word)


#: So many cue words are broadcast; if there are more, words are counted before they meet them.
CUES = 1_000_000


def _occurrences(texts: DataFrame, cues: DataFrame, most: int = CUES) -> DataFrame:
    """(cue, occurs): the places of each cue word in all texts.

    Left to its size check, Spark may send every word of every text through a shuffle to meet the few cues.
    """
    words = texts.select(F.explode(F.filter(F.split(F.lower("text"), _CUT), lambda x: x != "")).alias("cue"))
    count = F.count("*").alias("occurs")
    if cues.count() <= most:
        return words.join(F.broadcast(cues), "cue", "left_semi").groupBy("cue").agg(count)
    return words.groupBy("cue").agg(count).join(cues, "cue", "left_semi")


def _learned(spans: DataFrame, texts: DataFrame, seeds: int, rounds: int, belief: float) -> DataFrame:
    """(cue, kind, instance) that the graph believes, from rows (id, text, base, found) with any span and from `texts`, all of them."""
    base = spans.select(F.explode("base").alias("s")).select(_cue(F.col("s.left")).alias("cue"), F.col("s.kind").alias("kind"), F.lower(F.regexp_replace("s.hit", r"\s", "")).alias("instance"), F.lit(True).alias("seed"))
    found = spans.select(F.explode("found").alias("s")).select(_cue(F.col("s.left")).alias("cue"), F.lit(None).cast("int").alias("kind"), F.lower(F.regexp_replace("s.hit", r"\s", "")).alias("instance"), F.lit(False).alias("seed"))
    edges = store(base.union(found).where("cue IS NOT NULL").groupBy("cue", "kind", "instance", "seed").agg(F.count("*").alias("n")), "graph")
    # A pattern is judged against all places where its word, cut alike, occurs in any text.
    cues = edges.where("seed").groupBy("cue", "kind").agg(F.countDistinct("instance").alias("seeds"), F.sum("n").alias("hits")).where(F.col("seeds") >= seeds)
    cues = store(cues, "seeded")
    cues = store(cues.join(_occurrences(texts, cues.select("cue").distinct()), "cue"), "cues")
    options = store(edges.where("NOT seed").select("cue", "instance", "n").join(cues, "cue").select("cue", "kind", "instance", "n"), "options")
    score = cues.select("cue", "kind", F.least(F.lit(1.0), F.col("hits") / F.col("occurs")).alias("score"))
    believed = None
    for _ in range(rounds):
        # An instance is believed unless all its patterns are wrong (noisy or).
        believed = options.join(score, ["cue", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("belief"))
        believed = store(believed, "beliefs")
        gain = options.join(believed, ["kind", "instance"]).groupBy("cue", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("gain"))
        score = cues.join(gain, ["cue", "kind"], "left").select("cue", "kind", F.least(F.lit(1.0), (F.col("hits") + F.coalesce("gain", F.lit(0.0))) / F.col("occurs")).alias("score"))
    good = options.join(score.where(F.col("score") >= belief), ["cue", "kind"]).join(believed.where(F.col("belief") >= belief), ["kind", "instance"])
    return good.groupBy("cue", "instance").agg(F.min_by("kind", F.struct(-F.col("belief"), F.col("kind"))).alias("kind"))


def personal_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seeds: int = SEEDS, rounds: int = ROUNDS, belief: float = BELIEF, keep_rows: bool = False) -> DataFrame:
    """One row per row of `docs`: `base` and `all` spans, arrays of (kind number, start, end), end exclusive, in code points.

    A null or empty text has no spans; repeated rows are searched each.  Rows are told apart by
    a row key (id and text hash), so null and repeated ids are fine.  With `keep_rows` all
    columns of `docs` are returned beside `_base` and `_all`; a column of such a name gets them
    under further underscores, see `fresh`.
    """
    row_key, base_name, all_name = (fresh(n, docs) for n in ("_row_key", "_base", "_all"))
    rows = docs.withColumn(row_key, F.xxhash64(F.col(id_column).cast("string"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))))
    plain = rows.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.col(row_key).alias("row_key"))
    spans = _located(base_spans(plain), "found", CANDIDATE, _CANDIDATE_GATE)
    clear = lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    spans = spans.withColumn("found", F.filter("found", clear))
    hits = store(spans.where("size(base) > 0 OR size(found) > 0"), "spans")
    learned = _learned(hits, plain, seeds, rounds, belief)
    more = hits.where("size(found) > 0").select("row_key", F.explode("found").alias("s")).select(
        "row_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), _cue(F.col("s.left")).alias("cue"), F.lower(F.regexp_replace("s.hit", r"\s", "")).alias("instance"))
    more = more.join(learned, ["cue", "instance"]).select("row_key", F.struct("kind", "start", "end").alias("s")).distinct().groupBy("row_key").agg(F.collect_list("s").alias("more"))
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    facts = hits.groupBy("row_key").agg(F.first("base").alias("base")).select("row_key", F.transform("base", slim).alias("base"))
    none = F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int>>)")
    facts = store(facts.join(more, "row_key", "left").select("row_key", "base", F.sort_array(F.concat("base", F.coalesce("more", none))).alias("all")), "found")
    facts = facts.select(F.col("row_key").alias(row_key), F.col("base").alias(base_name), F.col("all").alias(all_name))
    joined = (rows if keep_rows else rows.select(id_column, row_key)).join(facts, row_key, "left")
    found = [F.coalesce(F.col(c), none).alias(n) for c, n in ((base_name, base_name if keep_rows else "base"), (all_name, all_name if keep_rows else "all"))]
    return joined.select(*(docs.columns if keep_rows else [id_column]), *found)


def span_list(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined, in the order of kinds, then starts."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts per kind and the digest of the base spans, and the list of all spans."""
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_column, *[count(k) for k in range(len(KINDS))], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("all")).alias("spans"))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets; overlapping spans become the first one's.  All columns come back, whatever their names."""
    found = personal_spans(docs, id_column, text_column, keep_rows=True, **options)
    spans = fresh("_all", docs)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(text_column)
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_column, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
